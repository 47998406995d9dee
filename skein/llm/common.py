"""Helpers that the corpus operators share: scratch tables, vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.ship import ship
from skein.sources.scratch import Stored, store  # noqa: F401  the operators take them from here

#: Texts go to Python in batches of this many rows, which keeps a worker's memory small even where texts are long.
BATCH_ROWS = 512
#: And of about this many bytes, where Spark heeds it.
BATCH_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches and runtime re-planning."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def numbered(df: DataFrame, *order: Column, as_: str = "place") -> DataFrame:
    """df, written, with a running number from 0 over all rows in order: rows are dealt by ranges, sorted there, and take their place after the sizes of the ranges before, a table of one row a range."""
    rows = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    own = F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.df.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count("*").alias("__c"))
    before = sizes.select("__range", (F.sum("__c").over(Window.orderBy("__range")) - F.col("__c")).alias("__before"))
    placed = rows.df.withColumn("__range", F.shiftright("__at", 33)).join(F.broadcast(before), "__range")
    return placed.withColumn(as_, F.col("__before") + own).drop("__range", "__before", "__at")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def binary(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, and the n + 1 offsets."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), off


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross the offsets."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = flag.copy()
    begin[1:] &= ~flag[:-1]
    inner = off[:-1][off[:-1] < len(flag)]
    begin[inner] = flag[inner]
    stop = flag.copy()
    stop[:-1] &= ~flag[1:]
    last = off[1:][off[1:] > 0] - 1
    stop[last] = flag[last]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step, all spans at once."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    h = mix(size.astype(np.uint64) * _K1 + np.uint64(seed))
    live, at = np.arange(len(size)), 0
    while True:
        live = live[size[live] > at]
        if not len(live):
            return h
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        lane = words[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
        h[live] = mix((h[live] ^ lane) * _K1 + np.uint64(at))
        at += 8


def space_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and each word's text index, for words split at ASCII white space."""
    data, off = text_bytes(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], off)
    return data, starts, ends, np.searchsorted(off, starts, side="right") - 1
