"""Line dedup: lines that several documents share stay only in the first of them.

Normalised lines are exploded to 128-bit hashes, distinct documents are counted for each
hash with partial aggregates, and what falls goes back to its document, whose remaining
lines are joined in their order. Line texts are never shuffled, whole texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import binary, prepare, read_documents, store

_WHITE = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10


def _digest(line: bytes) -> bytes | None:
    """128-bit hash of a line's key, or None if the key has fewer than MIN_POINTS code points."""
    key = line.strip(_WHITE).lower()
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(binary(batch.column(1))):
            own = {d for line in text.split(b"\n") if (d := _digest(line))}
            rows += [i] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], names=["doc_id", "h"])


def _dropper(names: list[str], at: int, drops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, fell = [], [], []
            for text, gone in zip(binary(batch.column(at)), batch.column(drops).to_pylist(), strict=True):
                own = text.split(b"\n")
                gone = set(gone or ())
                kept = [x for x in own if _digest(x) not in gone] if gone else own
                texts.append(b"\n".join(kept))
                lines.append(len(own))
                fell.append(len(own) - len(kept))
            columns = [c for i, c in enumerate(batch.columns) if i != drops]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(fell, pa.int64())], names=names)

    return run


def line_dedup(docs: DataFrame, lines_as: str = "n_lines", dropped_as: str = "n_dropped") -> DataFrame:
    """docs with shared lines taken out of `text`, and two counts: lines before, lines dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of
    10 code points or more that two different doc_ids hold stays in the smallest of them and
    goes elsewhere, each occurrence. A null or empty text is one empty line. Rows without an
    id count as one document that comes after all others. Repeated rows are treated alike
    and stay repeated. Other columns pass through; an empty table stays empty. Columns
    named like the counts are replaced, unless other names are given for these.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(lines_as, dropped_as)
    at = docs.columns.index("text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = store(docs.select("doc_id", "text").mapInArrow(_hashes, f"doc_id {id_type}, h binary")).df
    keys = held.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("without"))
    shared = store(keys.where((F.col("keeper") != F.col("last")) | (F.col("without") & F.col("keeper").isNotNull())).select("h", "keeper")).df  # written, so that Spark can split a hot line's join
    falls = held.join(shared, "h").where("doc_id is null or doc_id <> keeper").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("__drops"))
    joined = docs.join(falls, docs["doc_id"].eqNullSafe(falls["__id"]), "left").select(*[docs[c] for c in docs.columns], falls["__drops"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{lines_as}` bigint, `{dropped_as}` bigint"
    return joined.mapInArrow(_dropper([*docs.columns, lines_as, dropped_as], at, len(docs.columns)), schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
