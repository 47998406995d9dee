"""Quality: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of a document; each has a weight for every byte value
at each of its places. Responses are max-pooled in chunks that cover the whole document,
each of them overlapping the next by half, and the chunks' rectified maxima go by their mean
and their maximum into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import binary, crc_fold, prepare, read_documents, text_bytes
from skein.llm.learn import labelled_sample

#: The model is fitted on at most this many documents of each class, and this many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 60_000_000
WIDTH, STRIDE, FILTERS, CHUNK = 6, 2, 16, 96
STEPS, BATCH, RATE, SEED = 500, 64, 0.02, 5
THRESHOLD = 0.7
#: Bytes of text taken through the filters at once.
GROUP_BYTES = 1_000_000


@dataclass
class Network:
    """kernel (WIDTH, 256, FILTERS): a weight for each byte value at each place; out: weights of means, then maxima."""

    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts parted by WIDTH zeros, and where each begins."""
    data, off = text_bytes([t + b"\0" * WIDTH for t in texts])
    return data.astype(np.int32), off


def _chunks(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts; the first window of each half chunk; each chunk's first and second half, and its text.

    A chunk is two halves in a row, and the next one begins with its second half. Every text
    has a window at least; one of a single half is one chunk, whose halves are the same.
    """
    windows = np.maximum(1, -(-(np.diff(off) - WIDTH) // STRIDE))
    first = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(windows)), windows)
    at = off[text] + (np.arange(first[-1]) - first[text]) * STRIDE
    n = -(-windows // (CHUNK // 2))
    own = np.repeat(np.arange(len(windows)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = first[own] + place * (CHUNK // 2)
    one = np.flatnonzero((place < n[own] - 1) | (n[own] == 1))
    return at, begin, one, one + (n[own[one]] > 1), own[one]


def _respond(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = net.kernel[0][data[at]]
    for j in range(1, WIDTH):
        total += net.kernel[j][data[at + j]]
    return total


def _pool(values: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over each text's chunks."""
    first = np.searchsorted(own, np.arange(n))
    count = np.bincount(own, minlength=n)[:, None]
    return np.add.reduceat(values, first, axis=0) / count, np.maximum.reduceat(values, first, axis=0)


def probability(net: Network, texts: list[bytes]) -> np.ndarray:
    out, at = [np.zeros(0)], 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= GROUP_BYTES):
            some.append(texts[at])
            size += len(texts[at])
            at += 1
        data, off = padded(some)
        place, begin, one, two, own = _chunks(off)
        half = np.maximum.reduceat(_respond(net, data, place), begin, axis=0)
        peak = np.maximum(np.maximum(half[one], half[two]) + net.shift, 0)
        mean, top = _pool(peak, own, len(some))
        out.append(1 / (1 + np.exp(-np.clip(np.hstack([mean, top]) @ net.out + net.bias, -30, 30))))
    return np.concatenate(out)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value, grad):
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * grad**2
        return value - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


def fit(texts: list[bytes], labels: list[int]) -> Network:
    """Adam on the log loss of class-balanced batches; no texts of one class: a constant probability."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, dtype=np.float32)
    net = Network(rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.bias = float(np.log(prior / (1 - prior)))
        return net
    adam = _Adam(RATE)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    cached = {}
    for step in range(STEPS):
        rows = np.concatenate([rng.choice(good, BATCH // 2), rng.choice(bad, BATCH // 2)])
        for r in rows:
            if r not in cached:
                cached[r] = padded([texts[r]])[0]
        data = np.concatenate([cached[r] for r in rows])
        off = np.concatenate([[0], np.cumsum([len(cached[r]) for r in rows])])
        place, begin, one, two, own = _chunks(off)
        value = _respond(net, data, place)
        half = np.maximum.reduceat(value, begin, axis=0)
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(place))))
        # the first window that reaches its half's maximum, for each filter, and that of the chunk
        where = np.where(value >= half[of], np.arange(len(place))[:, None], len(place))
        where = np.minimum.reduceat(where, begin, axis=0)
        peak = np.maximum(half[one], half[two])
        where = np.where(half[one] >= half[two], where[one], where[two])
        live = peak + net.shift > 0
        h = np.where(live, peak + net.shift, 0)
        mean, top = _pool(h, own, len(rows))
        x = np.hstack([mean, top])
        p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.bias, -30, 30)))
        miss = (p - y[rows]) / len(rows)
        g_x = miss[:, None] * net.out
        count = np.bincount(own, minlength=len(rows))[own][:, None]
        g_h = g_x[own, :FILTERS] / count + g_x[own, FILTERS:] * (h >= top[own]) * (h > 0)
        g_h = np.where(live, g_h, 0)
        g_kernel = np.zeros_like(net.kernel)
        c, f = np.nonzero(g_h)
        for j in range(WIDTH):
            g_kernel[j] = np.bincount(data[place[where[c, f]] + j] * FILTERS + f, weights=g_h[c, f], minlength=256 * FILTERS).reshape(256, FILTERS)
        adam.t = step + 1
        net.kernel = adam.step("kernel", net.kernel, g_kernel + 1e-6 * net.kernel).astype(np.float32)
        net.shift = adam.step("shift", net.shift, g_h.sum(axis=0)).astype(np.float32)
        net.out = adam.step("out", net.out, x.T @ miss + 1e-4 * net.out).astype(np.float32)
        net.bias = float(adam.step("bias", net.bias, miss.sum()))

    return net


def score_documents(docs: DataFrame, net: Network, score_as: str = "score") -> DataFrame:
    """docs with the probability of quality for each row's whole text; null texts count as empty.

    Long texts are pooled whole, a chunk at a time. Repeated rows score alike and stay; the
    score depends on the text alone. Other columns pass through; one named like the score
    is replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(score_as)
    shared = spark.sparkContext.broadcast(net)  # 100 kB by WIDTH and FILTERS
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(shared.value, binary(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, score_as])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score_as}` double"
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not 2; see labelled_sample for nulls, repeats and long texts. Without labels, or with one class only, all scores are one constant."""
    prepare(docs.sparkSession)
    return fit(*labelled_sample(docs, labels, "quality", crc_fold(F.col("doc_id"), 4) != 2, SAMPLE_ROWS, SAMPLE_BYTES))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
