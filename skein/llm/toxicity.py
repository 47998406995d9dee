"""Toxicity: a factorization machine over hashed terms.

Terms are words (runs of letters) and their beginnings, hashed to buckets; a document holds
a bucket or it doesn't. Linear weights and k-dimensional factors are learned together, so
that two terms which mean little alone can mean much together, such as an insult with the
mention of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER, binary, crc_fold, hash_spans, prepare, read_documents, runs, text_bytes
from skein.llm.learn import labelled_sample

#: The model is fitted on at most this many documents of each class, and this many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 100_000_000
BUCKET_BITS, TERMS, FACTORS, MIN_SEEN = 20, 2048, 4, 4
STARTS = (4, 5, 7)
STEPS, BATCH, RATE, DECAY, SEED = 2500, 64, 0.1, 1e-4, 11
THRESHOLD = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[128:] = True


@dataclass
class Model:
    """slot: bucket -> row of the weights, or -1. Its size is fixed by BUCKET_BITS and TERMS."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every term occurrence."""
    data, off = text_bytes(texts)
    data = LOWER[data]
    start, end = runs(_LETTER[data], off)
    own = np.searchsorted(off, start, side="right") - 1
    doc, found = [own], [hash_spans(data, start, end)]
    for n in STARTS:
        long = end - start > n
        doc.append(own[long])
        found.append(hash_spans(data, start[long], start[long] + n, seed=n))
    return np.concatenate(doc), (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(doc, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def _margin(model: Model, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """bias + sum of weights + half of (square of sums less sum of squares) of the factors."""
    v = model.factors[slot]
    pair = 0.5 * (_sums(v, doc, n) ** 2 - _sums(v * v, doc, n)).sum(axis=1)
    return model.bias + np.bincount(doc, weights=model.linear[slot], minlength=n) + pair


def _present(doc: np.ndarray, bucket: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each known term of a document once."""
    s = slot[bucket]
    hit = s >= 0
    both = np.unique(doc[hit] * len(slot) + s[hit])
    return both // len(slot), both % len(slot)


def probability(model: Model, texts: list[bytes]) -> np.ndarray:
    doc, slot = _present(*buckets(texts), model.slot)
    return 1 / (1 + np.exp(-np.clip(_margin(model, doc, slot, len(texts)), -30, 30)))


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Adagrad on the log loss, with both classes alike in each batch; terms are those most unevenly spread over the classes. No texts: 0.5 for all."""
    y, n = np.array(labels, dtype=float), len(texts)
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    if not n or y.min() == y.max():
        prior = (y.sum() + 1) / (n + 2)
        return Model(slot, float(np.log(prior / (1 - prior))), np.zeros(1), np.zeros((1, FACTORS)))
    # a few documents at a time, each term once: what is held follows the different terms
    both = np.concatenate([np.unique((d + at) * (1 << BUCKET_BITS) + b) for at in range(0, n, 64) for d, b in [buckets(texts[at : at + 64])]])
    doc, bucket = both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)
    seen = np.bincount(bucket, minlength=len(slot))
    bad = np.bincount(bucket, weights=y[doc], minlength=len(slot))
    rate = (bad + 0.5) / (y.sum() + 1) - (seen - bad + 0.5) / (n - y.sum() + 1)
    score = np.abs(rate) / np.sqrt((seen + 1) / n)
    score[seen < MIN_SEEN] = 0
    best = np.argsort(-score, kind="stable")[:TERMS]
    best = best[score[best] > 0]
    slot[best] = np.arange(len(best))
    rng = np.random.default_rng(SEED)
    model = Model(slot, 0.0, np.zeros(max(1, len(best))), rng.normal(0, 0.01, (max(1, len(best)), FACTORS)))
    doc, term = _present(doc, bucket, slot)
    first = np.searchsorted(doc, np.arange(n + 1))
    g_bias, g_linear, g_factors = 1e-6, np.full_like(model.linear, 1e-6), np.full_like(model.factors, 1e-6)
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    for _ in range(STEPS):
        rows = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        size = first[rows + 1] - first[rows]
        d = np.repeat(np.arange(len(rows)), size)
        t = term[np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        v = model.factors[t]
        total = _sums(v, d, len(rows))
        miss = 1 / (1 + np.exp(-np.clip(_margin(model, d, t, len(rows)), -30, 30))) - y[rows]
        step = miss.mean()
        g_bias += step**2
        model.bias -= RATE * step / np.sqrt(g_bias)
        back = miss[d] / len(rows)
        grad = np.bincount(t, weights=back, minlength=len(model.linear)) + DECAY * model.linear
        g_linear += grad**2
        model.linear -= RATE * grad / np.sqrt(g_linear)
        grad = _sums(back[:, None] * (total[d] - v), t, len(model.linear)) + DECAY * model.factors
        g_factors += grad**2
        model.factors -= 0.3 * RATE * grad / np.sqrt(g_factors)
    return model


def score_documents(docs: DataFrame, model: Model, score_as: str = "score") -> DataFrame:
    """docs with a probability of toxicity for each row's whole text; null texts count as empty.

    Only term presence counts, so repeated text changes nothing; long texts count whole.
    Repeated rows score alike and stay; the score depends on the text alone, so ties are
    equal scores. Other columns pass through; one named like the score is replaced. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(score_as)
    shared = spark.sparkContext.broadcast(model)  # about 4 MB by BUCKET_BITS, TERMS and FACTORS, whatever the input
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(shared.value, binary(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, score_as])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score_as}` double"
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; see labelled_sample for nulls, repeats and long texts. Without labels, or with one class only, all scores are one constant."""
    prepare(docs.sparkSession)
    return fit(*labelled_sample(docs, labels, "toxic", crc_fold(F.col("doc_id"), 5) != 0, SAMPLE_ROWS, SAMPLE_BYTES))


def read_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, train(docs, read_labels(spark, sf_dir)))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
