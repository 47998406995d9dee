"""Bounded samples of labelled documents for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, rows: int, text_bytes: int) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of at most `rows` documents of each class, text_bytes in all.

    The rows with the least hashes of the doc_id are taken, so a sample doesn't depend on
    partitions. Only ids are sorted; texts are fetched for the ids chosen, a bounded set.
    Rows without an id or label are left out, and texts beyond text_bytes. Where an id
    repeats, its greater label and its least text count. Empty tables give empty lists; a
    null text is an empty one; long texts count whole.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).where(wanted)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id", F.lit(17)), "doc_id"]
    chosen = known.where("y = 1").orderBy(*order).limit(rows).unionByName(known.where("y = 0").orderBy(*order).limit(rows))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    texts: list[bytes] = []
    ys: list[int] = []
    for row in found.orderBy(*order).toLocalIterator():  # at most 2 * rows rows, one partition at a time
        text = (row.text or "").encode()
        if len(text) <= text_bytes:
            text_bytes -= len(text)
            texts.append(text)
            ys.append(row.y)
    return texts, ys
