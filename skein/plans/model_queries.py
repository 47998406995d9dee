"""Queries through the boundary to outside models: stand-ins that follow rules SQL can state take the models' place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import tags as T
from skein.plans import proxies as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _boxes(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a detector: as many boxes as the image's number has left over four, likelier ones first; multiples of 97 can't be read."""
    n = batch["image"].astype(int)
    if (n % 97 == 0).any():
        raise ValueError("unreadable")
    count = n % 4
    return pd.DataFrame({
        "image": batch["image"], "prompt": batch["prompt"],
        "boxes": [[[0.0, 0.0, i + 1.0, (x % 7) + 1.0] for i in range(c)] for x, c in zip(n, count, strict=True)],
        "scores": [[1.0 / (i + 2) for i in range(c)] for c in count], "labels": [[p] * c for p, c in zip(batch["prompt"], count, strict=True)],
    })


def x02_detect(spark, sf_dir: str) -> DataFrame:
    """A detector over all parts: what it finds for each image, a row for each box, and one for each image without boxes or with an error."""
    p = P.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image"), F.element_at(F.split("p_name", " "), -1).alias("prompt"))
    found = T.apply_model(p, _boxes, T.MODEL_SCHEMAS["detector"], batch_rows=16)
    each = found.select("image", "prompt", "error", F.explode_outer(F.arrays_zip("boxes", "scores", "labels")).alias("b"))
    area = (F.col("b.boxes")[2] - F.col("b.boxes")[0]) * (F.col("b.boxes")[3] - F.col("b.boxes")[1])
    return each.select("image", "prompt", F.col("b.labels").alias("label"), area.alias("area"), F.round("b.scores", 6).alias("score"), "error")


QUERIES["x02_detect"] = x02_detect
SQL["x02_detect"] = """WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS image, string_split(p_name,' ')[-1] AS prompt FROM part),
b AS (SELECT k, unnest(range(k % 4)) AS i FROM p WHERE k % 97 <> 0)
SELECT image, prompt, CASE WHEN i IS NOT NULL THEN prompt END AS label, ((i + 1) * (k % 7 + 1))::DOUBLE AS area, round(1.0::DOUBLE / (i + 2), 6) AS score,
 CASE WHEN k % 97 = 0 THEN 'ValueError: unreadable' END AS error FROM p LEFT JOIN b USING (k)"""


def _masks(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a segmenter: a box's mask has a byte for each unit of its area; it refuses to be asked about no boxes."""
    if (batch["boxes"].map(len) == 0).any():
        raise ValueError("no boxes")
    area = lambda b: int((b[2] - b[0]) * (b[3] - b[1]))
    return pd.DataFrame({"image": batch["image"], "masks": [[bytes(area(b)) for b in x] for x in batch["boxes"]], "scores": [[0.5] * len(x) for x in batch["boxes"]]})


def x03_segment(spark, sf_dir: str) -> DataFrame:
    """A segmenter over the boxes of all parts: one mask for each box, none for images without boxes, which it is never asked about."""
    k = F.col("p_partkey")
    boxes = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.array(F.lit(0.0), F.lit(0.0), i + F.lit(1.0), (k % 7) + F.lit(1.0)))
    rows = P.read(spark, sf_dir, "part").select(k.cast("string").alias("image"), F.slice(boxes, 1, (k % 4).cast("int")).alias("boxes"))
    made = T.segment(rows, _masks)
    area = F.aggregate("masks", F.lit(0), lambda n, m: n + F.octet_length(m))
    return made.select("image", F.size("masks").cast("bigint").alias("masks"), area.cast("bigint").alias("area"), F.size("scores").cast("bigint").alias("scores"), "error")


QUERIES["x03_segment"] = x03_segment
SQL["x03_segment"] = """SELECT p_partkey::VARCHAR AS image, p_partkey % 4 AS masks, (p_partkey % 4 * (p_partkey % 4 + 1) // 2 * (p_partkey % 7 + 1))::BIGINT AS area, p_partkey % 4 AS scores, NULL::VARCHAR AS error FROM part"""


def _classes(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a classifier of tags: short words are attributes, it gives a reason, and names some rows as errors of its own."""
    short = batch["tag"].str.len() < 5
    return pd.DataFrame({
        "tag": batch["tag"], "category": short.map({True: "attribute", False: "physical_object"}), "keep": ~short, "reason": "letters: " + batch["tag"].str.len().astype(str),
        "error": [("refused" if t.startswith("s") else None) for t in batch["tag"]],
    })


def x04_classify(spark, sf_dir: str) -> DataFrame:
    """A tag classifier over the different words of part names, asked for 20 tags a call; what it refuses stays with its own error."""
    words = P.read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    return T.apply_model(words, _classes, T.MODEL_SCHEMAS["classifier"], batch_rows=20)


QUERIES["x04_classify"] = x04_classify
SQL["x04_classify"] = """WITH w AS (SELECT DISTINCT unnest(string_split(p_name,' ')) AS tag FROM part)
SELECT tag, CASE WHEN length(tag) < 5 THEN 'attribute' ELSE 'physical_object' END AS category, length(tag) >= 5 AS keep, 'letters: ' || length(tag) AS reason, CASE WHEN tag LIKE 's%' THEN 'refused' END AS error FROM w"""


def _relations(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a grouper: it answers the other way round and in another order, skips pairs of one length, and adds pairs nobody asked for."""
    if len(batch) > T.PAIRS_A_CALL:
        raise ValueError("too many pairs")
    a, b = batch["label_a"].str.len(), batch["label_b"].str.len()
    said = pd.DataFrame({"label_a": batch["label_b"], "label_b": batch["label_a"], "relation": (a < b).map({True: "parent_child", False: "different"}), "similarity": 1.0 / (1.0 + (a - b).abs())})[a != b]
    more = pd.DataFrame({"label_a": ["?"], "label_b": ["!"], "relation": ["different"], "similarity": [0.0]})
    return pd.concat([said.iloc[::-1], more])


def x05_ask_pairs(spark, sf_dir: str) -> DataFrame:
    """A grouping model asked about all pairs of part names with one last word, each pair given twice, 80 pairs a call at most."""
    named = P.read(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.element_at(F.split("p_name", " "), -1).alias("group")).distinct()
    pairs = T.pairs_of_groups(named).select("label_a", "label_b")
    both = pairs.unionByName(pairs.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b")))
    return T.ask_pairs(both, _relations).withColumn("similarity", F.round("similarity", 6))


QUERIES["x05_ask_pairs"] = x05_ask_pairs
SQL["x05_ask_pairs"] = """WITH l AS (SELECT DISTINCT p_name AS label, string_split(p_name,' ')[-1] AS g FROM part)
SELECT a.label AS label_a, b.label AS label_b, CASE WHEN length(a.label) < length(b.label) THEN 'parent_child' WHEN length(a.label) > length(b.label) THEN 'different' END AS relation,
 CASE WHEN length(a.label) <> length(b.label) THEN round(1.0::DOUBLE / (1 + abs(length(a.label) - length(b.label))), 6) END AS similarity, CASE WHEN length(a.label) = length(b.label) THEN 'no reply' END AS error
FROM l a JOIN l b ON a.g = b.g AND a.label < b.label"""
