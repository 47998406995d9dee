"""Views of the driver's tables that stand for objects, points, detections, observations and tasks; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels that stand for the embeddings' ten classes.
OBJECT_LABELS = ("chair", "office chair", "table", "coffee table", "sofa", "couch", "lamp", "desk", "monitor", "plant")
# Known relations between two labels, their similarity and what merging makes of them.
LABEL_PAIRS = (
    ("couch", "sofa", "same_object_alias", 0.95, "allow"),
    ("chair", "office chair", "parent_child", 0.65, "cautious"),
    ("coffee table", "table", "parent_child", 0.65, "cautious"),
    ("desk", "table", "near_synonym", 0.85, "allow"),
    ("desk", "monitor", "related_but_distinct", 0.35, "hold"),
)

_LABELS_SQL = "[" + ",".join(f"'{x}'" for x in OBJECT_LABELS) + "]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box and label for each embedding: centre from its first three numbers, half sizes from the next three."""
    e = read(spark, sf_dir, "embeddings")
    c = [F.col("embedding")[i].cast("double") for i in range(3)]
    h = [F.abs(F.col("embedding")[i].cast("double")) for i in range(3, 6)]
    frames = (1 + F.col("vec_id") % 12).cast("bigint")
    seen = (frames + F.col("vec_id") % 7).cast("bigint")
    box = [x for a, m, r in zip("xyz", c, h, strict=True) for x in ((m - r).alias(f"{a}0"), (m + r).alias(f"{a}1"))]
    label = F.element_at(F.array(*[F.lit(x) for x in OBJECT_LABELS]), F.col("label") + 1)
    return e.select(
        F.col("vec_id").alias("id"), label.alias("label"), *[x.alias(f"c{a}") for a, x in zip("xyz", c, strict=True)], *box,
        frames.alias("frames"), seen.alias("seen"), (100 + F.col("vec_id") * 37 % 3000).cast("bigint").alias("points"),
        F.when((frames >= 2) | (seen >= 3), "confirmed").otherwise("candidate").alias("status"),
        (F.lit(0.2) + (F.col("vec_id") % 8) * 0.1).alias("box_score"),
    )


V_OBJECT = f"""v_object AS (
  SELECT vec_id AS id, {_LABELS_SQL}[label + 1] AS label,
    embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, embedding[3]::DOUBLE AS cz,
    embedding[1]::DOUBLE - abs(embedding[4]::DOUBLE) AS x0, embedding[1]::DOUBLE + abs(embedding[4]::DOUBLE) AS x1,
    embedding[2]::DOUBLE - abs(embedding[5]::DOUBLE) AS y0, embedding[2]::DOUBLE + abs(embedding[5]::DOUBLE) AS y1,
    embedding[3]::DOUBLE - abs(embedding[6]::DOUBLE) AS z0, embedding[3]::DOUBLE + abs(embedding[6]::DOUBLE) AS z1,
    (1 + vec_id % 12)::BIGINT AS frames, (1 + vec_id % 12 + vec_id % 7)::BIGINT AS seen, (100 + vec_id * 37 % 3000)::BIGINT AS points,
    CASE WHEN 1 + vec_id % 12 >= 2 OR 1 + vec_id % 12 + vec_id % 7 >= 3 THEN 'confirmed' ELSE 'candidate' END AS status,
    0.2::DOUBLE + (vec_id % 8)::DOUBLE * 0.1::DOUBLE AS box_score
  FROM embeddings)"""


def gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


V_GAUSS = "v_gauss AS (SELECT vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
V_OBJECT_POINT = """v_object_point AS (
  SELECT o.id, g.point FROM v_object o JOIN v_gauss g
  ON g.x BETWEEN o.x0 AND o.x1 AND g.y BETWEEN o.y0 AND o.y1 AND g.z BETWEEN o.z0 AND o.z1)"""


def label_pairs(spark: SparkSession) -> DataFrame:
    """The known label relations, a table of fixed size, keyed by both labels in order."""
    rows = [(min(a, b), max(a, b), r, s, p) for a, b, r, s, p in LABEL_PAIRS]
    return spark.createDataFrame(rows, "label_a string, label_b string, semantic string, similarity double, policy string")


#: The two labels of each known relation.
RELATED_LABELS = [(a, b) for a, b, *_ in LABEL_PAIRS]
V_LABEL_PAIR = (
    "v_label_pair AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{min(a, b)}','{max(a, b)}','{r}',{s}::DOUBLE,'{p}')" for a, b, r, s, p in LABEL_PAIRS)
    + ") t(label_a, label_b, semantic, similarity, policy))"
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections: frame, prompt, scores, area, and a number that settles ties."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("frame"), F.col("l_returnflag").alias("prompt"), F.col("l_extendedprice").alias("box_score"),
        (1 - 5 * F.col("l_discount")).alias("mask_score"), (0.6 * F.col("l_quantity") / 50).alias("area"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("tie"), "l_orderkey", "l_linenumber", "l_partkey",
    )


V_DETECTION = """v_detection AS (
  SELECT l_suppkey AS frame, l_returnflag AS prompt, l_extendedprice AS box_score, 1 - 5 * l_discount AS mask_score, 0.6::DOUBLE * l_quantity / 50 AS area,
         l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: hours since the start as frames, the event type as label, places from user and k."""
    return event_observations(read(spark, sf_dir, "events"))


def event_observations(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200) / 3600).cast("bigint")
    return e.select(
        F.col("event_id").alias("obs"), frame.alias("frame"), F.col("event_type").alias("label"), F.col("user_id").alias("user"), k.alias("k"), "value",
        (F.col("user_id") * 0.1).alias("cx"), (k * 0.05).alias("cy"), (F.col("value") * 0.01).alias("cz"),
    )


V_OBS = """v_obs AS (
  SELECT event_id AS obs, floor((epoch_us(ts) / 1000000 - 1704067200) / 3600)::BIGINT AS frame, event_type AS label, user_id AS user,
         json_extract(props, '$.k')::INT AS k, value,
         user_id::DOUBLE * 0.1::DOUBLE AS cx, json_extract(props, '$.k')::INT::DOUBLE * 0.05::DOUBLE AS cy, value * 0.01::DOUBLE AS cz FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queue tasks, each in one of the four states."""
    o = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("done")
    return o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("frame"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("ts"))


V_TASK = """v_task AS (
  SELECT o_orderkey AS task, o_custkey AS frame, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing'
         WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'done' END AS state, o_orderdate AS ts FROM orders)"""


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views)
