"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Each source's target is its weight times a common level, but no more than `epochs` times
its words. Sources over that are clamped, what they leave is dealt to the others by weight,
and so on until none is above. A source then gives whole repetitions of all its documents
and, for the rest, documents in the order of a seeded hash until the target is reached. The
place where that order is cut is found by counts of words over ranges of the hash: two
looks at 4096 ranges a source, then a sort of the few documents in the last range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import numbered, prepare, read_documents, store

#: Hexadecimal digits of the hash in one look, and how many looks there are.
DIGITS, LOOKS = 3, 2
_HASH_DIGITS = 15


def word_count(text: Column) -> Column:
    """How many runs of anything but ASCII white space a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _order(doc_id: Column, seed: int) -> Column:
    """A 60-bit hash of the seed and the id, for the order in which a source's documents are taken."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HASH_DIGITS), 16, 10).cast("bigint")


def _bucket(h: Column, look: int) -> Column:
    """The hash's digits of looks 0 to `look`, as one number."""
    return F.shiftright(h, 4 * (_HASH_DIGITS - DIGITS * (look + 1)))


def targets(sizes: DataFrame, weights: tuple[float, ...] | dict[str | None, float], share: float, epochs: float) -> DataFrame:
    """sizes (source, source_size) with target: capped water-filling of share times all sizes.

    weights is a cycle over the sources in the order of their names by code point, null last,
    or a weight for each name (others weigh nothing). Only one row of sums a round goes to the
    driver; a round clamps at least one source more, and the level only rises.
    """
    spark = sizes.sparkSession
    if isinstance(weights, dict):
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, weight double")
        table = sizes.join(given, F.col("source").eqNullSafe(F.col("__name")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        placed = numbered(sizes, F.asc_nulls_last("source"))
        table = placed.select("source", "source_size", F.get(cycle, F.pmod(F.col("place"), F.lit(len(weights))).cast("int")).alias("weight"))
    table = store(table.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))).df
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        n, capped, rest = table.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == clamped or not rest:
            break
        level, clamped = max(level, (share * words - capped) / rest), n
    return table.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _beside(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with a table of one row a source, null being a source like others; Spark broadcasts the table where it is small."""
    return rows.join(table.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _cut(rows: DataFrame, lefts: DataFrame, look: int) -> DataFrame:
    """(source, range, left): of each source the range of this look in which `left` words from its first row on are reached, and the words left to take in that range. A source has at most 4096 ranges a look."""
    counted = rows.groupBy("source", _bucket(F.col("h"), look).alias("range")).agg(F.sum("size").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source").orderBy("range")) - F.col("c")
    met = _beside(counted.withColumn("before", before), lefts.select("source", "left"))
    return store(met.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c"))).select("source", "range", (F.col("left") - F.col("before")).alias("left"))).df


def _take(rows: DataFrame, slim: DataFrame, weights, share: float, epochs: float) -> DataFrame:
    """rows (source, size, h, …) with source_size, target, whole and extra: whole repetitions and the words of a last one. slim has rows' source, size and h and may be read often."""
    words = F.floor(F.col("target") + 0.5).cast("bigint")
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint"))
    plan = store(plan.withColumn("left", words - F.col("whole") * F.col("source_size"))).df
    cut, some = plan, slim
    for look in range(LOOKS):
        if look:
            some = _beside(slim, cut.select("source", "range")).where(_bucket(F.col("h"), look - 1) == F.col("range")).drop("range")
        cut = _cut(some, cut, look)
    plan = plan.drop("left").join(cut.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    at = _beside(rows, plan).withColumn("at", _bucket(F.col("h"), LOOKS - 1))
    clear = at.where(F.col("range").isNull() | (F.col("at") != F.col("range"))).withColumn("extra", F.when(F.col("at") < F.col("range"), F.col("size")).otherwise(F.lit(0)).cast("bigint"))
    edge = at.where(F.col("at") == F.col("range"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    edge = edge.withColumn("extra", F.least(F.greatest(F.col("left") - before, F.lit(0)), F.col("size")).cast("bigint"))
    return clear.unionByName(edge).drop("at", "range", "left")


def shares(docs: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, extra, taken): what the mix takes of each row, in words.

    A row is taken `whole` times, and its first `extra` words once more; of each source at
    most one row is taken in part that last time, so a source's taken words are its target,
    rounded. Whether and how often a row is taken depends on its source's sizes and weights,
    the seed and its doc_id alone. Null or empty texts have no words and give none; a null
    source is a source, the last one; long texts count whole. Rows of one doc_id follow one
    another in the order, shorter ones first, equal rows are interchangeable. An empty table
    gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(F.col("doc_id"), seed).alias("h"))).df
    taken = _take(slim, slim.select("source", "size", "h"), weights, share, epochs)
    return taken.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: docs' columns and `repetition`, a row for each time that a document is taken; see shares.

    Where only a part of a text is taken, its words are joined by single blanks. Rows
    without words are never taken. A column repetition of docs is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("repetition")
    made = docs.select(F.struct(*docs.columns).alias("row"), "source", word_count(F.col("text")).alias("size"), _order(F.col("doc_id"), seed).alias("h"))
    slim = store(made.select("source", "size", "h")).df
    taken = _take(made, slim, weights, share, epochs).where("size > 0")
    times = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    rows = taken.where(times > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    part = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)")), 1, F.col("extra").cast("int")), " ")
    text = F.when((F.col("repetition") > F.col("whole")) & (F.col("extra") < F.col("size")), part).otherwise(F.col("row.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "repetition")


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    return shares(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


# The common level is the greatest that clamping the first k sources by cap over weight gives, over all k.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sizes
), steps AS (
  SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(cap, weight * (SELECT greatest(0, max(level)) FROM steps)) AS target FROM weighed
), plan AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole
  FROM goals
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken FROM placed
"""
