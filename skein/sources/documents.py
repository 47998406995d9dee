"""JSON documents, CSV pair tables, prompt files and caches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas
from skein.functions import labels as L

# Measures of a pair table, which its CSV has as text.
PAIR_MEASURES = ("center_distance", "bbox_iou", "bbox_intersection_over_smaller", "bbox_smaller_over_larger", "point_intersection_over_smaller", "point_iou", "bbox_volume_a", "bbox_volume_b")
PAIR_COUNTS = ("point_intersection_count", "support_frames_a", "support_frames_b", "observations_a", "observations_b")
PAIR_NAMES = ("relation", "reason", "object_id_a", "label_a", "object_id_b", "label_b")


def read_document_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The rows of JSON documents of a format, one document a file; documents of another format give none."""
    field, schema = schemas.rows_field(tag), schemas.row_schema(tag)
    if not field:
        return spark.read.schema(schema).option("multiLine", True).json(path).where(F.col("format") == tag)
    whole = T.StructType().add("format", T.StringType()).add(field, T.ArrayType(schema))
    docs = spark.read.schema(whole).option("multiLine", True).json(path).where(F.col("format") == tag)
    return docs.select(F.explode(field).alias("r")).select("r.*")


def write_document(rows: DataFrame, path: str, tag: str) -> None:
    """One JSON document of a format with all rows, in their order, a line each: one task writes them as they come, and nothing holds them all."""
    field = schemas.rows_field(tag)
    head = json.dumps({"format": tag})[:-1] + f', "{field}": ['

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        comma = ""
        for batch in batches:
            lines = batch.column(0).to_pylist()
            for i, line in enumerate(lines):
                lines[i], comma = comma + line, ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    each = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), F.monotonically_increasing_id().alias("o"))
    one = each.repartition(1).sortWithinPartitions("o").select("j")
    one.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A pair table from CSV: everything is text there, what isn't a number becomes null, and undefined figures 0."""
    names = [*PAIR_NAMES, *PAIR_MEASURES, *PAIR_COUNTS]
    raw = spark.read.option("header", True).schema(", ".join(f"{n} STRING" for n in names)).option("enforceSchema", False).csv(path)
    number = lambda n: F.col(n).try_cast("double")
    figure = lambda n: F.when(F.isnan(number(n)) | (F.abs(number(n)) == float("inf")), 0.0).otherwise(number(n)).alias(n)
    return raw.select(*PAIR_NAMES, *[figure(n) for n in PAIR_MEASURES], *[F.col(n).try_cast("bigint").alias(n) for n in PAIR_COUNTS])


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    """Chosen columns as CSV with a header; arrays, structs and maps as JSON."""
    cell = lambda c: F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c)
    df.select(*[cell(c) for c in (columns or df.columns)]).write.mode("overwrite").option("header", True).csv(path)


def directed_similarity(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, similarity) both ways, from a document of pairs: {"pairs": {"a|b": s}}, {"a|b": s}, or a list with label names of several spellings."""
    text = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    flat = F.coalesce(F.try_variant_get("v", "$.pairs", "map<string,double>"), F.try_variant_get("v", "$", "map<string,double>"))
    keyed = text.select(F.explode(flat).alias("key", "s")).select(F.split("key", r"\|")[0].alias("a"), F.split("key", r"\|")[1].alias("b"), "s")
    items = text.select(F.explode(F.coalesce(F.try_variant_get("v", "$.pairs", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("i"))
    name = lambda *keys: F.coalesce(*[F.try_variant_get("i", f"$.{k}", "string") for k in keys])
    listed = items.select(name("a", "left", "label_a").alias("a"), name("b", "right", "label_b").alias("b"), F.coalesce(F.try_variant_get("i", "$.similarity", "double"), F.try_variant_get("i", "$.score", "double")).alias("s"))
    one = keyed.unionByName(listed).where("a is not null and b is not null and s is not null").select(L.collapsed(F.col("a")).alias("a"), L.collapsed(F.col("b")).alias("b"), F.col("s").alias("similarity"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).distinct()


def undirected_similarity(items: DataFrame) -> DataFrame:
    """items (ord, label_a, label_b, …) keyed by both labels in order; blank and equal labels are left out, the last of repeats counts."""
    a, b = L.plain(F.col("label_a")), L.plain(F.col("label_b"))
    kept = items.withColumn("a", a).withColumn("b", b).where("a <> '' and b <> '' and a <> b")
    rest = [c for c in items.columns if c not in ("label_a", "label_b", "ord")]
    last = kept.groupBy(F.least("a", "b").alias("label_a"), F.greatest("a", "b").alias("label_b")).agg(F.max_by(F.struct(*rest), "ord").alias("r"))
    return last.select("label_a", "label_b", "r.*")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(frame_stem, prompt): prompts from JSON or delimited text files. A file's frames have their own; prompts without a frame have a null stem."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("t"), F.try_parse_json("value").alias("v"))
    listed = lambda c: F.coalesce(*[F.try_variant_get(c, f"$.{k}", "array<string>") for k in ("prompts", "object_prompts", "tags", "labels")])
    named = lambda c: F.coalesce(*[L.split_tags(F.try_variant_get(c, f"$.{k}", "string")) for k in ("prompts", "tags", "label")])
    each = text.select(F.col("t"), F.col("v"), F.explode_outer(F.try_variant_get("v", "$.results", "array<variant>")).alias("r"))
    source = F.coalesce(F.col("r"), F.col("v"))
    prompts = F.coalesce(listed(source), named(source), F.try_variant_get("v", "$", "array<string>"), F.when(F.col("v").isNull(), L.split_tags(F.col("t"))))
    found = each.select(F.try_variant_get(source, "$.frame_stem", "string").alias("frame_stem"), F.posexplode(prompts).alias("ord", "p"))
    return found.select("frame_stem", L.without_article(F.col("p")).alias("prompt")).where("prompt <> ''").distinct()


def prompts_of(frames: DataFrame, prompts: DataFrame) -> DataFrame:
    """(frame_stem, prompt): a frame's own prompts if it has any, else those of all."""
    own = frames.join(prompts.where("frame_stem is not null"), "frame_stem")
    without = frames.join(own.select("frame_stem").distinct(), "frame_stem", "left_anti")
    return own.select("frame_stem", "prompt").unionByName(without.crossJoin(prompts.select("prompt").distinct()).select("frame_stem", "prompt"))


def json_inside(text: Column) -> Column:
    """The JSON object within a fenced or wordy text, or null."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def split_kept(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame_stem, prompts) of the tags kept in each frame, distinct and sorted, and (frame_stem, held) of the others."""
    keep = classified.where("action = 'keep'").groupBy("frame_stem").agg(F.array_sort(F.collect_set("normalized_label")).alias("prompts"))
    hold = classified.where("action <> 'keep'").groupBy("frame_stem").agg(F.array_sort(F.collect_set("tag")).alias("held"))
    return keep, hold


def update_cache(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """cache and fresh rows together; what is fresh replaces what is cached for its key."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
