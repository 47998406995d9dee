"""Detections: the best of each frame and prompt, gates, and what becomes of a prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    best: int = 5
    least_mask_score: float = 0.6
    least_area: float = 0.06
    largest_area: float = 0.55


def top_detections(detections: DataFrame, best: int) -> DataFrame:
    """The `best` detections of each frame and prompt by box score, with their rank from 0; `tie` settles equal scores."""
    w = Window.partitionBy("frame", "prompt").orderBy(F.desc("box_score"), "tie")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).withColumn("rank", F.col("rank") - 1)


def gated(detections: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """detections with the first reason against each, and a running number of those without one."""
    reason = F.when(F.col("mask_score") < gate.least_mask_score, "low_mask_score").when(F.col("area") < gate.least_area, "area_too_small").when(F.col("area") > gate.largest_area, "area_too_large")
    d = detections.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    w = Window.partitionBy("frame", "prompt", "kept").orderBy("rank")
    return d.withColumn("instance", F.when(F.col("kept"), F.row_number().over(w) - 1))


def prompt_results(gated_rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """For each of prompts (frame, prompt): counts, best scores, and accepted, no_detection, or the reasons against it, sorted."""
    g = gated_rows.groupBy("frame", "prompt").agg(
        F.count("*").alias("detections"), F.count_if("kept").alias("kept"), F.max("box_score").alias("best_box"), F.max("mask_score").alias("best_mask"),
        F.sum(F.when(F.col("kept"), F.col("area"))).alias("kept_area"), F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"),
    )
    joined = prompts.join(g, ["frame", "prompt"], "left").fillna(0, ["detections", "kept", "best_box", "best_mask", "kept_area"])
    status = F.when(F.col("detections") == 0, "no_detection").when(F.col("kept") > 0, "accepted").otherwise(F.col("reasons"))
    return joined.withColumn("status", status)
