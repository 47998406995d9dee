"""The task queue as a log of events, and streams over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lift import numbered

# The states of a task; where a task is in several, the later one in a list counts.
STATES = ("pending", "processing", "done", "failed")


def enqueue(log: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Events (task, state, at, …) to append for new tasks (task, at): all with overwrite, else those that no state has yet."""
    fresh = new.dropDuplicates(["task"])
    if not overwrite:
        fresh = fresh.join(log.select("task").distinct(), "task", "left_anti")
    return fresh.withColumn("state", F.lit("pending"))


def latest(log: DataFrame, *order: str) -> DataFrame:
    """(task, state, at): each task's state by its last event, a partial aggregate and not a sort."""
    last = F.max_by(F.struct("state", "at"), F.struct(*order))
    return log.groupBy("task").agg(last.alias("e")).select("task", "e.state", "e.at")


def preferred(found: DataFrame, states: tuple[str, ...] = ("done", "processing", "pending", "failed")) -> DataFrame:
    """For each frame of found (frame, state, …) the row of the state listed last; rows of other states are left out."""
    rank = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state"))
    row = F.struct(*[F.col(c) for c in found.columns if c != "frame"])
    kept = found.where(F.col("state").isin(*states)).groupBy("frame").agg(F.max_by(row, F.struct(rank, "task")).alias("r"))
    return kept.select("frame", "r.*")


def counts(states: DataFrame) -> DataFrame:
    """(state, n) for all four states, those without tasks with 0."""
    all_states = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return all_states.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").fillna(0, ["n"])


def claim(now: DataFrame, at: Column, most: int) -> DataFrame:
    """Events that take the first `most` pending tasks, by task, into processing."""
    return now.where("state = 'pending'").orderBy("task").limit(most).select("task", F.lit("processing").alias("state"), at.alias("at"))


def finish(now: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Events that end processing tasks by their result (task, ok): done or failed."""
    mine = now.where("state = 'processing'").select("task").join(results, "task")
    return mine.select("task", F.when(F.col("ok"), "done").otherwise("failed").alias("state"), at.alias("at"))


def retry(now: DataFrame, state: str, at: Column, most: int | None = None) -> DataFrame:
    """Events that put tasks of a state back to pending, the first `most` by task."""
    again = now.where(F.col("state") == state)
    again = again.orderBy("task").limit(most) if most is not None else again
    return again.select("task", F.lit("pending").alias("state"), at.alias("at"))


def select_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """tasks in the order of wanted (ord, task); a wanted task that isn't there is an error when the rows are read."""
    j = wanted.join(tasks, "task", "left")
    there = F.when(F.col("state").isNull(), F.raise_error(F.concat(F.lit("no such task: "), F.col("task")))).otherwise(F.col("state"))
    return j.withColumn("state", there)


def image_inputs(listed: DataFrame, queue: DataFrame, states: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(image, frame, source): images given by name, then those of queued tasks in the states, without tasks that have none; at most `most` of the queue's."""
    queued = queue.where(F.col("state").isin(*states) & F.col("image").isNotNull()).select("image", "frame", F.lit("queue").alias("source"))
    queued = queued.orderBy("image", "frame").limit(most) if most is not None else queued
    return listed.select("image", F.lit(None).cast("bigint").alias("frame"), F.lit("listed").alias("source")).unionByName(queued)


def rewrite_paths(tasks: DataFrame, root: str) -> DataFrame:
    """tasks (image, image_relative, depth, depth_relative) with both paths below root and whether a path changed.

    The relative path counts where there is one; a depth path without one follows the image's
    name, frame_ becoming depth_.
    """
    below = lambda rel: F.concat(F.lit(root.rstrip("/") + "/"), rel)
    image = F.when(F.col("image_relative").isNotNull(), below(F.col("image_relative"))).otherwise(F.col("image"))
    stem = F.regexp_replace(F.element_at(F.split(image, "/"), -1), "^frame_", "depth_")
    depth = F.when(F.col("depth_relative").isNotNull(), below(F.col("depth_relative"))).otherwise(below(F.concat(F.lit("depth/"), stem)))
    out = tasks.withColumn("new_image", image).withColumn("new_depth", depth)
    return out.withColumn("changed", ~(F.col("image").eqNullSafe(F.col("new_image")) & F.col("depth").eqNullSafe(F.col("new_depth"))))


def keyframes(frames: DataFrame, every: int, start: Column, seconds: float) -> DataFrame:
    """Events (task, frame, state, at) of the keyframes of frames (task, frame): every `every`-th frame, pending one after another at an interval from start on."""
    kept = numbered(frames.where(F.col("frame") % every == 0), "frame", "task")
    at = F.timestamp_micros(F.unix_micros(start) + (F.col("number") * int(seconds * 1_000_000)))
    return kept.select("task", "frame", F.lit("pending").alias("state"), at.alias("at"))


def replay(spark: SparkSession, path: str, schema: str, seconds: float, files: int = 1):
    """The files of a folder as a stream, and a writer of it that takes `files` more of them at each interval: keyframes as they would arrive."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return arriving, arriving.writeStream.outputMode("append").trigger(processingTime=f"{seconds} seconds")


def result_counts(log: DataFrame) -> DataFrame:
    """(state, events, tasks): how often tasks ended in each final state, and how many tasks ever did."""
    ended = log.where(F.col("state").isin("done", "failed"))
    return ended.groupBy("state").agg(F.count("*").alias("events"), F.countDistinct("task").alias("tasks"))


def late_safe(events: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, delay)


def tumbling(events: DataFrame, size: str, *keys: str) -> DataFrame:
    """Counts and sums by window and keys; on a stream with a watermark, windows come out once they are closed."""
    g = events.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "cents")


def sliding(events: DataFrame, size: str, step: str, *keys: str) -> DataFrame:
    g = events.groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Runs of events of a key without a pause of `gap`: start, end and number."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """Events without repeats of keys within the watermark: what a durable queue's enqueue needs on a stream."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def run_once(stream: DataFrame, checkpoint: str, output: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet, exactly once for each row; then read what came out."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)
