"""Tasks that many workers claim at once: claims are events with an attempt, and the log, not the claimer, says who won."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skein.sources.ship import ship

#: An event of the log. Kinds: `enqueue` and `retry` open an attempt, `claim` asks for one, `finish` ends it.
EVENTS = "task bigint, attempt int, kind string, worker string, ts timestamp, ok boolean"


def attempts(log: DataFrame, lease: float) -> DataFrame:
    """(task, attempt, worker, claimed, ended, ok): who won each claimed attempt, and how the winner ended it within `lease` seconds.

    The first claim wins, of several at one time that of the least worker. Ends that others
    report, or the winner after its lease, don't count; of several the first does. Claims
    and ends meet by partial aggregates and one equi-join, however many workers ask.
    """
    first = log.where("kind = 'claim'").groupBy("task", "attempt").agg(F.min(F.struct("ts", "worker")).alias("c")).select("task", "attempt", "c.worker", F.col("c.ts").alias("claimed"))
    ends = log.where("kind = 'finish'").select("task", "attempt", "worker", "ts", F.coalesce("ok", F.lit(False)).alias("ok"))
    mine = first.join(ends, ["task", "attempt", "worker"]).where((F.col("ts") >= F.col("claimed")) & (F.col("ts") <= _end(lease)))
    done = mine.groupBy("task", "attempt").agg(F.min(F.struct("ts", "ok")).alias("e"))
    return first.join(done, ["task", "attempt"], "left").select("task", "attempt", "worker", "claimed", F.col("e.ts").alias("ended"), F.col("e.ok").alias("ok"))


def _end(lease: float) -> Column:
    return F.timestamp_micros(F.unix_micros("claimed") + int(lease * 1_000_000))


def states(log: DataFrame, now: Column, lease: float) -> DataFrame:
    """(task, attempt, state, worker): each task of log (EVENTS) as it stands at `now`.

    A task is done by its first attempt that ended well, whatever was claimed later. Else
    its last attempt counts: pending while nobody has claimed it, processing while its
    winner's lease lasts, failed if it ended ill; after a lease without an end the next
    attempt is pending, and a failed task is so once a retry opens its next attempt.
    Workers claim attempts that are pending here. A task without an opening event counts
    from its first claim; events after `now` are not seen yet; an empty log gives no rows.
    """
    log = log.where(F.col("ts") <= now)
    opened = log.where("kind IN ('enqueue', 'retry')").groupBy("task").agg(F.max("attempt").alias("opened"))
    row = F.struct("attempt", "worker", "claimed", "ok")
    last = attempts(log, lease).groupBy("task").agg(F.max_by(row, "attempt").alias("last"), F.min_by(row, F.when(F.col("ok"), F.col("attempt"))).alias("well"))
    t = opened.join(last, "task", "full").select("task", "opened", "last", F.when(F.col("well.ok"), F.col("well")).alias("well"))
    t = t.select("task", "opened", "well", "last.*")
    ask = F.struct(F.lit("pending").alias("state"), F.col("opened").alias("attempt"), F.lit(None).cast("string").alias("worker"))
    as_is = lambda state: F.struct(F.lit(state).alias("state"), F.col("attempt"), F.col("worker"))
    late = F.struct(F.lit("pending").alias("state"), (F.col("attempt") + 1).alias("attempt"), F.lit(None).cast("string").alias("worker"))
    found = (
        F.when(F.col("well").isNotNull(), F.struct(F.lit("done").alias("state"), F.col("well.attempt").alias("attempt"), F.col("well.worker").alias("worker")))
        .when(F.col("attempt").isNull() | (F.coalesce("opened", F.lit(0)) > F.col("attempt")), ask)
        .when(~F.col("ok"), as_is("failed")).when(now > _end(lease), late).otherwise(as_is("processing"))
    )
    return t.select("task", found.alias("s")).select("task", "s.attempt", "s.state", "s.worker")


def claim(now: DataFrame, worker: str, at: Column, most: int) -> DataFrame:
    """Events by which a worker asks for `most` pending tasks of states; workers begin at different ones, so that few ask for the same."""
    some = now.where("state = 'pending'").orderBy(F.xxhash64("task", F.lit(worker)), "task").limit(most)
    return some.select("task", "attempt", F.lit("claim").alias("kind"), F.lit(worker).alias("worker"), at.alias("ts"), F.lit(None).cast("boolean").alias("ok"))


def held(now: DataFrame, worker: str) -> DataFrame:
    """(task, attempt): what a worker holds by states; read after its claims are in the log, it is what it may work on."""
    return now.where((F.col("state") == "processing") & (F.col("worker") == worker)).select("task", "attempt")


def finish(results: DataFrame, worker: str, at: Column) -> DataFrame:
    """Events that end attempts by their results (task, attempt, ok)."""
    return results.select("task", "attempt", F.lit("finish").alias("kind"), F.lit(worker).alias("worker"), at.alias("ts"), "ok")


def retry(now: DataFrame, at: Column) -> DataFrame:
    """Events that open the next attempt of all failed tasks of states; written twice, they open it once."""
    again = now.where("state = 'failed'")
    return again.select("task", (F.col("attempt") + 1).alias("attempt"), F.lit("retry").alias("kind"), F.lit(None).cast("string").alias("worker"), at.alias("ts"), F.lit(None).cast("boolean").alias("ok"))


_OUT = "task bigint, attempt int, state string, worker string, ms bigint"


def _tracker(lease_ms: int) -> StatefulProcessor:
    class Tracker(StatefulProcessor):
        """A task's attempt, state, holder and the time its state began, with a timer at the end of a lease."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("task", StructType([StructField("attempt", LongType()), StructField("state", StringType()), StructField("worker", StringType()), StructField("ms", LongType())]))

        def handleInputRows(self, key, rows, timerValues):
            known = self.state.get() if self.state.exists() else (0, "new", None, 0)
            now, out = tuple(known), []
            for r in pd.concat(list(rows)).sort_values(["ms", "attempt", "kind", "worker"]).itertuples():
                attempt, state, worker, ms = now
                if state == "processing" and r.ms > ms + lease_ms:  # the timer hasn't fired yet, but events say that the lease is over
                    attempt, state, worker, ms = now = (attempt + 1, "pending", None, ms + lease_ms)
                    out.append(now)
                if state == "done":
                    continue
                if r.kind in ("enqueue", "retry") and r.attempt > attempt and state in ("new", "failed"):
                    now = (int(r.attempt), "pending", None, int(r.ms))
                elif r.kind == "claim" and (state == "new" or (state == "pending" and r.attempt == attempt)):
                    now = (int(r.attempt), "processing", r.worker, int(r.ms))
                elif r.kind == "finish" and state == "processing" and r.attempt == attempt and r.worker == worker:
                    now = (attempt, "done" if r.ok is True or r.ok == True else "failed", worker, int(r.ms))  # noqa: E712  numpy's truth
                else:
                    continue
                out.append(now)
            self.state.update(now)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if now[1] == "processing":
                self.handle.registerTimer(now[3] + lease_ms + 1)
            if out:
                yield self.rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            attempt, state, _, ms = self.state.get()
            if state == "processing" and expiredTimerInfo.getExpiryTimeInMs() > ms + lease_ms:
                now = (attempt + 1, "pending", None, ms + lease_ms)
                self.state.update(now)
                yield self.rows(key, [now])

        def rows(self, key, out):
            made = pd.DataFrame(out, columns=["attempt", "state", "worker", "ms"])
            made.insert(0, "task", key[0])
            return made.astype({"attempt": "int32", "worker": object})

        def close(self) -> None:
            pass

    return Tracker()


def changes(log: DataFrame, lease: float, late: str = "0 seconds") -> DataFrame:
    """(task, attempt, state, worker, ts): each change of a task's state, from a stream of events (EVENTS).

    The rules are those of states. A task is a value in Spark's state store. A lease that
    ends without events is found by a timer on event time, when the stream's watermark,
    `late` behind its newest event, passes its end: stuck tasks come back as pending. A
    stopped stream goes on from its checkpoint. The session's state store is set to RocksDB.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)
    rows = log.withWatermark("ts", late).select("task", "attempt", "kind", "worker", "ok", "ts", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("task").transformWithStateInPandas(_tracker(int(lease * 1000)), _OUT, "Append", "EventTime")
    return out.select("task", "attempt", "state", "worker", F.timestamp_millis("ms").alias("ts"))
