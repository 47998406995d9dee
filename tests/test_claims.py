"""Claims by many workers: one holder at any time, leases, retries, and a stream that stops and goes on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skein.streaming import claims
from skein.streaming.tasks import run_once

T0 = dt.datetime(2030, 1, 1)


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def moment(s: float):
    return F.lit(at(s).isoformat(sep=" ")).cast("timestamp")


def event(task, attempt, kind, worker, s, ok=None):
    return (task, attempt, kind, worker, at(s), ok)


def shown(log, s: float, lease: float = 10) -> dict:
    return {r.task: (r.attempt, r.state, r.worker) for r in claims.states(log, moment(s), lease).collect()}


LOG = [
    *[event(k, 1, "enqueue", None, 0) for k in range(1, 8)],
    event(1, 1, "claim", "b", 5), event(1, 1, "claim", "a", 5), event(1, 1, "claim", "c", 4.5), event(1, 1, "finish", "a", 6, True), event(1, 1, "finish", "c", 7, True), event(1, 1, "finish", "c", 8, False),  # c won
    event(2, 1, "claim", "b", 5), event(2, 1, "claim", "a", 5),  # a won, never ends
    event(3, 1, "claim", "a", 5), event(3, 1, "finish", "a", 16, True), event(3, 2, "claim", "b", 17), event(3, 2, "finish", "b", 18, True),  # a was late
    event(4, 1, "claim", "a", 5), event(4, 1, "finish", "a", 6, False), event(4, 2, "retry", None, 7), event(4, 2, "retry", None, 7), event(4, 2, "claim", "b", 19),
    event(5, 1, "claim", "a", 5), event(5, 1, "finish", "a", 15, None),  # no result is none
    event(6, 1, "claim", "a", 5), event(6, 1, "finish", "b", 6, True),  # b holds nothing
]
WANT = {1: (1, "done", "c"), 2: (2, "pending", None), 3: (2, "done", "b"), 4: (2, "processing", "b"), 5: (1, "failed", "a"), 6: (2, "pending", None), 7: (1, "pending", None)}


def test_the_log_says_who_won(spark):
    log = spark.createDataFrame(LOG, claims.EVENTS)
    assert shown(log, 20) == WANT
    assert shown(log, 4) == {k: (1, "pending", None) for k in range(1, 8)}
    assert shown(log, 15)[2] == (1, "processing", "a") and shown(log, 15.5)[2] == (2, "pending", None)
    assert shown(log.unionByName(log), 20) == WANT
    assert shown(log.limit(0), 20) == {}
    assert [tuple(r)[:3] for r in claims.retry(claims.states(log, moment(20), 10), moment(20)).collect()] == [(5, 2, "retry")]


def test_two_claimers_never_hold_one_task(spark):
    """Both read the same states and claim at once; each works only on what the log then gives it."""
    log = spark.createDataFrame([event(k, 1, "enqueue", None, 0) for k in range(60)], claims.EVENTS)
    seen: dict[int, str] = {}
    for step in range(1, 4):
        now = claims.states(log, moment(step * 100), 10)
        asked = [spark.createDataFrame(claims.claim(now, w, moment(step * 100), 40).collect(), claims.EVENTS) for w in "ab"]
        log = log.unionByName(asked[0]).unionByName(asked[1])
        after = claims.states(log, moment(step * 100 + 1), 10)
        mine = {w: {tuple(r) for r in claims.held(after, w).collect()} for w in "ab"}
        assert not {t for t, _ in mine["a"]} & {t for t, _ in mine["b"]}
        assert {t for w in "ab" for t, _ in mine[w]} == {r.task for x in asked for r in x.collect()}
        for w in "ab":  # the first half ends, the others get stuck and come back
            done = spark.createDataFrame([(t, k, True) for t, k in sorted(mine[w])[: 15 if step < 3 else 99]], "task bigint, attempt int, ok boolean")
            ended = claims.finish(done, w, moment(step * 100 + 2)).collect()
            assert not seen.keys() & {r.task for r in ended}
            seen |= {r.task: w for r in ended}
            if ended:
                log = log.unionByName(spark.createDataFrame(ended, claims.EVENTS))
        log = spark.createDataFrame(log.collect(), claims.EVENTS)
    assert {k: w for k, (_, s, w) in shown(log, 400).items() if s == "done"} == seen and len(seen) == 60


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Events come in two parts, the stream is stopped between them: its changes end in what the whole log says, none twice."""
    source, out = tmp_path / "log", tmp_path / "out"
    stream = lambda: claims.changes(spark.readStream.schema(claims.EVENTS).parquet(str(source)), 10)
    for part in ([e for e in LOG if e[4] <= at(6)], [e for e in LOG if e[4] > at(6)] + [event(9, 1, "enqueue", None, 20)]):
        spark.createDataFrame(part, claims.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        got = [tuple(r) for r in run_once(stream(), str(tmp_path / "check"), str(out)).collect()]
    assert len(got) == len(set(got))
    last: dict = {}
    for task, attempt, state, worker, ts in sorted(got, key=lambda r: (r[0], r[1], r[4])):
        last[task] = (attempt, state, worker)
    assert last == WANT | {9: (1, "pending", None)}
    assert (2, 2, "pending", None, at(15)) in got, "the timer puts the stuck task back at the end of its lease"
