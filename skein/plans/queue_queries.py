"""Queries on the task queue, its streams, and what a scene is exported as."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import geometry as G
from skein.functions import labels as L
from skein.operators import scene as E
from skein.plans import pair_queries
from skein.plans import proxies as P
from skein.sources.scratch import scratch_root
from skein.streaming import claims as C
from skein.streaming import tasks as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def a18_task_states(spark, sf_dir: str) -> DataFrame:
    return T.counts(P.tasks(spark, sf_dir))


QUERIES["a18_task_states"] = a18_task_states
SQL["a18_task_states"] = P.with_views(P.V_TASK) + " SELECT s AS state, count(task)::BIGINT AS n FROM (SELECT unnest(['pending','processing','done','failed']) AS s) LEFT JOIN v_task ON state = s GROUP BY s"


def t06_keyframe_replay(spark, sf_dir: str) -> DataFrame:
    """Every tenth frame's tasks as they would arrive, half a second apart."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    found = T.keyframes(P.tasks(spark, sf_dir).select("task", "frame"), 10, start, 0.5)
    return found.select("task", "frame", "state", F.unix_millis("at").alias("at_ms"))


QUERIES["t06_keyframe_replay"] = t06_keyframe_replay
SQL["t06_keyframe_replay"] = P.with_views(P.V_TASK) + """ SELECT task, frame, 'pending' AS state,
  (epoch_ms(TIMESTAMP '2024-01-01 00:00:00') + 500 * (row_number() OVER (ORDER BY frame, task) - 1))::BIGINT AS at_ms FROM v_task WHERE frame % 10 = 0"""


def a19_result_counts(spark, sf_dir: str) -> DataFrame:
    return T.result_counts(_log(spark, sf_dir))


QUERIES["a19_result_counts"] = a19_result_counts


def _log(spark, sf_dir: str) -> DataFrame:
    """Line items as events of their order's task, in the order of ship date and line."""
    li = P.read(spark, sf_dir, "lineitem")
    state = F.element_at(F.array(*[F.lit(s) for s in T.STATES]), F.col("l_linenumber") % 4 + 1)
    return li.select(F.col("l_orderkey").alias("task"), state.alias("state"), F.col("l_shipdate").cast("timestamp").alias("at"), "l_linenumber", "l_partkey", "l_suppkey")


_V_LOG = """v_log AS (SELECT l_orderkey AS task, ['pending','processing','done','failed'][l_linenumber % 4 + 1] AS state, l_shipdate AS "at", l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
_V_NOW = """v_now AS (SELECT task, state, "at" FROM v_log QUALIFY row_number() OVER (PARTITION BY task ORDER BY "at" DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)"""


SQL["a19_result_counts"] = P.with_views(_V_LOG) + " SELECT state, count(*)::BIGINT AS events, count(DISTINCT task)::BIGINT AS tasks FROM v_log WHERE state IN ('done', 'failed') GROUP BY state"


def _now(spark, sf_dir: str) -> DataFrame:
    return T.latest(_log(spark, sf_dir), "at", "l_linenumber", "l_partkey", "l_suppkey")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("stamp", F.date_format("at", "yyyy-MM-dd")).drop("at")


def t09_latest_state(spark, sf_dir: str) -> DataFrame:
    return _dated(_now(spark, sf_dir))


QUERIES["t09_latest_state"] = t09_latest_state
SQL["t09_latest_state"] = P.with_views(_V_LOG, _V_NOW) + """ SELECT task, state, strftime("at", '%Y-%m-%d') AS stamp FROM v_now"""


def s15_preferred_task(spark, sf_dir: str) -> DataFrame:
    """For each frame the task of the state that counts most."""
    return T.preferred(P.tasks(spark, sf_dir).select("frame", "state", "task"))


QUERIES["s15_preferred_task"] = s15_preferred_task
SQL["s15_preferred_task"] = P.with_views(P.V_TASK) + " SELECT frame, state, task FROM v_task QUALIFY row_number() OVER (PARTITION BY frame ORDER BY list_position(['done','processing','pending','failed'], state) DESC, task DESC) = 1"


def t01_enqueue(spark, sf_dir: str) -> DataFrame:
    """Orders enqueued where no event of theirs is logged yet, and how many states the log then has."""
    new = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return _dated(T.enqueue(_log(spark, sf_dir), new).select("task", "state", "at"))


QUERIES["t01_enqueue"] = t01_enqueue
SQL["t01_enqueue"] = P.with_views(_V_LOG) + " SELECT o_orderkey AS task, 'pending' AS state, strftime(o_orderdate, '%Y-%m-%d') AS stamp FROM orders WHERE o_orderkey NOT IN (SELECT task FROM v_log)"


def t02_claim(spark, sf_dir: str) -> DataFrame:
    """The state of all tasks after 500 pending ones are claimed and the processing ones ended by their result."""
    now = _now(spark, sf_dir)
    at = F.lit("2030-01-01").cast("timestamp")
    ended = T.finish(now, now.select("task", (F.col("task") % 10 > 0).alias("ok")), at)
    taken = T.claim(now, at, 500)
    log = now.withColumn("n", F.lit(0)).unionByName(ended.withColumn("n", F.lit(1))).unionByName(taken.withColumn("n", F.lit(1)))
    return _dated(T.latest(log, "n"))


_T02_SQL = P.with_views(_V_LOG, _V_NOW) + """, cl AS (SELECT task FROM v_now WHERE state = 'pending' ORDER BY task LIMIT 500)
, nw AS (SELECT task, CASE WHEN state = 'processing' THEN CASE WHEN task % 10 > 0 THEN 'done' ELSE 'failed' END WHEN task IN (SELECT task FROM cl) THEN 'processing' ELSE state END AS state,
 CASE WHEN state = 'processing' OR task IN (SELECT task FROM cl) THEN '2030-01-01' ELSE strftime("at", '%Y-%m-%d') END AS stamp FROM v_now)"""
QUERIES["t02_claim"] = t02_claim
SQL["t02_claim"] = _T02_SQL + " SELECT * FROM nw"


def _claim_log(spark, sf_dir: str) -> DataFrame:
    """Claims made from orders: each order is a task, the first four lines ask for its first attempt and try to end it, the others for a later one."""
    o, li = P.read(spark, sf_dir, "orders"), P.read(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("boolean")
    n = F.col("l_linenumber")
    later = F.when(n <= 4, 1).otherwise(2)
    worker = F.concat(F.lit("w"), F.col("l_suppkey") % 5)
    asked = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + (later - 1) * 40000000000000)
    opened = o.select(F.col("o_orderkey").alias("task"), F.lit(1).alias("attempt"), F.lit("enqueue").alias("kind"), F.lit(None).cast("string").alias("worker"), F.col("o_orderdate").cast("timestamp").alias("ts"), none.alias("ok"))
    claims = li.select(F.col("l_orderkey").alias("task"), later.alias("attempt"), F.lit("claim").alias("kind"), worker.alias("worker"), asked.alias("ts"), none.alias("ok"))
    ended = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("task"), later.alias("attempt"), F.lit("finish").alias("kind"), worker.alias("worker"), F.timestamp_micros(F.unix_micros(asked) + (F.col("l_quantity") * 86400000000).cast("bigint")).alias("ts"), (F.col("l_returnflag") != "R").alias("ok"))
    return opened.unionByName(claims).unionByName(ended)


def t02_claim_log(spark, sf_dir: str) -> DataFrame:
    """How each task stands once the log has said who won its attempts, with a lease of 20 days."""
    return C.states(_claim_log(spark, sf_dir), F.lit("1998-06-01").cast("timestamp"), 20 * 86400.0)


QUERIES["t02_claim_log"] = t02_claim_log
SQL["t02_claim_log"] = """WITH li AS (SELECT l_orderkey AS task, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS attempt, 'w' || (l_suppkey % 5) AS worker,
 l_shipdate::TIMESTAMP + to_seconds(CASE WHEN l_linenumber <= 4 THEN 0 ELSE 40000000 END) AS ts, l_linenumber % 2 = 1 AS ends, l_quantity AS q, l_returnflag <> 'R' AS ok FROM lineitem),
cl AS (SELECT * FROM li WHERE ts <= TIMESTAMP '1998-06-01'),
en AS (SELECT task, attempt, worker, ts + to_seconds((q * 86400)::BIGINT) AS ts, ok FROM li WHERE ends),
wn AS (SELECT task, attempt, worker, ts FROM cl QUALIFY row_number() OVER (PARTITION BY task, attempt ORDER BY ts, worker) = 1),
re AS (SELECT w.task, w.attempt, e.ok FROM wn w JOIN en e ON e.task = w.task AND e.attempt = w.attempt AND e.worker = w.worker AND e.ts BETWEEN w.ts AND w.ts + INTERVAL 20 DAY AND e.ts <= TIMESTAMP '1998-06-01'
 QUALIFY row_number() OVER (PARTITION BY w.task, w.attempt ORDER BY e.ts, e.ok) = 1),
a AS (SELECT w.*, r.ok FROM wn w LEFT JOIN re r USING (task, attempt)),
g AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY coalesce(ok, false) DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS k FROM a),
t AS (SELECT DISTINCT task FROM (SELECT o_orderkey AS task FROM orders WHERE o_orderdate <= DATE '1998-06-01' UNION ALL SELECT task FROM cl))
SELECT task, CASE WHEN g.task IS NULL THEN 1 WHEN ok IS NULL AND ts + INTERVAL 20 DAY < TIMESTAMP '1998-06-01' THEN attempt + 1 ELSE attempt END::INTEGER AS attempt,
 CASE WHEN ok THEN 'done' WHEN g.task IS NULL THEN 'pending' WHEN NOT ok THEN 'failed' WHEN ts + INTERVAL 20 DAY < TIMESTAMP '1998-06-01' THEN 'pending' ELSE 'processing' END AS state,
 CASE WHEN ok IS NOT NULL OR ts + INTERVAL 20 DAY >= TIMESTAMP '1998-06-01' THEN worker END AS worker
FROM t LEFT JOIN (SELECT * FROM g WHERE k = 1) g USING (task)"""


def t04_retry(spark, sf_dir: str) -> DataFrame:
    """Events that retry failed tasks, 300 at most, and all processing ones."""
    now, at = _now(spark, sf_dir), F.lit("2030-01-02").cast("timestamp")
    return _dated(T.retry(now, "failed", at, 300).unionByName(T.retry(now, "processing", at)))


QUERIES["t04_retry"] = t04_retry
SQL["t04_retry"] = P.with_views(_V_LOG, _V_NOW) + """ SELECT task, 'pending' AS state, '2030-01-02' AS stamp FROM (SELECT task FROM v_now WHERE state = 'failed' ORDER BY task LIMIT 300)
UNION ALL SELECT task, 'pending', '2030-01-02' FROM v_now WHERE state = 'processing'"""


def t07_pending_manifest(spark, sf_dir: str) -> DataFrame:
    """Pending tasks as a manifest, with their file names."""
    name = F.format_string("task_%06d_frame_%06d.json", "task", "frame")
    return P.tasks(spark, sf_dir).where("state = 'pending'").select("task", "frame", name.alias("file"))


QUERIES["t07_pending_manifest"] = t07_pending_manifest
SQL["t07_pending_manifest"] = P.with_views(P.V_TASK) + " SELECT task, frame, printf('task_%06d_frame_%06d.json', task, frame) AS file FROM v_task WHERE state = 'pending'"


def s16_image_inputs(spark, sf_dir: str) -> DataFrame:
    """Images named by parts, then those of done and pending tasks that have one, 700 at most."""
    listed = P.read(spark, sf_dir, "part").select(F.concat(F.lit("/one/"), F.col("p_partkey")).alias("image"))
    queue = P.tasks(spark, sf_dir).withColumn("image", F.when(F.col("task") % 4 > 0, F.format_string("/q/frame_%06d.png", "task")))
    return T.image_inputs(listed, queue, ("done", "pending"), 700)


QUERIES["s16_image_inputs"] = s16_image_inputs
SQL["s16_image_inputs"] = P.with_views(P.V_TASK) + """ SELECT '/one/' || p_partkey AS image, NULL::BIGINT AS frame, 'listed' AS source FROM part
UNION ALL SELECT * FROM (SELECT printf('/q/frame_%06d.png', task), frame, 'queue' FROM v_task WHERE state IN ('done','pending') AND task % 4 > 0 ORDER BY 1, 2 LIMIT 700)"""


def p21_task_selection(spark, sf_dir: str) -> DataFrame:
    """Tasks named by customers, in the customers' order; one that isn't there would be an error. The missing of another list are reported."""
    t = P.tasks(spark, sf_dir)
    wanted = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") * 3).alias("task"))
    found = T.select_tasks(t.select("task", "state"), wanted).select("ord", "task", "state")
    more = P.read(spark, sf_dir, "customer").select((F.col("c_custkey") * 30 + 1).alias("task"))
    gone = more.join(t.select("task"), "task", "left_anti").select(F.lit(-1).cast("bigint").alias("ord"), "task", F.lit("missing").alias("state"))
    return found.unionByName(gone)


QUERIES["p21_task_selection"] = p21_task_selection
SQL["p21_task_selection"] = P.with_views(P.V_TASK) + """ SELECT c_custkey AS ord, task, state FROM customer JOIN v_task ON task = c_custkey*3
UNION ALL SELECT -1, c_custkey*30+1, 'missing' FROM customer WHERE c_custkey*30+1 NOT IN (SELECT task FROM v_task)"""


def p22_path_rewrite(spark, sf_dir: str) -> DataFrame:
    """Task paths moved below a new root, some from relative paths, and whether they changed."""
    t = P.tasks(spark, sf_dir)
    stem = F.format_string("frame_%06d.png", "task")
    t = t.select(
        "task", F.concat(F.lit("/old/rgb/"), stem).alias("image"), F.when(F.col("task") % 3 > 0, F.concat(F.lit("rgb/"), stem)).alias("image_relative"),
        F.when(F.col("task") % 5 == 0, F.concat(F.lit("/data/depth/"), F.format_string("depth_%06d.png", "task"))).alias("depth"), F.when(F.col("task") % 4 == 0, F.concat(F.lit("d/"), stem)).alias("depth_relative"),
    )
    return T.rewrite_paths(t, "/data/").select("task", "new_image", "new_depth", "changed")


_P22_SQL = P.with_views(P.V_TASK) + """, f AS (SELECT task, printf('frame_%06d.png', task) AS s FROM v_task),
n AS (SELECT task, s, CASE WHEN task % 3 > 0 THEN '/data/rgb/' || s ELSE '/old/rgb/' || s END AS new_image, CASE WHEN task % 4 = 0 THEN '/data/d/' || s ELSE '/data/depth/' || replace(s,'frame_','depth_') END AS new_depth,
 CASE WHEN task % 5 = 0 THEN '/data/depth/' || replace(s,'frame_','depth_') END AS depth FROM f),
p AS (SELECT task, new_image, new_depth, NOT ('/old/rgb/' || s = new_image AND depth IS NOT DISTINCT FROM new_depth) AS changed FROM n)"""
QUERIES["p22_path_rewrite"] = p22_path_rewrite
SQL["p22_path_rewrite"] = _P22_SQL + " SELECT * FROM p"


def a20_path_totals(spark, sf_dir: str) -> DataFrame:
    r = p22_path_rewrite(spark, sf_dir)
    return r.agg(F.count("*").alias("tasks"), F.count_if("changed").alias("changed"), F.count_if(~F.col("new_image").startswith("/data/")).alias("outside"))


QUERIES["a20_path_totals"] = a20_path_totals
SQL["a20_path_totals"] = _P22_SQL + " SELECT count(*)::BIGINT AS tasks, count(*) FILTER (WHERE changed)::BIGINT AS changed, count(*) FILTER (WHERE NOT starts_with(new_image,'/data/'))::BIGINT AS outside FROM p"


def _events(spark, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_TS = "yyyy-MM-dd HH:mm:ss"


def t_tumbling(spark, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return T.tumbling(_events(spark, sf_dir), "1 hour", "event_type").withColumn("start", F.date_format("start", _TS))


QUERIES["t_tumbling"] = t_tumbling
SQL["t_tumbling"] = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2"


def t_sliding(spark, sf_dir: str) -> DataFrame:
    """Events in two-hour windows that begin every hour."""
    return T.sliding(_events(spark, sf_dir), "2 hours", "1 hour", "event_type").withColumn("start", F.date_format("start", _TS))


QUERIES["t_sliding"] = t_sliding
SQL["t_sliding"] = "SELECT strftime(b - i * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_type, unnest([0,1]) AS i FROM events) GROUP BY 1, 2"


def t_session(spark, sf_dir: str) -> DataFrame:
    """Each user's runs of events without a pause of six hours."""
    s = T.sessions(_events(spark, sf_dir), "6 hours", "user_id")
    return s.select("user_id", F.date_format("start", _TS).alias("start"), F.date_format("end", _TS).alias("end"), "n")


QUERIES["t_session"] = t_session
SQL["t_session"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""


def t_dedup(spark, sf_dir: str) -> DataFrame:
    """Users and types that were seen, each once."""
    return T.first_of_each(_events(spark, sf_dir), "user_id", "event_type").select("user_id", "event_type")


QUERIES["t_dedup"] = t_dedup
SQL["t_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"


def t_stream_windows(spark, sf_dir: str) -> DataFrame:
    """The tumbling windows as a stream over the events' file, run over all that is there; windows that the watermark hasn't passed stay back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    found = T.run_once(T.tumbling(T.late_safe(stream), "1 hour", "event_type"), out + "/checkpoint", out + "/rows")
    return found.withColumn("start", F.date_format("start", _TS))


QUERIES["t_stream_windows"] = t_stream_windows
SQL["t_stream_windows"] = """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_type, count(*)::BIGINT AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, cents FROM w WHERE b + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"""


def p11_object_record(spark, sf_dir: str) -> DataFrame:
    """Objects as export records, private columns dropped."""
    o = P.objects(spark, sf_dir)
    o = o.withColumn("stored_volume", F.when(F.col("id") % 3 == 0, 0.0).otherwise(G.volume("") * 2)).withColumn("final_status", F.when(F.col("id") % 2 == 0, "")).withColumn("source_ids", F.when(F.col("id") % 4 == 0, F.array(F.lit("obj_x"))))
    r = E.public(E.record(o).withColumn("_rank", F.lit(1)))
    c = F.col("corners")
    return r.select("object_id", "label", "status", "final_status", "volume", F.size(c).alias("n_corners"), c[2][0].alias("c2x"), c[5][0].alias("c5x"), c[7][2].alias("c7z"), F.concat_ws(",", "source_ids").alias("source_ids"), "points")


QUERIES["p11_object_record"] = p11_object_record
_VOL = "(greatest(x1-x0,0.0::DOUBLE)*greatest(y1-y0,0.0::DOUBLE)*greatest(z1-z0,0.0::DOUBLE))"
SQL["p11_object_record"] = P.with_views(P.V_OBJECT) + f""" SELECT printf('obj_%06d', id) AS object_id, label, status, 'kept' AS final_status, CASE WHEN id % 3 = 0 THEN {_VOL} WHEN {_VOL}*2 > 0 THEN {_VOL}*2 ELSE {_VOL} END AS volume,
 8::INT AS n_corners, x1 AS c2x, x1 AS c5x, z1 AS c7z, CASE WHEN id % 4 = 0 THEN 'obj_x' ELSE printf('obj_%06d', id) END AS source_ids, points FROM v_object"""


def w09_label_colors(spark, sf_dir: str) -> DataFrame:
    """Each label's colour, and its red as the points' constant harmonic, in millionths."""
    c = E.label_colors(P.objects(spark, sf_dir))
    return c.withColumn("dc", F.floor(E.sh_dc(F.col("r")) * 1e6 + 0.5).cast("bigint"))


QUERIES["w09_label_colors"] = w09_label_colors
SQL["w09_label_colors"] = P.with_views(P.V_OBJECT) + """, l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT label FROM v_object)),
h AS (SELECT *, (place*0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS h FROM l), s AS (SELECT *, floor(h*6)::INT AS k, h*6 - floor(h*6) AS f FROM h),
c AS (SELECT *, 0.95::DOUBLE AS v, 0.95::DOUBLE*(1-0.72::DOUBLE) AS p, 0.95::DOUBLE*(1-0.72::DOUBLE*f) AS q, 0.95::DOUBLE*(1-0.72::DOUBLE*(1-f)) AS t FROM s),
w AS (SELECT label, place, floor([v,q,p,p,t,v][k+1]*255+0.5::DOUBLE)::BIGINT AS r, floor([t,v,v,q,p,p][k+1]*255+0.5::DOUBLE)::BIGINT AS g, floor([p,p,t,v,v,q][k+1]*255+0.5::DOUBLE)::BIGINT AS b FROM c)
SELECT *, floor((r/255.0::DOUBLE-0.5::DOUBLE)/0.28209479177387814::DOUBLE*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS dc FROM w"""


def f27_box_edges(spark, sf_dir: str) -> DataFrame:
    """Points along all boxes' edges, five to each, and the points themselves, as one set of vertices."""
    e = E.edge_points(P.objects(spark, sf_dir), 5)
    marks = P.gaussians(spark, sf_dir).select(F.col("point").alias("id"), F.lit(-1).cast("bigint").alias("edge"), F.lit(0).cast("bigint").alias("step"), "x", "y", "z")
    whole = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(c)
    return e.unionByName(marks).select("id", "edge", "step", *[whole(c) for c in "xyz"])


_EDGES = [(n, i, j) for n in range(3) for i in (0, 1) for j in (0, 1)]


def _edge_sql() -> str:
    parts = []
    for e, (n, i, j) in enumerate(_EDGES):
        other = [a for k, a in enumerate("xyz") if k != n]
        fixed = dict(zip(other, (i, j), strict=True))
        xs = [f"{a}{fixed[a]} + ({a}{fixed[a]} - {a}{fixed[a]})*al" if a in fixed else f"{a}0 + ({a}1 - {a}0)*al" for a in "xyz"]
        parts.append(f"SELECT id, {e}::BIGINT AS edge, s::BIGINT AS step, " + ", ".join(f"{x} AS {a}" for a, x in zip("xyz", xs, strict=True)) + " FROM v_object, st")
    return " UNION ALL ".join(parts)


QUERIES["f27_box_edges"] = f27_box_edges
SQL["f27_box_edges"] = P.with_views(P.V_OBJECT, P.V_GAUSS) + ", st AS (SELECT s, s::DOUBLE/4.0::DOUBLE AS al FROM (SELECT unnest(range(0,5)) AS s)), e AS (" + _edge_sql() + " UNION ALL SELECT point, -1, 0, x, y, z FROM v_gauss) SELECT id, edge, step, " + ", ".join(
    f"floor({a}*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS {a}" for a in "xyz") + " FROM e"


def p23_recolored_points(spark, sf_dir: str) -> DataFrame:
    """Points inside objects get the least red of their objects' labels; numbers beyond the points are dropped."""
    o = P.objects(spark, sf_dir)
    chosen = pair_queries.object_points(spark, sf_dir).join(o.select("id", "label"), "id").select((F.col("point") + F.when(F.col("id") == 0, 10**9).otherwise(0)).alias("point"), "label")
    points = P.gaussians(spark, sf_dir).select("point", F.lit(-1.0).alias("red"))
    return E.recolored(points, chosen, E.label_colors(o))


QUERIES["p23_recolored_points"] = p23_recolored_points
SQL["p23_recolored_points"] = SQL["w09_label_colors"].rsplit("SELECT *, floor((r/255", 1)[0].rstrip() + ", " + P.V_GAUSS + ", " + P.V_OBJECT_POINT + """,
m AS (SELECT m.point, min(w.r) AS r FROM v_object_point m JOIN v_object o ON o.id = m.id JOIN w ON w.label = o.label WHERE m.id <> 0 GROUP BY m.point)
SELECT g.point, coalesce(m.r::DOUBLE, -1.0::DOUBLE) AS red FROM v_gauss g LEFT JOIN m USING (point)"""


def s22_scene_report(spark, sf_dir: str) -> DataFrame:
    """The 80 nearest relations as lines of a report."""
    return E.report_lines(pair_queries.scene(spark, sf_dir, 80), 80)


QUERIES["s22_scene_report"] = s22_scene_report
SQL["s22_scene_report"] = "WITH j AS (" + pair_queries.SQL["j15_scene_relations"] + "), t AS (SELECT *, row_number() OVER (ORDER BY distance, a, b) AS place FROM j) SELECT place, '- `' || alabel || '` to `' || blabel || '`: ' || relations AS line FROM t WHERE place <= 80"


def f29_split_tags(spark, sf_dir: str) -> DataFrame:
    """Tags of every part from one text with four separators."""
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" ,; "), F.col("p_brand"), F.lit("\n"), F.col("p_type"))
    return P.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", L.split_tags(text)).alias("tags"))


QUERIES["f29_split_tags"] = f29_split_tags
SQL["f29_split_tags"] = "SELECT p_partkey, replace(p_name,' ','/') || '/' || p_brand || '/' || p_type AS tags FROM part"
