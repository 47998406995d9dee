"""Queries from points and cameras to observations, and on the association of observations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry as G
from skein.functions import labels as L
from skein.operators import associate as S
from skein.operators import lift as X
from skein.plans import proxies as P
from skein.sources.scratch import scratch_root, store
from skein.streaming.tasks import run_once

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Three cameras, side by side, all looking along z.
CAMERAS = [
    X.Camera(n, ((1.0, 0.0, 0.0, x), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, -0.35), (0.0, 0.0, 0.0, 1.0)), 320.0, 320.0, 320.0, 240.0, 640, 480) for n, x in ((0, 0.0), (1, 0.2), (2, -0.2))
]
_V_SEEN = P.V_GAUSS + """, v_camera AS (SELECT * FROM (VALUES (0,0.0::DOUBLE),(1,-0.2::DOUBLE),(2,0.2::DOUBLE)) t(camera, dx)),
proj AS (SELECT camera, point, x + dx AS px, y AS py, z + 0.35::DOUBLE AS depth FROM v_gauss, v_camera),
pix AS (SELECT camera, point, depth, round_even(320.0::DOUBLE*px/depth + 320.0::DOUBLE, 0)::INT AS u, round_even(320.0::DOUBLE*py/depth + 240.0::DOUBLE, 0)::INT AS v FROM proj WHERE depth > 1e-6::DOUBLE),
seen AS (SELECT * FROM pix WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)"""


def _seen(spark, sf_dir: str) -> DataFrame:
    return X.visible(P.gaussians(spark, sf_dir), X.camera_table(spark, CAMERAS))


def j03_project(spark, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).select("camera", "point", "u", "v", F.floor(F.col("depth") * 1e9 + 0.5).cast("bigint").alias("depth"))


QUERIES["j03_project"] = j03_project
SQL["j03_project"] = "WITH " + _V_SEEN + " SELECT camera, point, u, v, floor(depth*1e9::DOUBLE+0.5::DOUBLE)::BIGINT AS depth FROM seen"


def _hits(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Visible points, and hits: each camera has four masks of one image quarter each, and a depth image that is off for every third column."""
    seen = _seen(spark, sf_dir)
    pixels = seen.select("camera", "u", "v").distinct()
    quarter = (F.col("u") >= 320).cast("int") + 2 * (F.col("v") >= 240).cast("int")
    mask = pixels.select((F.col("camera") * 10 + quarter).alias("obs"), "camera", "u", "v")
    depth = seen.groupBy("camera", "u", "v").agg(F.min("depth").alias("d")).select("camera", "u", "v", (F.col("d") + F.when(F.col("u") % 3 == 0, 0.2).otherwise(0.0)).alias("measured"))
    return seen, X.depth_consistent(X.in_mask(seen, mask), depth)


def p07_lift_cascade(spark, sf_dir: str) -> DataFrame:
    """What becomes of each observation: masks missing or unreadable for some, hits counted for the rest."""
    seen, hits = _hits(spark, sf_dir)
    visible = seen.groupBy("camera").agg(F.count("*").alias("visible"))
    obs = visible.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("obs", F.col("camera") * 10 + F.col("q"))
    obs = obs.join(hits.groupBy("obs").agg(F.count("*").alias("hits")), "obs", "left").fillna(0, ["hits"])
    obs = obs.withColumn("has_mask", F.col("q") < 4).withColumn("mask_ok", F.col("obs") != 13).withColumn("components", F.when(F.col("obs") == 2, 0).otherwise(1))
    done = X.lift_status(obs, X.LiftRules(least_hits=40, least_ratio=0.12))
    return done.select(F.col("obs").cast("bigint").alias("obs"), "visible", "hits", "ratio", "status", "reason")


_HITS_SQL = "WITH " + _V_SEEN + """, dep AS (SELECT camera, u, v, min(depth) + CASE WHEN u % 3 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS measured FROM seen GROUP BY camera, u, v),
hits AS (SELECT s.camera*10 + (s.u >= 320)::INT + 2*(s.v >= 240)::INT AS obs, s.* FROM seen s JOIN dep d USING (camera, u, v) WHERE measured > 0 AND abs(s.depth - measured) <= greatest(0.05::DOUBLE, measured*0.03::DOUBLE))"""
QUERIES["p07_lift_cascade"] = p07_lift_cascade
SQL["p07_lift_cascade"] = _HITS_SQL + """, vis AS (SELECT camera, count(*)::BIGINT AS visible FROM seen GROUP BY camera), o AS (SELECT camera*10 + q AS obs, q, visible FROM vis, (SELECT unnest(range(0,5)) AS q)),
h AS (SELECT obs, count(*)::BIGINT AS n FROM hits GROUP BY obs), c AS (SELECT o.obs, q, visible, coalesce(n,0) AS hits, coalesce(n,0)::DOUBLE/greatest(visible,1) AS ratio FROM o LEFT JOIN h USING (obs)),
r AS (SELECT *, CASE WHEN q >= 4 THEN 'missing_mask' WHEN obs = 13 THEN 'failed_read_mask' WHEN visible = 0 THEN 'no_visible_points' WHEN hits < 40 THEN 'too_few_hit_points' WHEN ratio < 0.12::DOUBLE THEN 'hit_ratio_too_low' WHEN obs = 2 THEN 'no_valid_component' END AS reason FROM c)
SELECT obs::BIGINT AS obs, visible, hits, ratio, CASE WHEN reason IS NULL THEN 'accepted_3d' ELSE 'rejected_3d' END AS status, reason FROM r"""


def p08_frame_status(spark, sf_dir: str) -> DataFrame:
    """What becomes of each frame, by the queue task found for it, the latest listed state counting."""
    t = P.tasks(spark, sf_dir)
    from skein.streaming.tasks import preferred

    own = preferred(t.select("frame", "state", "task")).select(
        "frame", "state", F.when(F.col("task") % 7 > 0, F.lit("pose")).alias("pose"), F.when(F.col("task") % 5 > 0, F.lit(1.0)).alias("focal"), F.when(F.col("task") % 3 > 0, F.lit(640)).alias("width")
    )
    frames = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame"), (F.col("c_custkey") % 4).alias("n_observations"))
    return X.frame_status(frames, own).select("frame", F.col("state").alias("task_state"), "status")


QUERIES["p08_frame_status"] = p08_frame_status
SQL["p08_frame_status"] = P.with_views(P.V_TASK) + """, k AS (SELECT * FROM v_task QUALIFY row_number() OVER (PARTITION BY frame ORDER BY list_position(['done','processing','pending','failed'], state) DESC, task DESC) = 1)
SELECT c_custkey AS frame, state AS task_state, CASE WHEN task IS NULL THEN 'missing_queue_task' WHEN task % 7 = 0 THEN 'missing_pose' WHEN task % 5 = 0 THEN 'missing_intrinsics' WHEN c_custkey % 4 = 0 THEN 'processed'
 WHEN task % 3 = 0 THEN 'missing_frame_size' ELSE 'processed' END AS status FROM customer LEFT JOIN k ON k.frame = c_custkey"""


def a10_mask_union(spark, sf_dir: str) -> DataFrame:
    """The area that each camera's masks cover together, masks of several observations sharing pixels."""
    pixels = _seen(spark, sf_dir).select("camera", "u", "v")
    wide = pixels.select("camera", F.explode(F.sequence(F.col("u") - 1, F.col("u") + 1)).alias("u"), "v")
    return X.mask_areas(wide.unionByName(pixels), 640, 480, "camera")


QUERIES["a10_mask_union"] = a10_mask_union
SQL["a10_mask_union"] = "WITH " + _V_SEEN + ", w AS (SELECT DISTINCT camera, u + d AS u, v FROM seen, (SELECT unnest([-1,0,1]) AS d)) SELECT camera, count(*)::BIGINT AS pixels, count(*)::DOUBLE / 307200 AS ratio FROM w GROUP BY camera"


def s12_frame_size(spark, sf_dir: str) -> DataFrame:
    """Frame sizes from tasks, else images, else masks, made from customers."""
    c = P.read(spark, sf_dir, "customer")
    pick = lambda n, value: F.when(F.col("c_custkey") % n == 0, F.lit(value))
    f = c.select("c_custkey", pick(2, 640).alias("task_width"), pick(2, 480).alias("task_height"), pick(3, 1280).alias("image_width"), pick(3, 720).alias("image_height"), pick(5, 320).alias("mask_width"), pick(5, 240).alias("mask_height"))
    return X.frame_size(f).select("c_custkey", "width", "height")


QUERIES["s12_frame_size"] = s12_frame_size
SQL["s12_frame_size"] = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 640 WHEN c_custkey % 3 = 0 THEN 1280 WHEN c_custkey % 5 = 0 THEN 320 END AS width,
 CASE WHEN c_custkey % 2 = 0 THEN 480 WHEN c_custkey % 3 = 0 THEN 720 WHEN c_custkey % 5 = 0 THEN 240 END AS height FROM customer"""


def f23_voxels(spark, sf_dir: str) -> DataFrame:
    """Points in each voxel."""
    g = P.gaussians(spark, sf_dir)
    return g.groupBy(*[G.voxel(F.col(a), 0.08).alias(f"v{a}") for a in "xyz"]).agg(F.count("*").alias("n"), F.min("point").alias("least"))


QUERIES["f23_voxels"] = f23_voxels
_VOX_SQL = "floor(x/0.08::DOUBLE)::INT AS vx, floor(y/0.08::DOUBLE)::INT AS vy, floor(z/0.08::DOUBLE)::INT AS vz"
SQL["f23_voxels"] = P.with_views(P.V_GAUSS) + f", g AS (SELECT {_VOX_SQL}, point FROM v_gauss) SELECT vx, vy, vz, count(*)::BIGINT AS n, min(point) AS least FROM g GROUP BY vx, vy, vz"


def _components(spark, sf_dir: str) -> DataFrame:
    """Points of each class, in components of touching voxels."""
    e = P.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), F.col("label").alias("set"))
    return X.voxel_components(P.gaussians(spark, sf_dir).join(e, "point"), 0.08)


def g02_voxel_components(spark, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).groupBy("set", "component").agg(F.count("*").alias("n"))


_COMP_SQL = "WITH RECURSIVE " + P.V_GAUSS + f""", c AS (SELECT label AS s, min(point) AS name, {_VOX_SQL} FROM v_gauss JOIN embeddings ON vec_id = point GROUP BY label, vx, vy, vz),
pt AS (SELECT label AS s, point, {_VOX_SQL} FROM v_gauss JOIN embeddings ON vec_id = point),
ed AS (SELECT a.s, a.name AS p, b.name AS q FROM c a JOIN c b ON a.s = b.s AND abs(a.vx-b.vx) <= 1 AND abs(a.vy-b.vy) <= 1 AND abs(a.vz-b.vz) <= 1),
reach(s, name, other) AS (SELECT s, p, q FROM ed UNION SELECT reach.s, reach.name, ed.q FROM reach JOIN ed ON ed.s = reach.s AND ed.p = reach.other),
root AS (SELECT s, name, min(other) AS component FROM reach GROUP BY s, name),
parts AS (SELECT pt.s, pt.point, root.component FROM pt JOIN c USING (s, vx, vy, vz) JOIN root ON root.s = c.s AND root.name = c.name),
size AS (SELECT s, component, count(*) AS n FROM parts GROUP BY s, component)"""
QUERIES["g02_voxel_components"] = g02_voxel_components
SQL["g02_voxel_components"] = _COMP_SQL + ' SELECT s AS "set", component, n::BIGINT AS n FROM size'


def w05_chosen_components(spark, sf_dir: str) -> DataFrame:
    """The three largest components of each class that have a few points and a share of all."""
    return X.chosen_components(_components(spark, sf_dir), X.LiftRules(component_points=2, component_ratio=0.03)).withColumn("place", F.col("place").cast("bigint"))


QUERIES["w05_chosen_components"] = w05_chosen_components
SQL["w05_chosen_components"] = _COMP_SQL + """, t AS (SELECT s, sum(n) AS total FROM size GROUP BY s)
SELECT s AS "set", component, n::BIGINT AS n, (row_number() OVER (PARTITION BY s ORDER BY n DESC, component) - 1)::BIGINT AS place FROM size JOIN t USING (s) WHERE n >= greatest(2, ceil(total*0.03::DOUBLE)) QUALIFY place < 3"""


def w08_observation_index(spark, sf_dir: str) -> DataFrame:
    """A running number over all observations by frame and id, with first and last frame of the label and the gap since the user's last."""
    o = P.observations(spark, sf_dir)
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy("user").orderBy("frame", "obs"))
    span = o.groupBy("label").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    n = X.numbered(o.select("obs", "frame", "label", "user", gap.alias("gap")), "frame", "obs")
    return n.join(span, "label").select("obs", "number", "gap", "first", "last")


QUERIES["w08_observation_index"] = w08_observation_index
SQL["w08_observation_index"] = P.with_views(P.V_OBS) + """ SELECT obs, row_number() OVER (ORDER BY frame, obs) - 1 AS number, frame - lag(frame) OVER (PARTITION BY user ORDER BY frame, obs) AS gap,
 min(frame) OVER (PARTITION BY label) AS first, max(frame) OVER (PARTITION BY label) AS last FROM v_obs"""


def f13_decay_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of each observation against the user's one before: time, place, label, weighted and capped for unlike labels; as whole millionths."""
    o = P.observations(spark, sf_dir)
    w = Window.partitionBy("user").orderBy("frame", "obs")
    back = {c: F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "label", "cx", "cy", "cz")}
    o = o.select("*", *back.values())
    time = G.time_score(F.col("frame"), F.col("p_frame"), 60.0)
    d = G.distance([F.col(f"c{a}") for a in "xyz"], [F.col(f"p_c{a}") for a in "xyz"])
    diag = F.sqrt(F.lit(0.75))
    place = F.coalesce(G.center_score(d, diag, diag, 0.5), F.lit(0.0))
    alike = F.when(F.col("p_label").isNull(), 0.0).otherwise(L.similarity(F.col("label"), F.col("p_label"), F.lit(None).cast("double")))
    weights = S.parse_weights("bbox_iou=0,point_overlap=0")
    raw = alike * weights["semantic_similarity"] + place * weights["center_distance_score"] + time * weights["temporal_consistency"]
    score = F.when(alike < 0.35, F.least(raw, F.lit(0.35 - 1e-6))).otherwise(raw)
    whole = lambda x: F.floor(x * 1e6 + 0.5).cast("bigint")
    return o.select("obs", whole(time).alias("time"), whole(place).alias("place"), whole(score).alias("score"))


QUERIES["f13_decay_scores"] = f13_decay_scores
SQL["f13_decay_scores"] = P.with_views(P.V_OBS) + """, l AS (SELECT *, lag(frame) OVER w AS pf, lag(label) OVER w AS pl, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz FROM v_obs WINDOW w AS (PARTITION BY user ORDER BY frame, obs)),
s AS (SELECT obs, CASE WHEN pf IS NULL THEN 0.0::DOUBLE ELSE exp(-greatest(frame-pf,0)::DOUBLE/60.0::DOUBLE) END AS t, coalesce(exp(-sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)+(cz-pz)*(cz-pz)) / greatest((sqrt(0.75::DOUBLE)+sqrt(0.75::DOUBLE))*0.5::DOUBLE, 0.5::DOUBLE)), 0.0::DOUBLE) AS p,
 CASE WHEN pl IS NULL THEN 0.0::DOUBLE WHEN label = pl THEN 1.0::DOUBLE WHEN contains(label,pl) OR contains(pl,label) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS a FROM l),
r AS (SELECT *, a*0.5::DOUBLE + p*0.375::DOUBLE + t*0.125::DOUBLE AS raw FROM s)
SELECT obs, floor(t*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS time, floor(p*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS place, floor((CASE WHEN a < 0.35::DOUBLE THEN least(raw, 0.35::DOUBLE-1e-6::DOUBLE) ELSE raw END)*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS score FROM r"""


def scene_observations(spark, sf_dir: str, observations: DataFrame | None = None) -> DataFrame:
    """Observations of each user as a scene, with boxes of half a unit and ten points, every 97th without points."""
    o = P.observations(spark, sf_dir) if observations is None else observations
    box = lambda s: F.array(*[F.col(f"c{a}") + F.lit(0.25 * s) for a in "xyz"])
    points = F.when(F.col("obs") % 97 > 0, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("user") * 100 + F.col("k") + i))
    return o.select(F.col("user").alias("scene"), "obs", "frame", "label", box(-1).alias("low"), box(1).alias("high"), F.array("cx", "cy", "cz").alias("center"), points.alias("points"), (F.col("value") / 100).alias("score"))


def _log_rows(log: DataFrame) -> DataFrame:
    """The log with its scores as whole millionths; how many objects were tried is the index's business."""
    whole = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(c)
    return log.select("scene", "obs", "frame", "action", "object_id", "best_id", whole("score"), *[whole(p) for p in S.PARTS])


def t05_association(spark, sf_dir: str) -> DataFrame:
    return _log_rows(S.fold(scene_observations(spark, sf_dir)))


QUERIES["t05_association"] = t05_association
# A recursion over each scene's observations in order; its state is the list of the scene's objects.
_V_FOLD = P.V_OBS + """, ob AS (
  SELECT user AS scene, obs, frame, label, [cx - 0.25, cy - 0.25, cz - 0.25] AS low, [cx + 0.25, cy + 0.25, cz + 0.25] AS high, [cx, cy, cz] AS center, CASE WHEN obs % 97 > 0 THEN list_transform(range(10), lambda i: user * 100 + k + i) END AS points, value / 100 AS score,
         row_number() OVER (PARTITION BY user ORDER BY frame, obs) AS turn FROM v_obs
), steps(scene, turn, objects, entry) AS (
  SELECT DISTINCT scene, 0::BIGINT, []::STRUCT(low DOUBLE[], high DOUBLE[], points BIGINT[], labels VARCHAR[], label VARCHAR, last BIGINT)[],
         NULL::STRUCT(obs BIGINT, action VARCHAR, object BIGINT, best BIGINT, score DOUBLE, parts DOUBLE[]) FROM ob
  UNION ALL
  SELECT scene, turn,
    CASE WHEN points IS NULL THEN objects
         WHEN best.score >= 0.55 THEN list_transform(objects, lambda o, i: CASE WHEN i <> best.i THEN o ELSE struct_pack(
                low := list_transform([1, 2, 3], lambda a: least(o.low[a], low[a])), high := list_transform([1, 2, 3], lambda a: greatest(o.high[a], high[a])), points := list_distinct(list_concat(o.points, points)),
                labels := list_concat(o.labels, [label]), last := greatest(o.last, frame),
                label := list_sort(list_transform(list_distinct(list_concat(o.labels, [label])), lambda l: struct_pack(n := -len(list_filter(list_concat(o.labels, [label]), lambda x: x = l)), l := l)))[1].l) END)
         ELSE list_append(objects, struct_pack(low := low, high := high, points := list_distinct(points), labels := [label], label := label, last := frame)) END,
    struct_pack(obs := obs, action := CASE WHEN points IS NULL THEN 'skipped_missing_hit_points' WHEN best.score >= 0.55 THEN 'match' ELSE 'new' END,
                object := CASE WHEN points IS NULL THEN NULL WHEN best.score >= 0.55 THEN best.i - 1 ELSE len(objects) END, best := CASE WHEN points IS NOT NULL THEN best.i - 1 END,
                score := CASE WHEN points IS NOT NULL THEN CASE WHEN best.i IS NULL THEN 0 ELSE best.score END END, parts := CASE WHEN points IS NOT NULL THEN best.parts END)
  FROM (
    SELECT *, list_reduce(list_prepend(struct_pack(i := NULL::BIGINT, raw := -1e9::DOUBLE, score := -1e9::DOUBLE, parts := NULL::DOUBLE[]), scored), lambda b, c: CASE WHEN c.raw > b.score THEN c ELSE b END) AS best FROM (
      SELECT *, list_transform(measured, lambda m: struct_pack(i := m.i, raw := CASE WHEN m.p[3] < 0.35 THEN least(m.total, 0.35 - 1e-6) ELSE m.total END, score := round(CASE WHEN m.p[3] < 0.35 THEN least(m.total, 0.35 - 1e-6) ELSE m.total END, 6), parts := list_transform(m.p, lambda x: round(x, 6)))) AS scored FROM (
        SELECT *, list_transform(parts, lambda m: struct_pack(i := m.i, p := m.p, total := (((0.25::DOUBLE * m.p[1] + 0.35::DOUBLE * m.p[2]) + 0.20::DOUBLE * m.p[3]) + 0.15::DOUBLE * m.p[4]) + 0.05::DOUBLE * m.p[5])) AS measured FROM (
          SELECT ob.*, s.objects, list_transform(s.objects, lambda o, i: struct_pack(i := i, p := [
              list_transform([list_product(list_transform([1, 2, 3], lambda a: greatest(0, least(o.high[a], ob.high[a]) - greatest(o.low[a], ob.low[a]))))], lambda v:
                CASE WHEN v > 0 THEN v / (list_product(list_transform([1, 2, 3], lambda a: o.high[a] - o.low[a])) + list_product(list_transform([1, 2, 3], lambda a: ob.high[a] - ob.low[a])) - v) ELSE 0 END)[1],
              len(list_intersect(o.points, ob.points))::DOUBLE / greatest(least(len(o.points), len(list_distinct(ob.points))), 1),
              CASE WHEN o.label = ob.label THEN 1 WHEN contains(o.label, ob.label) OR contains(ob.label, o.label) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END,
              exp(-sqrt(list_sum(list_transform([1, 2, 3], lambda a: pow(ob.center[a] - round((o.low[a] + o.high[a]) * 0.5::DOUBLE, 6), 2))))
                / greatest((sqrt(list_sum(list_transform([1, 2, 3], lambda a: pow(ob.high[a] - ob.low[a], 2)))) + sqrt(list_sum(list_transform([1, 2, 3], lambda a: pow(round(o.high[a] - o.low[a], 6), 2))))) * 0.5::DOUBLE, 0.5::DOUBLE)),
              exp(-greatest(0, ob.frame - o.last)::DOUBLE / 60.0::DOUBLE)])) AS parts
          FROM steps s JOIN ob ON ob.scene = s.scene AND ob.turn = s.turn + 1))))
), log AS (
  SELECT s.scene, ob.obs, ob.frame, ob.label, ob.low, ob.high, ob.points, ob.score AS box_score, entry.action AS action, format('obj_{:06d}', entry.object) AS object_id, CASE WHEN entry.best IS NOT NULL THEN format('obj_{:06d}', entry.best) END AS best_id, entry.score AS score, entry.parts AS parts
  FROM steps s JOIN ob ON ob.scene = s.scene AND ob.turn = s.turn WHERE s.turn > 0)"""
_FOLD = "WITH RECURSIVE " + _V_FOLD
SQL["t05_association"] = _FOLD + " SELECT scene, obs, frame, action, object_id, best_id, floor(score*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS score, " + ", ".join(f"floor(parts[{i + 1}]*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS {p}" for i, p in enumerate(S.PARTS)) + " FROM log"


def t05_objects(spark, sf_dir: str) -> DataFrame:
    """The objects that the association makes, their labels, support, points and boxes."""
    o = scene_observations(spark, sf_dir)
    log = store(S.fold(o)).df
    t = S.object_table(o, log)
    whole = lambda c: F.floor(c * 1e6 + 0.5).cast("bigint")
    return t.select("scene", "object_id", "status", "label", F.concat_ws(",", "aliases").alias("aliases"), "first_frame", "last_frame", "frames", "seen", "points", whole(F.col("mean_score")).alias("mean_score"), *[whole(F.col(c)[i]).alias(f"{c}_{a}") for c in ("low", "high", "center") for i, a in enumerate("xyz")])


QUERIES["t05_objects"] = t05_objects
SQL["t05_objects"] = _FOLD + """, n AS (SELECT scene, object_id, label, count(*) AS n FROM log WHERE object_id IS NOT NULL GROUP BY ALL),
l AS (SELECT scene, object_id, arg_min(label, struct_pack(n := -n, l := label)) AS label, string_agg(label, ',' ORDER BY label) AS aliases FROM n GROUP BY ALL),
p AS (SELECT scene, object_id, count(DISTINCT point) AS points FROM (SELECT scene, object_id, unnest(points) AS point FROM log WHERE object_id IS NOT NULL) GROUP BY ALL),
w AS (SELECT scene, object_id, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS frames, count(*) AS seen, avg(box_score) AS mean_score, """ + ", ".join(f"min(low[{i}]) AS low{i}, max(high[{i}]) AS high{i}" for i in (1, 2, 3)) + """ FROM log WHERE object_id IS NOT NULL GROUP BY scene, object_id)
SELECT scene, object_id, CASE WHEN seen > 1 AND (frames >= 2 OR seen >= 3) THEN 'confirmed' ELSE 'candidate' END AS status, label, aliases, first_frame, last_frame, frames, seen, points, floor(mean_score*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS mean_score, """ + ", ".join(
    f"floor({x}*1e6::DOUBLE+0.5::DOUBLE)::BIGINT AS {name}_{a}" for i, a in enumerate("xyz", 1) for name, x in (("low", f"low{i}"), ("high", f"high{i}"), ("center", f"round((low{i}+high{i})*0.5::DOUBLE, 6)"))
) + " FROM w JOIN l USING (scene, object_id) JOIN p USING (scene, object_id)"


def a17_frame_events(spark, sf_dir: str) -> DataFrame:
    e = S.frame_events(S.fold(scene_observations(spark, sf_dir)))
    return e.select("scene", "frame", F.size("events").alias("n_events"), F.to_json("events").alias("events"), F.to_json("counts").alias("counts"))


QUERIES["a17_frame_events"] = a17_frame_events
SQL["a17_frame_events"] = _FOLD + """, e AS (SELECT scene, frame, obs, action, object_id FROM log WHERE object_id IS NOT NULL)
SELECT scene, frame, count(*)::INT AS n_events, '[' || string_agg('{"obs":' || obs || ',"action":"' || action || '","object_id":"' || object_id || '"}', ',' ORDER BY obs) || ']' AS events,
 '{' || concat_ws(',', CASE WHEN count(*) FILTER (WHERE action = 'match') > 0 THEN '"match":' || count(*) FILTER (WHERE action = 'match') END, CASE WHEN count(*) FILTER (WHERE action = 'new') > 0 THEN '"new":' || count(*) FILTER (WHERE action = 'new') END) || '}' AS counts FROM e GROUP BY scene, frame"""


def t05_stream_association(spark, sf_dir: str) -> DataFrame:
    """The association as a stream over the events' file, objects kept as state."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = f"{scratch_root(spark)}/fold-{uuid.uuid4().hex}"
    return _log_rows(run_once(S.fold_stream(scene_observations(spark, sf_dir, P.event_observations(stream))), out + "/checkpoint", out + "/rows"))


QUERIES["t05_stream_association"] = t05_stream_association
SQL["t05_stream_association"] = SQL["t05_association"]


def a13_running_mean(spark, sf_dir: str) -> DataFrame:
    """The running mean of a user's values, as whole millionths, and how many places there were so far: each counts where it first comes."""
    w = Window.partitionBy("user").orderBy("frame", "obs").rowsBetween(Window.unboundedPreceding, 0)
    o = P.observations(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    first = F.col("k").isNotNull() & (F.row_number().over(Window.partitionBy("user", "k").orderBy("frame", "obs")) == 1)
    o = o.withColumn("new", first.cast("bigint"))
    return o.select("obs", F.floor(F.sum("cents").over(w) * 10000.0 / F.count("*").over(w) + 0.5).cast("bigint").alias("mean"), F.sum("new").over(w).alias("places"))


QUERIES["a13_running_mean"] = a13_running_mean
SQL["a13_running_mean"] = P.with_views(P.V_OBS) + """ SELECT obs, floor(sum(round(value*100)::BIGINT) OVER w * 10000.0::DOUBLE / count(*) OVER w + 0.5::DOUBLE)::BIGINT AS mean, (count(DISTINCT k) OVER w)::BIGINT AS places
 FROM v_obs WINDOW w AS (PARTITION BY user ORDER BY frame, obs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
