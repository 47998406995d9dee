"""The association's index against a fold that scores every object, and the objects made from the log."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest

from skein.operators import associate

OBS = "scene long, obs long, frame long, label string, low array<double>, high array<double>, center array<double>, points array<long>, score double"
LABELS = ["cup", "cups", "red cup", "lamp", "door", "x", "desk lamp"]


class Plain(associate.Scene):
    """Scores all objects, in the order they were made."""

    def _near_best(self, row, center, size):
        return list(range(len(self.objects)))


def world(seed, n, spread):
    """Observations of boxes in a cube, some on whole coordinates so that scores tie, with points that several share."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = [rng.choice([rng.uniform(-spread, spread), float(round(rng.uniform(-spread, spread)))]) for _ in range(3)]
        r = rng.choice([0.0, 0.1, 0.25, 0.5, 2.0])
        points = [rng.randrange(int(50 * spread)) for _ in range(rng.randrange(1, 8))]
        out.append(SimpleNamespace(obs=i, frame=i // 3, label=rng.choice(LABELS), low=[x - r for x in c], high=[x + r for x in c], center=None if rng.random() < 0.3 else c, points=points, score=rng.choice([None, rng.random()])))
    return out


@pytest.mark.parametrize("rules", [associate.FoldRules(), associate.FoldRules(window=0, threshold=0.4), associate.FoldRules(weights=associate.parse_weights("point_overlap=0,bbox_iou=0")), associate.FoldRules(known={("cup", "lamp"): 0.9, ("x", "door"): 0.1})])
@pytest.mark.parametrize("spread", [2, 10, 40])
def test_index_equals_plain_fold(rules, spread):
    rows = world(spread, 400, spread)
    plain = Plain(rules)
    want = [plain.follow(r) for r in rows]
    for few, cells in ((4, 40), (4, 1024), (64, 1024), (10_000, 1)):
        scene = associate.Scene(rules, few)
        scene.MANY_CELLS = cells
        assert [scene.follow(r) for r in rows] == want
        assert [(o.label, o.labels, o.status, o.low, o.high, o.points, o.frames) for o in scene.objects] == [(o.label, o.labels, o.status, o.low, o.high, o.points, o.frames) for o in plain.objects]


def test_few_objects_are_tried_where_they_lie_apart():
    """Observations of places far from one another: what is scored for each doesn't grow with the scene."""
    tried = []
    for n in (500, 2000):
        scene = associate.Scene(associate.FoldRules())
        for i in range(n):
            x = 3.0 * (i % 997)
            scene.follow(SimpleNamespace(obs=i, frame=i // 50, label="cup", low=[x, 0.0, 0.0], high=[x + 1, 1.0, 1.0], center=None, points=[i % 997], score=0.5))
        tried.append(scene.tried / n)
    assert tried[0] < 64 and tried[1] < 64


def test_objects_from_the_log(spark):
    rules = associate.FoldRules()
    rows, want, points = [], {}, {}
    for k in range(3):
        scene = Plain(rules)
        for r in world(k, 150, 3):
            rows.append((k, r.obs, r.frame, r.label, r.low, r.high, r.center, r.points, r.score))
            scene.follow(r)
        for i, o in enumerate(scene.objects):
            want[k, f"obj_{i:06d}"] = (o.status, o.label, sorted(o.labels), o.labels, o.first, o.last, len(o.frames), o.seen, len(o.points), o.low, o.high, o.center, o.size, round(o.score, 9))
            points[k, f"obj_{i:06d}"] = o.points
    rows += [(0, 900, 900, "cup", [0.0] * 3, [1.0] * 3, None, None, 0.5), (None, 901, 900, "cup", [0.0] * 3, [1.0] * 3, None, [1], 0.5), (7, 902, 0, None, [0.0] * 3, [1.0] * 3, None, [1, 1], None)]
    df = spark.createDataFrame(rows, OBS).repartition(5)
    log = associate.fold(df, rules).cache()
    assert log.count() == len(rows)
    got = {(r.scene, r.object_id): (r.status, r.label, r.aliases, r.label_counts, r.first_frame, r.last_frame, r.frames, r.seen, r.points, r.low, r.high, r.center, r["size"], round(r.mean_score, 9)) for r in associate.object_table(df, log, rules).collect()}
    assert got.pop((7, "obj_000000"))[:2] == ("candidate", "")
    assert got == want
    held = {}
    for r in associate.object_points(df, log).collect():
        held.setdefault((r.scene, r.object_id), set()).add(r.point)
    held.pop((7, "obj_000000"))
    assert held == points


def test_frame_events_follow_the_scenes_once(spark):
    from skein.plans import lift_queries

    plan = lift_queries.a17_frame_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_lists_of_numbers_are_cut_whole():
    import pyarrow as pa

    for values in ([[1.0, 2.0], None, [], [3.0]], [[1.0, None], [2.0]], [None], []):
        column = pa.array([[9.0], *values], pa.list_(pa.float64())).slice(1)
        assert associate._plain(column) == values


@pytest.mark.parametrize("scores, mean", [([0.1, 0.2, 0.3], 0.6 / 3), ([0.3, 0.2, 0.1], 0.6 / 3), ([None, 0.7, 0.1, 0.2], 0.25), ([float("nan"), 1.0], float("nan")), ([1e300, 2e300], 1.5e300)])
def test_mean_score_in_any_order(spark, scores, mean):
    box = [[0.0] * 3, [1.0] * 3, None, [1]]
    obs = spark.createDataFrame([(1, n, n, "cup", *box, s) for n, s in enumerate(scores)], OBS).coalesce(1)
    log = spark.createDataFrame([(1, n, "obj_000000") for n in range(len(scores))], "scene long, obs long, object_id string").coalesce(1)
    got = associate.object_table(obs, log).first()["mean_score"]
    assert got == mean or got != got and mean != mean
