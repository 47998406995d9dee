"""Operators on hand-made tables: thresholds, ties, empty input, and plain models of what they do."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import geometry as G
from skein.functions import labels as L
from skein.operators import associate, audit, detect, lift, pairs, resolve, scene, spatial, tags
from skein.operators.components import connected_components


def values(spark, column, *data):
    """What a Column builder makes of one string column's values."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_forms(spark):
    raw = (None, "", " \t A_Red  Chair\n", "_chair", "the table", "Another Lamp")
    assert values(spark, L.plain, *raw) == ["", "", "a red  chair", " chair", "the table", "another lamp"]
    assert values(spark, L.collapsed, *raw) == ["", "", "a red chair", "chair", "the table", "another lamp"]
    assert values(spark, L.without_article, *raw) == ["", "", "red chair", "chair", "table", "another lamp"]
    assert values(spark, L.tokens, "glass doors", "gas", "") == [["glass", "glas", "doors", "door"], ["gas"], []]
    assert values(spark, L.slug, "Coffee  Table!", "--", "é") == ["coffee_table", "object", "object"]
    assert values(spark, L.frame_number, "frame_000123", "no number", "7x") == [123, None, None]
    assert values(spark, L.split_tags, "a | b,c ;\n d", "") == [["a", "b", "c", "d"], []]
    assert values(spark, L.family, "stool", "desk lamp", "sofa", "person") == ["chair", "table", "sofa", None]
    assert values(spark, L.family_wide, "arm sofa", "laptop", "human") == ["sofa", "computer", "person"]


def test_label_pairs(spark):
    rows = [("sofa", "sofa", None, 1.0), ("chair", "office chair", None, 0.8), ("", "x", None, 0.8), ("red cup", "blue cup", None, 0.35), ("lamp", "desk", None, 0.2), ("a", "b", 1.7, 1.0), ("a", "b", -1.0, 0.0), ("w x y z", "w x y q", None, 0.6)]
    df = spark.createDataFrame(rows, "a string, b string, s double, want double")
    assert all(math.isclose(r.got, r.want) for r in df.select("want", L.similarity(F.col("a"), F.col("b"), F.col("s")).alias("got")).collect())
    fine = spark.createDataFrame([("table", "coffee table", "coffee table"), ("a b", "c", "a b"), ("a b", "c d", None), ("", "x", None), ("x", "x", None)], "a string, b string, w string")
    assert all(r.g == r.w for r in fine.select("w", L.more_specific(F.col("a"), F.col("b")).alias("g")).collect())
    clean = spark.createDataFrame([(["The Cup", "cup", "12", "x", "Red_Cup"],)], "t array<string>")
    assert clean.select(L.clean_tags(F.col("t"), 5, 2).alias("c")).first().c == ["cup", "red cup"]


def box(i, x, side, label="cup", **more):
    x = float(x)
    return {"id": i, "label": label, "cx": x, "cy": 0.0, "cz": 0.0, "x0": x - side / 2, "x1": x + side / 2, "y0": -side / 2, "y1": side / 2, "z0": -side / 2, "z1": side / 2,
            "frames": 5, "seen": 8, "points": 1000, "status": "confirmed", "box_score": 0.5, **more}


BOX = "id long, label string, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, frames long, seen long, points long, status string, box_score double"


def boxes(spark, *rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in BOX.split(", ")) for r in rows], BOX)


def test_boxes_meet_once(spark):
    rng = random.Random(5)
    rows = [box(i, rng.uniform(-2, 2), rng.uniform(0.01, 1.5)) for i in range(40)]
    df = boxes(spark, *rows)
    for cell, reach in ((0.3, 0.0), (5.0, 0.0), (0.4, 0.5)):
        got = [(r.a, r.b) for r in spatial.overlapping_boxes(df, cell, reach).collect()]
        want = {(a["id"], b["id"]) for a, b in itertools.combinations(rows, 2) if a["x0"] - reach <= b["x1"] and b["x0"] - reach <= a["x1"]}
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_by_rounds(spark):
    rng = random.Random(6)
    spots = [(i, rng.gauss(0, 1), rng.gauss(0, 1), 0.0) for i in range(60)] + [(900, 500.0, 0.0, 0.0), (901, 0.0, 0.0, 0.0), (902, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(spots, "id long, x double, y double, z double")
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest(df, 3, 0.1).collect()}
    for s in spots:
        order = sorted((math.dist(s[1:], o[1:]), o[0]) for o in spots if o[0] != s[0])
        assert [got[s[0], k] for k in (1, 2, 3)] == [o for _, o in order[:3]]
    assert spatial.nearest(df.limit(1), 3, 0.1).count() == 0


def test_nearest_at_any_distance(spark):
    """Far points find their neighbours, coordinates that are no numbers have none, and fewer points than asked for give all there are."""
    spots = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 5e6, 0.0, 0.0), (4, -9e12, 2.0, 0.0)]
    bad = [(5, float("nan"), 0.0, 0.0), (6, float("inf"), 0.0, 0.0), (7, None, 0.0, 0.0)]
    df = spark.createDataFrame(spots + bad, "id long, x double, y double, z double")
    got = {(r.id, r.other, r["rank"]) for r in spatial.nearest(df, 1, 0.1).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 1, 1)}
    assert spatial.nearest(df, 9, 0.1).count() == 12
    same = spark.createDataFrame([(i, 7.0, 7.0, 7.0) for i in range(50)], "id long, x double, y double, z double")
    assert {(r.id, r.other) for r in spatial.nearest(same, 1, 0.1).collect()} == {(i, int(i == 0)) for i in range(50)}


@pytest.mark.parametrize("meetings", [0, 200])  # by the rarest items, and by all that meet
@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_set_overlap_loses_no_pair(spark, monkeypatch, least, meetings):
    monkeypatch.setattr(spatial, "MEETINGS", meetings)
    rng = random.Random(7)
    sets = {i: {rng.randrange(30) if rng.random() < 0.9 else 100 + i for _ in range(rng.randrange(1, 20))} for i in range(30)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in [*s, *list(s)[:1]]], "id long, item long")
    got = {(r.a, r.b): r.shared for r in spatial.set_overlap(df, least).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * min(len(sets[a]), len(sets[b]))}
    assert got == want


@pytest.mark.parametrize("least", [0.1, 0.5, 1.0])
def test_heavy_items_are_counted_apart(spark, monkeypatch, least):
    """One item in most sets, some in many, and sets of heavy items alone: the defined pairs, whatever counts as heavy."""
    rng = random.Random(9)
    sets = {i: {rng.randrange(40, 400) for _ in range(rng.randrange(0, 12))} | ({0} if i % 5 else set()) | {rng.randrange(1, 8) for _ in range(rng.randrange(0, 5))} for i in range(150)}
    members = [(i, x) for i, own in sets.items() for x in own]
    df = spark.createDataFrame(members + members[:20], "id long, item long").repartition(5)
    also = [(i, i + 7) for i in range(0, 140, 3)]
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and (n >= least * min(len(sets[a]), len(sets[b])) or (a, b) in also):
                want[a, b] = n
    for meetings, most in ((200, 5000), (5, 5000), (200, 10), (0, 0)):
        monkeypatch.setattr(spatial, "MEETINGS", meetings)
        monkeypatch.setattr(spatial, "MOST", most)
        assert {(r.a, r.b): r.shared for r in spatial.common_counts(df, least, spark.createDataFrame(also, "a long, b long")).collect()} == want


def test_a_heavy_item_makes_no_square(spark):
    """An item of 20,000 sets among others that few share: it meets nobody, and pairs count it all the same."""
    n = 20_000
    df = spark.range(n).select("id", F.explode(F.array(F.lit(-1), F.col("id"), F.floor(F.col("id") / 2) + n, F.floor(F.col("id") / 2) + 2 * n)).alias("item"))
    got = spatial.set_overlap(df, 0.6)
    assert got.agg(F.count("*"), F.min("shared"), F.max("shared")).first() == (n // 2, 3, 3)


@pytest.mark.parametrize("meetings", [0, 200])
def test_pair_relations_at_their_thresholds(spark, monkeypatch, meetings):
    monkeypatch.setattr(spatial, "MEETINGS", meetings)
    df = boxes(spark, box(1, 0.0, 1.0), box(2, 0.0, 0.8), box(3, 0.0, 0.95), box(4, 0.0, 0.8, "bowl"), box(5, 50.0, 1.0), box(6, 51.0, 1.0))
    none = spark.createDataFrame([], "id long, item long")
    got = {(r.a, r.b): r.relation for r in pairs.relate(pairs.pair_evidence(df, none, 1.0)).collect()}
    assert got[1, 2] == "possible_partial_whole_same_label" and got[1, 3] == "possible_duplicate_same_label" and got[1, 4] == "label_conflict_same_region"
    assert (5, 6) not in got
    # points alone are evidence, from 0.35 of the smaller set on
    far = spark.createDataFrame([(5, i) for i in range(20)] + [(6, i) for i in range(13, 33)], "id long, item long")
    found = pairs.relate(pairs.pair_evidence(df, far, 1.0)).where("a = 5").collect()
    assert [(r.b, r.relation, r.point_containment) for r in found] == [(6, "possible_duplicate_same_label", 0.35)]


@pytest.mark.parametrize("block", [64, 2048])
def test_box_evidence_equals_the_pairs_of_members(spark, block):
    """Blocks of any size, boxes without points, points on edges, equal boxes: the rows that members give, and no exchange of pairs."""
    rng = random.Random(11)
    rows = [box(i, rng.choice([0.0, 0.5, rng.uniform(0, 3)]), rng.choice([0.5, 1.0, rng.uniform(0, 1.5)]), rng.choice("abc")) for i in range(150)] + [box(200, 90.0, 1.0), box(201, 90.0, 1.0)]
    df = boxes(spark, *rows)
    points = spark.createDataFrame([(i, rng.choice([0.0, 0.25, 0.5, rng.uniform(0, 3)]), rng.choice([0.0, rng.uniform(-0.5, 0.5)]), 0.0) for i in range(400)] + [(500, None, 0.0, 0.0)], "point long, x double, y double, z double")
    members = spatial.points_in_boxes(points, df, 0.5).select("id", F.col("point").alias("item"))
    names = ["a", "b", "alabel", "blabel", "bseen", "shared", "point_containment", "point_iou", "box_iou", "box_containment", "size_ratio", "distance"]
    want = {tuple(r) for r in pairs.pair_evidence(df, members, 0.5).select(*names).collect()}
    found = pairs.box_evidence(df, points, block=block).select(*names)
    got = found.collect()
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want
    assert (200, 201) in {(r.a, r.b) for r in got if r.shared is None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroups") < plan.index("Exchange")


def test_scene_pairs_are_not_shuffled(spark):
    """A pair that overlaps, is near and is nearest comes once, from the cells, with nothing dealt out after them."""
    df = boxes(spark, box(1, 0.0, 1.0), box(2, 0.4, 1.0), box(3, 2.0, 0.1), box(4, 2.3, 0.1), box(5, 9.0, 1.0))
    found = pairs.scene_relations(df, pairs.SceneRules(near=0.5, neighbours=1))
    assert sorted((r.a, r.b, r.iou > 0, r.distance <= 0.5) for r in found.collect()) == [(1, 2, True, True), (3, 4, False, True), (4, 5, False, False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") < plan.index("Join") < plan.index("Exchange")


def test_merges_that_join_nothing_are_dropped_in_tasks(spark):
    """A crowd of objects that all merge with one another: each task hands on a forest of its merges, and the roots stay."""
    rng = random.Random(3)
    rows = [(f"{n:06d}", *rng.sample(range(60), 2)) for n in range(3000)]
    df = spark.createDataFrame(rows, "ord string, target long, absorbed long").repartition(3)
    assert df.mapInPandas(resolve._joining, df.schema).count() <= 3 * 59
    parent = list(range(60))
    top = lambda x: x if parent[x] == x else top(parent[x])
    for _, t, a in rows:
        if top(a) != top(t):
            parent[top(a)] = top(t)
    assert {r.id: r.root for r in resolve.merge_roots(df).collect()} == {i: top(i) for i in range(60)}


@given(st.lists(st.floats(-5, 5), min_size=12, max_size=12))
@settings(max_examples=20, deadline=None)
def test_box_measures(spark, x):
    names = [f"{p}{a}{k}" for p in "pq" for a in "xyz" for k in (0, 1)]
    pairs_ = [sorted(x[i : i + 2]) for i in range(0, 12, 2)]
    df = spark.createDataFrame([tuple(v for p in pairs_ for v in p)], ", ".join(f"{n} double" for n in names))
    r = df.select(G.iou("p", "q").alias("a"), G.iou("q", "p").alias("b"), G.over_smaller("p", "q").alias("c"), G.smaller_over_larger("p", "q").alias("d")).first()
    assert math.isclose(r.a, r.b, abs_tol=1e-12) and 0 <= r.a <= r.c + 1e-9 <= 1 + 2e-9 and 0 < r.d <= 1


PAIR = "a long, b long, relation string, point_containment double, point_iou double, box_iou double, box_containment double, distance double"


def pair_rows(spark, objects, *rows):
    p = spark.createDataFrame(list(rows), PAIR)
    side = lambda x: objects.select(*[F.col(c).alias(x if c == "id" else x + c) for c in objects.columns])
    return p.join(side("a"), "a").join(side("b"), "b")


def test_suppression_branches(spark):
    o = boxes(spark, box(1, 0, 1, "cup", frames=20, seen=40), box(2, 0, 1, "lamp", frames=3, seen=5), box(3, 0, 1, "plant", frames=9, seen=18), box(4, 0, 1, "red cup", frames=2), box(5, 0, 1, "door", frames=19, seen=44), box(6, 0, 1, "bin", frames=4, seen=9))
    c = "label_conflict_same_region"
    rows = [(1, 2, c, 0.9, 0.30, 0.0, 0.0, 9.0), (1, 3, c, 0.9, 0.5, 0.0, 0.0, 9.0), (1, 4, c, 0.9, 0.5, 0.5, 0.0, 0.1), (1, 5, c, 0.9, 0.5, 0.5, 0.5, 0.1), (1, 6, c, 0.0, 0.29, 0.5, 0.5, 0.1), (5, 6, c, 0.0, 0.3, 0.0, 0.0, 0.6)]
    got = {(r.suppressed, r.keeper) for r in resolve.suppressions(pair_rows(spark, o, *rows)).collect()}
    # 3 has too many frames to be weak and less than four times as many stand against it; 4 is a cup too; 5 is too close in support
    assert got == {(2, 1), (6, 5)}
    assert resolve.suppressions(pair_rows(spark, o, *rows), resolve.SuppressRules(protect=("lamp",))).where("suppressed = 2").count() == 0
    listed = resolve.suppressions(pair_rows(spark, o, *rows), resolve.SuppressRules(suppress=("plant",))).collect()
    assert [(r.suppressed, r.keeper, r.reason) for r in listed] == [(3, 1, "weaker_suppress_label_conflict_same_region")]


def test_merge_branches(spark):
    o = boxes(spark, *[box(i, 0, 1 + i / 100, label) for i, label in enumerate(["chair", "chair", "table", "table", "cup", "cup", "desk", "coffee table", "couch", "sofa", "lamp"])])
    part, dup, con = "possible_partial_whole_same_label", "possible_duplicate_same_label", "label_conflict_same_region"
    cases = [
        ((0, 1, dup, 0.9, 0.85, 0.80, 0.9, 0.10), "chair_like_near_exact_duplicate"), ((0, 1, dup, 0.9, 0.84, 0.80, 0.9, 0.10), "chair_like_preserve_instances"),
        ((2, 3, part, 0.60, 0.0, 0.0, 0.70, 0.0), "table_partial_whole"), ((2, 3, part, 0.59, 0.0, 0.0, 0.70, 0.0), "table_overlap_too_weak"),
        ((2, 3, dup, 0.0, 0.35, 0.0, 0.0, 0.0), "table_duplicate"), ((2, 3, dup, 0.1, 0.3, 0.0, 0.0, 0.0), "table_duplicate_too_weak"),
        ((4, 5, part, 0.80, 0.0, 0.0, 0.80, 0.0), "generic_partial_whole"), ((4, 5, part, 0.79, 0.9, 0.0, 0.80, 0.0), "generic_overlap_too_weak"),
        ((4, 5, dup, 0.8, 0.0, 0.0, 0.8, 0.0), "generic_duplicate"), ((4, 5, dup, 0.8, 0.34, 0.0, 0.7, 0.0), "generic_duplicate_too_weak"),
        ((3, 6, con, 0.0, 0.5, 0.2, 0.0, 9.0), "semantic_near_synonym_duplicate"), ((3, 6, con, 0.7, 0.0, 0.0, 0.7, 0.45), "semantic_near_synonym_partial_whole"), ((3, 6, con, 0.7, 0.0, 0.0, 0.7, 0.46), "semantic_near_synonym_overlap_too_weak"),
        ((3, 7, con, 0.0, 0.65, 0.35, 0.0, 9.0), "semantic_parent_child_duplicate"), ((3, 7, con, 0.85, 0.0, 0.0, 0.8, 0.36), "semantic_parent_child_overlap_too_weak"),
        ((8, 9, con, 1.0, 1.0, 1.0, 1.0, 0.0), "semantic_same_object_alias_not_mergeable"), ((4, 10, con, 1.0, 1.0, 1.0, 1.0, 0.0), "semantic_relation_unknown"),
    ]
    from skein.plans.proxies import label_pairs

    for row, reason in cases:
        r = resolve.merge_decisions(pair_rows(spark, o, row), label_pairs(spark)).first()
        assert r.reason == reason and r["merge"] == reason.endswith(("_duplicate", "_partial_whole")), row
        assert (r.target is not None) == r["merge"]
    assert resolve.merge_decisions(pair_rows(spark, o, cases[2][0]), label_pairs(spark)).first().target == 3  # the larger whole
    assert resolve.merge_decisions(pair_rows(spark, o, cases[13][0]), label_pairs(spark)).first().target == 7  # the more specific label


def test_merge_roots_follow_the_order(spark):
    a = [(1, 10, 11), (2, 12, 11), (3, 12, 10), (4, 20, 21)]
    got = {r.id: (r.component, r.root) for r in resolve.merge_roots(spark.createDataFrame(a, "ord long, target long, absorbed long")).collect()}
    assert got == {10: (10, 12), 11: (10, 12), 12: (10, 12), 20: (20, 20), 21: (20, 20)}
    b = [(o, t, x) for o, t, x in [(2, 10, 11), (1, 12, 11)]]
    got = {r.id: r.root for r in resolve.merge_roots(spark.createDataFrame(b, "ord long, target long, absorbed long")).collect()}
    assert got == {10: 10, 11: 10, 12: 10}


def test_merge_roots_of_large_groups_go_block_by_block(spark):
    """A chain, a star, dense groups and small ones, in blocks of few merges and in one: the roots of a plain union-find."""
    rng = random.Random(5)
    merges = [(x, x + 1) if rng.random() < 0.5 else (x + 1, x) for x in range(60)] + [(200, 201 + i) if i % 3 else (201 + i, 200) for i in range(40)]
    merges += [(rng.randrange(400, 420), rng.randrange(400, 420)) for _ in range(60)] + [(500, 501)]
    merges = [(t, a) for t, a in merges if t != a]
    order = rng.sample(range(len(merges)), len(merges))
    rows = [(o, t, a) for o, (t, a) in zip(order, merges, strict=True)]
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for _, t, a in sorted(rows):
        t, a = top(t), top(a)
        if t != a:
            parent[a] = t
    want = {x: top(x) for m in merges for x in m}
    df = spark.createDataFrame(rows, "ord long, target long, absorbed long").repartition(3)
    for most in (23, 1000):
        assert {r.id: r.root for r in resolve.merge_roots(df, most).collect()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_components_under_any_order(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)]
    first = sorted(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    edges = [e[:: rng.choice((1, -1))] for e in rng.sample(edges, len(edges))]
    assert first == sorted(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))


@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6), st.sampled_from([float("nan"), float("inf"), None])), max_size=30))
@settings(max_examples=8, deadline=None)
def test_whole_summary_equals_the_aggregate(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got, want = audit.whole_summary(df, "v", "v").first(), df.agg(*audit.summary("v", "v")).first()
    assert got.asDict().keys() == want.asDict().keys()
    for a, b in zip(got, want, strict=True):
        assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    r = df.agg(*audit.summary("v", "v")).first()
    assert r.v_count == 0 and all(x is None for x in list(r)[1:])


def test_gate_and_prompts(spark):
    d = spark.createDataFrame([(1, "p", 0.9, 0.6, 0.3, 1), (1, "p", 0.8, 0.59, 0.01, 2), (1, "p", 0.7, 0.9, 0.01, 3), (1, "p", 0.6, 0.9, 0.9, 4), (2, "p", 0.9, 0.1, 0.3, 5), (2, "p", 0.8, 0.9, 0.9, 6)], "frame long, prompt string, box_score double, mask_score double, area double, tie int")
    g = detect.gated(detect.top_detections(d, 5))
    assert [(r.tie, r.reason, r.instance) for r in g.orderBy("tie").collect()] == [(1, None, 0), (2, "low_mask_score", None), (3, "area_too_small", None), (4, "area_too_large", None), (5, "low_mask_score", None), (6, "area_too_large", None)]
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "frame long, prompt string")
    assert {r.frame: r.status for r in detect.prompt_results(g, prompts).collect()} == {1: "accepted", 2: "area_too_large,low_mask_score", 3: "no_detection"}


def test_two_blobs(spark):
    blob = lambda n, x: [(1, n + i, x + 0.05 * (i % 5), 0.0, 0.05 * (i // 5)) for i in range(20)]
    df = spark.createDataFrame(blob(0, 0.0) + blob(100, 3.0)[:7], "set long, point long, x double, y double, z double")
    parts = lift.voxel_components(df, 0.08)
    assert {(r.component, r["count"]) for r in parts.groupBy("component").count().collect()} == {(0, 20), (100, 7)}
    kept = lift.chosen_components(parts, lift.LiftRules(component_points=8, component_ratio=0.0)).collect()
    assert [(r.component, r.place) for r in kept] == [(0, 0)]


@pytest.mark.parametrize("points_a_cell", [1, 64])
def test_cameras_find_all_points_by_cells(spark, monkeypatch, points_a_cell):
    """What cells lead to is what trying each point with each camera gives; turned cameras, points on image edges, undefined places."""
    monkeypatch.setattr(lift, "CELL_POINTS", points_a_cell)
    rng = np.random.default_rng(4)
    cameras = []
    for k in range(12):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        pose = np.eye(4)
        pose[:3, :3], pose[:3, 3] = turn, rng.uniform(-2, 2, 3)
        cameras.append(lift.Camera(k, tuple(map(tuple, pose.tolist())), 40.0, 55.0, 20.0, 15.0, 40, 30))
    cameras.append(lift.Camera(99, tuple(map(tuple, np.eye(4).tolist())), 10.0, 10.0, 4.0, 4.0, 9, 9))
    xyz = rng.uniform(-3, 3, (700, 3))
    edges = [(x, y, 1.0) for x in (-0.45, -0.4501, 0.45, 0.4499, 0.0) for y in (-0.45, 0.45, 0.449)]
    xyz = np.concatenate([xyz, edges])
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)] + [(10_000, math.nan, 0.0, 1.0), (10_001, 0.0, math.inf, 1.0), (10_002, None, 0.0, 1.0)]
    got = {(r.camera, r.point): (r.u, r.v) for r in lift.visible(spark.createDataFrame(rows, "point long, x double, y double, z double"), lift.camera_table(spark, cameras)).collect()}
    want = {}
    for c in cameras:
        m = np.array(c.inverse())
        for i, (x, y, z) in enumerate(xyz.tolist()):
            a, b, depth = (m[k, 0] * x + m[k, 1] * y + m[k, 2] * z + m[k, 3] for k in range(3))
            if depth > 1e-6:
                u, v = np.rint(c.fx * a / depth + c.cx), np.rint(c.fy * b / depth + c.cy)
                if 0 <= u < c.width and 0 <= v < c.height:
                    want[c.camera, i] = (int(u), int(v))
    assert got == want and len({k for k, _ in want}) > 8
    assert lift.visible(spark.createDataFrame([], "point long, x double, y double, z double"), lift.camera_table(spark, cameras)).count() == 0


def test_lift_and_frame_status(spark):
    rows = [(1, False, True, 9, 9, 1), (2, True, False, 9, 9, 1), (3, True, True, 0, 0, 0), (4, True, True, 100, 29, 1), (5, True, True, 1000, 30, 1), (6, True, True, 100, 30, 0), (7, True, True, 100, 30, 2)]
    df = spark.createDataFrame(rows, "obs long, has_mask boolean, mask_ok boolean, visible long, hits long, components int")
    got = {r.obs: r.reason for r in lift.lift_status(df, lift.LiftRules(least_ratio=0.1)).collect()}
    assert got == {1: "missing_mask", 2: "failed_read_mask", 3: "no_visible_points", 4: "too_few_hit_points", 5: "hit_ratio_too_low", 6: "no_valid_component", 7: None}
    poses = spark.createDataFrame([([float(i) for i in range(16)],), ([1.0],), (None,)], "p array<double>").select(lift.pose_rows(F.col("p")).alias("r")).collect()
    assert poses[0].r[1] == [4.0, 5.0, 6.0, 7.0] and poses[1].r is None and poses[2].r is None


def test_numbers_over_all_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(7)
    got = [(r.k, r.number) for r in lift.numbered(df, "k", "id").orderBy("k", "id").collect()]
    assert [n for _, n in got] == list(range(1000))


OBS = "scene long, obs long, frame long, label string, low array<double>, high array<double>, center array<double>, points array<long>, score double"


def observation(obs, frame, label, x, points, scene=1):
    return (scene, obs, frame, label, [x - 0.25] * 3, [x + 0.25] * 3, [x] * 3, points, 0.5)


def test_fold_branches(spark):
    p = list(range(10))
    rows = [observation(1, 0, "cup", 0.0, p), observation(2, 1, "cup", 0.01, p), observation(3, 1, "door", 0.0, p), observation(4, 2, "cup", 0.0, None), observation(5, 2, "cup", 9.0, [99]), observation(6, 3, "cups", 0.0, p), observation(1, 0, "cup", 0.0, p, scene=2)]
    for n in (1, 5):
        log = associate.fold(spark.createDataFrame(rows, OBS).repartition(n))
        got = {(r.scene, r.obs): (r.action, r.object_id) for r in log.collect()}
        assert got == {(1, 1): ("new", "obj_000000"), (1, 2): ("match", "obj_000000"), (1, 3): ("new", "obj_000001"), (1, 4): ("skipped_missing_hit_points", None), (1, 5): ("new", "obj_000002"), (1, 6): ("match", "obj_000000"), (2, 1): ("new", "obj_000000")}
        events = {(r.scene, r.frame): (len(r.events), r.counts) for r in associate.frame_events(log).collect()}
        assert events[1, 1] == (2, {"match": 1, "new": 1}) and (1, 2) in events and events[1, 2][0] == 1


def test_confirmation_comes_with_updates():
    from types import SimpleNamespace

    s = associate.Scene(associate.FoldRules(confirm_frames=1))
    row = lambda obs, frame, label="cup": SimpleNamespace(obs=obs, frame=frame, label=label, low=[0.0] * 3, high=[1.0] * 3, center=[0.5] * 3, points=[1, 2], score=0.4)
    s.step(row(1, 0))
    assert s.objects[0].status == "candidate"
    s.step(row(2, 0, "cups"))
    assert s.objects[0].status == "confirmed" and s.objects[0].label == "cup" and s.objects[0].seen == 2


def test_weights():
    assert associate.parse_weights(" ") == associate.WEIGHTS
    w = associate.parse_weights("bbox_iou=1,point_overlap=0")
    assert math.isclose(sum(w.values()), 1) and w["point_overlap"] == 0
    for bad in ("depth=1", "bbox_iou=0,point_overlap=0,semantic_similarity=0,center_distance_score=0,temporal_consistency=0"):
        with pytest.raises(ValueError):
            associate.parse_weights(bad)


def test_greedy_groups(spark):
    words = ["blue cup", "cup", "lamp", "red cup", "red lamp", "sofa"]
    labels = spark.createDataFrame([("s", w) for w in words], "scope string, label string")
    got = {}
    for r in tags.greedy_groups(tags.lexical_edges(labels.select("label")), labels).collect():
        got.setdefault(r.group_id, []).append(r.label)
    assert {k: sorted(v) for k, v in got.items()} == {"group_000": ["blue cup", "cup", "red cup"], "group_001": ["lamp", "red lamp"]}


def test_model_boundary_isolates_rows(spark):
    def model(batch):
        if (batch["k"] == 3).any():
            raise RuntimeError("bad row")
        return batch.assign(v="ok")

    df = spark.range(6).withColumnRenamed("id", "k")
    got = {r.k: (r.v, r.error) for r in tags.apply_model(df, model, "k bigint, v string, error string").collect()}
    assert got[3] == (None, "RuntimeError: bad row") and all(got[k] == ("ok", None) for k in (0, 1, 2, 4, 5))


def test_one_bad_row_leaves_its_neighbours_large_calls_in_many_tasks(spark):
    def model(batch):
        if (batch["k"] == 700).any():
            raise RuntimeError("bad row")
        return batch.assign(n=len(batch))

    df = spark.range(1000).coalesce(1).withColumnRenamed("id", "k")
    got = {r.k: (r.n, r.error) for r in tags.apply_model(df, model, "k bigint, n bigint, error string").collect()}
    assert len(got) == 1000 and got[700] == (None, "RuntimeError: bad row")
    assert sum(1 / n for k, (n, _) in got.items() if k != 700) < 30  # calls that went well
    few = tags.apply_model(df, lambda batch: batch.assign(n=len(batch)), "k bigint, n bigint, error string", batch_rows=16)
    assert few.select(F.spark_partition_id()).distinct().count() > 1 and {r.n for r in few.collect()} <= set(range(1, 17))


def test_errors_of_the_model_itself_and_busy_services(spark):
    def model(batch, calls=[]):  # noqa: B006  a worker's own count of its calls
        calls.append(len(batch))
        if len(batch) > 1 or len(calls) % 3:
            raise RuntimeError("busy")
        return batch.assign(v="ok", error=["refused" if k == 2 else None for k in batch["k"]])

    df = spark.range(4).coalesce(1).withColumnRenamed("id", "k")
    got = {r.k: (r.v, r.error) for r in tags.apply_model(df, model, "k bigint, v string, error string", retries=3).collect()}
    assert got == {0: ("ok", None), 1: ("ok", None), 2: ("ok", "refused"), 3: ("ok", None)}


def test_segments_and_pairs_asked_of_models(spark):
    def segmenter(batch):
        assert (batch["boxes"].map(len) > 0).all()
        return batch.assign(masks=batch["boxes"].map(lambda b: [bytes([len(x)]) for x in b]), scores=batch["boxes"].map(lambda b: [0.5] * len(b)))[["image", "masks", "scores"]]

    rows = spark.createDataFrame([("a", [[0.0, 1.0]]), ("b", []), ("c", None)], "image string, boxes array<array<double>>")
    got = {r.image: (r.masks, r.scores, r.error) for r in tags.segment(rows, segmenter).collect()}
    assert got == {"a": ([bytearray([2])], [0.5], None), "b": ([], [], None), "c": ([], [], None)}

    def grouper(batch):
        assert len(batch) <= tags.PAIRS_A_CALL
        turned = batch[batch["label_a"] != "p000"].iloc[::-1].rename(columns={"label_a": "label_b", "label_b": "label_a"})  # one is forgotten, all come back the other way round
        turned = turned.assign(relation="same", similarity=0.9, error=["refused" if b == "p001" else None for b in turned["label_b"]])
        extra = turned.iloc[:1].assign(label_a="never", label_b="asked", error=None)
        return pd.concat([turned, turned.iloc[:1].assign(similarity=0.1), extra])[["label_a", "label_b", "relation", "similarity", "error"]]

    pairs = [(f"p{i:03d}", "z") for i in range(200)] + [("z", "p007"), ("z", "z")]
    got = {(r.label_a, r.label_b): (r.relation, r.similarity, r.error) for r in tags.ask_pairs(spark.createDataFrame(pairs, "label_a string, label_b string"), grouper).collect()}
    assert got == {(f"p{i:03d}", "z"): (None, None, "no reply") if i == 0 else ("same", 0.9, "refused" if i == 1 else None) for i in range(200)}


def test_model_calls_are_batched_and_tried_again(spark):
    def detector(batch, tried=[]):  # noqa: B006  a worker's own memory of what it has failed once
        assert len(batch) <= 2
        key = batch["image"].iloc[0]
        if key not in tried:
            tried.append(key)
            raise RuntimeError("busy")
        return batch.assign(boxes=[[[0.0, 0.0, 1.0, 1.0]]] * len(batch), scores=[[0.5]] * len(batch), labels=[["x"]] * len(batch))

    df = spark.createDataFrame([(f"i{k}", "chair") for k in range(5)], "image string, prompt string").coalesce(1)
    got = tags.apply_model(df, detector, tags.MODEL_SCHEMAS["detector"], batch_rows=2, retries=1).collect()
    assert len(got) == 5 and all(r.error is None and r.boxes == [[0.0, 0.0, 1.0, 1.0]] for r in got)


def test_scene_pieces(spark):
    c = {r.label: (r.place, r.r, r.g, r.b) for r in scene.label_colors(spark.createDataFrame([("b",), ("a",), ("b",)], "label string")).collect()}
    assert c["a"] == (0, 242, 68, 68) and c["b"][0] == 1
    e = scene.edge_points(boxes(spark, box(1, 0.0, 2.0)), 3).collect()
    assert len(e) == 36 and all(max(abs(r.x), abs(r.y), abs(r.z)) == 1.0 for r in e)
    assert scene.public(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]


def test_stream_fold_equals_batch(spark, tmp_path):
    from skein.streaming.tasks import run_once

    rng = random.Random(3)
    rows = [observation(i, i // 3, rng.choice(["cup", "lamp", "red cup"]), rng.choice([0.0, 0.1, 5.0]), list(range(rng.randrange(5))) or None, scene=i % 2) for i in range(60)]
    for n in range(3):  # three files, read one a micro-batch, in the order of their frames
        spark.createDataFrame(rows[20 * n : 20 * n + 20], OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], OBS).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_once(associate.fold_stream(stream), str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, associate.fold(spark.createDataFrame(rows, OBS)).collect()))


def test_mask_area_and_depth(spark):
    m = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 3, 3)], "f int, u int, v int")
    assert {r.f: (r.pixels, r.ratio) for r in lift.mask_areas(m, 4, 4, "f").collect()} == {1: (2, 0.125), 2: (1, 0.0625)}
    d = spark.createDataFrame([(0, 0, 0, 1500, 1000.0), (0, 1, 0, 0, 1000.0)], "camera int, u int, v int, raw int, depth_scale double")
    assert [r.measured for r in lift.depth_meters(d).collect()] == [1.5]


def test_nearest_begins_where_points_are_dense(spark):
    """Most points in a tiny cluster, a few far away: the first reach fits the cluster, and all find their neighbours."""
    from skein.operators import spatial

    rnd = random.Random(5)
    rows = [(i, *[0.5 + rnd.random() * 1e-3 for _ in range(3)]) for i in range(300)] + [(300 + i, float(i), 0.0, 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    low = {"x": 0.0, "y": 0.0, "z": 0.0}
    assert 7 / 2**16 <= spatial._near_reach(df, low, 7.0, 2) < 1e-3
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest(df, 2, 10.0).collect()}
    for i, *p in rows:
        want = sorted((math.dist(p, q), j) for j, *q in rows if j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in want]


def test_box_figures_without_rows_of_points(spark, monkeypatch):
    from skein.plans import audit_queries

    rng = np.random.default_rng(5)
    spots = [(i, *map(float, rng.normal(size=3).round(2))) for i in range(300)]
    made = [(i, *[x for c, h in zip(rng.normal(size=3), rng.uniform(0, 1.5, 3), strict=True) for x in (float(c - h), float(c + h))]) for i in range(150)]
    points = spark.createDataFrame(spots, "point long, x double, y double, z double")
    own = spark.createDataFrame(made, "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    members = spatial.points_in_boxes(points, own, 0.5)
    for plain, inner in ((audit.percentile_boxes, audit.inner_percentile_boxes), (audit.oriented_boxes, audit.inner_oriented_boxes)):
        want = plain(members, points)
        got = {r.id: tuple(r) for r in inner(own, points).select(*want.columns).collect()}
        want = {r.id: tuple(r) for r in want.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    monkeypatch.setattr(spatial, "points_in_boxes", lambda *_: pytest.fail("a row for each point in a box"))
    for name in ("a11_percentile_box", "a23_oriented_box"):
        assert audit_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_set_overlap_moves_no_row_for_a_meeting(spark, monkeypatch):
    """Two blocks of sets against plain counts; each item's sets go out as lists."""
    monkeypatch.setattr(spatial, "SETS", 16)
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(40), rng.randint(1, 9))) for i in range(40)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item long")
    counts = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    for least in (None, 0.5):
        want = {k: n for k, n in counts.items() if n and (least is None or n >= least * min(len(sets[k[0]]), len(sets[k[1]])))}
        found = spatial._counted(df, least)
        assert {(r.a, r.b): r.shared for r in found.collect()} == want
    assert spatial._counted(df.limit(0)).count() == 0
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().sparkPlan().toString()
