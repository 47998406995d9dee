"""Labels inside labels, their classes and greedy groups, against plain versions."""

from __future__ import annotations

import random

import pytest

from skein.operators import lexical, tags


def related(a: str, b: str) -> bool:
    return a in b or b in a or bool(set(a.split(" ")) & set(b.split(" ")))


def plain_groups(labels: list[str]) -> dict[str, list[str]]:
    used, out = set(), {}
    for k, label in enumerate(labels := sorted(set(labels))):
        later = [x for x in labels[k + 1 :] if related(label, x)]
        if label not in used and later:
            used |= {label, *later}
            out[f"group_{len(out):03d}"] = sorted([label, *later])
    return out


def grouped(df) -> dict:
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.scope, {}).setdefault(r.group_id, []).append(r.label)
    return {s: {g: sorted(x) for g, x in v.items()} for s, v in got.items()}


def vocabulary(seed: int, n: int, words: int) -> list[str]:
    rnd = random.Random(seed)
    some = ["".join(rnd.choices("abcde", k=rnd.randint(1, 7))) for _ in range(words)]
    return [" ".join(rnd.choices(some, k=rnd.randint(1, 3))) for _ in range(n)]


def test_inside_is_all_pairs(spark):
    labels = [*vocabulary(1, 150, 60), "é", "né é", "arm", "charm bed", "", "tie", "tie"]
    got = [tuple(r) for r in lexical.inside(spark.createDataFrame([(x,) for x in labels] + [(None,)], "label string")).collect()]
    want = {(a, b) for a in labels for b in labels if a and a != b and a in b}
    assert len(got) == len(set(got)) and set(got) == want


def test_classes_tell_the_edges(spark):
    labels = sorted(set(vocabulary(2, 60, 25)))
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    by_word, pairs = {}, set()
    for r in lexical.classes(df).collect():
        if r.kind == "word":
            by_word.setdefault(r.item, []).append(r)
        else:
            pairs.add((min(r.item, r.label), max(r.item, r.label)))
            assert not set(r.item.split(" ")) & set(r.label.split(" "))
    for rows in by_word.values():
        own = sorted(r.label for r in rows)
        assert len(own) > 1 and {(r.first_label, r.n_labels) for r in rows} == {(own[0], len(own))}
        pairs |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :]}
    assert pairs == {tuple(r) for r in tags.lexical_edges(df).collect()} == {(a, b) for a in labels for b in labels if a < b and related(a, b)}


@pytest.mark.parametrize("followed", [0, 40, lexical.FOLLOWED])
def test_groups_by_rounds_and_blocks(spark, followed):
    scopes = {"s": vocabulary(3, 40, 35), "t": vocabulary(4, 10, 5), "alone": ["q"], "none": ["x y", "v w"]}
    rows = [(s, x) for s, v in scopes.items() for x in v]
    labels = spark.createDataFrame([*rows, rows[0], (None, "a"), ("s", None)], "scope string, label string")
    want = {s: g for s, v in scopes.items() if (g := plain_groups(v))}
    assert grouped(lexical.lexical_groups(labels, followed)) == want
    if followed:
        clean = labels.na.drop()
        assert grouped(tags.greedy_groups(tags.lexical_edges(clean.select("label")), clean, followed)) == want


def test_a_chain_is_settled_in_blocks(spark):
    """Each label relates to the next alone: every second one starts a group, whatever the block."""
    n = 500
    labels = [f"w{k:05d} w{k + 1:05d}" for k in range(n)]
    df = spark.createDataFrame([("s", x) for x in labels], "scope string, label string")
    got = grouped(lexical.lexical_groups(df, followed=800))["s"]
    assert got == {f"group_{k // 2:03d}": labels[k : k + 2] for k in range(0, n, 2)}


def test_a_common_word_makes_no_pairs(spark):
    """A word in 20,000 labels of a scope: rows stay as many as labels have words."""
    df = spark.range(20000).selectExpr("'s' AS scope", "format_string('item %06d', id) AS label")
    got = lexical.lexical_groups(df, followed=1000)
    assert [tuple(r) for r in got.groupBy("group_id").count().collect()] == [("group_000", 20000)]


def test_empty_vocabulary(spark):
    none = spark.createDataFrame([], "scope string, label string")
    assert lexical.lexical_groups(none).count() == 0 and lexical.classes(none).count() == 0
    assert tags.greedy_groups(tags.lexical_edges(none), none).count() == 0
