"""Labels that share words or lie inside one another: compact links, and greedy groups by rounds of dependency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import Stored, store
from skein.sources.ship import ship

#: Characters of the parts by which a label is looked for inside others.
WIDTH = 4
#: Rows of one scope that are followed in one task; more are settled by rounds first.
FOLLOWED = 200_000


def words_of(labels: DataFrame) -> DataFrame:
    """labels with a row for each of a label's different words, in `item`."""
    return labels.withColumn("item", F.explode(F.array_distinct(F.split("label", " "))))


def inside(labels: DataFrame) -> DataFrame:
    """(inside, whole): different labels of labels (label) of which one holds the other, each pair once.

    A label asks for others by one part alone, of its parts of WIDTH characters the one that
    the fewest labels have (a shorter label asks by itself), and what it meets is checked. So
    a label has as many rows as characters, and a part that all labels have is asked for only
    by labels made of nothing else. The empty label is inside none; null labels are left out.
    """
    known = labels.select("label").where(F.length("label") > 0).distinct()
    n = F.length("label")

    def parts(width: int) -> DataFrame:
        all_of = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring("label", i, F.lit(width)))
        return known.where(n >= width).select("label", F.explode(F.array_distinct(all_of)).alias("part"))

    long = parts(WIDTH)
    common = long.groupBy("part").agg(F.count("*").alias("n"))
    asked = long.join(common, "part").groupBy("label").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    asked = asked.unionByName(known.where(n < WIDTH).select("label", F.col("label").alias("part")))
    held = long
    for width in range(1, WIDTH):
        held = held.unionByName(parts(width))
    met = asked.withColumnRenamed("label", "inside").join(held.withColumnRenamed("label", "whole"), "part")
    return met.where((F.col("inside") != F.col("whole")) & F.contains("whole", F.col("inside"))).select("inside", "whole")


def classes(labels: DataFrame) -> DataFrame:
    """(kind, item, label, first_label, n_labels): which labels (label) relate, without their pairs.

    Kind `word`: a row for each label that holds the word `item` and shares it, with the
    least of these labels and their number. Kind `inside`: `label` holds the label `item`
    with which it has no word in common. As many rows as labels have words, and one for each
    pair of the second kind.
    """
    words = words_of(labels.select("label").where("label IS NOT NULL").distinct())
    of_word = words.groupBy("item").agg(F.min("label").alias("first_label"), F.count("*").alias("n_labels")).where("n_labels > 1")
    by_word = words.join(of_word, "item").select(F.lit("word").alias("kind"), "item", "label", "first_label", "n_labels")
    apart = ~F.arrays_overlap(F.split("inside", " "), F.split("whole", " "))
    by_part = inside(labels).where(apart).select(F.lit("inside").alias("kind"), F.col("inside").alias("item"), F.col("whole").alias("label"), F.least("inside", "whole").alias("first_label"), F.lit(2).cast("bigint").alias("n_labels"))
    return by_word.unionByName(by_part)


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The labels chosen of some of a scope's rows (scope, label, item, earlier), taken in order."""
    taken, chosen = set(), set()
    for label, rows in pdf.groupby("label", sort=True):
        items = set(rows["item"].dropna())
        if taken.isdisjoint(items) and chosen.isdisjoint(rows["earlier"].dropna()):
            chosen.add(label)
            taken |= items
    return pd.DataFrame({"scope": [pdf["scope"].iloc[0]] * len(chosen), "label": sorted(chosen)}, dtype=object)


class _Open:
    """What isn't settled yet: nodes (scope, label), members (scope, label, item), links (scope, earlier, label)."""

    def __init__(self, nodes: DataFrame, members: DataFrame, links: DataFrame):
        self.tables: list[Stored] = [store(x) for x in (nodes, members, links)]
        self.nodes, self.members, self.links = (x.df for x in self.tables)

    def rows(self) -> DataFrame:
        """All of it as rows (scope, label, item, earlier); a link belongs to its later label."""
        none = F.lit(None).cast("string")
        r = self.nodes.select("scope", "label", none.alias("item"), none.alias("earlier"))
        r = r.unionByName(self.members.select("scope", "label", "item", none.alias("earlier")))
        return r.unionByName(self.links.select("scope", "label", none.alias("item"), "earlier"))

    def free(self) -> DataFrame:
        """Labels before which no open label relates to them."""
        least = self.members.groupBy("scope", "item").agg(F.min("label").alias("least"))
        behind = self.members.join(least, ["scope", "item"]).where("label > least").select("scope", "label")
        return self.nodes.join(behind.unionByName(self.links.select("scope", "label")), ["scope", "label"], "left_anti")

    def without(self, chosen: DataFrame, settled: DataFrame) -> _Open:
        """What stays open once `settled` are known, of which `chosen` start groups: their later relations are settled, too."""
        taken = self.members.join(chosen, ["scope", "label"]).select("scope", "item").distinct()
        used = self.members.join(taken, ["scope", "item"]).select("scope", "label")
        used = used.unionByName(self.links.join(chosen.withColumnRenamed("label", "earlier"), ["scope", "earlier"]).select("scope", "label"))
        gone = store(settled.unionByName(used).distinct())
        keep = lambda df, name: df.join(gone.df.withColumnRenamed("label", name), ["scope", name], "left_anti")
        after = _Open(keep(self.nodes, "label"), keep(self.members, "label").select("scope", "label", "item"), keep(keep(self.links, "label"), "earlier").select("scope", "earlier", "label"))
        gone.drop()
        return after

    def of(self, scopes: DataFrame, how: str) -> _Open:
        return _Open(*[df.join(scopes, "scope", how) for df in (self.nodes, self.members, self.links)])

    def drop(self) -> None:
        for x in self.tables:
            x.drop()


def first_choice(members: DataFrame, links: DataFrame, followed: int = FOLLOWED) -> DataFrame:
    """(scope, label): the labels that are chosen when each scope's are taken in order and one is chosen unless an earlier chosen one relates to it.

    Labels relate when they are members (scope, label, item) of one item, or linked by links
    (scope, earlier, label), earlier < label. An item's members are never paired: of them at
    most one is chosen, and what a round needs of an item is its least open member.

    A scope of at most `followed` rows is followed in one task. In larger ones a round
    chooses all labels without an open relation before them and settles their later
    relations. Where a round settles less than a twentieth, as along chains, the first
    labels of each scope, with at most `followed` rows, are followed in a task besides.
    """
    from skein.operators.lift import numbered

    ship(members.sparkSession)
    members, links = members.select("scope", "label", "item").distinct(), links.select("scope", "earlier", "label").distinct()
    nodes = members.select("scope", "label").unionByName(links.select("scope", "label")).unionByName(links.select("scope", F.col("earlier").alias("label"))).distinct()
    schema = "scope string, label string"
    now, chosen = _Open(nodes, members, links), []

    def move(after: _Open) -> None:
        nonlocal now
        now.drop()
        now = after

    while True:
        sizes = store(now.rows().groupBy("scope").agg(F.count("*").alias("n")))
        large = sizes.df.where(F.col("n") > followed).select("scope")
        chosen.append(store(now.rows().join(large, "scope", "left_anti").groupBy("scope").applyInPandas(_follow, schema)).df)
        n_before = sizes.df.where(F.col("n") > followed).agg(F.sum("n")).first()[0]
        if not n_before:
            break
        move(now.of(large, "left_semi"))
        sizes.drop()
        free = store(now.free())
        chosen.append(free.df)
        move(now.without(free.df, free.df))
        rows = now.rows()
        n_after = rows.count()
        if followed and 20 * n_after > 19 * n_before:
            placed = numbered(rows.select("scope", "label"), "scope", "label")
            placed = placed.join(placed.groupBy("scope").agg(F.min("number").alias("first")), "scope")
            ends = store(placed.where(F.col("number") - F.col("first") == followed).select("scope", F.col("label").alias("end")))
            block = rows.join(ends.df, "scope", "left").where(F.col("end").isNull() | (F.col("label") < F.col("end"))).drop("end")
            own = store(block.groupBy("scope").applyInPandas(_follow, schema))
            chosen.append(own.df)
            move(now.without(own.df, block.select("scope", "label").distinct()))
            ends.drop()
    now.drop()
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def groups_of(chosen: DataFrame, later: DataFrame) -> DataFrame:
    """(scope, group_id, label): each chosen label (scope, label) with its later relations of (scope, first, label), numbered in order within the scope; those without any are no group."""
    from skein.operators.lift import numbered

    rows = store(later.join(chosen.withColumnRenamed("label", "first"), ["scope", "first"], "left_semi").select("scope", "first", "label").distinct()).df
    starts = numbered(rows.select("scope", "first").distinct(), "scope", "first")
    starts = starts.join(starts.groupBy("scope").agg(F.min("number").alias("least")), "scope")
    starts = starts.select("scope", "first", F.format_string("group_%03d", F.col("number") - F.col("least")).alias("group_id"))
    both = rows.unionByName(rows.select("scope", "first", F.col("first").alias("label")).distinct())
    return both.join(starts, ["scope", "first"]).select("scope", "group_id", "label")


def lexical_groups(labels: DataFrame, followed: int = FOLLOWED) -> DataFrame:
    """(scope, group_id, label): labels (scope, label) of each scope taken in order; one not yet in a group starts one with all later labels it shares a word with, holds, or is held by.

    A later label may be in several groups; a label that relates to no later one starts
    none. The pairs of a common word are never made: two labels that start groups share no
    word, so each word has one group and each label at most a row for each of its words and
    for each label inside or around it. Null scopes and labels are left out.
    """
    own = store(labels.select("scope", "label").where("scope IS NOT NULL AND label IS NOT NULL").distinct()).df
    words = store(words_of(own)).df
    found = inside(own.select("label"))
    held = own.withColumnRenamed("label", "inside").join(found, "inside").join(own.withColumnRenamed("label", "whole"), ["scope", "whole"])
    links = store(held.select("scope", F.least("inside", "whole").alias("earlier"), F.greatest("inside", "whole").alias("label"))).df
    chosen = store(first_choice(words, links, followed)).df
    first = words.join(chosen, ["scope", "label"]).select("scope", "item", F.col("label").alias("first"))
    by_word = words.join(first, ["scope", "item"]).where(F.col("label") > F.col("first")).select("scope", "first", "label")
    by_link = links.join(chosen.withColumnRenamed("label", "earlier"), ["scope", "earlier"]).select("scope", F.col("earlier").alias("first"), "label")
    return groups_of(chosen, by_word.unionByName(by_link))
