"""Tags and labels: rule classes, repairs of what a classifier says, groups and candidate pairs."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import labels as L
from skein.operators import lexical
from skein.sources.scratch import store
from skein.sources.ship import ship

# What the rule classifier knows, by category.
SCENE_TERMS = ("bathroom", "bedroom", "corridor", "hallway", "home", "house", "indoor", "indoors", "interior", "kitchen", "living room", "office", "room", "scene")
ATTRIBUTE_TERMS = ("black", "blue", "bright", "brown", "closed", "dark", "gray", "green", "large", "modern", "open", "red", "small", "white", "wooden", "yellow")
MATERIAL_TERMS = ("ceramic", "fabric", "glass", "leather", "metal", "plastic", "steel", "wood")
GENERIC_TERMS = ("appliance", "decoration", "equipment", "furniture", "item", "object", "stuff", "thing")
# Categories whose tags may become prompts, and the others.
KEEP_CATEGORIES = ("physical_object",)
HOLD_CATEGORIES = ("scene_or_place", "structural_surface", "attribute", "material", "action", "generic_category", "uncertain")
# Relations of two labels with their usual similarity and merge policy.
RELATIONS = {
    "same_object_alias": (0.95, "allow"), "near_synonym": (0.85, "allow"), "parent_child": (0.65, "cautious"),
    "part_of": (0.55, "cautious"), "related_but_distinct": (0.35, "hold"), "different": (0.2, "hold"),
}
POLICIES = ("allow", "cautious", "hold")
GROUP_TYPES = ("alias_family", "object_family", "part_whole", "related_structure", "other_related")


def rule_category(tag: Column) -> Column:
    """The category of a normal tag by the term lists; a tag in none is uncertain."""
    return (
        F.when(tag.isin(*SCENE_TERMS), "scene_or_place").when(tag.isin(*ATTRIBUTE_TERMS), "attribute")
        .when(tag.isin(*MATERIAL_TERMS), "material").when(tag.isin(*GENERIC_TERMS), "generic_category").otherwise("uncertain")
    )


def classify(tags: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """tags (tag) with category, keep and normalized_label. The rules alone keep nothing; tags in `allowed` count as objects."""
    category = F.when(F.col("tag").isin(*allowed), "physical_object").otherwise(rule_category(F.col("tag"))) if allowed else rule_category(F.col("tag"))
    keep = F.col("category").isin(*KEEP_CATEGORIES)
    return tags.withColumn("category", category).withColumn("is_object_prompt", keep).withColumn("action", F.when(keep, "keep").otherwise("hold")).withColumn("normalized_label", F.when(keep, F.col("tag")))


def repair_classes(items: DataFrame) -> DataFrame:
    """items (tag, category, is_object_prompt, action, normalized_label) made consistent: unknown categories are uncertain, and those hold."""
    c = F.trim(F.coalesce(F.expr("nullif(category, '')"), F.lit("uncertain")))
    c = F.when(c.isin(*KEEP_CATEGORIES, *HOLD_CATEGORIES), c).otherwise("uncertain")
    out = items.withColumn("tag", L.without_article(F.col("tag"))).withColumn("category", c)
    may = F.col("category").isin(*KEEP_CATEGORIES)
    prompt = F.coalesce(F.col("is_object_prompt"), may)
    out = out.withColumn("is_object_prompt", prompt)
    act = F.when(F.col("action").isin("keep", "hold"), F.col("action")).otherwise(F.when(F.col("is_object_prompt"), "keep").otherwise("hold"))
    out = out.withColumn("action", F.when(may, act).otherwise("hold")).withColumn("is_object_prompt", may & F.col("is_object_prompt"))
    label = F.when(F.col("normalized_label").isNotNull(), L.without_article(F.col("normalized_label"))).when(F.col("is_object_prompt"), F.col("tag"))
    return out.withColumn("normalized_label", label)


def with_cache(tags: DataFrame, cache: DataFrame, classifier) -> DataFrame:
    """Each tag's class from cache (tag, …) where it is there, else from `classifier`, which sees only the misses."""
    hits = tags.join(cache, "tag").withColumn("from_cache", F.lit(True))
    fresh = classifier(tags.join(cache.select("tag"), "tag", "left_anti")).withColumn("from_cache", F.lit(False))
    return hits.unionByName(fresh)


def repair_similarity(items: DataFrame) -> DataFrame:
    """items (label_a, label_b, relation, similarity string, policy) made consistent: unknown relations are `different`, missing figures the relation's own."""
    relation = F.when(F.trim("relation").isin(*RELATIONS), F.trim("relation")).otherwise("different")
    out = items.withColumn("relation", relation)
    usual = F.create_map(*[F.lit(x) for r, (s, _) in RELATIONS.items() for x in (r, s)])
    policy = F.create_map(*[F.lit(x) for r, (_, p) in RELATIONS.items() for x in (r, p)])
    s = F.coalesce(F.col("similarity").try_cast("double"), usual[F.col("relation")])
    p = F.when(F.trim("policy").isin(*POLICIES), F.trim("policy")).otherwise(policy[F.col("relation")])
    a, b = L.without_article(F.col("label_a")), L.without_article(F.col("label_b"))
    return out.select(a.alias("label_a"), b.alias("label_b"), L.pair_key(a, b).alias("pair_key"), "relation", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("similarity"), p.alias("policy"))


def repair_groups(raw: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, ungrouped): raw (ord, group_type, labels) with known labels only, each once, groups of two or more; and the known labels that are in none.

    Group numbers follow ord; labels of a group are sorted.
    """
    flat = raw.select("ord", "group_type", F.explode("labels").alias("l")).select("ord", "group_type", L.without_article(F.col("l")).alias("label")).distinct()
    valid = flat.join(known.select("label").distinct(), "label", "left_semi")
    size = valid.groupBy("ord").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.first("group_type").alias("t")).where(F.size("labels") >= 2)
    kind = F.when(F.trim(F.coalesce("t", F.lit("object_family"))).isin(*GROUP_TYPES), F.trim(F.coalesce("t", F.lit("object_family")))).otherwise("other_related")
    # one row a group that a reviewer names: a short list, numbered in one task
    number = F.row_number().over(Window.orderBy("ord")) - 1
    groups = size.select("ord", F.format_string("group_%03d", number).alias("group_id"), kind.alias("group_type"), "labels")
    return groups, known.select("label").distinct().join(groups.select(F.explode("labels").alias("label")).distinct(), "label", "left_anti")


def pairs_of_groups(members: DataFrame) -> DataFrame:
    """(label_a, label_b, pair_key): pairs of labels that share a group (group, label), each once."""
    a = members.select("group", F.col("label").alias("label_a")).distinct()
    b = members.select("group", F.col("label").alias("label_b")).distinct()
    return a.join(b, "group").where("label_a < label_b").select("label_a", "label_b").distinct().withColumn("pair_key", L.pair_key(F.col("label_a"), F.col("label_b")))


def lexical_edges(labels: DataFrame) -> DataFrame:
    """(label_a, label_b): labels with a word in common or one inside the other, each pair once.

    The result itself grows with the square of a common word's labels; lexical.classes says
    the same without pairs, and lexical.lexical_groups needs none.
    """
    words = lexical.words_of(labels.select("label").distinct())
    by_word = words.select(F.col("label").alias("label_a"), "item").join(words.select(F.col("label").alias("label_b"), "item"), "item").where("label_a < label_b").select("label_a", "label_b")
    by_part = lexical.inside(labels).select(F.least("inside", "whole").alias("label_a"), F.greatest("inside", "whole").alias("label_b"))
    return by_word.unionByName(by_part).distinct()


def greedy_groups(edges: DataFrame, labels: DataFrame, followed: int = lexical.FOLLOWED) -> DataFrame:
    """(scope, group_id, label): labels of each scope taken in order; one not yet in a group starts one with all later labels it relates to.

    For relations of any kind: labels (scope, label), edges (label_a, label_b) with label_a
    < label_b. A later label may be in several groups. A scope of at most `followed` rows is
    one task's, larger ones are settled by rounds.
    """
    own = labels.select("scope", "label").distinct()
    links = edges.select(F.col("label_a").alias("earlier"), F.col("label_b").alias("later")).join(own.withColumnRenamed("label", "earlier"), "earlier")
    links = store(links.join(own.withColumnRenamed("label", "later"), ["scope", "later"]).select("scope", "earlier", F.col("later").alias("label"))).df
    chosen = lexical.first_choice(own.limit(0).withColumn("item", F.lit(None).cast("string")), links, followed)
    return lexical.groups_of(chosen, links.withColumnRenamed("earlier", "first"))


# What a call of each kind of outside model returns for a row.
MODEL_SCHEMAS = {
    "tagger": "image string, tags array<string>, raw string, error string",
    "detector": "image string, prompt string, boxes array<array<double>>, scores array<double>, labels array<string>, error string",
    "segmenter": "image string, masks array<binary>, scores array<double>, error string",
    "classifier": "tag string, category string, keep boolean, reason string, error string",
    "grouper": "label_a string, label_b string, relation string, similarity double, error string",
}
#: Pairs that a grouping model is asked about in one call.
PAIRS_A_CALL = 80


#: Rows of replies that are handed on together: small calls would make a table of a few rows each.
HANDED = 256


def apply_model(rows: DataFrame, model, schema: str, batch_rows: int | None = None, retries: int = 0, wait: float = 0.0) -> DataFrame:
    """The boundary to outside models: `model` maps pandas batches of at most batch_rows rows to rows of schema, such as one of MODEL_SCHEMAS.

    A call that fails is tried `retries` times more, after `wait` seconds and then twice as
    long each time. A batch that fails for good is halved, and its halves are tried as often,
    until what fails is one row, with the failure in `error`. An error that the model itself
    gives for a row is kept. With batch_rows, rows are dealt over all tasks, as few bytes may be many calls.
    """

    ship(rows.sparkSession)
    names = [part.split()[0] for part in re.split(r",(?![^<]*>)", schema)]

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        for n in range(retries + 1):
            try:
                return model(batch)
            except Exception:  # noqa: BLE001  whatever an outside model raises
                if n == retries:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    def replies(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            made = call(some)
        except Exception as e:  # noqa: BLE001  one bad row must not end the job: its neighbours are tried without it
            if len(some) > 1:
                yield from replies(some.iloc[: len(some) // 2])
                yield from replies(some.iloc[len(some) // 2 :])
                return
            row = some.assign(error=f"{type(e).__name__}: {e}")
            made = row.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
        yield made

    def joined(made: list[pd.DataFrame]) -> pd.DataFrame:
        out = made[0] if len(made) == 1 else pd.concat(made, ignore_index=True)
        own = out["error"].astype(object) if "error" in out else pd.Series(None, index=out.index, dtype=object)
        return out.assign(error=own.where(own.notna(), None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), batch_rows or max(1, len(batch))):
                for reply in replies(batch.iloc[at : at + (batch_rows or len(batch))]):
                    if len(reply):
                        made.append(reply)
                        n += len(reply)
                    if n >= HANDED:
                        yield joined(made)
                        made, n = [], 0
        if made:
            yield joined(made)

    if batch_rows:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInPandas(run, schema)


def segment(rows: DataFrame, model, retries: int = 0, wait: float = 0.0) -> DataFrame:
    """(image, masks, scores, error) of rows (image, boxes): a mask for each box. An image without boxes has no masks and is never sent to the model."""
    none = rows.where(F.col("boxes").isNull() | (F.size("boxes") == 0))
    empty = none.select("image", F.array().cast("array<binary>").alias("masks"), F.array().cast("array<double>").alias("scores"), F.lit(None).cast("string").alias("error"))
    return apply_model(rows.where(F.size("boxes") > 0), model, MODEL_SCHEMAS["segmenter"], retries=retries, wait=wait).unionByName(empty)


def ask_pairs(pairs: DataFrame, model, retries: int = 0, wait: float = 0.0) -> DataFrame:
    """What a model says of label pairs (label_a, label_b): a row for each different pair, either way round being one, with relation, similarity and error.

    Pairs go out PAIRS_A_CALL at a time; replies are matched by their labels, in whatever
    order and either way round they come. Of several replies to a pair the one without an
    error counts, of these the most similar; a pair without a reply has the error `no reply`,
    and replies to pairs that weren't asked are dropped.
    """
    key = lambda: (F.least("label_a", "label_b").alias("label_a"), F.greatest("label_a", "label_b").alias("label_b"))
    asked = pairs.where("label_a <> label_b").select(*key()).distinct()
    replies = apply_model(asked, model, MODEL_SCHEMAS["grouper"], batch_rows=PAIRS_A_CALL, retries=retries, wait=wait)
    replies = replies.select(*key(), F.struct(F.col("error").isNull().alias("fine"), "similarity", "relation", "error").alias("reply"))
    found = replies.groupBy("label_a", "label_b").agg(F.max("reply").alias("reply"))
    out = asked.join(found, ["label_a", "label_b"], "left")
    return out.select("label_a", "label_b", "reply.relation", "reply.similarity", F.when(F.col("reply").isNull(), "no reply").otherwise(F.col("reply.error")).alias("error"))
