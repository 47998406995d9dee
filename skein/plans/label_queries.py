"""Queries on labels and tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import labels as L
from skein.operators import lexical
from skein.operators import tags as T
from skein.plans import proxies as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def part_labels(spark, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()


def f01_normalize_labels(spark, sf_dir: str) -> DataFrame:
    """Every part's name with case, tabs, underscores and an article put in, in the three normal forms, as a slug and as a file name's number."""
    raw = F.concat(F.lit(" \tThe  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("\n"))
    p = P.read(spark, sf_dir, "part").withColumn("raw", raw)
    return p.select("p_partkey", L.plain(F.col("raw")).alias("v2"), L.collapsed(F.col("raw")).alias("v1"), L.without_article(F.col("raw")).alias("v3"), L.slug(F.col("raw")).alias("slug"),
                    L.frame_number(F.format_string("frame_%06d", "p_partkey")).alias("frame"))


QUERIES["f01_normalize_labels"] = f01_normalize_labels
SQL["f01_normalize_labels"] = r"""SELECT p_partkey, 'the  ' || replace(lower(p_name), '_', ' ') AS v2, 'the ' || lower(p_name) AS v1, lower(p_name) AS v3, 'the_' || replace(lower(p_name), ' ', '_') AS slug,
regexp_extract(printf('frame_%06d', p_partkey), '([0-9]+)$', 1)::BIGINT AS frame FROM part"""


def _label_pair_rows(spark, sf_dir: str) -> DataFrame:
    """Pairs of part names that share a word, with the known similarity of some."""
    words = part_labels(spark, sf_dir).select("label", F.explode(F.split("label", " ")).alias("group"))
    given = F.when((F.col("label_a") == "large ring") & (F.col("label_b") == "small ring"), F.lit(1.7))
    return T.pairs_of_groups(words).withColumn("given", given)


def f05_label_similarity(spark, sf_dir: str) -> DataFrame:
    p = _label_pair_rows(spark, sf_dir)
    a, b = F.col("label_a"), F.col("label_b")
    plural = F.concat(b, F.lit("s"))
    return p.select("label_a", "label_b", L.similarity(a, b, F.col("given")).alias("similarity"), L.similarity(a, plural, F.lit(None).cast("double")).alias("with_plural"),
                    F.size(L.tokens(plural)).cast("bigint").alias("n_tokens"), L.more_specific(a, F.concat(a, F.lit(" set"))).alias("specific"), L.compatible(a, b).alias("compatible"))


_PAIRS_SQL = """w AS (SELECT DISTINCT p_name AS label, unnest(string_split(p_name, ' ')) AS g FROM part),
pr AS (SELECT DISTINCT a.label AS label_a, b.label AS label_b FROM w a JOIN w b ON a.g = b.g AND a.label < b.label)"""
QUERIES["f05_label_similarity"] = f05_label_similarity
SQL["f05_label_similarity"] = "WITH " + _PAIRS_SQL + """, t AS (
 SELECT *, label_b || 's' AS pl, string_split(label_a,' ') AS ta, string_split(label_b,' ') AS tb,
   list_distinct(list_concat(string_split(label_b || 's',' '), [x[1:len(x)-1] for x in string_split(label_b || 's',' ') if suffix(x,'s') and len(x) > 3])) AS tp,
   list_distinct(list_concat(string_split(label_a,' '), [x[1:len(x)-1] for x in string_split(label_a,' ') if suffix(x,'s') and len(x) > 3])) AS xa,
   list_distinct(list_concat(string_split(label_b,' '), [x[1:len(x)-1] for x in string_split(label_b,' ') if suffix(x,'s') and len(x) > 3])) AS xb FROM pr),
j AS (SELECT *, len(list_intersect(xa,xb))::DOUBLE / len(list_distinct(list_concat(xa,xb))) AS j1, len(list_intersect(xa,tp))::DOUBLE / len(list_distinct(list_concat(xa,tp))) AS j2 FROM t)
SELECT label_a, label_b,
 CASE WHEN label_a = 'large ring' AND label_b = 'small ring' THEN 1.0::DOUBLE WHEN label_a = label_b THEN 1.0::DOUBLE WHEN contains(label_a,label_b) OR contains(label_b,label_a) THEN 0.8::DOUBLE
   WHEN j1 > 0 THEN greatest(0.35::DOUBLE, least(0.75::DOUBLE, j1)) ELSE 0.2::DOUBLE END AS similarity,
 CASE WHEN label_a = pl THEN 1.0::DOUBLE WHEN contains(label_a,pl) OR contains(pl,label_a) THEN 0.8::DOUBLE WHEN j2 > 0 THEN greatest(0.35::DOUBLE, least(0.75::DOUBLE, j2)) ELSE 0.2::DOUBLE END AS with_plural,
 len(tp)::BIGINT AS n_tokens, label_a || ' set' AS specific, true AS compatible FROM j"""


def f07_label_family(spark, sf_dir: str) -> DataFrame:
    o = P.objects(spark, sf_dir)
    return o.select("id", "label", L.family(F.col("label")).alias("family"), L.family_wide(F.col("label")).alias("family_wide"))


QUERIES["f07_label_family"] = f07_label_family
_FAMILY_SQL = "CASE WHEN contains({0},'chair') OR {0} = 'stool' THEN 'chair' WHEN contains({0},'table') OR contains({0},'desk') THEN 'table' WHEN {0} IN ('couch','sofa','loveseat') THEN 'sofa' END"
_FAMILY_WIDE_SQL = """CASE WHEN contains({0},'chair') OR {0} = 'stool' THEN 'chair' WHEN {0} IN ('couch','sofa','loveseat','arm sofa') THEN 'sofa' WHEN contains({0},'table') OR contains({0},'desk') THEN 'table'
 WHEN contains({0},'computer') OR contains({0},'laptop') OR contains({0},'monitor') THEN 'computer' WHEN {0} IN ('person','woman','man','human') THEN 'person' END"""
SQL["f07_label_family"] = P.with_views(P.V_OBJECT) + f" SELECT id, label, {_FAMILY_SQL.format('label')} AS family, {_FAMILY_WIDE_SQL.format('label')} AS family_wide FROM v_object"


def j17_group_pairs(spark, sf_dir: str) -> DataFrame:
    """Candidate pairs of labels grouped by their last word, beside how many all pairs would be."""
    labels = part_labels(spark, sf_dir)
    pairs = T.pairs_of_groups(labels.select("label", F.element_at(F.split("label", " "), -1).alias("group")))
    n = labels.agg(F.count("*").alias("n"))
    return pairs.crossJoin(F.broadcast(n)).select("label_a", "label_b", "pair_key", F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("all_pairs"))


QUERIES["j17_group_pairs"] = j17_group_pairs
SQL["j17_group_pairs"] = """WITH l AS (SELECT DISTINCT p_name AS label, string_split(p_name,' ')[-1] AS g FROM part)
SELECT a.label AS label_a, b.label AS label_b, a.label || '|' || b.label AS pair_key, (SELECT (count(*)*(count(*)-1)/2)::BIGINT FROM l) AS all_pairs FROM l a JOIN l b ON a.g = b.g AND a.label < b.label"""


def p12_rule_classify(spark, sf_dir: str) -> DataFrame:
    """Distinct words of part names, half of them from a cache of earlier classes, the rest by rule, with an allow-list; repaired."""
    p = P.read(spark, sf_dir, "part")
    tags = p.select(F.explode(L.split_tags(F.replace("p_name", F.lit(" "), F.lit("|")))).alias("tag")).distinct()
    cached = T.classify(tags.where(F.length("tag") % 2 == 0)).withColumn("category", F.lit("no such category")).select("tag", "category", F.lit(None).cast("boolean").alias("is_object_prompt"), F.lit("maybe").alias("action"), F.lit(None).cast("string").alias("normalized_label"))
    found = T.with_cache(tags, cached, lambda misses: T.classify(misses, ("ring", "plate")).select("tag", "category", "is_object_prompt", "action", "normalized_label"))
    return T.repair_classes(found)


QUERIES["p12_rule_classify"] = p12_rule_classify
_IN = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"
SQL["p12_rule_classify"] = f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name,' ')) AS tag FROM part), c AS (SELECT tag, length(tag) % 2 = 0 AS from_cache,
 CASE WHEN length(tag) % 2 = 0 THEN 'uncertain' WHEN tag IN ('ring','plate') THEN 'physical_object' WHEN tag IN {_IN(T.SCENE_TERMS)} THEN 'scene_or_place' WHEN tag IN {_IN(T.ATTRIBUTE_TERMS)} THEN 'attribute'
 WHEN tag IN {_IN(T.MATERIAL_TERMS)} THEN 'material' WHEN tag IN {_IN(T.GENERIC_TERMS)} THEN 'generic_category' ELSE 'uncertain' END AS category FROM w)
SELECT tag, category, category = 'physical_object' AS is_object_prompt, CASE WHEN category = 'physical_object' THEN 'keep' ELSE 'hold' END AS action,
 CASE WHEN category = 'physical_object' THEN tag END AS normalized_label, from_cache FROM c"""


def a07_scene_tags(spark, sf_dir: str) -> DataFrame:
    """The 20 most frequent tags over all parts, after cleaning each part's own list."""
    p = P.read(spark, sf_dir, "part")
    raw = F.split(F.concat_ws(";", F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit(";")), F.replace(F.lower("p_type"), F.lit(" "), F.lit(";")), F.col("p_size").cast("string")), ";")
    tags = p.select(F.explode(L.clean_tags(raw, 6, 3)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


QUERIES["a07_scene_tags"] = a07_scene_tags
SQL["a07_scene_tags"] = r"""WITH r AS (SELECT p_partkey, unnest(list_concat([lower(p_name)], string_split(p_name,' '), string_split(lower(p_type),' '), [p_size::VARCHAR])) AS tag,
 unnest(range(1, 2 + len(string_split(p_name,' ')) + len(string_split(p_type,' ')) + 1)) AS i FROM part),
k AS (SELECT p_partkey, tag, min(i) AS i FROM r WHERE length(tag) >= 3 AND NOT regexp_full_match(tag, '[0-9]+') GROUP BY p_partkey, tag),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM k)
SELECT tag, count(*)::BIGINT AS n FROM o WHERE rn <= 6 GROUP BY tag ORDER BY n DESC, tag LIMIT 20"""


def a08_label_counts(spark, sf_dir: str) -> DataFrame:
    """Labels of 30 parts or more."""
    return P.read(spark, sf_dir, "part").groupBy(L.without_article(F.col("p_name")).alias("label")).agg(F.count("*").alias("n")).where("n >= 30")


QUERIES["a08_label_counts"] = a08_label_counts
SQL["a08_label_counts"] = "SELECT p_name AS label, count(*)::BIGINT AS n FROM part GROUP BY p_name HAVING count(*) >= 30"


def j18_lexical_edges(spark, sf_dir: str) -> DataFrame:
    return T.lexical_edges(part_labels(spark, sf_dir))


QUERIES["j18_lexical_edges"] = j18_lexical_edges
SQL["j18_lexical_edges"] = """WITH l AS (SELECT DISTINCT p_name AS label FROM part)
SELECT a.label AS label_a, b.label AS label_b FROM l a JOIN l b ON a.label < b.label AND (contains(a.label,b.label) OR contains(b.label,a.label) OR list_has_any(string_split(a.label,' '), string_split(b.label,' ')))"""


def j18_lexical_classes(spark, sf_dir: str) -> DataFrame:
    """Which names, types, brands and beginnings of types of parts share words or lie inside one another, without their pairs."""
    p = P.read(spark, sf_dir, "part")
    more = p.select(F.explode(F.array(*[F.lower(x) for x in ("p_name", "p_type", "p_brand", F.substring("p_type", 1, 3))])).alias("label"))
    return lexical.classes(more)


QUERIES["j18_lexical_classes"] = j18_lexical_classes
SQL["j18_lexical_classes"] = """WITH l AS (SELECT DISTINCT lower(unnest([p_name, p_type, p_brand, p_type[1:3]])) AS label FROM part WHERE p_name IS NOT NULL),
w AS (SELECT label, unnest(list_distinct(string_split(label,' '))) AS item FROM l), n AS (SELECT item, min(label) AS first_label, count(*)::BIGINT AS n_labels FROM w GROUP BY item HAVING count(*) > 1)
SELECT 'word' AS kind, item, label, first_label, n_labels FROM w JOIN n USING (item)
UNION ALL SELECT 'inside', a.label, b.label, least(a.label,b.label), 2::BIGINT FROM l a JOIN l b ON a.label <> b.label AND contains(b.label,a.label) AND NOT list_has_any(string_split(a.label,' '), string_split(b.label,' '))"""


def g03_greedy_groups(spark, sf_dir: str) -> DataFrame:
    """Greedy label groups of each brand's vocabulary."""
    labels = P.read(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.col("p_name").alias("label")).distinct()
    return lexical.lexical_groups(labels)


QUERIES["g03_greedy_groups"] = g03_greedy_groups
# each brand's labels one after another: which are used after k of them, and how many groups there are
SQL["g03_greedy_groups"] = """WITH RECURSIVE l AS (SELECT DISTINCT p_brand AS scope, p_name AS label FROM part),
e AS (SELECT a.scope, a.label, b.label AS other FROM l a JOIN l b ON a.scope = b.scope AND a.label < b.label AND (contains(a.label,b.label) OR contains(b.label,a.label) OR list_has_any(string_split(a.label,' '), string_split(b.label,' ')))),
f AS (SELECT scope, label, list(other) AS later FROM e GROUP BY scope, label),
o AS (SELECT scope, label, later, row_number() OVER (PARTITION BY scope ORDER BY label) AS k FROM f),
st(scope, k, used, n, grp) AS (
  SELECT DISTINCT scope, 0::BIGINT, []::VARCHAR[], 0, []::VARCHAR[] FROM l
  UNION ALL SELECT st.scope, o.k, CASE WHEN list_contains(used, label) THEN used ELSE list_concat(used, [label], later) END,
    CASE WHEN list_contains(used, label) THEN n ELSE n + 1 END, CASE WHEN list_contains(used, label) THEN [] ELSE list_concat([label], later) END
  FROM st JOIN o ON o.scope = st.scope AND o.k = st.k + 1)
SELECT scope, printf('group_%03d', n - 1) AS group_id, unnest(grp) AS label FROM st WHERE len(grp) > 0"""


def p14_similarity_repair(spark, sf_dir: str) -> DataFrame:
    """Similarity items as a model might return them, made from customers: unknown relations, figures out of range or no figures, odd policies."""
    c = P.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    relation = F.element_at(F.array(*[F.lit(x) for x in ("same_object_alias", " near_synonym", "parent_child", "part_of", "related_but_distinct", "different", "cousin", "")]), (k % 8 + 1).cast("int"))
    figure = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, None).otherwise((F.col("c_acctbal") / 5000).cast("string"))
    policy = F.element_at(F.array(*[F.lit(x) for x in ("allow", "cautious ", "hold", "perhaps")]), (k % 4 + 1).cast("int"))
    items = c.select(F.concat(F.lit("The "), F.lower("c_mktsegment")).alias("label_a"), F.lower("c_name").alias("label_b"), relation.alias("relation"), figure.alias("similarity"), policy.alias("policy"))
    return T.repair_similarity(items).where("similarity >= 0.3")


QUERIES["p14_similarity_repair"] = p14_similarity_repair
SQL["p14_similarity_repair"] = """WITH r AS (SELECT c_custkey AS k, lower(c_mktsegment) AS label_a, lower(c_name) AS label_b,
 ['same_object_alias','near_synonym','parent_child','part_of','related_but_distinct','different','different','different'][c_custkey % 8 + 1] AS relation,
 CASE WHEN c_custkey % 5 > 1 THEN c_acctbal / 5000 END AS given, ['allow','cautious','hold',NULL][c_custkey % 4 + 1] AS p FROM customer),
d AS (SELECT *, [0.95,0.85,0.65,0.55,0.35,0.2,0.2,0.2][k % 8 + 1]::DOUBLE AS us, ['allow','allow','cautious','cautious','hold','hold','hold','hold'][k % 8 + 1] AS up FROM r),
e AS (SELECT label_a, label_b, least(label_a,label_b) || '|' || greatest(label_a,label_b) AS pair_key, relation, least(greatest(coalesce(given, us), 0.0::DOUBLE), 1.0::DOUBLE) AS similarity, coalesce(p, up) AS policy FROM d)
SELECT * FROM e WHERE similarity >= 0.3::DOUBLE"""


def a25_relation_counts(spark, sf_dir: str) -> DataFrame:
    """How many repaired items each relation has, and the 30 likest pairs' least likeness."""
    items = p14_similarity_repair(spark, sf_dir)
    top = items.orderBy(F.desc("similarity"), "label_a", "label_b").limit(30).agg(F.min("similarity").alias("least_of_top"))
    return items.groupBy("relation").agg(F.count("*").alias("n")).crossJoin(F.broadcast(top))


QUERIES["a25_relation_counts"] = a25_relation_counts
SQL["a25_relation_counts"] = "WITH i AS (" + SQL["p14_similarity_repair"] + "), t AS (SELECT min(similarity) AS least_of_top FROM (SELECT similarity FROM i ORDER BY similarity DESC, label_a, label_b LIMIT 30)) SELECT relation, count(*)::BIGINT AS n, any_value(least_of_top) AS least_of_top FROM i, t GROUP BY relation"


def w11_first_distinct(spark, sf_dir: str) -> DataFrame:
    """Each customer's order priorities, each once, in the order they first came."""
    o = P.read(spark, sf_dir, "orders")
    each = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return o.groupBy("o_custkey").agg(F.array_join(F.array_distinct(F.transform(each, lambda e: e["o_orderpriority"])), ",").alias("priorities"))


QUERIES["w11_first_distinct"] = w11_first_distinct
SQL["w11_first_distinct"] = "WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(p, ',' ORDER BY k) AS priorities FROM f GROUP BY o_custkey"


def p15_group_repair(spark, sf_dir: str) -> DataFrame:
    """Groups as a model might return them, made from suppliers and parts: unknown labels, repeats, single members, odd types."""
    known = part_labels(spark, sf_dir).where(F.length("label") % 3 > 0)
    raw = P.read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("ord")).agg(F.collect_list(F.concat(F.lit("The "), F.col("p_name"))).alias("labels"))
    raw = raw.withColumn("group_type", F.when(F.col("ord") % 3 == 0, "part_whole").when(F.col("ord") % 3 == 1, "clique"))
    groups, rest = T.repair_groups(raw, known)
    return groups.select("group_id", "group_type", F.concat_ws(",", "labels").alias("labels")).unionByName(rest.select(F.lit("ungrouped").alias("group_id"), F.lit("").alias("group_type"), F.col("label").alias("labels")))


QUERIES["p15_group_repair"] = p15_group_repair
SQL["p15_group_repair"] = """WITH k AS (SELECT DISTINCT p_name AS label FROM part WHERE length(p_name) % 3 > 0),
m AS (SELECT DISTINCT p_size AS ord, p_name AS label FROM part JOIN k ON k.label = p_name),
g AS (SELECT ord, string_agg(label, ',' ORDER BY label) AS labels FROM m GROUP BY ord HAVING count(*) >= 2)
SELECT printf('group_%03d', row_number() OVER (ORDER BY ord) - 1) AS group_id, CASE WHEN ord % 3 = 0 THEN 'part_whole' WHEN ord % 3 = 1 THEN 'other_related' ELSE 'object_family' END AS group_type, labels FROM g
UNION ALL SELECT 'ungrouped', '', label FROM k WHERE label NOT IN (SELECT label FROM m JOIN g USING (ord))"""


def s26_variant_decode(spark, sf_dir: str) -> DataFrame:
    """Tags and prompts out of JSON of three shapes, inside fences and other text, made from events."""
    e = P.read(spark, sf_dir, "events")
    shape = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"prompts": ["'), F.col("event_type"), F.lit('", "x"]}'))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit('{"results": [{"tags": "'), F.col("event_type"), F.lit(' | y"}]}'))
    ).otherwise(F.concat(F.lit('{"label": "'), F.col("event_type"), F.lit('"}')))
    text = F.concat(F.lit("Sure:\n```json\n"), shape, F.lit("\n```"))
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    v = F.try_parse_json(bare)
    many = F.try_variant_get(v, "$.prompts", "array<string>")
    nested = L.split_tags(F.try_variant_get(v, "$.results[0].tags", "string"))
    one = F.array(F.try_variant_get(v, "$.label", "string"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.select("event_id", F.concat_ws(",", F.coalesce(many, nested, one)).alias("tags"), k.alias("k"))


QUERIES["s26_variant_decode"] = s26_variant_decode
SQL["s26_variant_decode"] = "SELECT event_id, event_type || CASE event_id % 3 WHEN 0 THEN ',x' WHEN 1 THEN ',y' ELSE '' END AS tags, json_extract(props,'$.k')::BIGINT AS k FROM events"


def _first_words(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a tagger: a text's first three words."""
    if (batch["doc_id"] % 97 == 96).any():
        raise ValueError("unreadable")
    return batch.assign(tags=[",".join(t.lower().split()[:3]) for t in batch["text"]])[["doc_id", "tags"]]


def x01_stub_tagger(spark, sf_dir: str) -> DataFrame:
    """A model behind the boundary, over all documents; rows it fails on are reported with their error."""
    docs = P.read(spark, sf_dir, "documents").select("doc_id", "text")
    return T.apply_model(docs, _first_words, "doc_id bigint, tags string, error string")


QUERIES["x01_stub_tagger"] = x01_stub_tagger
SQL["x01_stub_tagger"] = r"""SELECT doc_id, CASE WHEN doc_id % 97 <> 96 THEN array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:3], ',') END AS tags,
 CASE WHEN doc_id % 97 = 96 THEN 'ValueError: unreadable' END AS error FROM documents"""
