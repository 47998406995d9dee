"""Merkle manifest of a dataset as a persistent tree: a tampered leaf makes a version of its own.

Leaves of a language ascend by doc_id and are hashed in pairs up to the language's subroot;
subroots, by language, likewise up to the root. The tree is cut into aligned blocks of 1024
nodes of one level. A task builds the subtree of a block of leaves once; each tampered leaf
then makes a version of it by copying its ancestors, all other nodes being shared. Above,
blocks of block roots are trees of the same kind, level by level of blocks, and each block
learns its path to the root from the block over it. Versions go up the same way: a version's
root in one block is the changed leaf of the block over it, whose ancestors are copied there,
up to the root; a block of many versions is handed out with bounded parts of them. An
untampered leaf is folded along its siblings. No tree or level is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import numbered, prepare, read_documents, store

#: Levels of a block; it has 2 to this power of nodes at most.
HEIGHT = 10
#: Versions that one copy of a block above the leaves makes.
PART_VERSIONS = 1 << 11
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The digest of a row from its fields in order: `-` for null, else bytes in UTF-8, a colon and the value."""
    return F.sha2(F.concat(*[_field(c) for c in columns.values()]).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides the crc32 of the id as text; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class PersistentTree:
    """A block's subtree. Nodes are never changed: a version is the root of copied ancestors over shared nodes."""

    def __init__(self, leaves: list[str], height: int):
        self.digest, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        self.height = height
        self.root = self._grow(list(range(len(leaves))), height)

    def _node(self, left: int, right: int) -> int:
        self.digest.append(_hash(*[self.digest[i] for i in (left, right) if i >= 0]))
        self.left.append(left)
        self.right.append(right)
        return len(self.digest) - 1

    def _grow(self, row: list[int], levels: int) -> int:
        for _ in range(levels):
            row = [self._node(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        return row[0]

    def path(self, at: int) -> list[tuple[int, bool]]:
        """From leaf `at` upwards: the sibling (-1 if there is none), and whether it stands on the left."""
        node, out = self.root, []
        for level in range(self.height - 1, -1, -1):
            right = bool(at >> level & 1)
            out.append((self.left[node] if right else self.right[node], right))
            node = self.right[node] if right else self.left[node]
        return out[::-1]

    def version(self, at: int, digest: str) -> int:
        """The root of a new version in which leaf `at` has this digest: `height` nodes are copied, no node is changed."""
        self.digest.append(digest)
        self.left.append(-1)
        self.right.append(-1)
        node = len(self.digest) - 1
        for sibling, on_left in self.path(at):
            node = self._node(sibling, node) if on_left else self._node(node, sibling)
        return node


def _levels(n: int, height: int) -> int:
    """Levels of a block of a tree with n nodes: all of them, or as many as a tree of one block needs."""
    return min(height, max(n - 1, 0).bit_length())


def _bits(hexes: list[str]) -> bytes:
    return bytes.fromhex("".join(hexes))


def _leaf_block(pdf: pd.DataFrame, height: int) -> pd.DataFrame:
    """A block of leaves: siblings' digests within the block, the block's root, and what each leaf comes to there: the root of a tampered leaf's version, or the leaf folded along its siblings."""
    pdf = pdf.sort_values("pos")
    tree = PersistentTree([x.hex() for x in pdf.leaf], _levels(int(pdf.n.iloc[0]), height))
    proofs, folded, copied = [], [], []
    for i, (leaf, changed) in enumerate(zip(pdf.leaf, pdf.changed, strict=True)):
        path, before = [(tree.digest[s] if s >= 0 else "", left) for s, left in tree.path(i)], len(tree.digest)
        proofs.append(_bits([s for s, _ in path]))
        if changed is None:
            now = leaf.hex()
            for sibling, left in path:
                now = _hash(sibling, now) if left else _hash(now, sibling)
            folded.append(now)
        else:
            folded.append(tree.digest[tree.version(i, changed.hex())])
        copied.append(len(tree.digest) - before)
    roots = [tree.digest[tree.root]] + [None] * (len(pdf) - 1)
    return pd.DataFrame({"doc_id": pdf.doc_id, "lang": pdf.lang, "tree": pdf.tree, "n": pdf.n, "pos": pdf.pos, "leaf": pdf.leaf, "changed": pdf.changed, "proof": proofs, "folded": folded, "copied": copied, "block_root": np.array(roots, dtype=object)})


def _node_block(pdf: pd.DataFrame, height: int) -> pd.DataFrame:
    """A block of nodes further up: each node's path to the block's root, and that root beside the first."""
    pdf = pdf.sort_values("pos")
    tree = PersistentTree(list(pdf.digest), _levels(int(pdf.n.iloc[0]), height))
    paths = [[{"l": tree.digest[s] if s >= 0 and left else "", "r": tree.digest[s] if s >= 0 and not left else ""} for s, left in tree.path(i)] for i in range(len(pdf))]
    roots = [tree.digest[tree.root]] + [None] * (len(pdf) - 1)
    return pd.DataFrame({"tree": pdf.tree, "n": pdf.n, "pos": pdf.pos, "digest": pdf.digest, "path": paths, "block_root": np.array(roots, dtype=object)})


def _version_block(versions: pd.DataFrame, nodes: pd.DataFrame, height: int) -> pd.DataFrame:
    """Versions go on through a block of nodes further up: each one's node is a changed leaf there, whose ancestors are copied."""
    if versions.empty:
        return versions[["own", "place", "tree", "pos", "digest", "copied"]]
    nodes = nodes.sort_values("pos")
    tree = PersistentTree(list(nodes.digest), _levels(int(nodes.n.iloc[0]), height))
    roots = [tree.version(at, digest) for at, digest in zip(versions.pos - nodes.pos.iloc[0], versions.digest, strict=True)]
    return pd.DataFrame({"own": versions.own, "place": versions.place, "tree": versions.tree, "pos": versions.pos.to_numpy() >> height, "digest": np.array([tree.digest[x] for x in roots], dtype=object), "copied": versions.copied + tree.height})


_VERSIONS = "own bigint, place bigint, tree bigint, pos bigint, digest string, copied bigint"
_PATH = "array<struct<l: string, r: string>>"


def _up(n: Column, height: int) -> Column:
    return F.shiftright(n + ((1 << height) - 1), height)


def _copied(nodes: DataFrame, versions: DataFrame, height: int) -> DataFrame:
    """versions (own, place, tree, pos, digest, copied), each of the leaf at a place of tree `own`, a level of blocks further up. A block of many versions meets them in parts, each with the block's nodes; the table of such blocks has fewer rows than versions / PART_VERSIONS."""
    block = F.shiftright("pos", height)
    keys = ["tree", "block", "part"]
    many = F.broadcast(versions.groupBy("tree", block.alias("block")).agg(F.ceil(F.count("*") / PART_VERSIONS).alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    dealt = versions.withColumn("block", block).join(many, ["tree", "block"], "left").withColumn("part", F.pmod(F.xxhash64("own", "place"), parts)).drop("parts")
    each = nodes.withColumn("block", block).join(many, ["tree", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
    grown = dealt.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(lambda v, n: _version_block(v, n, height), _VERSIONS)
    return store(grown).df


def _paths(nodes: DataFrame, versions: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, n, pos, digest) with each one's path to its tree's top, and the top's digest; and versions, which begin at nodes, at their tops. Blocks go up level by level, a few rounds whatever the size, and paths come down again."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("tree", "n", "pos", "digest", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top")), versions
    block = F.shiftright("pos", height)
    built = store(nodes.groupBy("tree", block.alias("block")).applyInPandas(lambda pdf: _node_block(pdf, height), f"tree bigint, n bigint, pos bigint, digest string, path {_PATH}, block_root string")).df
    over = built.where("block_root is not null").select("tree", _up(F.col("n"), height).alias("n"), block.alias("pos"), F.col("block_root").alias("digest"))
    over, versions = _paths(over, _copied(nodes, versions, height), height)
    over = over.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), "top")
    return built.withColumn("block", block).join(over, ["tree", "block"]).select("tree", "n", "pos", "digest", F.concat("path", "rest").alias("path"), "top"), versions


def fold(digest: Column, path: Column) -> Column:
    """The digest at the end of a path of siblings, each left or right of what is folded so far, or absent."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, is_tampered: Callable[[Column], Column] = tampered, height: int = HEIGHT) -> DataFrame:
    """(doc_id, lang, pos, leaf, subroot, root, proof_sha256, folded_root, verified, tampered_leaf, copied_nodes, copied_above) of each row.

    pos is the leaf's place in its language. proof_sha256 hashes the siblings from the leaf
    to the root. Of rows whose doc_id `is_tampered` picks, n_chars grows by one (null stays),
    and folded_root is the root of the version that this leaf makes; of others, it is the
    leaf folded along its siblings. verified tells whether it is the root; copied_nodes counts
    what the version copied within its block, which has `height` levels, copied_above what it
    copied from there to the root. Null fields hash as `-`; a null language is the first
    tree, a null doc_id the first leaves of its tree and never tampered; rows of one doc_id
    are ordered by their leaves, so equal rows are interchangeable. Long texts are hashed
    whole. An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    fields = {c: F.col(c) for c in LEAF}
    changed = leaf_hash(fields | {"n_chars": F.col("n_chars").cast("bigint") + 1})
    slim = docs.select("doc_id", "lang", F.unhex(leaf_hash(fields)).alias("leaf"), F.when(is_tampered(F.col("doc_id")), F.unhex(changed)).alias("changed"))
    placed = store(numbered(store(slim).df, F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("leaf"), as_="at")).df
    langs = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    langs = store(numbered(langs, F.asc_nulls_first("lang"), as_="tree")).df
    named = langs.withColumnRenamed("lang", "__lang")
    leaves = placed.join(named, F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("pos", F.col("at") - F.col("first")).drop("__lang", "at", "first")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    block = F.shiftright("pos", height)
    schema = f"doc_id {id_type}, lang string, tree bigint, n bigint, pos bigint, leaf binary, changed binary, proof binary, folded string, copied bigint, block_root string"
    built = store(leaves.select("doc_id", "lang", "tree", "n", "pos", "leaf", "changed").groupBy("tree", block.alias("block")).applyInPandas(lambda pdf: _leaf_block(pdf, height), schema)).df
    nodes = store(built.where("block_root is not null").select("tree", _up(F.col("n"), height).alias("n"), block.alias("pos"), F.col("block_root").alias("digest"))).df
    versions = store(built.where("changed is not null").select(F.col("tree").alias("own"), F.col("pos").alias("place"), "tree", block.alias("pos"), F.col("folded").alias("digest"), F.lit(0).cast("bigint").alias("copied"))).df
    tops, versions = _paths(nodes, versions, height)
    tops = store(tops).df
    trees = tops.where("pos = 0").select(F.lit(0).cast("bigint").alias("tree"), F.lit(langs.count()).cast("bigint").alias("n"), F.col("tree").alias("pos"), F.col("top").alias("digest"))
    trees, versions = _paths(trees, versions.withColumn("pos", F.col("tree")).withColumn("tree", F.lit(0).cast("bigint")), height)
    trees = store(trees).df.select(F.col("pos").alias("tree"), F.col("path").alias("last"), F.col("top").alias("root"))
    above = store(tops.join(trees, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "root")).df
    each = built.withColumn("block", block).join(above, ["tree", "block"])
    siblings = F.concat(F.lower(F.hex("proof")), F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""))
    ends = versions.select(F.col("own").alias("tree"), F.col("place").alias("pos"), F.col("digest").alias("end"), F.col("copied").alias("copied_above"))
    same = each.where("changed is null").withColumn("end", fold(F.col("folded"), F.col("path"))).withColumn("copied_above", F.lit(0).cast("bigint"))
    each = same.unionByName(each.where("changed is not null").join(ends, ["tree", "pos"]))
    out = each.select("doc_id", "lang", "pos", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), F.col("end").alias("folded_root"), F.lower(F.hex("changed")).alias("tampered_leaf"), F.col("copied").alias("copied_nodes"), "copied_above")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(read_documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# crc32 by its definition, a bit a step; the tree by a recursion over levels, each leaf followed up to the root.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_concat([CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))),
                     lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, pos, sha256(head || chars || tail) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(head || more || tail) END AS changed
  FROM d
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, pos // 2
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY pos // 2
), low AS (
  SELECT doc_id, lang, pos AS leaf_pos, leaf, pos, 0 AS level, '' AS proof, changed AS folded, (SELECT max(n) FROM nodes x WHERE x.lang IS NOT DISTINCT FROM leaves.lang AND x.level = 0) AS n FROM leaves
  UNION ALL
  SELECT l.doc_id, l.lang, l.leaf_pos, l.leaf, l.pos // 2, l.level + 1, l.proof || coalesce(s.digest, ''),
         CASE WHEN l.folded IS NULL THEN NULL WHEN l.pos % 2 = 1 THEN sha256(coalesce(s.digest, '') || l.folded) ELSE sha256(l.folded || coalesce(s.digest, '')) END, (l.n + 1) // 2
  FROM low l LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.pos = xor(l.pos, 1) WHERE l.n > 1
), high AS (
  SELECT l.doc_id, l.leaf, r.digest AS subroot, r.pos, 0 AS level, l.proof, l.folded, (SELECT count(*) FROM subroots) AS n FROM low l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1
  UNION ALL
  SELECT h.doc_id, h.leaf, h.subroot, h.pos // 2, h.level + 1, h.proof || coalesce(s.digest, ''),
         CASE WHEN h.folded IS NULL THEN NULL WHEN h.pos % 2 = 1 THEN sha256(coalesce(s.digest, '') || h.folded) ELSE sha256(h.folded || coalesce(s.digest, '')) END, (h.n + 1) // 2
  FROM high h LEFT JOIN tops s ON s.level = h.level AND s.pos = xor(h.pos, 1) WHERE h.n > 1
)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, coalesce(folded, t.digest) AS folded_root, coalesce(folded, t.digest) = t.digest AS verified
FROM high, (SELECT digest FROM tops WHERE n = 1) t WHERE high.n = 1
"""
