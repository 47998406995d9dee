"""The Merkle manifest, the mix of sources and the cross-tokenizer alignment: SQL, plain versions, and odd input."""

from __future__ import annotations

import collections
import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.llm import crosstok, merkle, mixing
from tests.test_oracle import plain

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size long, leaf string, pos long, key string"
LONG = " ".join(f"word{i % 97}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null in each column, empty, blank and very long texts, repeated rows, repeated ids, and columns named as the operators' own."""
    texts = [None, "", " \n\t ", "one two three", "one two three", LONG, "Straße 日本 é\n\nz", "<|endoftext|> <s> a", "a▁b", "x  y", "ﬁ ½"]
    data = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2", "Z"][i % 4], None if i == 2 else len(t or "")) for i, t in enumerate(texts)]
    data += [(None, "no id", "en", "s1", 5), data[3], data[3], (4, "other text of this id", "en", "s1", 21), (40, "alone in its language", "zz", "é", 21)]
    return spark.createDataFrame([(*r, 9, "x", 3, "k") for r in data], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def con(spark, df=None):
    c = duckdb.connect()
    if df is None:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    else:
        table = df.toArrow()
        c.register("documents", table)
    return c


@pytest.mark.parametrize("query,sql", [(merkle.op11_merkle, merkle.OP11_SQL), (mixing.op12_mixing, mixing.OP12_SQL)])
def test_against_sql(spark, query, sql):
    got, want = query(spark, SMALL).toPandas(), con(spark).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """All levels of a tree, and each leaf's siblings, left to right."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        paths.append([(levels[k][(i >> k) ^ 1] if (i >> k) ^ 1 < len(levels[k]) else None, i >> k & 1) for k in range(len(levels) - 1)])
    return levels[-1][0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(field(r.doc_id), field(r.source), field(r.lang), field(None if r.n_chars is None else r.n_chars + more), field(r.text))
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.lang].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        own[lang] = plain_tree([leaf(r) for r in trees[lang]])
    root, tops = plain_tree([own[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for r, path in zip(trees[lang], own[lang][1], strict=True):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now = leaf(r, 1) if changed else leaf(r)
            for sibling, right in path + top:
                now = sha(*((sibling or "", now) if right else (now, sibling or "")))
            out.append((r.doc_id, leaf(r), own[lang][0], root, sha(*[s for s, _ in path + top if s]), now, now == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_of_odd_rows(spark, odd, height):
    more = odd.unionByName(odd.limit(0)).unionByName(spark.range(100, 157).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source"), F.lit(4).alias("n_chars"), *[F.lit(None).cast(odd.schema[c].dataType).alias(c) for c in ("size", "leaf", "pos", "key")]))
    made = merkle.manifest(more, height=height)
    got = made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(more.collect()), key=key)
    changed = made.where("tampered_leaf is not null").select("doc_id", "copied_nodes", "verified").collect()
    assert {r.doc_id for r in changed} == {i for i in [*range(11), 40, *range(100, 157)] if zlib.crc32(str(i).encode()) % 7 == 0}
    assert all(r.copied_nodes <= height + 1 for r in changed) and all(r.verified == (r.doc_id == 2) for r in changed)


@pytest.mark.parametrize("height,part", [(1, 3), (3, 5), (10, 1 << 11)])
def test_versions_copy_nodes_up_to_the_root(spark, monkeypatch, height, part):
    """Above the leaves' blocks, too, however many blocks there are and in however many parts a block meets its versions."""
    monkeypatch.setattr(merkle, "PART_VERSIONS", part)
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.expr("CASE WHEN id < 64 THEN 'de' WHEN id < 89 THEN 'en' END").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("t"), "id").alias("text"))
    rows, made = docs.collect(), merkle.manifest(docs, lambda c: c % 2 == 0, height).collect()
    levels = {"de": 6 + 2, "en": 5 + 2, None: 0 + 2}
    for r in made:
        assert r.copied_nodes + r.copied_above == (0 if r.doc_id % 2 else 1 + levels[r.lang]), r
        assert r.verified == bool(r.doc_id % 2) and (r.folded_root == r.root) == r.verified
    assert len({r.folded_root for r in made}) == 46 and len({r.root for r in made}) == 1
    monkeypatch.setattr(zlib, "crc32", lambda x: 7 if int(x) % 2 == 0 else 1)
    assert sorted((r.doc_id, r.proof_sha256, r.folded_root) for r in made) == sorted((r[0], r[4], r[5]) for r in plain_manifest(rows))


def test_untampered_leaves_are_folded(monkeypatch):
    """What an untampered leaf comes to is worked out from its siblings: a wrong one shows."""
    pdf = pd.DataFrame({"doc_id": range(5), "lang": "en", "tree": 0, "n": 5, "pos": range(5), "leaf": [bytes.fromhex(sha(str(i))) for i in range(5)], "changed": None})
    right = merkle._leaf_block(pdf, 10)
    assert list(right.folded) == [right.block_root[0]] * 5 and list(right.copied) == [0] * 5
    path = merkle.PersistentTree.path
    monkeypatch.setattr(merkle.PersistentTree, "path", lambda self, at: [(s if at != 3 else self.root, left) for s, left in path(self, at)])
    assert [x == right.block_root[0] for x in merkle._leaf_block(pdf, 10).folded] == [True, True, True, False, True]


def test_manifest_without_rows(empty):
    assert merkle.manifest(empty).count() == 0


def test_persistent_tree():
    leaves = [sha(str(i)) for i in range(11)]
    tree = merkle.PersistentTree(leaves, 4)
    root, size = tree.digest[tree.root], len(tree.digest)
    versions = [tree.version(i, sha("changed", str(i))) for i in range(11)]
    assert len(tree.digest) == size + 11 * 5 and tree.digest[tree.root] == root
    for i, v in enumerate(versions):
        assert tree.digest[v] == plain_tree([sha("changed", str(k)) if k == i else x for k, x in enumerate(leaves)])[0]
        reached, todo = set(), [v]
        while todo:
            n = todo.pop()
            reached.add(n)
            todo += [x for x in (tree.left[n], tree.right[n]) if x >= 0]
        assert sum(n >= size for n in reached) == 5  # all else is shared with the first tree


def test_mix_of_odd_rows(spark, odd, empty):
    got = mixing.shares(odd).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert plain(got) == plain(con(spark, odd).sql(mixing.OP12_SQL).df())
    assert mixing.shares(empty).count() == 0 and mixing.mixture(empty).count() == 0
    again = mixing.shares(odd.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert plain(again) == plain(got)


def test_mixture_takes_what_shares_say(spark, odd):
    docs = odd.withColumn("repetition", F.lit("clash"))
    mix = mixing.mixture(docs)
    assert mix.columns == [*[c for c in docs.columns if c != "repetition"], "repetition"]
    words = lambda t: len((t or "").split())
    taken = collections.Counter()
    for r in mix.collect():
        taken[r.doc_id] += words(r.text)
        assert r["size"] == 9 and r.key == "k"
    want = collections.Counter()
    for r in mixing.shares(odd).collect():
        want[r.doc_id] += r.taken
    assert taken == +want


def test_water_filling(spark):
    """The common level against bisection, for weights by cycle and by name."""
    sizes = [("a", 10), ("b", 1000), ("c", 5), ("d", 700), (None, 90), ("e", 0)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    for weights in [(3, 1, 2), (1,), {"a": 5.0, "b": 1.0, None: 2.5}]:
        order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        w = {s: weights[i % len(weights)] if isinstance(weights, tuple) else weights.get(s, 0.0) for i, (s, _) in enumerate(order)}
        goal = 1.5 * sum(n for _, n in sizes)
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2.0 * n, w[s] * mid) for s, n in sizes) < goal else (low, mid)
        got = {r.source: r.target for r in mixing.targets(df, weights, 1.5, 2.0).collect()}
        reach = sum(2.0 * n for s, n in sizes if w[s])
        want = {s: min(2.0 * n, w[s] * low) for s, n in sizes} if reach >= goal else {s: 2.0 * n if w[s] else 0.0 for s, n in sizes}
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    taken = mixing.shares(docs)
    assert taken.where("taken > 2 * size").count() == 0
    for r in taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.5
    other = mixing.shares(docs, seed=2)
    assert {tuple(r) for r in other.select("doc_id", "taken").collect()} != {tuple(r) for r in taken.select("doc_id", "taken").collect()}


def plain_alignment(rows):
    """What align_counts returns, from the libraries' encoders and a walk over both sides' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401  the file's own decoder

    a_side = Tokenizer.from_file(crosstok.tokenizer_path())
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=crosstok.tokenizer_path("piece_bpe_32k.model"))
    alphabet = crosstok._byte_alphabet()
    a_bytes = lambda i: bytes(alphabet[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    links, found = collections.Counter(), []
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        pa, pb = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not text or not b"".join(pa) == b"".join(pb) == (" " + text).encode():
            found.append((doc, [], [], [], []))
            continue
        groups, own, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        group = ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                group[0].append(a[i])
                at_a += len(pa[i])
                i += 1
            else:
                group[1].append(b[j])
                at_b += len(pb[j])
                j += 1
            if at_a == at_b:
                groups.append(group)
                own.append((group[0][-1], group[1][-1]))
                group = ([], [])
        links.update(own)
        found.append((doc, a, b, groups, own))
    most = collections.Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    text = lambda g: ",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1]))
    rows = [(d, len(a), len(b), len(g), len(o), sum(links[x] == most[x[1]] for x in o), sum(links[x] for x in o), sha(";".join(map(text, g))) if g else "") for d, a, b, g, o in found]
    return rows, links


MEASURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_brute_force(spark, odd, empty):
    files = crosstok.tokenizer_path(), crosstok.tokenizer_path("piece_bpe_32k.model")
    for df in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        measures, pairs = crosstok.align_counts(df, *files)
        want, links = plain_alignment([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        key = lambda r: tuple(map(str, r))
        assert measures.columns == MEASURES
        assert sorted(map(tuple, measures.collect()), key=key) == sorted(want, key=key)
        assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(links)
    assert crosstok.align_counts(empty, *files)[0].count() == 0 and crosstok.alignments(empty, *files).count() == 0


def test_alignment_of_many_copies(spark):
    """A text of more rows than a part: each row has its measures, counts follow all rows."""
    files = crosstok.tokenizer_path(), crosstok.tokenizer_path("piece_bpe_32k.model")
    n = 3 * crosstok.ROWS_A_PART
    df = spark.range(n + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "the same words again").otherwise("the other").alias("text"))
    got = crosstok.align_counts(df, *files)[0].collect()
    want = plain_alignment([(i, "the same words again" if i < n else "the other") for i in range(n + 1)])[0]
    assert sorted(map(tuple, got)) == sorted(want)


def test_alignments_are_whole(spark, odd):
    files = crosstok.tokenizer_path(), crosstok.tokenizer_path("piece_bpe_32k.model")
    side = crosstok.Aligner(open(files[0], encoding="utf-8").read(), open(files[1], "rb").read())
    found = crosstok.alignments(odd, *files).collect()
    texts = sorted({r.text for r in odd.collect() if r.text})
    assert {r.text for r in found} == {t for t, r in zip(texts, plain_alignment(enumerate(texts))[0], strict=True) if r[1]}
    for r in found:
        raw, at = (" " + r.text).encode(), 0
        for g in r.groups:
            own = b"".join(side.a.token[i] for i in g.a)
            assert own == b"".join(side.b.token[i] for i in g.b) == raw[at : g.end]
            at = g.end
        assert at == len(raw)
    assert {r.text: r.copies for r in found}["one two three"] == 4


def test_files_that_ranks_cannot_express_go_to_the_library():
    import json

    files = crosstok.tokenizer_path()
    data = json.load(open(files, encoding="utf-8"))
    fast = crosstok.ByteTokens(json.dumps(data))
    data["pre_tokenizer"]["add_prefix_space"] = True
    slow = crosstok.ByteTokens(json.dumps(data))
    assert fast.by_rank is not None and slow.by_rank is None
    assert slow.encode(" a b") == fast.encode(" a b")
