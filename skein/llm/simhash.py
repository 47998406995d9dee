"""SimHash near-duplicates, compared through bit planes.

Fingerprints are stored vertically: plane b holds bit b of 64 fingerprints in one machine
word. A row is compared with 64 others at a time by exclusive-or with each plane; carry-save
counters, one word for each binary digit of the count, add the differing bits of all 64 at
once. Counters start so that they overflow just beyond the radius, and a block of 64 is
abandoned when every lane has overflowed.

Only distinct fingerprints are compared, within blocks that every pair in reach must share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import binary, mix, prepare, store
from skein.operators.components import connected_components

#: Rows of one block that are compared as they are; larger blocks are divided, without losing a pair.
BLOCK_ROWS = 2048
#: Rows that a task holds while it compares.
CHUNK_ROWS = 16384
#: Row and block pairs compared in one numpy step.
STEP_PAIRS = 1 << 17

_SALTS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], dtype=np.uint64)


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ngram words, A-Z lower-cased, split at ASCII white space; fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= ngram:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))
    return np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """words 64-bit parts; a bit is 1 if set in over half of the hashes. No hashes: zero."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            part = part if k == 0 else mix(part ^ _SALTS[k])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _bands(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """bands 64-bit keys, each from the minima of `rows` multiplicative permutations of the shingle hashes."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[None, at : at + 4096] * factors[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)]


def with_fingerprints(docs: DataFrame, ngram: int, words: int = 1, bands: int = 0, rows: int = 0) -> DataFrame:
    """(doc_id, fp array<long>[, bands array<long>]) of each row; docs has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in binary(batch.column(1)):
                h = shingle_hashes(text, ngram)
                fps.append(fingerprint(h, words).view(np.int64).tolist())
                if bands:
                    keys.append(np.array(_bands(h, bands, rows), dtype=np.uint64).view(np.int64).tolist())
            columns = [batch.column(0), pa.array(fps, pa.list_(pa.int64()))] + ([pa.array(keys, pa.list_(pa.int64()))] if bands else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "bands"][: len(columns)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp array<bigint>" + (", bands array<bigint>" if bands else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit planes (bits, blocks) of fps (rows, words), and the bits (rows, bits)."""
    n, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, words * 64), np.uint8)
    padded[:n] = bits
    lanes = np.packbits(padded.T.reshape(words * 64, -1, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view(np.uint64)[:, :, 0], bits


def links(fps: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < end[i], of rows of fps that differ in at most radius bits.

    start and end bound the run of rows that row i may be compared with.
    """
    planes, bits = _planes(fps)
    digits = max(1, (radius + 1).bit_length())
    first = (1 << digits) - 1 - radius  # the counter overflows when radius + 1 is added
    full, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    row = np.arange(len(fps))
    low = (row + 1) // 64
    count = np.where(end > row + 1, (end - 1) // 64 - low + 1, 0)
    edges = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(fps):
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + STEP_PAIRS, side="right")) - 1)
        i = np.repeat(row[at:upto], count[at:upto])
        block = low[i] + np.arange(edges[at], edges[upto]) - edges[i]
        at = upto
        if not len(i):
            continue
        lo = np.clip(i + 1 - block * 64, 0, 64).astype(np.uint64)
        hi = np.clip(end[i] - block * 64, 0, 64).astype(np.uint64)
        below = lambda x: np.where(x == 64, full, (np.uint64(1) << (x & np.uint64(63))) - np.uint64(1))
        over = ~(below(hi) & ~below(lo))  # lanes outside the run count as exceeded
        digit = [np.full(len(i), full if first >> k & 1 else zero) for k in range(digits)]
        for b in range(planes.shape[0]):
            carry = planes[b][block] ^ (zero - bits[i, b].astype(np.uint64))
            for k in range(digits):
                digit[k], carry = digit[k] ^ carry, digit[k] & carry
            over |= carry
            if b % 8 == 7:
                alive = over != full
                if alive.mean() < 0.8:
                    i, block, over, digit = i[alive], block[alive], over[alive], [d[alive] for d in digit]
                    if not len(i):
                        break
        near = ~over
        hit = np.flatnonzero(near)
        lane = np.unpackbits(np.ascontiguousarray(near[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(lane)
        yield i[hit[which]], block[hit[which]] * 64 + bit


def _lowest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row it is connected with."""
    label = np.arange(n)
    for i, j in found:
        a, b = np.concatenate([i, np.arange(n)]), np.concatenate([j, label])
        while True:
            old = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == old).all():
                break
    return label


def _compare(radius: int, words: int, named: int = 0):
    """For rows (key, fp) sorted by key: edges (a, b) that connect what is linked within each key's run.

    With named, that many more longs follow a fingerprint's words, and edges are between these.
    """

    def solve(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        end = np.repeat(start + size, size)
        label = _lowest(len(key), links(fps[:, :words], np.repeat(start, size), end, radius))
        own = np.flatnonzero(label != np.arange(len(key)))
        name = fps[:, words:] if named else fps
        as_list = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64).tolist(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([as_list(name[own]), as_list(name[label[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.zeros(0, np.int64), np.zeros((0, words + named), np.uint64)
        for batch in batches:
            fps = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words + named)
            keys, held = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([held, fps])
            if len(keys) >= CHUNK_ROWS:
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield solve(keys[:cut], held[:cut])
                    keys, held = keys[cut:], held[cut:]
        if len(keys):
            yield solve(keys, held)

    return run


def _pigeonhole(bits: list[int], keep: int, parts: int) -> list[list[int]]:
    """Bit lists: the bits dealt into `parts`, every choice of `keep` of them."""
    dealt = [bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts)]
    return [sum(c, []) for c in combinations(dealt, keep)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _edges(rows: DataFrame, radius: int, words: int, named: int = 0) -> DataFrame:
    """rows (key long, fp): rows of a key meet, sorted, and are compared there."""
    return rows.repartition(F.col("key")).sortWithinPartitions("key").select("key", "fp").mapInArrow(_compare(radius, words, named), "a array<bigint>, b array<bigint>")


def exact_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Edges that connect all 64-bit fingerprints (fp array of one long, distinct) within radius bits.

    The bits are dealt into radius + 3 parts; two fingerprints in reach agree on three of
    them at least, so each choice of three keys a block, and every pair in reach meets in
    one. A block of more than BLOCK_ROWS rows is keyed again in the same way by the bits it
    leaves free, which bounds it: 2/5 of 2/5 of 64 bits, for a radius of 2, leave at most
    2 ** 11 distinct fingerprints. No pair is lost.
    """
    parts = radius + 3
    tables = _pigeonhole(list(range(64)), 3, parts)
    word = F.col("fp")[0]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), word.bitwiseAND(F.lit(_mask(b))).alias("v")) for t, b in enumerate(tables)])).alias("k"))
    keyed = keyed.select("fp", "k.t", "k.v")
    hot = store(keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).drop("n")).df  # written, so that Spark can split a hot block's joins
    plain = keyed.join(hot, ["t", "v"], "left_anti").select(F.xxhash64("t", "v").alias("key"), "fp")
    finer: Column = F.lit(None).cast("array<struct<s:int,w:bigint>>")
    for t, kept in enumerate(tables):
        free = [b for b in range(64) if b not in kept]
        subs = _pigeonhole(free, 3, parts)
        finer = F.when(F.col("t") == t, F.array(*[F.struct(F.lit(s).alias("s"), word.bitwiseAND(F.lit(_mask(b))).alias("w")) for s, b in enumerate(subs)])).otherwise(finer)
    split = keyed.join(hot, ["t", "v"], "left_semi").select("t", "v", "fp", F.explode(finer).alias("k")).select(F.xxhash64("t", "v", "k.s", "k.w").alias("key"), "fp")
    return _edges(plain.unionByName(split), radius, 1)


def banded_edges(fps: DataFrame, radius: int, words: int, named: int = 0) -> DataFrame:
    """Edges that connect fingerprints within radius bits among those that share a band key (fp, bands distinct); named: see _compare.

    In a band of more than BLOCK_ROWS rows those in reach of its least row are linked to it,
    so a group of near copies costs its rows and no more. Only the others are compared with
    the whole band, in chunks that meet two by two in tasks of their own; no pair is lost.
    """
    keyed = fps.select("fp", F.posexplode("bands").alias("t", "v")).select("fp", F.xxhash64("t", "v").alias("key")).distinct()
    sizes = store(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")).df  # written, as above
    plain = _edges(keyed.join(sizes.where(F.col("n") <= BLOCK_ROWS), "key").select("key", "fp"), radius, words, named)
    hot = sizes.where(F.col("n") > BLOCK_ROWS)
    if hot.isEmpty():
        return plain
    rows = store(keyed.join(hot, "key").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.ceil(F.col("n") / BLOCK_ROWS)))).df
    lead = store(rows.groupBy("key").agg(F.min("fp").alias("lead"))).df
    apart = sum((F.bit_count(F.col("fp")[w].bitwiseXOR(F.col("lead")[w])) for w in range(words)), F.lit(0))
    judged = store(rows.join(lead, "key").withColumn("near", apart <= radius)).df
    others = judged.where(~F.col("near")).groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("s"))
    met = judged.join(others, "key").withColumn("o", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("s")))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c - 1))
    whole = met.withColumn("o", each(F.col("s")))
    visits = met.where(~F.col("near")).drop("c").withColumn("c", each(F.ceil(F.col("n") / BLOCK_ROWS)))
    met = whole.select(F.xxhash64("key", "c", "o").alias("key"), "fp").unionByName(visits.select(F.xxhash64("key", "c", "o").alias("key"), "fp")).distinct()
    name = lambda c: F.slice(c, words + 1, named) if named else F.col(c)
    stars = judged.where("near and fp <> lead").select(name("fp").alias("a"), name("lead").alias("b"))
    return plain.unionByName(stars).unionByName(_edges(met, radius, words, named))


def simhash_components(docs: DataFrame, ngram: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id) of each row of docs (doc_id, text): exact groups of linked fingerprints.

    Null or blank texts have fingerprint zero and are linked like any other, long ones count
    whole, and a bit of exactly half the shingles is not set. Equal
    fingerprints are one node, so copies cost nothing beyond their own rows. Repeated rows
    are returned as often as they occur; an empty table gives an empty result. component_id
    is the smallest non-null doc_id reachable. Other columns of docs are ignored.
    """
    prepare(docs.sparkSession)
    own = store(with_fingerprints(docs, ngram)).df
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(exact_edges(nodes.select("fp"), radius))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = store(named).df
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.col("fp")[0].alias("fp"), "component_id")


#: For near copies on word shingles: of 256 bits 39 differ on average at a Jaccard likeness of 0.8, and
#: 48 where it is 4 shingles of 5, with a deviation of 6; the radius leaves five of these more, as links are verified.
NEAR_WORDS, NEAR_RADIUS, NEAR_BANDS, NEAR_ROWS = 4, 80, 20, 5


def _node(shingles: np.ndarray) -> list[int]:
    """128 bits of a set of shingles (sorted, distinct), as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()


def with_nodes(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, x long, node array<long>, fp array<long>, bands array<long>) of each row: x of its id and text, the rest of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in binary(batch.column(2)):
                h = np.unique(shingle_hashes(text, ngram))
                nodes.append(_node(h))
                fps.append(fingerprint(h, NEAR_WORDS).view(np.int64).tolist())
                keys.append(np.array(_bands(h, NEAR_BANDS, NEAR_ROWS), dtype=np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.list_(pa.int64())) for c in (nodes, fps, keys))], names=["doc_id", "x", "node", "fp", "bands"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x bigint, node array<bigint>, fp array<bigint>, bands array<bigint>"
    return docs.select("doc_id", _row_hash(), "text").mapInArrow(run, schema)


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text").alias("x")


def _alike(shared: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
    """Likeness 0.8 or more, exactly, from the shared shingles and the sum of both sets' sizes."""
    return 9 * shared >= 4 * sizes


def _with_sets(ngram: int):
    """(node, root, shingles) of rows (node, root, text) whose text has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, ngram)) for t in binary(batch.column(2))]
            own = [_node(h) == node for h, node in zip(sets, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "root", "shingles"]).filter(pa.array(own, pa.bool_()))

    return run


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each row's set is alike to that of its group's first node."""
    for batch in batches:
        near = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            near.append(bool(_alike(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=["node", "root", "shingles", "near"])


class _Chunk:
    """The sets at home in a chunk, by shingle; those near their group's first node count as connected."""

    def __init__(self, rows: list[tuple]):
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.nodes, self.size = [r[0] for r in rows], np.array([len(x) for x in sets], np.int64)
        value, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        led = [i for i, r in enumerate(rows) if r[2]]
        self.group = np.arange(len(rows))
        self.group[led] = led[0] if led else 0

    def link(self, node: list[int], shingles: bytes) -> Iterator[tuple[list[int], list[int]]]:
        """Edges of a node to one node of each connected group with a set alike, which join into one."""
        s = np.frombuffer(shingles, np.uint64)
        low, high = np.searchsorted(self.value, s, "left"), np.searchsorted(self.value, s, "right")
        n = high - low
        place = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(s) else np.zeros(0, np.int64)
        shared = np.bincount(self.owner[place], minlength=len(self.nodes))
        groups, first = np.unique(self.group[hit := np.flatnonzero(_alike(shared, self.size + len(s)))], return_index=True)
        for i in hit[first].tolist():
            yield node, self.nodes[i]
        if len(groups) > 1:
            self.group[np.isin(self.group, groups)] = groups[0]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, visits, node, shingles, near) by key, those at home before visitors: edges of what is alike to a row not near."""
    now, home, chunk = None, [], None

    def settle():
        chunk = _Chunk(home)
        return chunk, [e for r in home if not r[2] for e in chunk.link(r[0], r[1])]

    for batch in batches:
        found = []
        for key, visits, node, shingles, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if home and chunk is None:
                    found += settle()[1]
                now, home, chunk = key, [], None
            if not visits:
                home.append((node, shingles, near))
                continue
            if chunk is None:
                chunk, edges = settle()
                found += edges
            found += chunk.link(node, shingles)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.list_(pa.int64())) for k in (0, 1)], names=["a", "b"])
    if home and chunk is None:
        found = settle()[1]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.list_(pa.int64())) for k in (0, 1)], names=["a", "b"])


def verified_edges(docs: DataFrame, maybe: DataFrame, ngram: int) -> DataFrame:
    """Edges that connect all nodes of a group of maybe (node, x, root) whose sets of shingles are alike in 0.8 or more.

    Each set is made anew from one text. Sets alike to that of the group's root are linked
    to it; only the others are compared with all of their group, in chunks of BLOCK_ROWS rows
    that they visit, so a group of copies of one text costs no more than its rows.
    """
    reps = docs.select(_row_hash(), "text").join(maybe, "x").select("node", "root", "text")
    sets = store(reps.mapInArrow(_with_sets(ngram), "node array<bigint>, root array<bigint>, shingles binary").dropDuplicates(["node"])).df
    first = sets.where("node = root").select("root", F.col("shingles").alias("leads"))
    judged = store(sets.join(first, "root").select("node", "root", "shingles", "leads").mapInArrow(_led, "node array<bigint>, root array<bigint>, shingles binary, near boolean")).df
    sizes = store(judged.groupBy("root").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("others")).where("others > 0").select("root", F.ceil(F.col("n") / BLOCK_ROWS).alias("s"))).df
    rows = judged.join(sizes, "root").withColumn("c", F.pmod(F.xxhash64("node"), F.col("s")))
    home = rows.withColumn("o", F.col("c"))
    away = rows.where(~F.col("near") & (F.col("s") > 1)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") - 1))).where("o <> c")
    met = home.unionByName(away).select(F.xxhash64("root", "o").alias("key"), (F.col("o") != F.col("c")).alias("visits"), "node", "shingles", "near")
    edges = met.repartition("key").sortWithinPartitions("key", "visits").mapInArrow(_verify, "a array<bigint>, b array<bigint>")
    return judged.where("near and node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(edges)


def _near_nodes(docs: DataFrame, ngram: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, x, node), and (node, root, first): of each node its group and its first row (none: without an id, doc_id, x)."""
    own = store(with_nodes(docs, ngram)).df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("first")
    nodes = store(own.groupBy("node").agg(F.min("x").alias("x"), first)).df
    maybe = connected_components(banded_edges(own.select(F.concat("fp", "node").alias("fp"), "bands"), radius, NEAR_WORDS, 2))
    roots = connected_components(verified_edges(docs, nodes.select("node", "x").join(maybe, "node"), ngram))
    return own.select("doc_id", "x", "node"), store(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))).df


def near_copies(docs: DataFrame, ngram: int = 5, radius: int = NEAR_RADIUS) -> DataFrame:
    """(doc_id, component_id) of each row: groups of texts alike in 0.8 or more of their five-word shingles.

    Texts of the same set of shingles are one node, with four SimHash words of that set; nodes
    that share one of 20 keys of five minima meet in a block, which a pair of likeness 0.8
    does with a chance of 0.9996, and are compared there through bit planes. What this may
    connect is verified on the sets. Equal texts always share a group. Nulls, empty tables and repeated
    rows: as in simhash_components.
    """
    prepare(docs.sparkSession)
    own, named = _near_nodes(docs, ngram, radius)
    least = named.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    return own.join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, ngram: int = 5, radius: int = NEAR_RADIUS) -> DataFrame:
    """docs without near copies: one row of each group stays, the one of the smallest doc_id.

    Rows without an id come last in their group, and rows of one id are ordered by a hash of
    their texts; rows equal in both are one. Blank and null texts are one group. Very long
    texts count whole; no link is missed for their length. An empty table stays empty; all
    columns are kept, whatever their names.
    """
    prepare(docs.sparkSession)
    first = _near_nodes(docs, ngram, radius)[1].groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    nil = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", nil).alias("i"), "x"]
    rows = docs.select(F.struct("*").alias("row"), "doc_id", _row_hash()).select("row", *key)
    found = rows.join(first.select(*key), ["none", "i", "x"], "left_semi")
    return found.groupBy("none", "i", "x").agg(F.first("row").alias("row")).select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import read_documents

    found = simhash_components(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
