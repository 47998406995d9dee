"""Exact removal of byte strings that start anywhere else too, by suffix arrays of shards.

Equal strings of SIZE bytes must meet in one shard. Each picks its anchor: the least hash of
the GRAM-byte strings in it, the leftmost if several are equal, which depends on its bytes
alone. A stretch of neighbouring strings with one anchor is a fragment, keyed by bytes around
the anchor that all its strings share. Fragments whose key occurs once hold no repeat and go
no further. The others are sorted by key into shards; a suffix array of the distinct
fragments of a shard, by induced sorting, and its permuted common prefixes show which strings
start at two places. A key of very many distinct fragments would not fit a shard: the strings
of its fragments are known by 128-bit hashes instead, which meet in parts by hash, packed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import binary, mix, prepare, read_documents, store, text_bytes
from skein.llm.suffixes import permuted_common_prefixes, suffix_array

SIZE = 400
#: Bytes of fragments in one suffix array; shards end with a key.
SHARD_BYTES = 500_000
#: The strings of a key of more distinct fragments than this are counted by hash.
HOT_FRAGMENTS = 512
#: Bytes of such fragments in one block, and strings in one part.
BLOCK_BYTES, PART_STRINGS = 4_000_000, 1 << 20
GROUP_BYTES = 2_000_000

_P, _Q = 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25


def gram(size: int) -> int:
    return max(1, size // 12)


class _Rolling:
    """Hashes of any spans of data, from sums of powers modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int = _P):
        n = len(data)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:-1])])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - width + 1)
    return np.minimum(behind[at], ahead[at + width - 1])


def fragments(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(text, key, first start, number of starts) of each fragment of texts; starts from each text's own beginning."""
    data, off = text_bytes(texts)
    q, half = gram(size), size // 2
    if len(data) < size:
        return (np.zeros(0, np.int64),) * 4
    rolling = _Rolling(data)
    at = np.arange(len(data) - q + 1)
    low = np.uint64((1 << 24) - 1)
    best = _window_minima(rolling.spans(at, at + q) & ~low | at.astype(np.uint64), size - q + 1)
    start = np.arange(len(best))
    own = np.searchsorted(off, start, side="right") - 1
    whole = start + size <= off[own + 1]
    start, own = start[whole], own[whole]
    anchor = (best[whole] & low).astype(np.int64)
    left = start < anchor - half  # these hold the bytes before the anchor, the others those after it
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (own[1:] != own[:-1])])) if len(start) else np.zeros(0, np.int64)
    first, count = start[cut], np.diff(np.append(cut, len(start)))
    a, is_left = anchor[cut], left[cut]
    key = np.where(is_left, rolling.spans(np.where(is_left, a - half, 0), np.where(is_left, a + q, 0)), rolling.spans(np.where(is_left, 0, a), np.where(is_left, 0, a + half)))
    key = mix(key + is_left.astype(np.uint64))
    return own[cut], key, first - off[own[cut]], count


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(2))
            at = 0
            while at < len(texts):
                upto, total = at, 0
                while upto < len(texts) and (upto == at or total + len(texts[upto]) <= GROUP_BYTES):
                    total += len(texts[upto])
                    upto += 1
                for own, key, first, count in _long_apart(texts[at:upto], size):
                    rows = pa.array(own + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key.view(np.int64)), pa.array(first), pa.array(count)], names=["doc_id", "th", "k", "s", "n"])
                at = upto

    return run


def _long_apart(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """fragments(), with a text of over 16 million bytes taken in overlapping pieces: a string's anchor doesn't depend on where it stands."""
    limit = 1 << 23
    if len(texts) > 1 or len(texts[0]) <= limit:
        yield fragments(texts, size)
        return
    for at in range(0, len(texts[0]) - size + 1, limit):
        own, key, first, count = fragments([texts[0][at : at + limit + size - 1]], size)
        yield own, key, first + at, count


def _cut(size: int):
    """The bytes of each fragment, and a 128-bit hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for i, (text, parts) in enumerate(zip(binary(batch.column("text")), batch.column("parts").to_pylist(), strict=True)):
                for p in parts:
                    data = text[p["s"] : p["s"] + p["n"] + size - 1]
                    rows.append(i)
                    for column, x in zip(out, (p["k"], hashlib.blake2b(data, digest_size=16).digest(), p["s"], data), strict=True):
                        column.append(x)
            at = pa.array(rows, pa.int64())
            types = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "th", "k", "fh", "s", "data"])

    return run


def repeated_starts(parts: list[bytes], size: int) -> list[np.ndarray]:
    """For each of parts, which of its strings of `size` bytes start at two places or more in them all."""
    total = sum(len(p) + 1 for p in parts) + 1
    text = np.ones(total, np.int64)  # 1 parts fragments, 0 ends the text
    at, bounds = 0, []
    for p in parts:
        text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 2
        bounds.append((at, len(p) - size + 1))
        at += len(p) + 1
    text[-1] = 0
    shared, before = permuted_common_prefixes(text, suffix_array(text))
    twice = shared >= size
    twice[before[shared >= size]] = True
    return [twice[a : a + n] for a, n in bounds]


_RUNS = pa.list_(pa.struct([("o", pa.int64()), ("n", pa.int64())]))
_SOLVED = "k bigint, fh binary, runs array<struct<o:bigint,n:bigint>>"


def _marked_runs(flag: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return [{"o": a, "n": b - a} for a, b in edge.reshape(-1, 2).tolist()]


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), _RUNS))], names=["k", "fh", "runs"])


def _shards(size: int):
    """Rows (k, fh, copies, data) sorted by k: the runs of repeated starts of each fragment that has any, as (k, fh, runs)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[0] for r in rows]
        alone = [(i == 0 or keys[i - 1] != k) and (i + 1 == len(keys) or keys[i + 1] != k) for i, k in enumerate(keys)]
        ordered = [r for r, x in zip(rows, alone, strict=True) if not x]
        flags = repeated_starts([r[3] for r in ordered], size) if ordered else []
        out = [(k, fh, runs) for (k, fh, copies, _), flag in zip(ordered, flags, strict=True) if (runs := _marked_runs(flag | (copies > 1)))]
        # a key's only fragment is repeated as a whole or not at all: there is nothing to put in order
        out += [(k, fh, [{"o": 0, "n": len(data) - size + 1}]) for (k, fh, copies, data), x in zip(rows, alone, strict=True) if x and copies > 1]
        return _solved(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield solve(held)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments (k, fh, copies, data) as few large rows."""
    number = TaskContext.get().partitionId() << 32

    def emit(held: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        columns = [pa.array([[r[i] for r in held]], pa.list_(t)) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=["block", "k", "fh", "copies", "data"])

    held, total = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            total += len(row[3])
            if total >= BLOCK_BYTES:
                yield emit(held)
                number += 1
                held, total = [], 0
    if held:
        yield emit(held)


def _strings(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes, as (n, 2) words, of all strings of `size` bytes of each of parts, one after another, and where each of parts begins."""
    data, off = text_bytes(parts)
    count = np.diff(off) - size + 1
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(off[:-1] - first, count)
    return np.stack([_Rolling(data, base).spans(at, at + size) for base in (_P, _Q)], axis=1), first


def _order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, and which of them, in order, is another than the one before."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    h = h[order]
    return order, np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]).any(axis=1)])


def _part_edges(h: np.ndarray, part_bits: int) -> np.ndarray:
    inner = np.searchsorted(h, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)) if part_bits else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(h)]])


def _asker(size: int, part_bits: int):
    """The distinct strings of each block (block, data), and whether it has them twice, as one row for each part by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = _strings(data, size)[0]
                order, new = _order(h)
                first = np.flatnonzero(new)
                h, twice = h[order[first]], np.diff(np.append(first, len(order))) > 1
                edges = _part_edges(h[:, 0], part_bits)
                parts = np.flatnonzero(np.diff(edges)).tolist()
                cut = [slice(edges[p], edges[p + 1]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (h, twice))], names=["part", "block", "h", "twice"])

    return run


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a part, whose rows come together, which of its strings occur twice or more in them all."""

    def answer(part: int, rows: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([np.frombuffer(r[1], np.uint64).reshape(-1, 2) for r in rows])
        order, new = _order(h)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        many = np.empty(len(h), bool)
        many[order] = np.repeat(count > 1, count)
        many |= np.concatenate([np.frombuffer(r[2], bool) for r in rows])
        cut = np.cumsum([0] + [len(r[1]) // 16 for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([many[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["block", "part", "flags"])

    now, held = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and held:
                yield answer(now, held)
                held = []
            now = part
            held.append(row)
    if held:
        yield answer(now, held)


def _reader(size: int):
    """Blocks, each before the answers to it, which come by part: the runs of repeated starts, as in _shards."""

    def solve(block: tuple, flags: list[bytes]) -> pa.RecordBatch:
        ks, fhs, copies, data = block
        h, first = _strings(data, size)
        order, new = _order(h)
        twice = np.empty(len(h), bool)
        twice[order] = np.frombuffer(b"".join(flags), bool)[np.cumsum(new) - 1]
        return _solved([(k, fh, runs) for k, fh, c, flag in zip(ks, fhs, copies, np.split(twice, first[1:]), strict=True) if (runs := _marked_runs(flag | (c > 1)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, flags = None, []
        for batch in batches:
            for part, *row, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    if block is not None:
                        yield solve(block, flags)
                    block, flags = row, []
                else:
                    flags.append(flag)
        if block is not None:
            yield solve(block, flags)

    return run


def _by_hash(parts: DataFrame, size: int) -> DataFrame:
    """(k, fh, runs) of distinct fragments (k, fh, copies, data), however many share a key: two shuffles of few large rows, 17 bytes for each distinct string of a block."""
    fragment = "k array<bigint>, fh array<binary>, copies array<bigint>, data array<binary>"
    blocks = store(parts.select("k", "fh", "copies", "data").mapInArrow(_blocks, f"block bigint, {fragment}")).df  # written once, so that a block's number holds
    strings = parts.agg(F.sum(F.octet_length("data") - size + 1)).first()[0] or 0
    part_bits = min(24, max(4, int(strings // PART_STRINGS).bit_length()))
    asked = blocks.select("block", "data").mapInArrow(_asker(size, part_bits), "part int, block bigint, h binary, twice binary")
    answers = asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answerer, "block bigint, part int, flags binary")
    met = blocks.withColumn("part", F.lit(-1)).unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part")
    return met.select("part", "k", "fh", "copies", "data", "flags").mapInArrow(_reader(size), _SOLVED)


def _solve(parts: DataFrame, size: int, hot_fragments: int) -> DataFrame:
    """(k, fh, runs): the runs of repeated starts in each distinct fragment of parts (k, fh, copies, data) that has any."""
    hot = store(parts.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > hot_fragments).select("k")).df
    some = not hot.isEmpty()
    plain = parts.join(hot, "k", "left_anti") if some else parts
    solved = plain.select("k", "fh", "copies", "data").repartition("k").sortWithinPartitions("k").mapInArrow(_shards(size), _SOLVED)
    return solved.unionByName(_by_hash(store(parts.join(hot, "k", "left_semi")).df, size)) if some else solved


def repeat_spans(docs: DataFrame, size: int = SIZE, hot_fragments: int = HOT_FRAGMENTS) -> DataFrame:
    """(doc_id, th, runs): the runs (s, n) of starts whose `size` bytes start elsewhere too, for each different row of docs (doc_id, th, text) that has any; th is a hash of the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = store(docs.select("doc_id", "th", "text").mapInArrow(_scan(size), f"doc_id {id_type}, th bigint, k bigint, s bigint, n bigint")).df
    twice = store(found.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")).df
    own = found.join(twice, "k", "left_semi")  # nothing above it needs the rows of a key together, so that Spark can split a hot one
    own = own.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.collect_set(F.struct("k", "s", "n")).alias("parts"))
    both = docs.join(own, docs["doc_id"].eqNullSafe(own["i"]) & (docs["th"] == own["t"])).select("doc_id", "th", "text", "parts")
    pieces = store(both.mapInArrow(_cut(size), f"doc_id {id_type}, th bigint, k bigint, fh binary, s bigint, data binary")).df
    distinct = store(pieces.groupBy("k", "fh").agg(F.count("*").alias("copies"), F.first("data").alias("data"))).df
    solved = store(_solve(distinct, size, hot_fragments)).df
    placed = pieces.select("doc_id", "th", "k", "fh", "s").join(solved, ["k", "fh"])  # a fragment has one row in solved
    moved = F.transform("runs", lambda r: F.struct((F.col("s") + r["o"]).alias("s"), r["n"].alias("n")))
    return placed.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(moved)).alias("runs"))


def _remove(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_of, removed, spans, kept = [], [], [], []
            for text, runs in zip(binary(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                left, at, gone, count = [], 0, 0, 0
                for r in sorted(runs or (), key=lambda r: r["s"]):
                    a, b = r["s"], r["s"] + r["n"] + size - 1
                    if a > at or not count:
                        left.append(text[at:a])
                        count += 1
                        gone += b - a
                    elif b > at:
                        gone += b - at
                    at = max(at, b)
                left.append(text[at:])
                whole = b"".join(left)
                size_of.append(len(text))
                removed.append(gone)
                spans.append(count)
                kept.append(whole if keep_text else hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary() if keep_text else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, keep_text: bool = True, hot_fragments: int = HOT_FRAGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: its bytes without those covered by a repeated string of `size` bytes.

    All strings are judged on the input, within and across texts, but none reaches over two
    texts, however long these are. kept is the rest, as bytes since characters may be cut, or its SHA-256 without
    keep_text. A null text is empty. Repeated rows repeat each other, so each loses what
    `size` bytes cover. Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeat_spans(docs, size, hot_fragments)
    spans = spans.select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "runs")
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["i"]) & (docs["th"] == spans["t"]), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_remove(size, keep_text), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'binary' if keep_text else 'string'}")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir), keep_text=False).withColumnRenamed("kept", "kept_sha256")
