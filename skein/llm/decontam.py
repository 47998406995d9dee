"""Benchmark decontamination by the q-gram lemma.

An item of length n that occurs in a text with at most e edits shares at least
n - q + 1 - q * e of its q-grams with the text, all within a band of e diagonals to either
side. The lemma is asked twice. First by an item's seeds: of e + k disjoint q-grams each
edit spoils one at most, so k of them stand within the band; the seeds are those that
fewest items have, an eighth of all q-grams at most. They are counted in diagonal bands
that overlap by half, and in bands that reach k all shared q-grams are counted; banded
alignment then measures the least number of edits where these reach the lemma's bound.
Hits are taken in pieces of a fixed number, by item, and long texts in windows, so a
task's memory doesn't grow with texts, items or matches.

Texts and items are compared as UTF-8 with A-Z lower-cased and runs of ASCII white space
made one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skein.llm.common import binary, prepare, read_documents

Q = 8
#: Edits allowed as a share of an item's bytes.
EDITS = 0.1
#: Seeds of an item beyond its edits, as far as they fit: so many must stand in a text.
SEEDS = 4
#: Benchmark bytes in one broadcast index, which has about three times as many; a larger benchmark is taken in parts, each against all documents.
PART_BYTES = 8_000_000
BITMAP_BITS = 22
#: Texts of a batch are searched in groups of about this many bytes; longer ones in windows of it that overlap by what an item may cover.
GROUP_BYTES = 1_000_000
#: Hits of q-grams in memory at a time.
PIECE = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def budget(size: int) -> int:
    """Edits allowed for an item of this many bytes: EDITS of them, as far as the lemma still asks for one shared q-gram."""
    return max(0, min(int(EDITS * size), (size - Q) // Q))


@dataclass
class Index:
    """A benchmark's items and their seeds: a bitmap over the seeds' hashes, their different codes, and of each item the numbers of its codes and their places."""

    ids: list[list]
    texts: list[bytes]
    least: np.ndarray
    bitmap: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    code: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, list[int]]]
    longest: int


def _codes(data: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at each place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.ndarray(len(data) - Q + 1, dtype="<u8", buffer=data.data, strides=(1,)))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _K) >> np.uint64(64 - BITMAP_BITS)


def _seeds(often: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Places of an item's seeds, and how many of them a place of the item must hold; often says how common the q-gram at each place is."""
    e = budget(n)
    k = max(1, min(SEEDS, n // Q - e))
    best, cost = np.zeros(0, np.int64), None
    for offset in range(min(Q, n - Q * (e + k) + 1)):
        places = np.arange(offset, n - Q + 1, Q)
        own = places[np.argsort(often[places], kind="stable")[: e + k]]
        if cost is None or often[own].sum() < cost:
            best, cost = own, often[own].sum()
    return best, k


def build_index(items: list[tuple[int, bytes]]) -> Index:
    """items: (id, normalised text); items of one text are one, texts under Q bytes have no q-grams and are looked up whole."""
    ids: dict[bytes, list] = {}
    for i, t in items:
        ids.setdefault(t, []).append(i)
    texts = list(ids)
    parts = [_codes(np.frombuffer(t, np.uint8)) for t in texts]
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    code, place, least, short = [], [], np.ones(len(texts), np.int64), {}
    for i, (t, own) in enumerate(zip(texts, parts, strict=True)):
        places = np.zeros(0, np.int64)
        if len(own):
            places, least[i] = _seeds(np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left"), len(t))
        elif t:
            short.setdefault(len(t), []).append((int.from_bytes(t, "little"), i))
        code.append(own[places])
        place.append(places)
    first = np.concatenate([[0], np.cumsum([len(x) for x in place])]).astype(np.int64)
    known, number = np.unique(np.concatenate(code) if code else np.zeros(0, np.uint64), return_inverse=True)
    bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
    bitmap[_slot(known)] = True
    by_size = {n: (np.array([v for v, _ in sorted(own)], np.uint64), [i for _, i in sorted(own)]) for n, own in short.items()}
    places = np.concatenate(place).astype(np.int32) if place else np.zeros(0, np.int32)
    return Index(list(ids.values()), texts, least, bitmap, known, first, number.astype(np.int32), places, by_size, max(map(len, texts), default=0))


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Runs of counts that sum up to PIECE or less, or have one member."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")))
        yield slice(at, end)
        at = end


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, … for each count, one after another."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _seeded(index: Index, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, lowest diagonals) of the bands that hold as many of an item's seeds as they must; diagonals over all the texts of codes."""
    at = np.flatnonzero(index.bitmap[_slot(codes)])
    where = np.searchsorted(index.codes, codes[at])
    where[where == len(index.codes)] = 0
    real = index.codes[where] == codes[at]
    at, where = at[real], where[real]
    order = np.argsort(where, kind="stable")
    at = at[order]
    often = np.bincount(where, minlength=len(index.codes))
    begin = np.concatenate([[0], np.cumsum(often)[:-1]])
    hits = often[index.code]
    upto = np.concatenate([[0], np.cumsum(hits)])
    sizes = np.array([len(t) for t in index.texts], np.int64)
    half = 2 * np.array([budget(n) for n in sizes.tolist()], np.int64) + 1  # an occurrence spans at most 2e + 1 diagonals, so one of two overlapping bands of twice that holds them all
    bands = (len(codes) + index.longest) // half + 2
    for items in _slices(np.diff(upto[index.first])):
        own = np.arange(index.first[items.start], index.first[items.stop])
        own = own[hits[own] > 0]
        if not len(own):
            continue
        item = np.repeat(np.arange(items.start, items.stop), np.diff(index.first[items.start : items.stop + 1]))[own - index.first[items.start]]
        base = np.concatenate([[0], np.cumsum(bands[items] + 1)])[:-1]  # a free number between items, so that the last band of one isn't beside the first of the next
        keys, counts = [], []
        for some in _slices(hits[own]):
            o, i = own[some], np.repeat(item[some], hits[own[some]])
            diagonal = at[_ranges(begin[index.code[o]], hits[o])] - np.repeat(index.place[o], hits[o])
            key, n = np.unique(base[i - items.start] + (diagonal + sizes[i]) // half[i], return_counts=True)
            keys.append(key)
            counts.append(n)
        if len(keys) > 1:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        # band b holds its own diagonals and those of the next number; a band may begin one before the first hit
        both = np.unique(np.concatenate([key, key - 1]))
        place = np.searchsorted(key, both)
        here = np.where((place < len(key)) & (key[np.minimum(place, len(key) - 1)] == both), n[np.minimum(place, len(key) - 1)], 0)
        place = np.searchsorted(key, both + 1)
        after = np.where((place < len(key)) & (key[np.minimum(place, len(key) - 1)] == both + 1), n[np.minimum(place, len(key) - 1)], 0)
        which = np.searchsorted(base, both, side="right") - 1
        which[both < 0] = 0
        good = here + after >= index.least[items][which]
        which, band = which[good], (both - base[which])[good]
        for i in np.unique(which).tolist():
            k = items.start + i
            yield k, band[which == i] * half[k] - sizes[k]


def _enough(index: Index, item: int, codes: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Which of an item's bands hold as many of its q-grams as the lemma asks."""
    own = _codes(np.frombuffer(index.texts[item], np.uint8))
    width = 2 * (2 * budget(len(index.texts[item])) + 1)
    span = len(own) + width - 1
    good = np.zeros(len(lows), bool)
    step = max(1, PIECE // (4 * span))
    for begin in range(0, len(lows), step):
        low = lows[begin : begin + step]
        at = low[:, None] + np.arange(span)
        here = np.where((at >= 0) & (at < len(codes)), codes[np.clip(at, 0, max(len(codes) - 1, 0))], np.uint64(0))
        shared = np.zeros(len(low), np.int64)
        for i, c in enumerate(own):
            shared += (here[:, i : i + width] == c).any(axis=1)
        good[begin : begin + step] = shared >= len(own) - Q * budget(len(index.texts[item]))
    return good


def candidates(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, item, lowest diagonal) of every band that the lemma can't rule out; normalised texts."""
    codes = _codes(np.frombuffer(b"\0".join(texts) + b"\0" * Q, np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for item, lows in _seeded(index, codes):
        lows = lows[_enough(index, item, codes, lows)]
        n = len(index.texts[item])
        # A band may start before its text; its middle places it.
        text = np.clip(np.searchsorted(offsets, lows + 2 * budget(n) + 1 + n // 2, side="right") - 1, 0, len(texts) - 1)
        for t, low in zip(text.tolist(), (lows - offsets[text]).tolist(), strict=True):
            yield t, item, low


def align(pattern: bytes, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of the whole pattern in each band, and the step past the band's start where it ends.

    bands (places, len(pattern) + width - 1) holds text from each band's lowest diagonal on;
    row i of the table has the width cells i to i + width - 1 of it. All places advance
    together, a row a step.
    """
    n, width = len(pattern), bands.shape[1] - len(pattern) + 1
    kind = np.int16 if n + width < 1 << 14 else np.int32  # no cell exceeds both together
    index = np.arange(width, dtype=kind)
    row = np.zeros((len(bands), width), kind)
    for i, c in enumerate(pattern):
        new = row + (bands[:, i : i + width] != c)
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - index, axis=1) + index
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end + n


def _align_places(index: Index, texts: list[bytes], item: int, places: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(text, edits, end) for places (text, lowest diagonal) where an item is within its budget. Bands of the same bytes are aligned once, as long as they fit in memory."""
    pattern = index.texts[item]
    e = budget(len(pattern))
    width = 2 * (2 * e + 1) + 2 * e  # the band, and e more to either side for an alignment that leaves it
    size = len(pattern) + width - 1
    known: dict[bytes, tuple[int, int]] = {}
    while some := list(islice(places, max(1, PIECE // size))):
        own = []
        for text, low in some:
            begin = low - e
            part = texts[text][max(0, begin) : max(0, begin + size)]
            own.append((b"\0" * max(0, -begin) + part).ljust(size, b"\0")[:size])
        new = [x for x in dict.fromkeys(own) if x not in known]
        if (len(known) + len(new)) * size > 8 * PIECE:
            known, new = {}, list(dict.fromkeys(own))
        for at in range(0, len(new), 256):
            bands = np.frombuffer(b"".join(new[at : at + 256]), np.uint8).reshape(-1, size)
            known.update(zip(new[at : at + 256], zip(*[x.tolist() for x in align(pattern, bands)], strict=True), strict=True))
        for (text, low), region in zip(some, own, strict=True):
            edits, end = known[region]
            if edits <= e:
                yield text, edits, low - e + end


def _short(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, item, end) of the first place of each item under Q bytes."""
    for n, (values, items) in index.short.items():
        for t, whole in enumerate(texts):
            if len(whole) >= n:
                at = _codes(np.frombuffer(whole + b"\0" * (Q - n), np.uint8)) & np.uint64((1 << 8 * n) - 1)
                for v in np.intersect1d(values, at).tolist():
                    i = items[int(np.searchsorted(values, np.uint64(v)))]
                    yield t, i, whole.find(index.texts[i]) + n


def find(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, end in the normalised text): the best place of each item within its budget."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for item, places in groupby(candidates(index, texts), key=lambda c: c[1]):
        for text, edits, end in _align_places(index, texts, item, ((t, low) for t, _, low in places)):
            best[text, item] = min(best.get((text, item), (edits, end)), (edits, end))
    for text, item, end in _short(index, texts):
        best[text, item] = (0, end)
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def find_in_windows(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """find over texts of any length and number, a group or a window at a time."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    overlap = index.longest + budget(index.longest)
    window = max(GROUP_BYTES, 4 * overlap)
    group: list[tuple[int, int, bytes]] = []

    def settle() -> None:
        for k, item, edits, end in find(index, [t for _, _, t in group]):
            text, begin, _ = group[k]
            value = (edits, begin + end)
            best[text, item] = min(best.get((text, item), value), value)
        group.clear()

    for i, whole in enumerate(texts):
        for begin in range(0, max(1, len(whole) - overlap), window - overlap):
            group.append((i, begin, whole[begin : begin + window]))
            if sum(len(t) for _, _, t in group) >= GROUP_BYTES:
                settle()
    settle()
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _searcher(shared, keep: bool, item_type: str = "bigint"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = find_in_windows(index, [normalise(t) for t in binary(batch.column("text"))])
            if keep:
                hit = {f[0] for f in found}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))
            else:
                found = [(t, name, e, end) for t, i, e, end in found for name in index.ids[i]]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array([f[1] for f in found], pa.int64() if item_type == "bigint" else pa.string()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "edits", "end_at"])

    return run


def _item_type(benchmark: DataFrame) -> str:
    return "bigint" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"


def _parts(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of at most about PART_BYTES of items each; the number of parts follows the benchmark's size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast(_item_type(benchmark)).alias("item_id"), "text").where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).distinct().toLocalIterator()
        own = sorted({(r.item_id, normalise(r.text.encode())) for r in rows})
        yield spark.sparkContext.broadcast(build_index([x for x in own if x[1]]))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, end_at) for each row and each benchmark item that it holds within the edit budget.

    edits is the least number of byte edits, end_at where the best place ends in the
    normalised text, the first of equally good ones. Null or empty texts and items match
    nothing, very long ones are searched whole; items under Q bytes match only as they are. An item_id that is no whole number is returned as a string. A benchmark of any size works: it is searched part by part. Repeated
    rows are reported each; extra columns are ignored; empty tables give no rows.
    """
    prepare(docs.sparkSession)
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), _item_type(benchmark)
    out = None
    for shared in _parts(benchmark):
        found = docs.select("doc_id", "text").mapInArrow(_searcher(shared, False, item_type), f"doc_id {id_type}, item_id {item_type}, edits bigint, end_at bigint")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns kept; nulls as in contaminations."""
    prepare(docs.sparkSession)
    for shared in _parts(benchmark):
        docs = docs.mapInArrow(_searcher(shared, True), docs.schema)
    return docs


def read_benchmark(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(read_documents(spark, sf_dir), read_benchmark(spark, sf_dir))
