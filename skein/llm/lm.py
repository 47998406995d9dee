"""Language-model scores from a log-frequency Bloom filter.

Counts of single tokens and of token pairs are quantised on a logarithmic scale and put in a
Bloom filter: an n-gram of level q is entered as (n-gram, 1) to (n-gram, q), and its level is
read back by probing until one is missing. The filter comes in parts by the first bits of the
n-gram's hash, each as large as its own entries need, so it grows with the corpus and nothing
is left out. Nobody holds it whole: blocks of texts send their distinct n-grams to the parts
and get the levels back, then smooth pair counts with single counts. The add-half base score
beside it uses exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import binary, crc_fold, hash_spans, mix, prepare, read_documents, space_tokens, store

#: Bits of a hash, after those that name its part, by which the filter knows an n-gram.
KEY_BITS = 40
#: Bits a level sets, all in one 64-bit word, and bits allowed for each level entered.
PROBES, BITS_PER_ENTRY = 4, 12
#: Counts c have level 1 + floor(log(c) / log(BASE)).
BASE = 1.4
#: Weight of the single-token distribution in a pair's probability, in tokens.
PRIOR = 200.0
#: Most frequent tokens, at most, whose exact counts go to all workers; all other counts are joined.
HOT_TOKENS = 1 << 18
#: Distinct n-grams that a counting task holds.
HELD = 3_000_000
#: Text bytes for each part that n-grams are dealt into.
PART_BYTES = 24_000_000
#: Text bytes for each block that asks the filter's parts for levels.
BLOCK_BYTES = 8_000_000

_END, _START, _PAIR = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A27), np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every token: words with A-Z lower-cased, and an end for each text, in order."""
    data, start, end, own = space_tokens(texts)
    h = hash_spans(data, start, end)
    at = np.searchsorted(own, np.arange(len(texts)), side="right")
    return np.insert(h, at, _END), np.insert(own, at, np.arange(len(texts)))


def pairs(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of the token before (a start, for a text's first) and of the two together."""
    before = np.roll(h, 1)
    before[np.flatnonzero(np.diff(own, prepend=-1))] = _START
    return before, mix(before * _PAIR ^ h)


def _count(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


class _Tally:
    """Counts by hash, kept as sorted arrays and merged when much has come in."""

    def __init__(self):
        self.h, self.n, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray) -> None:
        self.new.append(np.unique(h, return_counts=True))
        if sum(len(x) for x, _ in self.new) > max(500_000, len(self.h) // 2):
            self.settle()

    def settle(self) -> int:
        self.h, self.n = _count(np.concatenate([self.h, *(x for x, _ in self.new)]), np.concatenate([self.n, *(n for _, n in self.new)]))
        self.new = []
        return len(self.h)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.h, self.n
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of each number, those of one rank together: in sorted hashes and small codes the high ones compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, width - 1 :: -1].T).tobytes()


def _from_planes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1)[::-1].T
    return out.view("<u8")[:, 0]


def _edges(h: np.ndarray, part_bits: int) -> np.ndarray:
    """Where the parts of sorted hashes begin and end."""
    inner = np.searchsorted(h, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)) if part_bits else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(h)]])


def _packed(kind: int, h: np.ndarray, n: np.ndarray, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted hashes and counts as one row for each part they fall in: few large rows are shuffled, not many small ones."""
    edges = _edges(h, part_bits)
    rows = [p for p in range(1 << part_bits) if edges[p] < edges[p + 1]]
    large = n.astype(np.int64) > 254
    small = np.where(large, 255, n).astype(np.uint8)
    counts = [np.concatenate([small[edges[p] : edges[p + 1]].view(np.uint8), n[edges[p] : edges[p + 1]][large[edges[p] : edges[p + 1]]].astype("<i8").view(np.uint8)]).tobytes() for p in rows]
    hashes = [_planes(h[edges[p] : edges[p + 1]], 8) for p in rows]
    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "part", "h", "n"])


def _unpacked(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = _from_planes(h, 8)
    counts = np.frombuffer(n, np.uint8)[: len(keys)].astype(np.int64)
    counts[counts == 255] = np.frombuffer(n[len(keys) :], "<i8")
    return keys, counts


def _counter(part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _Tally(), _Tally()
        for batch in batches:
            texts = binary(batch.column(0))
            for at in range(0, len(texts), 128):
                h, own = tokens(texts[at : at + 128])
                one.add(h)
                two.add(pairs(h, own)[1])
            for kind, tally in ((1, one), (2, two)):
                if len(tally.h) > HELD:
                    yield from _packed(kind, *tally.take(), part_bits)
        for kind, tally in ((1, one), (2, two)):
            yield from _packed(kind, *tally.take(), part_bits)

    return run


def _builder(part_bits: int):
    """Adds up each part, whose rows come together, by kind, and builds its filter of all tokens and pairs."""

    def emit(part: int, held: dict) -> pa.RecordBatch:
        both = {k: _count(np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])) for k, rows in held.items()}
        h, n = both.get(1, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        h2, n2 = both.get(2, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        bits = filter_part(_key(np.concatenate([h, h2]), part_bits), level(np.concatenate([n, n2])))
        values = [part, h.tobytes(), n.astype("<i8").tobytes(), int(n.sum()), len(h), bits.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "h", "n", "total", "distinct", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for kind, part, h, n in zip(*batch.columns, strict=True):
                if part.as_py() != now and held:
                    yield emit(now, held)
                    held = {}
                now = part.as_py()
                held.setdefault(kind.as_py(), []).append(_unpacked(h.as_py(), n.as_py()))
        if held:
            yield emit(now, held)

    return run


def _built(dealt: DataFrame, part_bits: int) -> DataFrame:
    """dealt: packed rows (kind, part, h, n). A row for each part: its tokens and their counts, sums of these, its filter."""
    return store(dealt.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_builder(part_bits), "part int, h binary, n binary, total bigint, distinct bigint, bits binary")).df


def count_ngrams(docs: DataFrame) -> Model:
    """The model of `text`: exact counts of all tokens, and the filter of their levels and those of pairs.

    Tokens and pairs are known by 64-bit hashes. Parts follow the hashes, evenly whatever
    the words, and their number follows the text's size.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(20, max(6, int(size // PART_BYTES).bit_length()))
    parts = _built(docs.select("text").mapInArrow(_counter(part_bits), "kind int, part int, h binary, n binary"), part_bits)
    total, distinct = parts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return Model(parts, part_bits, total, distinct)


def level(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle, on the log scale, of the whole counts that have it; 0 for level 0."""
    low = np.ceil(BASE ** (q - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**q - 1e-9) - 1)
    return np.where(q < 1, 0.0, np.sqrt(low * high))


def _key(h: np.ndarray, part_bits: int) -> np.ndarray:
    return (h << np.uint64(part_bits)) >> np.uint64(64 - KEY_BITS)


def _probe(key: np.ndarray, q: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of an n-gram's level in a filter of so many words, and the bits set there."""
    g = mix(key + np.uint64(0x632BE59BD9B4E019 * q & (1 << 64) - 1))
    mask = np.zeros(len(key), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (g >> np.uint64(6 * k) & np.uint64(63))
    return ((g >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32), mask


def filter_part(key: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The filter of n-grams of levels q, BITS_PER_ENTRY bits for each level entered, as 64-bit words."""
    bits = np.zeros(max(1, -(-int(q.sum()) * BITS_PER_ENTRY // 64)), np.uint64)
    for x in range(1, int(q.max(initial=0)) + 1):
        word, mask = _probe(key[q >= x], x, len(bits))
        order = np.argsort(word)
        word, mask = word[order], mask[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bits[word[first]] |= np.bitwise_or.reduceat(mask, first)
    return bits


def filter_levels(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many levels of each n-gram are in a part's filter, by probing one after another."""
    out, live, q = np.zeros(len(key), np.uint8), np.arange(len(key)), 1
    while len(live) and q < 200:
        word, mask = _probe(key[live], q, len(bits))
        live = live[bits[word] & mask == mask]
        out[live] = q
        q += 1
    return out


@dataclass
class Model:
    """parts: a row for each part of the n-grams, see _built. total, distinct: tokens and different tokens seen in training."""

    parts: DataFrame
    part_bits: int
    total: int
    distinct: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of a few n-grams, asked from the driver, part by part."""
        out = np.zeros(len(h), np.int64)
        own = h >> np.uint64(64 - self.part_bits)
        for row in self.parts.select("part", "bits").where(F.col("part").isin(np.unique(own).tolist())).toLocalIterator():
            mine = own == row.part
            out[mine] = filter_levels(np.frombuffer(row.bits, np.uint64), _key(h[mine], self.part_bits))
        return out

    def tokens(self) -> DataFrame:
        """(h, n): the exact counts of all tokens."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["h", "n"])

        return self.parts.select("h", "n").mapInArrow(run, "h bigint, n bigint")


def build_filter(grams: DataFrame, total: int, distinct: int) -> Model:
    """The model of counts that are there already: grams has a row (kind, h, n) for each n-gram."""
    part_bits = min(20, max(6, (grams.count() >> 20).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h, n = (c.to_numpy() for c in batch.columns)
            for k in (1, 2):
                yield from _packed(k, *_count(h[kind == k].view(np.uint64), n[kind == k]), part_bits)

    return Model(_built(grams.select("kind", "h", "n").mapInArrow(pack, "kind int, part int, h binary, n binary"), part_bits), part_bits, total, distinct)


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks: the hashes of a block's words, the most frequent first, and each token as its word's place."""
    number = TaskContext.get().partitionId() << 32

    def emit(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        h, own = tokens(texts)
        word, back, n = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(word), np.uint64)
        rank[order] = np.arange(len(word), dtype=np.uint64)
        ids = pa.concat_arrays(ids)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(np.bincount(own, minlength=len(texts)).astype(np.int32)))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([word[order].tobytes()], pa.binary()), pa.array([_planes(rank[back], 4)], pa.binary())], names=["block", "ids", "sizes", "words", "codes"])

    ids, texts, size = [], [], 0
    for batch in batches:
        more = binary(batch.column(1))
        at = 0
        for i, t in enumerate(more):
            size += len(t)
            if size >= BLOCK_BYTES or i == len(more) - 1:
                ids.append(batch.column(0).slice(at, i + 1 - at))
                texts += more[at : i + 1]
                at = i + 1
            if size >= BLOCK_BYTES:
                yield emit(ids, texts)
                number += 1
                ids, texts, size = [], [], 0
    if texts:
        yield emit(ids, texts)


def _decoded(sizes: list[int], words: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its words' hashes, each token's word and text, each token's pair, and the sorted hashes of all its n-grams."""
    word, code = np.frombuffer(words, np.uint64), _from_planes(codes, 4).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    two = pairs(word[code], own)[1]
    return word, code, own, two, np.unique(np.concatenate([word, two]))


def _asker(part_bits: int):
    """The n-grams of each block (block, sizes, words, codes), as one row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *coded in zip(*batch.columns, strict=True):
                grams = _decoded(*(x.as_py() for x in coded))[-1]
                edges = _edges(grams, part_bits)
                rows = [p for p in range(1 << part_bits) if edges[p] < edges[p + 1]]
                asked = [_planes(_key(grams[edges[p] : edges[p + 1]], part_bits), KEY_BITS // 8) for p in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(asked, pa.binary())], names=["part", "block", "data"])

    return run


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part the filter comes first, as block -1, then what the blocks ask; a part without filter knows nothing."""
    now, bits = None, np.zeros(1, np.uint64)
    for batch in batches:
        for part, block, data in zip(*batch.columns, strict=True):
            part, block, data = part.as_py(), block.as_py(), data.as_py()
            if part != now:
                now, bits = part, np.zeros(1, np.uint64)
            if block < 0:
                bits = np.frombuffer(data, np.uint64)
            else:
                found = filter_levels(bits, _from_planes(data, KEY_BITS // 8))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["block", "part", "data"])


def _log_probability(word: np.ndarray, first: np.ndarray, pair: np.ndarray, own: np.ndarray, n: int, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each text: pairs smoothed by single tokens with a Dirichlet prior.

    word, first, pair: counts of each token, of the one before (infinite at a text's start) and of both together.
    """
    pair = np.minimum(pair, np.minimum(word, first))
    single = (word + 0.5) / (total + 0.5 * (distinct + 1))
    with np.errstate(invalid="ignore"):
        p = (pair + PRIOR * single) / (np.where(np.isinf(first), pair, first) + PRIOR)
    p = np.where(np.isinf(first), single, p)
    return np.bincount(own, weights=np.log10(np.minimum(p, 1.0)), minlength=n)


def _frequent(single: DataFrame) -> DataFrame:
    """The tokens of the highest counts, at most HOT_TOKENS, by a least count read off a histogram: no task sorts them all."""
    place = F.floor(F.log(F.col("n")) * 100).cast("int")
    least, room = 0, HOT_TOKENS
    for b, c in sorted(((r.b, r.c) for r in single.groupBy(place.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True):
        room -= c
        if room < 0:
            least = b + 1
            break
    return single.where(place >= least)


def lm_scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, learning from training's texts.

    base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens with exact counts c;
    score is the model's. A null or empty text is one token, the end; long texts are scored
    whole. Repeated rows are
    scored, and learned from, each. Without training rows all counts are 0. Other columns
    are ignored; an empty docs gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = count_ngrams(training)
    single, total, distinct = model.tokens(), model.total, model.distinct
    hot = _frequent(single).toArrow()
    order = np.argsort(hot.column("h").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((hot.column("h").to_numpy().view(np.uint64)[order], hot.column("n").to_numpy()[order]))
    whole = float(total + 0.5 * (distinct + 1))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(ids: pa.Array, sizes: list[int], words: bytes, codes: bytes, found: list[bytes]) -> pa.RecordBatch:
        word, code, own, two, grams = _decoded(sizes, words, codes)
        n, levels = len(sizes), np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        count = value(levels[np.searchsorted(grams, word)])[code]
        first = np.roll(count, 1)
        first[np.flatnonzero(np.diff(own, prepend=-1))] = np.inf
        score = _log_probability(count, first, value(levels[np.searchsorted(grams, two)]), own, n, total, distinct)
        keys, counts = shared.value
        place = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
        known = keys[place] == word if len(keys) else np.zeros(len(word), bool)
        c = np.where(known, counts[place] if len(keys) else 0, 0)[code]
        known = known[code]
        base = np.bincount(own[known], weights=np.log10((c[known] + 0.5) / whole), minlength=n)
        lost = np.flatnonzero(~known)
        cut = np.searchsorted(own[lost], np.arange(n + 1))
        rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(word[code[lost]].view(np.int64)))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.array(sizes, np.int64)), pa.array(np.bincount(own[known], minlength=n), pa.int64()), pa.array(base.astype(np.float64)), pa.array(score.astype(np.float64)), rare], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, found = None, None, []
        for batch in batches:
            for number, part, ids, *coded, data in zip(*batch.columns, strict=True):
                if part.as_py() < 0:  # a block's texts come before its levels, which are sorted by part
                    if block is not None:
                        yield score(*block, found)
                    now, block, found = number.as_py(), (ids.values, *(x.as_py() for x in coded)), []
                else:
                    assert number.as_py() == now
                    found.append(data.as_py())
        if block is not None:
            yield score(*block, found)

    blocks = store(docs.select("doc_id", "text").mapInArrow(_coder, f"block bigint, ids array<{id_type}>, sizes array<int>, words binary, codes binary")).df  # written once, so that a block's number holds
    asked = blocks.select("block", "sizes", "words", "codes").mapInArrow(_asker(model.part_bits), "part int, block bigint, data binary")
    filters = model.parts.select("part", F.lit(-1).cast("bigint").alias("block"), F.col("bits").alias("data"))
    answers = filters.unionByName(asked).repartition("part").sortWithinPartitions("part", "block").mapInArrow(_answerer, "block bigint, part int, data binary")
    texts = blocks.select("block", F.lit(-1).alias("part"), "ids", "sizes", "words", "codes", F.lit(None).cast("binary").alias("data"))
    met = texts.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part")
    scored = met.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>")
    scored = store(scored.withColumn("row", F.monotonically_increasing_id())).df  # written once, so that a row's number holds
    rare = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("f")).join(single, "h", "left")
    nil = F.lit(0).cast("bigint")
    part = rare.select("row", F.lit(None).cast(id_type).alias("doc_id"), nil.alias("n_tokens"), F.when(F.col("n") > 0, F.col("f")).otherwise(nil).alias("n_known"), (F.col("f") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / whole)).alias("base_score"), F.lit(0.0).alias("score"))
    summed = scored.drop("rare").select(part.columns).unionByName(part).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_lm(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 5) == 1
    found = lm_scores(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
