"""Byte-level BPE encoding and decoding with a transducer lexicon.

Frequent words of the corpus are encoded once, by exact merging, and compiled into a minimal
acyclic transducer whose outputs lead to their ids. Workers memory-map it. Words that it
doesn't hold are merged exactly, many at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import prepare, read_documents, store
from skein.llm.transducer import Transducer, compile_words

#: Words of the corpus that go into the lexicon, at most: those of the highest counts.
LEXICON_WORDS = 32768
#: Words that a worker remembers, and that a counting task holds before it hands its counts on.
MEMORY_WORDS = 700_000
#: Characters of text whose words are looked up together.
GROUP_CHARS = 4_000_000
#: Longer words are merged one by one, with a heap.
LONG_BYTES = 48

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level scheme's split into words, with its white space spelled out.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_NONE = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The scheme's letter for each byte: printable ones stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """tokens: the bytes of each id. Merges by sorted pair key, with rank and result. specials: literal -> id."""

    tokens: list[bytes]
    base: np.ndarray
    pairs: np.ndarray
    rank: np.ndarray
    result: np.ndarray
    specials: dict[str, int]
    table: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *specials.values()]) + 1)
        for token, i in ids.items():
            if token not in specials:
                tokens[i] = bytes(letters[c] for c in token)
        for token, i in specials.items():
            tokens[i] = token.encode()
        base = np.zeros(256, np.int64)
        for c, b in letters.items():
            base[b] = ids[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([ids[a] << 20 | ids[b] for a, b in merges], dtype=np.int64)
        result = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pair)
        return cls(tokens, base, pair[order], order.astype(np.int64), result[order], specials)

    def _merge_long(self, word: bytes) -> list[int]:
        if not self.table:
            self.table = {int(p): (int(r), int(t)) for p, r, t in zip(self.pairs, self.rank, self.result, strict=True)}
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(*self.table[p], i, p) for i in range(len(ids) - 1) if (p := ids[i] << 20 | ids[i + 1]) in self.table]
        heap = [(r, i, p, t) for r, t, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else len(ids)
                if left >= 0 and right < len(ids) and (p := ids[left] << 20 | ids[right]) in self.table:
                    r, t = self.table[p]
                    heapq.heappush(heap, (r, left, p, t))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pair stands among the merges, or -1; either side may be -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def _merge_block(self, words: list[bytes]) -> list[list[int]]:
        """Words of like length, side by side: each step makes the first merge of the lowest rank in every word."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        grid = np.full((len(words), width + 1), -1, np.int64)
        grid[np.arange(width + 1) < size[:, None]] = self.base[np.frombuffer(b"".join(words), np.uint8)]
        at = self._ranks(grid[:, :-1], grid[:, 1:])
        rank = np.where(at < 0, _NONE, self.rank[at])
        live = np.arange(len(words))
        while len(live):
            where = rank[live].argmin(axis=1)
            go = rank[live, where] < _NONE
            live, where = live[go], where[go]
            if not len(live):
                break
            grid[live, where] = self.result[at[live, where]]
            for table, none in ((grid, -1), (at, -1), (rank, _NONE)):  # what follows moves up by one
                own = table[live]
                own[:, :-1] = np.where(np.arange(own.shape[1] - 1) > where[:, None], own[:, 1:], own[:, :-1])
                own[:, -1] = none
                table[live] = own
            for place in (where - 1, where):  # only the merged symbol's two pairs are new
                rows, place = live[place >= 0], place[place >= 0]
                new = self._ranks(grid[rows, place], grid[rows, place + 1])
                at[rows, place], rank[rows, place] = new, np.where(new < 0, _NONE, self.rank[new])
        return [[x for x in row if x >= 0] for row in grid.tolist()]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact ids of each word, by the merges alone."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_BYTES:
                out[i] = self._merge_long(w)
            elif w:
                by_size.setdefault(len(w), []).append(i)
        for own in by_size.values():
            for at in range(0, len(own), 8192):
                some = own[at : at + 8192]
                for i, ids in zip(some, self._merge_block([words[i] for i in some]), strict=True):
                    out[i] = ids
        return out


def _pieces(text: str, specials: regex.Pattern | None) -> list[str]:
    if specials is None or not specials.search(text):
        return _WORDS.findall(text)
    return [p for i, part in enumerate(specials.split(text)) for p in ([part] if i % 2 else _WORDS.findall(part))]


def _special_pattern(vocabulary: Vocabulary) -> regex.Pattern | None:
    longest = sorted(vocabulary.specials, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The parts, as the scheme splits them, of the most frequent blank-separated words over all rows.

    Counts are summed in tasks, then shuffled. The least count is read off a histogram, so
    that only the words chosen, at most `limit`, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split(" "))
            if len(counts) >= MEMORY_WORDS:
                yield emit()
                counts.clear()
        yield emit()

    found = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = store(found.where("n > 1 and length(word) <= 64").withColumn("b", F.floor(F.log("n") * 100).cast("int"))).df
    least, room = 0, limit
    for b, c in sorted(((r.b, r.c) for r in found.groupBy("b").agg(F.count("*").alias("c")).collect()), reverse=True):
        room -= c
        if room < 0:
            least = b + 1
            break
    chosen = found.where(F.col("b") >= least).select("word").toArrow().column("word").to_pylist()
    pieces = {p for w in chosen for p in _WORDS.findall(" " + w)} - set(vocabulary.specials)
    return sorted(p.encode() for p in pieces)


@dataclass
class Lexicon:
    """What workers get: the vocabulary (of fixed size) and a packed transducer of at most LEXICON_WORDS words."""

    vocabulary: Vocabulary
    packed: bytes
    ids: np.ndarray
    first: np.ndarray


def build_lexicon(words: list[bytes], vocabulary: Vocabulary) -> Lexicon:
    ids = vocabulary.merge(words)
    return Lexicon(vocabulary, compile_words(words).pack(), np.array([x for own in ids for x in own], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))


class Coder:
    """Encodes and decodes in a worker; what it has met is remembered up to MEMORY_WORDS words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.vocabulary = lexicon, lexicon.vocabulary
        self.words = Transducer.mapped(lexicon.packed)
        self.specials = _special_pattern(self.vocabulary)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known.clear()
            new = list(pieces)
        for piece in [p for p in new if p in self.vocabulary.specials]:
            self._keep(piece, [self.vocabulary.specials[piece]])
        new = [p for p in new if p not in self.vocabulary.specials]
        raw = [p.encode() for p in new]
        number = self.words.lookup(raw)
        first = self.lexicon.first
        for piece, n in zip(new, number.tolist(), strict=True):
            if n >= 0:
                self._keep(piece, self.lexicon.ids[first[n] : first[n + 1]].tolist())
        unseen = np.flatnonzero(number < 0).tolist()
        for i, ids in zip(unseen, self.vocabulary.merge([raw[i] for i in unseen]), strict=True):
            self._keep(new[i], ids)

    def _keep(self, piece: str, ids: list[int]) -> None:
        self.known[piece] = (len(ids), ",".join(map(str, ids)), b"".join([self.vocabulary.tokens[i] for i in ids]))

    def texts(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text, of each of its words: how many ids, the ids as text, and the bytes they decode to."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                split.append(_pieces(texts[at], self.specials))
                size += len(texts[at])
                at += 1
            self._learn(set().union(*split))
            for pieces in split:
                yield [self.known[p] for p in pieces]


_last: list = []


def _coder(lexicon: Lexicon) -> Coder:
    """This worker's coder for a lexicon; it lives on between tasks."""
    if not _last or _last[0].lexicon is not lexicon:
        _last[:] = [Coder(lexicon)]
    return _last[0]


def _shared(docs: DataFrame, tokenizer: str):
    vocabulary = Vocabulary.read(tokenizer)
    return docs.sparkSession.sparkContext.broadcast(build_lexicon(frequent_words(docs, vocabulary), vocabulary))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with `ids`, the token ids of each row's whole text; a null text has none.

    tokenizer is the path of a byte-level BPE file, which only the driver reads. Special
    tokens' literals in a text become their ids; none are added. Repeated rows are encoded
    each; an empty table stays empty; a column ids of docs is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("ids")
    shared = _shared(docs, tokenizer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            ids = [[int(i) for w in words for i in w[1].split(",")] for words in coder.texts([t or "" for t in batch.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>"
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows with `decoded`, the text of their `ids`; null ids give an empty text, bytes that aren't UTF-8 the replacement sign."""
    prepare(rows.sparkSession)
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer).tokens)
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([shared.value[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string"
    return rows.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encode, then decode the ids, as digests.

    A null or empty text has no tokens and the digests of nothing; long texts are encoded
    whole; repeated rows are returned each; other columns are ignored; an empty table gives
    no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    shared = _shared(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for words in coder.texts([t or "" for t in batch.column(1).to_pylist()]):
                n.append(sum([w[0] for w in words]))
                ids.append(hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest())
                back = b"".join([w[2] for w in words])
                decoded.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(read_documents(spark, sf_dir), tokenizer_path())
