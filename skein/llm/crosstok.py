"""Cross-tokenizer alignment of a byte-level BPE (A) and a piece BPE with byte fallback (B).

Rows are shuffled by their full text, and each different text is tokenised and aligned once.
Byte offsets at which tokens of both sides end cut them into groups; the last tokens of a
group are linked. Links are counted for each pair of ids, weighted by how many rows have the
text, and what the counts say of a text goes back to all its rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import tokenizer_path
from skein.llm.common import prepare, read_documents, store

#: A text of more rows than this is joined back to them in parts of about so many.
ROWS_A_PART = 500
_SHIFT = 32


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: bytes that print stand for themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Side A: a byte-level BPE file. Ids that follow the order of its merges are found by rank; other files are left to the tokenizers library."""

    def __init__(self, file: str):
        data = json.loads(file)
        alphabet = _byte_alphabet()
        vocab = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        own = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if all(c in alphabet for c in token)}
        self.file = file
        self.token: list[bytes] = [b""] * (1 + max([*vocab.values(), *[t["id"] for t in data.get("added_tokens", [])]]))
        for token, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        made = [vocab["".join(m)] for m in merges]
        split = data.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not data.get("normalizer") and not data["model"].get("ignore_merges")
        special = {t["content"] for t in data.get("added_tokens", [])}
        ranks = {b: i for b, i in own.items() if b.decode("utf-8", "replace") not in special}
        self.by_rank = None
        if plain and made == sorted(made) and len(set(made)) == len(made) and len(ranks) == len(made) + 256 and all(len(b) > 1 for b, i in ranks.items() if i >= (made or [0])[0]):
            self.by_rank = ranks
        self._coder = self._slow = None

    def _tokenizer(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.file)
            self._slow.encode_special_tokens = True
            self._slow.no_truncation()
            self._slow.no_padding()
        return self._slow

    def encode(self, text: str) -> list[int]:
        # runs of one kind of character that are this long are beyond the fast coder's splitter
        if self.by_rank is None or len(text) > 200_000:
            return self._tokenizer().encode(text, add_special_tokens=False).ids
        if self._coder is None:
            import public_tokenizers
            import tiktoken

            self._coder = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.by_rank, special_tokens={})
        return self._coder.encode_ordinary(text)


class PieceTokens:
    """Side B: a sentencepiece model; a piece's bytes are its UTF-8 with U+2581 as a blank, a fallback piece is its byte."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.token = [bytes([int(p[3:-1], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Aligner:
    """Both sides' tokens with their byte lengths and, for digests, their ids as text with each separator."""

    def __init__(self, byte_file: str, piece_model: bytes):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_model)
        self.size = [np.array([len(t) for t in side.token], np.int64) for side in (self.a, self.b)]
        # ids as text before a comma, a bar or a semicolon, by separator and id
        self.names = np.array([f"{i}{sep}" for sep in ",|;" for i in range(max(map(len, self.size)))], dtype=object).reshape(3, -1)

    def texts(self, texts: list[str]) -> tuple[list, list, np.ndarray]:
        """Ids of each side for each text, and which texts both sides give back byte for byte; the others have no ids."""
        ids_a, ids_b, fine = [], [], np.zeros(len(texts), bool)
        for i, (text, b) in enumerate(zip(texts, self.b.encode(texts), strict=True)):
            raw = (" " + text).encode()
            fine[i] = b"".join([self.b.token[x] for x in b]) == raw
            a = self.a.encode(" " + text) if fine[i] else []
            fine[i] = fine[i] and b"".join([self.a.token[x] for x in a]) == raw
            ids_a.append(a if fine[i] else [])
            ids_b.append(b if fine[i] else [])
        return ids_a, ids_b, fine


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and the n + 1 places where each text's begin."""
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=first[1:])
    return np.fromiter((i for x in ids for i in x), np.int64, int(first[-1])), first


class Groups:
    """The groups of a batch of texts: tokens of both sides up to each common end, all texts laid one after another."""

    def __init__(self, aligner: Aligner, ids_a: list[list[int]], ids_b: list[list[int]]):
        self.n = len(ids_a)
        (self.a, self.first_a), (self.b, self.first_b) = _flat(ids_a), _flat(ids_b)
        end_a, end_b = np.cumsum(aligner.size[0][self.a]), np.cumsum(aligner.size[1][self.b])
        self.ends, self.last_a, self.last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)  # no token is empty, so ends differ
        self.group_a, self.group_b = np.searchsorted(self.ends, end_a), np.searchsorted(self.ends, end_b)
        self.first = np.searchsorted(self.last_a, self.first_a)  # groups before each text's first token
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids in one number, how often), each different link of a text once."""
        key = self.a[self.last_a] << _SHIFT | self.b[self.last_b]
        order = np.lexsort((key, self.text))
        text, key = self.text[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        return text[at], key[at], np.diff(np.append(at, len(key)))

    def digests(self, names: np.ndarray) -> list[str]:
        """The sha256 of each text's groups as text; a text without tokens has an empty string."""
        sep_a, sep_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sep_a[self.last_a], sep_b[self.last_b] = 1, 2
        order = np.argsort(np.concatenate([self.group_a * 2, self.group_b * 2 + 1]), kind="stable")
        parts = np.concatenate([names[sep_a, self.a], names[sep_b, self.b]])[order]
        first = self.first_a + self.first_b
        out = []
        for i in range(self.n):
            own = parts[first[i] : first[i + 1]]
            out.append(hashlib.sha256("".join(own.tolist())[:-1].encode()).hexdigest() if len(own) else "")
        return out


_last: list = []


def _aligner(shared) -> Aligner:
    """This worker's aligner; it lives on between tasks."""
    if not _last or _last[0] is not shared.value:
        _last[:] = [shared.value, Aligner(*shared.value)]
    return _last[1]


def _models(spark, byte_file: str, piece_model: str):
    """Both model files, about two megabytes whatever the corpus; only the driver reads them."""
    with open(byte_file, encoding="utf-8") as a, open(piece_model, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text, copies): each different text that isn't empty, and how many rows have it; rows meet by their full texts, partly counted before they do."""
    return docs.where("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("copies"))


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids_a, ids_b, fine = aligner.texts(texts)
            groups = Groups(aligner, ids_a, ids_b)
            text, key, n = groups.pairs()
            first = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"]))
            counts = [np.diff(x) for x in (groups.first_a, groups.first_b, groups.first)]
            digests = groups.digests(aligner.names)
            columns = [pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()), batch.column("copies"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), links]
            rows = pa.RecordBatch.from_arrays(columns, names=["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
            yield rows.filter(pa.array(fine))

    return run


_MEASURED = "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<struct<pair: bigint, n: bigint>>"


def _each_link(texts: DataFrame) -> DataFrame:
    return texts.select("key", "copies", F.inline("links"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, total, best): how many links of all rows hold each pair of ids, and whether no A id is linked more often to its B id."""
    totals = store(_each_link(texts).groupBy("pair").agg(F.sum(F.col("n") * F.col("copies")).alias("total"))).df
    b = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return store(totals.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))).df


def align_counts(docs: DataFrame, byte_file: str, piece_model: str) -> tuple[DataFrame, DataFrame]:
    """Measures of each row, and the counts of the pairs of ids.

    The first is (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), the
    second (a, b, count, best). n_links equals n_groups, as no token is empty: the last
    tokens of a group are the ones that end together. n_best are links whose pair is counted
    at least as often as any other of its B id, count_sum adds the counts over all links.
    Null and empty texts, and those that a side doesn't give back byte for byte, have zeros
    and an empty digest. Strings of special tokens are plain text. Long texts are aligned
    whole, repeated rows each count and are returned each, an empty table gives no rows, and
    other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = _models(spark, byte_file, piece_model)
    texts = store(distinct_texts(docs).mapInArrow(_measured(shared), _MEASURED)).df
    counts = pair_counts(texts)
    # counts are few beside the links; Spark sends them to all tasks where they are small
    met = _each_link(texts).join(counts, "pair")
    sums = met.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    parts = (F.col("copies") / ROWS_A_PART).cast("bigint") + 1
    own = store(texts.drop("links").withColumn("parts", parts).join(sums, "key")).df
    hot = store(own.where("parts > 1").select(F.col("key").alias("hot"), F.col("parts").alias("spread"))).df
    rows = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("key"))
    rows = rows.join(hot, F.col("key") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("spread", F.lit(1))))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumnRenamed("key", "own_key").withColumnRenamed("part", "own_part")
    met = rows.join(own, (F.col("key") == F.col("own_key")) & (F.col("part") == F.col("own_part")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    measures = met.select("doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce("n_groups", F.lit(0)).cast("bigint").alias("n_links"), zero("n_best"), zero("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    table = counts.select(F.shiftright("pair", _SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).cast("int").alias("b"), F.col("total").alias("count"), "best")
    return measures, table


def alignments(docs: DataFrame, byte_file: str, piece_model: str) -> DataFrame:
    """(text, copies, groups) of each different text: groups of A ids, B ids and the byte in space+text where they end; texts as in align_counts, those without tokens left out."""
    prepare(docs.sparkSession)
    shared = _models(docs.sparkSession, byte_file, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            ids_a, ids_b, fine = aligner.texts(batch.column("text").to_pylist())
            g = Groups(aligner, ids_a, ids_b)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, last + 1).astype(np.int32)), pa.array(ids.astype(np.int32))) for ids, last in ((g.a, g.last_a), (g.b, g.last_b))]
            ends = g.ends - np.append(0, g.ends)[g.first[:-1]][g.text] if len(g.ends) else g.ends
            groups = pa.StructArray.from_arrays([*lists, pa.array(ends, pa.int64())], names=["a", "b", "end"])
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(g.first.astype(np.int32)), groups)], names=["text", "copies", "groups"])
            yield rows.filter(pa.array(fine))

    return distinct_texts(docs).mapInArrow(run, "text string, copies bigint, groups array<struct<a: array<int>, b: array<int>, end: bigint>>")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_counts(read_documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))[0]
