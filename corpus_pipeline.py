"""From raw documents to token ids, in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontam, lines, simhash, toxicity
from skein.llm.common import read_documents, store


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose probability of toxicity reaches the threshold; the model learns from the labelled rows of documents.

    A null or empty text scores as a text without terms; a long one counts whole. Repeated
    rows score alike, and a score equal to the threshold goes. Rows without an id and all
    columns are kept; an empty table stays empty.
    """
    model = toxicity.train(read_documents(spark, sf_dir), toxicity.read_labels(spark, sf_dir))
    score = _free(docs, "__score")
    return toxicity.score_documents(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share go from all but the first; n_chars, where there is such a column, follows the text.

    No row goes. A null text is one empty line and becomes an empty text. Of rows that
    repeat an id all are that document. All columns are kept; an empty table stays empty.
    """
    n_lines, n_dropped = _free(docs, "__lines"), _free(docs, "__dropped")
    kept = lines.line_dedup(docs, n_lines, n_dropped).drop(n_lines, n_dropped)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; of rows without an id one stays where no other does.

    Texts without words, null ones too, are copies of each other, as are repeated rows; long
    texts count whole. All columns are kept; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage.

    A null or empty text holds none; long texts are searched whole; repeated rows go or stay
    together. All columns are kept; an empty table, or an empty benchmark, changes nothing.
    """
    return decontam.decontaminate(docs, decontam.read_benchmark(spark, sf_dir))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: token counts and digests of the ids and of the text decoded from them.

    A null or empty text has no tokens; long texts are encoded whole; repeated rows are
    returned each. Other columns go; an empty table gives no rows.
    """
    return bpe.encode_digests(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("BPE", to_tokens),
]

#: SQL can't express the learned and the approximate stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = read_documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs).df
    return docs
