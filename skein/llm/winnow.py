"""Document fingerprints by winnowing, in DataFrame functions alone.

Rolling hashes of K words are taken at every word, the least hash of every WINDOW of them is
selected, the rightmost where it occurs more than once, and kept with its position. Two
texts that share a run of K + WINDOW - 1 words share a selected hash.

A word is hashed once. The hash of a run of words is that of its beginning, moved on by a
power of BASE, plus that of its end, so runs of 2, 4 and K words are made from shorter ones
that neighbours share, and the least of 2, 4 and 8 hashes likewise: DataFrame functions have
no running state, and need none this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prepare, read_documents, store

K, WINDOW = 5, 8
#: Hashes are polynomials in BASE modulo the greatest prime of 35 bits; no product passes 63 bits for K up to 5.
PRIME, BASE = (1 << 35) - 31, (1 << 13) - 1
#: A selected value holds 35 bits of hash above 28 bits of position, so positions reach beyond any string Spark can hold.
POSITION_BITS = 28
_POSITION = (1 << POSITION_BITS) - 1


def _over_runs(df: DataFrame, values: str, n: int, join) -> DataFrame:
    """df with array column `values` made into one of its runs of n neighbours; join(a, b, size) of two runs' values, b of `size` elements, is that of both together."""
    made, have = f"{values}_made", 0
    part, size = values, 1
    while size <= n:
        if n & size:  # runs of the sizes that n is made of, the longest last and leftmost
            first = F.col(part) if not have else _beside(part, made, size, have, join)
            df, have = df.withColumn(made, first), have + size
        if 2 * size <= n:
            twice = f"{values}_{2 * size}"
            df = df.withColumn(twice, _beside(part, part, size, size, join))
            df, part = df.drop(part) if part != values else df, twice
        size *= 2
    return df.drop(part).drop(values).withColumnRenamed(made, values)


def _beside(left: str, right: str, shift: int, of_right: int, join) -> Column:
    """join of each element of left and the one `shift` places on in right, a run of `of_right` elements, as far as there is one."""
    n = F.greatest(F.least(F.size(right) - shift, F.size(left)), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: join(a, b, of_right))


def with_selection(df: DataFrame, text: str, selected: str) -> DataFrame:
    """df with array<bigint> `selected` for string column `text`; each value is hash << 28 | 2**28 - 1 - position.

    So the least value of a window is its least hash, and of equal hashes the rightmost.
    Texts of fewer than K words have one hash, of all their words; texts without words none.
    """
    words, hashes, keys, least = (f"__{selected}_{x}" for x in ("words", "hashes", "keys", "least"))
    df = df.withColumn(words, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))).drop(words)
    short = F.pmod(F.xxhash64(hashes), F.lit(PRIME))
    df = df.withColumn(keys, F.col(hashes))
    df = _over_runs(df, keys, K, lambda a, b, n: (a * F.lit(BASE**n % PRIME) + b) % F.lit(PRIME))
    marked = lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(F.lit(_POSITION) - i)
    few = F.array(marked(short, F.lit(0)))
    df = df.withColumn(keys, F.when(F.size(hashes) >= K, F.transform(keys, marked)).when(F.size(hashes) > 0, few).otherwise(F.array().cast("array<bigint>"))).drop(hashes)
    df = _over_runs(df.withColumn(least, F.col(keys)), least, WINDOW, lambda a, b, n: F.least(a, b))
    chosen = F.when(F.size(keys) > WINDOW, F.array_distinct(least)).when(F.size(keys) > 0, F.array(F.array_min(keys))).otherwise(F.col(keys))
    return df.withColumn(selected, chosen).drop(keys, least)


def as_string(selected: str) -> Column:
    """Comma-joined hex: of each selected value the last 7 digits are the word's position, those before the hash."""
    return F.array_join(F.transform(selected, lambda v: F.hex(v.bitwiseXOR(F.lit(_POSITION)))), ",")


def hashes(selected: str) -> Column:
    """The selected hashes as whole numbers of 32 bits, half the size of the selection; what likeness compares."""
    return F.transform(selected, lambda v: F.shiftright(F.shiftleft(F.shiftright(v, POSITION_BITS), 32), 32).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a part of all; 1 if neither text has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: What names a row: whether its id is null, the id or 0, and a hash of its text. Unlike a null id these join as they are.
_KEY = ["z", "i", "th"]


def successors(rows: DataFrame) -> DataFrame:
    """rows (z, i, th, n) distinct: each row's key and n beside the key of the one that follows it as nz, ni, nth; the first follows the last.

    Rows are sorted by range partitions; a window leads inside each, and a table of one row a
    partition carries on from one to the next. No task holds all ids.
    """
    rows = rows.withColumn("z", ~F.col("z"))  # a null id comes first
    placed = store(rows.repartitionByRange(*_KEY).select("*", F.spark_partition_id().alias("p"))).df
    own = F.struct(*_KEY)
    first = placed.groupBy("p").agg(F.min(own).alias("f"))
    over = Window.orderBy("p")  # one row a partition
    first = first.select("p", F.coalesce(F.lead("f").over(over), F.first("f").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = placed.withColumn("next", F.lead(own).over(Window.partitionBy("p").orderBy(*_KEY)))
    found = inside.join(F.broadcast(first), "p").withColumn("next", F.coalesce("next", "after"))
    return found.select((~F.col("next.z")).alias("nz"), F.col("next.i").alias("ni"), F.col("next.th").alias("nth"), (~F.col("z")).alias("z"), "i", "th", "n")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many, or all, of the next document's, by ascending doc_id; the first follows the last.
    Null texts are empty, long ones are fingerprinted whole; a null id comes first. Rows of one id are ordered by a hash of
    their texts; equal rows are returned each, followed by the next different row. A single
    document follows itself. Other columns are ignored; an empty table gives no rows.

    Whole texts are hashed once and shuffled once, by their keys, with what was selected of
    them: the exchange serves both sides of the join that brings a document the beginning
    and the hashes of the next one.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    key = [F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0).cast(id_type)).alias("i")]
    docs = docs.select(*key, F.coalesce("text", F.lit("")).alias("text")).select("z", "i", F.xxhash64("text").alias("th"), "text")
    order = store(successors(docs.select(*_KEY, F.length("text").alias("n")).groupBy(*_KEY).agg(F.max("n").alias("n")))).df
    to = order.select(F.col("nz").alias("z"), F.col("ni").alias("i"), F.col("nth").alias("th"), F.col("z").alias("pz"), F.col("i").alias("pi"), F.col("th").alias("pth"), "n")
    docs = with_selection(docs, "text", "sel")
    heads = docs.join(to, _KEY).select("pz", "pi", "pth", "n", "text", "sel")
    heads = heads.select(F.col("pz").alias("z"), F.col("pi").alias("i"), F.col("pth").alias("th"), F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"), hashes("sel").alias("next_hashes"))
    heads = heads.groupBy(*_KEY).agg(F.max("head").alias("head"), F.max("next_hashes").alias("next_hashes"))
    joined = docs.join(heads, _KEY).withColumn("n", F.length("text"))
    joined = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), F.col("head")))
    joined = with_selection(joined.select("z", "i", "n", "edited", "next_hashes", "sel"), "edited", "edited_sel")
    joined = joined.select("z", "i", "n", "edited", "sel", "edited_sel", "next_hashes", hashes("sel").alias("h"), hashes("edited_sel").alias("eh"))
    return joined.select(
        F.when(~F.col("z"), F.col("i")).alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("sel").alias("fingerprint"), as_string("edited_sel").alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"), likeness(F.col("h"), F.col("next_hashes")).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_documents(spark, sf_dir))
