"""Exact quantiles of many measures for many keys, no task holding a large key's values.

A key's values are counted by partial aggregates, and the places that its quantiles need are
looked up in the running counts. Keys of more than LIMIT values take a look before that:
mergeable sketches of bounded size bracket each quantile, one pass counts exactly what lies
below each bracket, and only values inside brackets, a few of ten thousand, are put in
order. A bracket that misses its place is widened and counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.scratch import store

#: Values of a key that are put in order in one task without a look at sketches first.
LIMIT = 2_000_000
#: Ranks a sketch may be off by, as a part of the values.
ACCURACY = 10_000


def _place(q: Column | float, n: Column, up: bool) -> Column:
    t = F.lit(q) * (n - 1)
    return F.ceil(t) if up else F.floor(t)


def _figures(rows: DataFrame, group: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """rows (group…, x) with, for each group, n, least, greatest, mean and the quantiles q0, q1, …, by running counts over its different values; a null x only makes the group be there."""
    counted = rows.groupBy(*group, "x").agg(F.count("x").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("x"))
    total = F.sum("c").over(Window.partitionBy(*group))
    placed = counted.withColumn("upto", upto).withColumn("total", total)
    at = lambda p: F.max(F.when((p < F.col("upto")) & (p >= F.col("upto") - F.col("c")), F.col("x")))
    ends = [at(_place(q, F.col("total"), up)).alias(f"e{i}{k}") for i, q in enumerate(quantiles) for k, up in enumerate((False, True))]
    made = placed.groupBy(*group).agg(F.sum("c").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.try_divide(F.sum(F.col("x") * F.col("c")), F.sum("c")).alias("mean"), *ends)
    return made.select(*group, "n", "least", "greatest", "mean", *[_between(q, F.col("n"), F.col(f"e{i}0"), F.col(f"e{i}1")).alias(f"q{i}") for i, q in enumerate(quantiles)])


def _between(q: float, n: Column, low: Column, high: Column) -> Column:
    t = F.lit(q) * (n - 1)
    return low + (high - low) * (t - F.floor(t))


def _large(rows: DataFrame, group: list[str], base: DataFrame, quantiles: tuple[float, ...], accuracy: int) -> DataFrame:
    """_figures of rows whose groups all are large; base has their n, least, greatest and mean."""
    wanted, gap, out = dict(enumerate(quantiles)), 2.0 / accuracy, base
    while wanted:
        edges = [max(0.0, q - gap) for q in wanted.values()] + [min(1.0, q + gap) for q in wanted.values()]
        sketch = F.percentile_approx("x", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy))
        brackets = rows.groupBy(*group).agg(sketch.alias("edge"))
        k = len(wanted)
        own = [F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.when(F.lit(edges[j] > 0), F.col("edge")[j]).alias("low"), F.when(F.lit(edges[k + j] < 1), F.col("edge")[k + j]).alias("high")) for j, (i, q) in enumerate(wanted.items())]
        brackets = store(brackets.withColumn("b", F.array(*own)).drop("edge")).df
        met = _same(rows, brackets, group)
        below = lambda b: b["low"].isNotNull() & (F.col("x") < b["low"])
        within = lambda b: (b["low"].isNull() | (F.col("x") >= b["low"])) & (b["high"].isNull() | (F.col("x") <= b["high"]))
        counts = met.groupBy(*group).agg(*[f(F.col("b")[j]) for j in range(k) for f in (lambda b, j=j: F.count_if(below(b)).alias(f"below{j}"), lambda b, j=j: F.count_if(within(b)).alias(f"within{j}"))])
        inside = met.select(*group, "x", F.explode(F.filter("b", within)).alias("b")).select(*group, "x", F.col("b.i").alias("i")).groupBy(*group, "i", "x").agg(F.count("*").alias("c"))
        each = counts.select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col(f"below{j}").alias("below"), F.col(f"within{j}").alias("within")) for j, (i, q) in enumerate(wanted.items())])).alias("w")).select(*group, "w.*")
        each = store(_same(each, base.select(*group, "n"), group)).df
        missed = (_place(F.col("q"), F.col("n"), False) < F.col("below")) | (_place(F.col("q"), F.col("n"), True) >= F.col("below") + F.col("within"))
        again = {r.i for r in each.where(missed).select("i").distinct().collect()}  # at most as many as there are quantiles
        done = {i: q for i, q in wanted.items() if i not in again}
        if done:
            joined = _same(inside, each, [*group, "i"]).withColumn("upto", F.sum("c").over(Window.partitionBy(*group, "i").orderBy("x")) + F.col("below"))
            at = lambda p: F.max(F.when((p < F.col("upto")) & (p >= F.col("upto") - F.col("c")), F.col("x")))
            ends = joined.groupBy(*group).agg(*[e for i, q in done.items() for e in (F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}"), *[at(F.when(F.col("i") == i, _place(q, F.col("n"), up))).alias(f"e{i}{s}") for s, up in enumerate((False, True))])])
            out = _same(out, store(ends.select(*group, *[_between(q, F.col(f"n{i}"), F.col(f"e{i}0"), F.col(f"e{i}1")).alias(f"q{i}") for i, q in done.items()])).df, group)
        wanted, gap = {i: wanted[i] for i in again}, gap * 8
    return out.select(*group, "n", "least", "greatest", "mean", *[f"q{i}" for i in range(len(quantiles))])


def _same(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """a joined with b on the group's columns, nulls being equal; b's are dropped."""
    named = b.select(*[F.col(c).alias(f"__{c}" if c in group else c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    return a.join(named, on).drop(*[f"__{c}" for c in group])


def quantiles_by_key(df: DataFrame, keys: list[str], measures: dict[str, Column], quantiles: tuple[float, ...], limit: int = LIMIT, accuracy: int = ACCURACY) -> DataFrame:
    """(keys…, measure, n, least, greatest, mean, q0, q1, …): figures of each measure's finite values for each key, quantiles interpolated between neighbours.

    A key without finite values has n = 0 and nulls; null keys are one key. All measures of
    all keys are looked up together.
    """
    finite = lambda x: F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), finite(x.cast("double")).alias("x")) for m, x in measures.items()])
    rows = df.select(*keys, F.inline(each))
    group = [*keys, "measure"]
    base = rows.groupBy(*group).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"))
    some = rows.groupBy(*group).agg(F.count("x").alias("n")).agg(F.count_if(F.col("n") > limit), F.count_if(F.col("n") <= limit)).first()
    if not some[0]:
        return _figures(rows, group, quantiles)
    base = store(base).df
    large = base.where(F.col("n") > limit)
    out = _large(_same(rows.where("x is not null"), large.select(*group), group), group, large, quantiles, accuracy)
    return out.unionByName(_figures(_same(rows, base.where(F.col("n") <= limit).select(*group), group), group, quantiles)) if some[1] else out


def wide(figures: DataFrame, keys: list[str], names: dict[str, dict[str, str]]) -> DataFrame:
    """One row a key: of each measure the figures named, each under its new name."""
    return figures.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col(c))).alias(new) for m, own in names.items() for c, new in own.items()])
