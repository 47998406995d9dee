"""Quantile summaries, baselines by label, and rule flags."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry as G
from skein.operators.boxpairs import from_inner_points
from skein.operators.quantiles import quantiles_by_key, wide
from skein.sources.scratch import store
from skein.sources.ship import ship

LONG = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
SHORT = (0.25, 0.50, 0.75, 0.90)


def _name(prefix: str, q: float) -> str:
    return f"{prefix}_p{round(q * 100):02d}"


def summary(column: str, prefix: str, quantiles: tuple[float, ...] = LONG) -> list[Column]:
    """Aggregates over the finite values of a column, for groups known to be small: count, least, quantiles between neighbours, greatest, mean; null over none. Where a key may have any number of values there is key_summary, for a whole table whole_summary."""
    x = F.col(column).cast("double")
    x = F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
    q = F.percentile(x, F.array(*[F.lit(v) for v in quantiles]))
    return [
        F.count(x).alias(f"{prefix}_count"), F.min(x).alias(f"{prefix}_min"),
        *[q[i].alias(_name(prefix, v)) for i, v in enumerate(quantiles)],
        F.max(x).alias(f"{prefix}_max"), F.avg(x).alias(f"{prefix}_mean"),
    ]


def _names(prefix: str, quantiles: tuple[float, ...]) -> dict[str, str]:
    """The figures of a summary, in order, and what they are called."""
    return {"n": f"{prefix}_count", "least": f"{prefix}_min", **{f"q{i}": _name(prefix, q) for i, q in enumerate(quantiles)}, "greatest": f"{prefix}_max", "mean": f"{prefix}_mean"}


def key_summary(df: DataFrame, keys: list[str], measures: dict[str, Column], quantiles: tuple[float, ...] = LONG) -> DataFrame:
    """One row a key with summary's figures of each measure, under its name as prefix; no task holds a large key's values."""
    return wide(quantiles_by_key(df, keys, measures, quantiles), keys, {m: _names(m, quantiles) for m in measures})


def whole_summary(df: DataFrame, column: str, prefix: str, quantiles: tuple[float, ...] = LONG) -> DataFrame:
    """One row with summary's figures of a whole table, exact, without a task that holds all values of a large one."""
    return key_summary(df, [], {prefix: F.col(column)}, quantiles).withColumn(f"{prefix}_count", F.coalesce(f"{prefix}_count", F.lit(0)).cast("bigint"))


def _beside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b, a row a key each, side by side; a null key meets a null key."""
    return a.join(b.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def label_stats(observations: DataFrame) -> DataFrame:
    """By label: how many observations and frames, first and last frame, a summary of each measure, greatest extents."""
    frames = observations.groupBy("label", "frame").agg(F.count("*").alias("c"), *[F.max(f"c{a}").alias(f"max_{a}") for a in G.AXES])
    counts = frames.groupBy("label").agg(F.sum("c").alias("n"), F.count("frame").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *[F.max(f"max_{a}").alias(f"max_{a}") for a in G.AXES])
    figures = key_summary(observations, ["label"], {"value": F.col("value")})
    return _beside(counts, figures, "label").select("label", "n", "frames", "first_frame", "last_frame", *_names("value", LONG).values(), *[f"max_{a}" for a in G.AXES])


def frequency(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, n, place): values by falling count, those of one count by where they were first seen."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.select("value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint").alias("place"))


@dataclass(frozen=True)
class QualityRules:
    watch: tuple[str, ...] = ()
    least_frames: int = 2
    least_seen: int = 3
    low_box_score: float = 0.35
    low_mask_score: float = 0.0
    large_factor: float = 2.5
    least_purity: float = 0.7
    elongated: float = 8.0
    few_points: int = 500


# Flags in the order they are listed, with their weights in the severity.
SEVERITY = {
    "watch_label": 3, "low_support": 2, "low_box_score": 1, "low_mask_score": 1,
    "mixed_label_evidence": 2, "large_for_label": 2, "elongated_bbox": 1, "low_point_count": 1,
}


def label_baselines(objects: DataFrame) -> DataFrame:
    figures = key_summary(objects, ["label"], {"volume": G.volume(""), "points": F.col("points"), "frames": F.col("frames")}, SHORT)
    return _beside(objects.groupBy("label").agg(F.count("*").alias("n")), figures, "label")


def quality_rows(objects: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """objects (…, top_count, mask_score) with flags, severity, aspect, purity and volume beside the label's upper quartile."""
    sizes = F.filter(F.array(*[F.col(f"{a}1") - F.col(f"{a}0") for a in G.AXES]), lambda s: s > 1e-9)
    o = objects.withColumn("volume", G.volume("")).withColumn("sizes", sizes)
    o = o.withColumn("aspect", F.when(F.size("sizes") > 0, F.array_max("sizes") / F.array_min("sizes")).otherwise(0.0))
    o = o.withColumn("purity", F.col("top_count") / F.greatest(F.col("seen"), F.lit(1)))
    base = quantiles_by_key(objects, ["label"], {"volume": G.volume("")}, (0.75,)).select("label", F.col("q0").alias("p75"))
    o = o.join(base, "label").withColumn("ratio", F.when(F.col("p75") != 0, F.col("volume") / F.greatest("p75", F.lit(1e-12))))
    tests = {
        "watch_label": F.col("label").isin(*rules.watch) if rules.watch else F.lit(False),
        "low_support": (F.col("frames") < rules.least_frames) | (F.col("seen") < rules.least_seen),
        "low_box_score": (F.col("box_score") > 0) & (F.col("box_score") < rules.low_box_score),
        "low_mask_score": (F.col("mask_score") > 0) & (F.col("mask_score") < rules.low_mask_score),
        "mixed_label_evidence": F.col("purity") < rules.least_purity,
        "large_for_label": F.coalesce(F.col("ratio") >= rules.large_factor, F.lit(False)),
        "elongated_bbox": F.col("aspect") >= rules.elongated,
        "low_point_count": F.col("points") < rules.few_points,
    }
    flags = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    severity = sum(F.when(t, SEVERITY[name]).otherwise(0) for name, t in tests.items())
    return o.withColumn("flags", flags).withColumn("severity", severity)


def percentile_boxes(members: DataFrame, points: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(id, n, bounds, centre, volume): of each set of members (id, point) a box between two percentiles of each axis, and the mean of the points inside, or of all if none is."""
    at = store(members.join(points, "point").select("id", *G.AXES)).df
    figures = quantiles_by_key(at, ["id"], {a: F.col(a) for a in G.AXES}, (low, high))
    bounds = wide(figures, ["id"], {a: ({"n": "n"} if a == "x" else {}) | {"q0": f"{a}0", "q1": f"{a}1"} for a in G.AXES})
    both = at.join(bounds, "id")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & F.col("z").between(F.col("z0"), F.col("z1"))
    edges = [f"{a}{k}" for a in G.AXES for k in (0, 1)]
    mid = both.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", *edges)], *[F.coalesce(F.avg(F.when(inside, F.col(a))), F.avg(a)).alias(f"c{a}") for a in G.AXES], F.count_if(inside).alias("inside"))
    return mid.withColumn("volume", G.volume("")).select("id", "n", *edges, *[f"c{a}" for a in G.AXES], "inside", "volume")


def oriented_boxes(members: DataFrame, points: DataFrame, low: float = 0.02, high: float = 0.98, least: int = 8) -> DataFrame:
    """(id, n, e0, e1, e2): extents of each set along its own axes, greatest first; sets under `least` points have their plain box's.

    Covariances are aggregates, so only six numbers a set reach Python, for the axes; the
    extents lie between percentiles of the projections on them, which don't depend on where
    the axes begin.
    """
    at = store(members.join(points, "point").select("id", *G.AXES)).df
    ship(members.sparkSession)
    pairs = [(a, b) for i, a in enumerate(G.AXES) for b in G.AXES[i:]]
    moments = at.groupBy("id").agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(a + b) for a, b in pairs], *[(F.max(a) - F.min(a)).alias(f"s{a}") for a in G.AXES])

    def axes(batches):
        import numpy as np

        for pdf in batches:
            c = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
            v = np.linalg.eigh(np.where(np.isfinite(c), c, 0.0))[1]
            yield pdf[["id", "n", "sx", "sy", "sz"]].assign(**{f"v{i}{j}": v[:, i, j] for i in range(3) for j in range(3)})

    schema = f"id {members.schema['id'].dataType.simpleString()}, n bigint, sx double, sy double, sz double, " + ", ".join(f"v{i}{j} double" for i in range(3) for j in range(3))
    framed = store(moments.mapInPandas(axes, schema)).df
    on_axis = lambda j: sum(F.col(a) * F.col(f"v{i}{j}") for i, a in enumerate(G.AXES))
    many = at.join(framed.where(F.col("n") >= least), "id")
    figures = quantiles_by_key(many, ["id"], {f"w{j}": on_axis(j) for j in range(3)}, (low, high))
    extents = figures.select("id", "measure", (F.col("q1") - F.col("q0")).alias("w"))
    found = wide(extents, ["id"], {f"w{j}": {"w": f"w{j}"} for j in range(3)})
    both = framed.select("id", "n", "sx", "sy", "sz").join(found, "id", "left")
    e = F.sort_array(F.when(F.col("n") >= least, F.array("w0", "w1", "w2")).otherwise(F.array("sx", "sy", "sz")), asc=False)
    return both.select("id", "n", *[e[i].alias(f"e{i}") for i in range(3)])


def _between_sorted(x: np.ndarray, q: float) -> float:
    """The quantile of sorted values between neighbours, as quantiles_by_key has it."""
    t = q * (len(x) - 1)
    low, high = x[int(np.floor(t))], x[int(np.ceil(t))]
    return float(low + (high - low) * (t - np.floor(t)))


def inner_percentile_boxes(objects: DataFrame, points: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """percentile_boxes of the points (x, y, z) inside each box of objects, without a row for each of them."""
    edges = [f"{a}{k}" for a in G.AXES for k in (0, 1)]

    def told(p: list[np.ndarray]) -> tuple:
        ends = [_between_sorted(s, q) for s in map(np.sort, p) for q in (low, high)]
        inside = np.logical_and.reduce([(x >= a) & (x <= b) for x, a, b in zip(p, ends[::2], ends[1::2], strict=True)])
        n = int(inside.sum())
        return len(p[0]), *ends, *[float((x[inside] if n else x).mean()) for x in p], n

    found = from_inner_points(objects, points, told, "n bigint, " + ", ".join(f"{c} double" for c in (*edges, "cx", "cy", "cz")) + ", inside bigint")
    return found.withColumn("volume", G.volume(""))


def inner_oriented_boxes(objects: DataFrame, points: DataFrame, low: float = 0.02, high: float = 0.98, least: int = 8) -> DataFrame:
    """oriented_boxes of the points (x, y, z) inside each box of objects, without a row for each of them."""

    def told(p: list[np.ndarray]) -> tuple:
        if len(p[0]) < least:
            sides = [float(x.max() - x.min()) for x in p]
        else:
            v = np.linalg.eigh(np.cov(np.stack(p)))[1]
            along = [np.sort(p[0] * v[0, j] + p[1] * v[1, j] + p[2] * v[2, j]) for j in range(3)]
            sides = [_between_sorted(x, high) - _between_sorted(x, low) for x in along]
        return len(p[0]), *sorted(sides, reverse=True)

    return from_inner_points(objects, points, told, "n bigint, e0 double, e1 double, e2 double")
