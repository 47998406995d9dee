"""What a finished scene is exported as: records, colours, drawn edges, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry as G

# The golden ratio's fraction, by which hues step; the constant term of spherical harmonics.
GOLDEN, SH0 = 0.6180339887498949, 0.28209479177387814


def record(objects: DataFrame) -> DataFrame:
    """objects as export records: whole-number ids and counts, box corners, a volume that falls back to the sides' product."""
    own = F.when(F.col("stored_volume") > 0, F.col("stored_volume")).otherwise(G.volume(""))
    return objects.select(
        F.format_string("obj_%06d", "id").alias("object_id"), "label", "status", F.coalesce(F.expr("nullif(final_status, '')"), F.lit("kept")).alias("final_status"), own.alias("volume"),
        G.corners("").alias("corners"), F.coalesce("source_ids", F.array(F.format_string("obj_%06d", "id"))).alias("source_ids"), "points", "frames", "seen",
    )


def public(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def label_colors(labels: DataFrame) -> DataFrame:
    """(label, place, r, g, b): a colour for each distinct label, hues stepping by the golden ratio in label order, as whole numbers to 255.

    The vocabulary of labels, not the objects, is numbered.
    """
    place = F.row_number().over(Window.orderBy("label")) - 1
    c = labels.select("label").distinct().withColumn("place", place)
    h = (F.col("place") * GOLDEN) % 1.0
    sector = F.floor(h * 6).cast("int")
    f = h * 6 - sector
    s, v = 0.72, 0.95
    p, q, t = F.lit(v * (1 - s)), F.lit(v) * (1 - F.lit(s) * f), F.lit(v) * (1 - F.lit(s) * (1 - f))
    full = F.lit(v)
    pick = lambda *xs: F.element_at(F.array(*xs), sector % 6 + 1)
    r, g, b = pick(full, q, p, p, t, full), pick(t, full, full, q, p, p), pick(p, p, t, full, full, q)
    whole = lambda x: F.floor(x * 255 + 0.5).cast("bigint")
    return c.select("label", F.col("place").cast("bigint").alias("place"), whole(r).alias("r"), whole(g).alias("g"), whole(b).alias("b"))


def sh_dc(c: Column) -> Column:
    """A colour part of 0..255 as the constant spherical harmonic."""
    return (c / 255.0 - 0.5) / SH0


def edge_points(boxes: DataFrame, steps: int) -> DataFrame:
    """(id, edge, step, x, y, z): points along the twelve edges of each box, both ends among them."""
    at = lambda a, k: F.col(f"{a}{k}")
    corner = {(i, j, k): (at("x", i), at("y", j), at("z", k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    ends = [(p, tuple(1 if d == n else x for d, x in enumerate(p))) for n in range(3) for p in sorted(corner) if p[n] == 0]
    edges = F.array(*[F.struct(F.lit(e).alias("edge"), *[x.alias(f"a{n}") for n, x in zip("xyz", corner[p], strict=True)], *[x.alias(f"b{n}") for n, x in zip("xyz", corner[q], strict=True)]) for e, (p, q) in enumerate(ends)])
    flat = boxes.select("id", F.explode(edges).alias("e")).select("id", "e.*").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    alpha = F.col("step") / float(steps - 1)
    return flat.select("id", F.col("edge").cast("bigint").alias("edge"), F.col("step").cast("bigint").alias("step"), *[(F.col(f"a{n}") + (F.col(f"b{n}") - F.col(f"a{n}")) * alpha).alias(n) for n in "xyz"])


def recolored(points: DataFrame, chosen: DataFrame, colors: DataFrame) -> DataFrame:
    """points (point, red) with new colours where chosen (point, label) names them; numbers that name no point change nothing."""
    c = chosen.join(colors, "label").groupBy("point").agg(F.min("r").alias("r"))
    return points.join(c, "point", "left").withColumn("red", F.coalesce(F.col("r").cast("double"), "red")).drop("r")


def report_lines(relations: DataFrame, most: int = 80) -> DataFrame:
    """(place, line): the nearest relations as lines of a Markdown list."""
    first = relations.orderBy("distance", "a", "b").limit(most)
    place = F.row_number().over(Window.orderBy("distance", "a", "b"))  # at most `most` rows
    line = F.format_string("- `%s` to `%s`: %s", F.col("alabel"), F.col("blabel"), F.col("relations"))
    return first.select(place.cast("bigint").alias("place"), line.alias("line"))
