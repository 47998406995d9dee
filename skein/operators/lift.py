"""From points and cameras to observations in space: projection, masks, depth, components, boxes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import geometry as G
from skein.operators.components import connected_components
from skein.sources.scratch import store


def pose_rows(pose: Column) -> Column:
    """A 4 x 4 pose from sixteen numbers or four rows of four; anything else, and null, is null."""
    rows = F.array(*[F.slice(pose, 4 * i + 1, 4) for i in range(4)])
    return F.when(F.size(pose) == 16, rows)


@dataclass(frozen=True)
class Camera:
    """One camera: pose from camera to world, focal lengths, centre and size of the image."""

    camera: int
    pose: tuple[tuple[float, ...], ...]
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int

    def inverse(self) -> list[list[float]]:
        return np.linalg.inv(np.array(self.pose, dtype=float)).tolist()


def camera_table(spark, cameras: list[Camera]) -> DataFrame:
    """Cameras as rows, with the first three rows of the inverse pose as columns m00 … m23."""
    rows = [(c.camera, c.fx, c.fy, c.cx, c.cy, c.width, c.height, *[x for r in c.inverse()[:3] for x in r]) for c in cameras]
    names = "camera int, fx double, fy double, cx double, cy double, width int, height int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4))
    return spark.createDataFrame(rows, names)


#: Points in a cell that are tried together, on average, and the finest grid, in halvings of the whole.
CELL_POINTS, FINEST = 64, 12


def _to_camera(x: Column, y: Column, z: Column) -> list[Column]:
    """A place in a camera's own axes, by the camera's columns m00 … m23."""
    return [F.col(f"m{i}0") * x + F.col(f"m{i}1") * y + F.col(f"m{i}2") * z + F.col(f"m{i}3") for i in range(3)]


def _may_see(center: list[Column], radius: Column) -> Column:
    """Whether a ball reaches the camera's view volume: in front of it, and on the inner side of the four planes through the image's edges, rounding of pixels and of the arithmetic included."""
    x, y, z = _to_camera(*center)
    # a pose may stretch; its rows' largest length bounds by how much
    stretch = F.greatest(*[F.sqrt(sum(F.col(f"m{i}{j}") * F.col(f"m{i}{j}") for j in range(3))) for i in range(3)])
    r = radius * stretch * 1.75 + 1e-6
    out = z + r > 0
    for axis, f, c, size in ((x, F.col("fx"), F.col("cx"), F.col("width")), (y, F.col("fy"), F.col("cy"), F.col("height"))):
        for slope, sign in ((c + 0.51, 1.0), (size - 0.49 - c, -1.0)):
            out &= axis * f * sign + z * slope >= -(F.abs(f) + F.abs(slope)) * r
    return out


def visible(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera, point, u, v, depth): points in front of a camera and inside its image, pixels rounded half to even.

    Points lie in cells of a grid, cells in larger ones up to one that holds all. Cameras go
    down from there, by equi-joins, into those cells alone that reach into their view, and
    only the points of the last ones are tried. Points with undefined or infinite coordinates
    are in no image.
    """
    finite = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf")) for a in G.AXES]
    points = points.where(finite[0] & finite[1] & finite[2]).select("point", *[F.col(a).cast("double").alias(a) for a in G.AXES])
    n, *bounds = points.agg(F.count("*"), *[f(a) for a in G.AXES for f in (F.min, F.max)]).first()
    low = bounds[::2] if n else [0.0] * 3
    span = max(max((h - m for m, h in zip(low, bounds[1::2], strict=True)), default=0.0) if n else 0.0, 1e-9) * (1 + 1e-9)
    levels = min(FINEST, max(1, math.ceil(math.log(max(n, 1) / CELL_POINTS + 1, 8)) + 1))
    finest = [F.least(F.floor((F.col(a) - F.lit(m)) / F.lit(span) * 2**levels), F.lit(2**levels - 1)).cast("bigint").alias(f"g{a}") for a, m in zip(G.AXES, low, strict=True)]
    placed = points.select("*", *finest)
    cells = store(placed.select("gx", "gy", "gz").distinct()).df
    own = cameras.columns
    seen = cameras.withColumns({f"p{a}": F.lit(0).cast("bigint") for a in G.AXES})
    for level in range(1, levels + 1):
        there = cells.select(*[F.shiftright(f"g{a}", levels - level).alias(f"g{a}") for a in G.AXES]).distinct().withColumns({f"p{a}": F.shiftright(f"g{a}", 1) for a in G.AXES})
        size = span / 2**level
        middle = [F.lit(m) + (F.col(f"g{a}") + 0.5) * F.lit(size) for a, m in zip(G.AXES, low, strict=True)]
        met = seen.join(there, [f"p{a}" for a in G.AXES]).where(_may_see(middle, F.lit(size * 3**0.5 / 2)))
        seen = met.select(*own, *[F.col(f"g{a}").alias(f"p{a}") for a in G.AXES])
    seen = seen.select(*own, *[F.col(f"p{a}").alias(f"g{a}") for a in G.AXES])
    both = placed.join(seen, ["gx", "gy", "gz"])
    c = _to_camera(*[F.col(a) for a in G.AXES])
    both = both.withColumn("depth", c[2]).where(F.col("depth") > 1e-6)
    both = both.withColumn("u", F.rint(F.col("fx") * c[0] / F.col("depth") + F.col("cx"))).withColumn("v", F.rint(F.col("fy") * c[1] / F.col("depth") + F.col("cy")))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    return both.where(inside).select("camera", "point", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "depth")


def in_mask(seen: DataFrame, mask: DataFrame) -> DataFrame:
    """Visible points whose pixel is set in an observation's mask (obs, camera, u, v): an equi-join on pixels."""
    return mask.join(seen, ["camera", "u", "v"]).select("obs", "camera", "point", "u", "v", "depth")


def depth_consistent(hits: DataFrame, depth: DataFrame, absolute: float = 0.05, relative: float = 0.03) -> DataFrame:
    """hits whose depth agrees with the image's (camera, u, v, measured), within the larger of an absolute and a relative gap."""
    m = hits.join(depth, ["camera", "u", "v"])
    fine = (F.col("measured") > 0) & ~F.isnan("measured")
    return m.where(fine & (F.abs(F.col("depth") - F.col("measured")) <= F.greatest(F.lit(absolute), F.col("measured") * relative)))


def mask_areas(masks: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """(keys…, pixels, ratio): the area of the union of masks (keys…, u, v), each pixel once, and its share of the image."""
    return masks.select(*keys, "u", "v").distinct().groupBy(*keys).agg(F.count("*").alias("pixels"), (F.count("*") / F.lit(width * height)).alias("ratio"))


def frame_size(frames: DataFrame) -> DataFrame:
    """frames with width and height: the task's, else the image's, else the mask's."""
    return frames.withColumn("width", F.coalesce("task_width", "image_width", "mask_width")).withColumn("height", F.coalesce("task_height", "image_height", "mask_height"))


def depth_meters(pixels: DataFrame) -> DataFrame:
    """pixels (camera, u, v, raw, depth_scale) as metres; 0 and undefined raw values measure nothing."""
    return pixels.where((F.col("raw") > 0) & ~F.isnan(F.col("raw").cast("double"))).select("camera", "u", "v", (F.col("raw") / F.col("depth_scale")).alias("measured"))


@dataclass(frozen=True)
class LiftRules:
    least_hits: int = 30
    least_ratio: float = 0.0
    voxel: float = 0.08
    component_points: int = 120
    component_ratio: float = 0.08
    components: int = 3


def voxel_components(points: DataFrame, size: float) -> DataFrame:
    """(set, point, component): points of each set joined through voxels that touch, corners included; a component is named by its least point.

    points has set, point, x, y, z. Neighbouring voxels are found by an equi-join on shifted
    cells, half of the 26 directions being enough; the graph is of voxels, not points.
    """
    at = points.select("set", "point", *[G.voxel(F.col(a), size).alias(f"v{a}") for a in G.AXES])
    cells = at.groupBy("set", "vx", "vy", "vz").agg(F.min("point").alias("name"))
    half = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]
    moves = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in half])
    shifted = cells.withColumn("m", F.explode(moves)).select("set", (F.col("vx") + F.col("m.dx")).alias("vx"), (F.col("vy") + F.col("m.dy")).alias("vy"), (F.col("vz") + F.col("m.dz")).alias("vz"), F.col("name").alias("other"))
    touching = cells.join(shifted, ["set", "vx", "vy", "vz"]).select(F.struct("set", "name").alias("a"), F.struct("set", F.col("other").alias("name")).alias("b"))
    roots = connected_components(touching).select(F.col("node.set").alias("set"), F.col("node.name").alias("name"), F.col("root.name").alias("component"))
    named = cells.join(roots, ["set", "name"], "left").select("set", "vx", "vy", "vz", F.coalesce("component", "name").alias("component"))
    return at.join(named, ["set", "vx", "vy", "vz"]).select("set", "point", "component")


def chosen_components(parts: DataFrame, rules: LiftRules) -> DataFrame:
    """(set, component, n, place): the largest components of each set, of enough points, at most `components` of them; ties by the least point."""
    total = parts.groupBy("set").agg(F.count("*").alias("total"))
    size = parts.groupBy("set", "component").agg(F.count("*").alias("n")).join(total, "set")
    enough = F.greatest(F.lit(rules.component_points), F.ceil(F.col("total") * rules.component_ratio))
    w = Window.partitionBy("set").orderBy(F.desc("n"), "component")
    ranked = size.where(F.col("n") >= enough).withColumn("place", F.row_number().over(w) - 1)
    return ranked.where(F.col("place") < rules.components).select("set", "component", "n", "place") if rules.components > 0 else ranked.select("set", "component", "n", "place")


def lift_status(observations: DataFrame, rules: LiftRules) -> DataFrame:
    """observations (has_mask, mask_ok, visible, hits, components) with status and the first reason against each."""
    ratio = F.col("hits") / F.greatest("visible", F.lit(1))
    reason = (
        F.when(~F.col("has_mask"), "missing_mask").when(~F.col("mask_ok"), "failed_read_mask").when(F.col("visible") == 0, "no_visible_points")
        .when(F.col("hits") < rules.least_hits, "too_few_hit_points").when(ratio < rules.least_ratio, "hit_ratio_too_low").when(F.col("components") == 0, "no_valid_component")
    )
    return observations.withColumn("ratio", ratio).withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted_3d").otherwise("rejected_3d"))


def frame_status(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """frames (frame, n_observations) with what became of each, by its queue task (frame, pose, focal, width)."""
    j = frames.join(tasks.withColumn("has_task", F.lit(True)), "frame", "left")
    status = (
        F.when(F.col("has_task").isNull(), "missing_queue_task").when(F.col("pose").isNull(), "missing_pose").when(F.col("focal").isNull(), "missing_intrinsics")
        .when(F.col("n_observations") == 0, "processed").when(F.col("width").isNull(), "missing_frame_size").otherwise("processed")
    )
    return j.withColumn("status", status)


def numbered(observations: DataFrame, *order: str) -> DataFrame:
    """observations with a running number over all of them in order, without one task that holds them all.

    Rows are range-partitioned by the order; each takes its place in its partition after the
    sizes of those before, a table of one row a partition.
    """
    placed = store(observations.repartitionByRange(*order).withColumn("p", F.spark_partition_id())).df
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1
    return placed.withColumn("own", own).join(F.broadcast(before), "p").withColumn("number", F.col("before") + F.col("own")).drop("p", "own", "before")
