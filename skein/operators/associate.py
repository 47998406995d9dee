"""Observations to objects, in order: the stateful fold, its scores, and reports on its log."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from skein.functions import labels as L
from skein.operators.spatial import spread
from skein.sources.ship import ship

# The usual weights of the five measures, in the order they are added.
WEIGHTS = {"bbox_iou": 0.25, "point_overlap": 0.35, "semantic_similarity": 0.20, "center_distance_score": 0.15, "temporal_consistency": 0.05}


def parse_weights(text: str) -> dict[str, float]:
    """Weights from `name=value` parts: none leaves the usual ones, otherwise all are scaled to a sum of one; unknown names and sums not above 0 are errors."""
    given = [p.split("=", 1) for p in text.split(",") if p.strip()]
    if not given:
        return dict(WEIGHTS)
    unknown = [k.strip() for k, _ in given if k.strip() not in WEIGHTS]
    if unknown:
        raise ValueError(f"unknown weight: {unknown[0]}")
    merged = WEIGHTS | {k.strip(): float(v) for k, v in given}
    total = sum(merged.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {k: v / total for k, v in merged.items()}


@dataclass(frozen=True)
class FoldRules:
    threshold: float = 0.55
    confirm_frames: int = 2
    confirm_seen: int = 3
    least_scale: float = 0.5
    window: float = 60.0
    least_semantic: float = 0.35
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    #: known similarities of two labels, either way round
    known: dict[tuple[str, str], float] = field(default_factory=dict)


def _tokens(label: str) -> set[str]:
    out = set()
    for w in label.split():
        out |= {w, w[:-1]} if w.endswith("s") and len(w) > 3 else {w}
    return out


def _similar(a: str, b: str, known: dict[tuple[str, str], float]) -> float:
    for pair in ((a, b), (b, a)):
        if pair in known:
            return max(0.0, min(1.0, known[pair]))
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    x, y = _tokens(a), _tokens(b)
    shared = len(x & y) / len(x | y) if x and y else 0.0
    return max(0.35, min(0.75, shared)) if shared else 0.2


class _Object:
    """One object of a scene as the fold sees it."""

    def __init__(self, row):
        self.low, self.high = list(row.low), list(row.high)
        self.points = set(row.points)
        self.labels = {row.label: 1}
        self.frames, self.seen, self.first, self.last = {row.frame}, 1, row.frame, row.frame
        self.status = "candidate"
        self.score = row.score or 0.0
        self._shape()

    def _shape(self) -> None:
        self.center = [round((a + b) * 0.5, 6) for a, b in zip(self.low, self.high, strict=True)]
        self.size = [round(max(b - a, 0.0), 6) for a, b in zip(self.low, self.high, strict=True)]
        self.label = min(self.labels, key=lambda x: (-self.labels[x], x))

    def take(self, row, rules: FoldRules) -> None:
        self.low = [min(a, b) for a, b in zip(self.low, row.low, strict=True)]
        self.high = [max(a, b) for a, b in zip(self.high, row.high, strict=True)]
        self.points |= set(row.points)
        self.labels[row.label] = self.labels.get(row.label, 0) + 1
        self.frames.add(row.frame)
        self.seen += 1
        self.first, self.last = min(self.first, row.frame), max(self.last, row.frame)
        self.score = (self.score * (self.seen - 1) + (row.score or 0.0)) / self.seen
        if len(self.frames) >= rules.confirm_frames or self.seen >= rules.confirm_seen:
            self.status = "confirmed"
        self._shape()

    def measures(self, row, center: list[float], size: list[float], rules: FoldRules) -> list[float]:
        shared = own = other = 1.0
        for a, b, x, y in zip(self.low, self.high, row.low, row.high, strict=True):
            shared *= max(0.0, min(b, y) - max(a, x))
            own *= max(0.0, b - a)
            other *= max(0.0, y - x)
        joint = own + other - shared
        points = set(row.points)
        common = len(self.points & points) / max(min(len(self.points), len(points)), 1)
        diag = (math.dist(size, (0, 0, 0)) + math.dist(self.size, (0, 0, 0))) * 0.5
        gap = max(0, row.frame - self.last)
        near = math.exp(-gap / rules.window) if rules.window > 0 else float(gap == 0)
        return [shared / joint if shared > 0 and joint > 0 else 0.0, common, _similar(row.label, self.label, rules.known), math.exp(-math.dist(center, self.center) / max(diag, rules.least_scale)), near]


#: Scores nearer to the best than this are computed exactly and compared in the objects' order; it covers rounding to six digits and the bounds' own error.
_MARGIN = 3e-6


class Scene:
    """The fold's state: objects in the order they were made, with an index over them.

    The index has the points' objects (an inverted list), and a grid of cells by label and
    centre of boxes, each with bounds over its objects: the hull of their boxes and of their
    centres, the largest diagonal, the last frame. For an observation,
    objects that share points are scored first, then cells by falling upper bound of what
    an object without shared points can reach there, until no bound reaches the best score.
    Cells are made twice as wide when there are more than MANY_CELLS of them. Scenes of few
    objects need no cells: all are scored at once.
    """

    FEW, MANY_CELLS = 64, 1024

    def __init__(self, rules: FoldRules, few: int = FEW):
        self.rules, self.few, self.objects = rules, few, []
        self.weights = np.array(list(rules.weights.values()))
        self.holders: dict[int, list[int]] = {}
        self.names: dict[str, int] = {}
        self.alike: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.shape = np.zeros((14, 16))  # low, high, centre, diagonal, volume, last frame, label, number of points; a column an object
        self.cells: dict[tuple[int, ...], int] = {}
        self.members: list[list[int]] = []
        self.cell_of: dict[int, int] = {}
        self.bounds = np.zeros((16, 15))  # low, high, least and greatest centre, diagonal, last frame, label
        self.width = 1.0
        self.tried = 0

    def add(self, made: _Object) -> int:
        """Put an object at the end; states of a stream are restored this way."""
        self.objects.append(made)
        i = len(self.objects) - 1
        if i == self.shape.shape[1]:
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)], axis=1)
        self._index(i, made.points)
        return i

    def _index(self, i: int, new_points) -> None:
        o = self.objects[i]
        for p in new_points:
            self.holders.setdefault(p, []).append(i)
        name = self.names.setdefault(o.label, len(self.names))
        volume = math.prod(max(0.0, b - a) for a, b in zip(o.low, o.high, strict=True))
        self.shape[:, i] = [*o.low, *o.high, *o.center, math.dist(o.size, (0, 0, 0)), volume, o.last, name, len(o.points)]
        if self.cells:
            self._into_cell(i)
        elif len(self.objects) > self.few:
            self._regrid()

    def _regrid(self) -> None:
        self.cells, self.members, self.cell_of = {}, [], {}
        for i in range(len(self.objects)):
            self._into_cell(i)

    def _into_cell(self, i: int) -> None:
        """Add an object to the cell of its label and centre; that which it leaves keeps its bounds, which hold for fewer as well."""
        row = self.shape[:, i]
        key = (*np.floor(row[6:9] / self.width).astype(int).tolist(), int(row[12]))
        k = self.cells.get(key)
        if k is None:
            if len(self.cells) >= self.MANY_CELLS + 8 * len(self.names):  # eight a label remain however wide cells are
                self.width *= 2
                return self._regrid()
            k = self.cells[key] = len(self.members)
            self.members.append([])
            if k == len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.bounds[k] = [*row[:9], *row[6:9], row[9], row[11], row[12]]
        if (old := self.cell_of.get(i)) != k:
            if old is not None:
                self.members[old].remove(i)
            self.members[k].append(i)
            self.cell_of[i] = k
        b = self.bounds[k]
        b[:3], b[6:9] = np.minimum(b[:3], row[:3]), np.minimum(b[6:9], row[6:9])
        b[3:6], b[9:12] = np.maximum(b[3:6], row[3:6]), np.maximum(b[9:12], row[6:9])
        b[12:14] = max(b[12], row[9]), max(b[13], row[11])

    def _similarities(self, label: str) -> tuple[np.ndarray, np.ndarray]:
        """The label's similarity to each label met, by number, and what caps the score there."""
        known = self.alike.get(label)
        if known is None or len(known[0]) < len(self.names):
            alike = np.array([_similar(label, x, self.rules.known) for x in self.names])
            known = self.alike[label] = alike, np.where(alike < self.rules.least_semantic, self.rules.least_semantic - 1e-6, np.inf)
        return known

    def _terms(self, iou: np.ndarray, common, alike: np.ndarray, away: np.ndarray, diag: np.ndarray, last: np.ndarray, row, own: float) -> np.ndarray:
        rules = self.rules
        scale = np.maximum((diag + own) * 0.5, rules.least_scale)
        gap = np.maximum(row.frame - last, 0)
        near = np.exp(-gap / rules.window) if rules.window > 0 else (gap == 0).astype(float)
        w = self.weights
        score = w[0] * iou + w[1] * common + w[2] * alike + w[3] * np.exp(-away / scale) + w[4] * near
        return np.where(alike < rules.least_semantic, np.minimum(score, rules.least_semantic - 1e-6), score)

    def _scores(self, which, row, low, high, center, own, volume, met: dict[int, int], n_points: int) -> np.ndarray:
        """The scores of the objects `which`, up to rounding in the last bits; met are those of them that share points, by their places among them. Objects are few, so what counts is the number of calls."""
        s, rules, w = self.shape[:, which], self.rules, self.weights
        self.tried += s.shape[1]
        side = np.minimum(s[3:6], high[:, None])
        side -= np.maximum(s[:3], low[:, None])
        np.maximum(side, 0.0, out=side)
        both = side[0] * side[1] * side[2]
        joint = s[10] + volume - both
        away = s[6:9] - center[:, None]
        away *= away
        fall = np.empty((2, s.shape[1]))
        np.divide(np.sqrt(away[0] + away[1] + away[2]), np.minimum((s[9] + own) * -0.5, -rules.least_scale), out=fall[0])
        gap = np.maximum(row.frame - s[11], 0.0)
        np.divide(gap, -(rules.window if rules.window > 0 else 1.0), out=fall[1])
        np.exp(fall, out=fall)
        near = fall[1] if rules.window > 0 else gap == 0
        alike, cap = self._similarities(row.label)
        names = s[12].astype(np.intp)
        score = w[2] * alike[names]
        score += w[3] * fall[0]
        score += w[4] * near
        score += w[0] * np.divide(both, joint, out=np.zeros(len(both)), where=(both > 0) & (joint > 0))
        for i, shared in met.items():
            score[i] += w[1] * shared / max(min(s[13, i], n_points), 1)
        return np.minimum(score, cap[names])

    def _limits(self, row, low, high, center, own) -> np.ndarray:
        """For each cell, the most that an object there can score without a shared point."""
        b = self.bounds[: len(self.members)]
        iou = (np.minimum(b[:, 3:6], high) > np.maximum(b[:, :3], low)).all(axis=1).astype(float)
        away = np.sqrt((np.maximum(np.maximum(b[:, 6:9] - center, center - b[:, 9:12]), 0.0) ** 2).sum(axis=1))
        return self._terms(iou, 0.0, self._similarities(row.label)[0][b[:, 14].astype(int)], away, b[:, 12], b[:, 13], row, own)

    def _near_best(self, row, center: list[float], size: list[float]) -> list[int]:
        """Objects that may be the best, in the order they were made: all that score within _MARGIN of the best."""
        low, high, middle = np.array(row.low), np.array(row.high), np.array(center)
        own, volume = math.dist(size, (0, 0, 0)), math.prod(max(0.0, x) for x in size)
        points = set(row.points)
        met: dict[int, int] = {}
        for p in points:
            for i in self.holders.get(p, ()):
                met[i] = met.get(i, 0) + 1
        n = len(self.objects)
        if not self.cells or (self.weights < 0).any():  # with a negative weight the limits don't hold
            score = self._scores(slice(n), row, low, high, middle, own, volume, met, len(points))
            return np.flatnonzero(score >= score.max() - _MARGIN).tolist()
        which = np.fromiter(met, np.int64, len(met))
        score = self._scores(which, row, low, high, middle, own, volume, dict(enumerate(met.values())), len(points))
        best = score.max() if len(score) else -math.inf
        found = [(which, score)]
        limits = self._limits(row, low, high, middle, own)
        for k in np.argsort(-limits).tolist():
            if limits[k] < best - _MARGIN:
                break
            which = np.array([i for i in self.members[k] if i not in met], np.int64)
            if len(which):
                score = self._scores(which, row, low, high, middle, own, volume, {}, len(points))
                best = max(best, score.max())
                found.append((which, score))
        return sorted({int(i) for which, score in found for i in which[score >= best - _MARGIN]})

    def match(self, row) -> tuple[int, float, list[float]]:
        """The best object's number (-1 if there is none), its score and its five measures, rounded to six digits.

        An object is better only if its unrounded score exceeds the best one's, rounded.
        Labels too unlike cap the score just below what counts as alike. Scores far below
        the best can't take part in that, so only those close to it are compared.
        """
        rules = self.rules
        center = [(a + b) * 0.5 for a, b in zip(row.low, row.high, strict=True)] if row.center is None else list(row.center)
        size = [b - a for a, b in zip(row.low, row.high, strict=True)]
        best, best_score, parts = -1, 0.0, []
        for i in self._near_best(row, center, size) if self.objects else ():
            m = self.objects[i].measures(row, center, size, rules)
            score = sum(w * x for w, x in zip(rules.weights.values(), m, strict=True))
            if m[2] < rules.least_semantic:
                score = min(score, rules.least_semantic - 1e-6)
            if best < 0 or score > best_score:
                best, best_score, parts = i, round(score, 6), [round(x, 6) for x in m]
        return best, best_score, parts

    def follow(self, row) -> tuple[str, int, int, float, list[float]]:
        """Take an observation: match or new, the object's number, that of the best one before, and its score and measures."""
        best, score, parts = self.match(row)
        if best >= 0 and score >= self.rules.threshold:
            o = self.objects[best]
            new = set(row.points) - o.points
            o.take(row, self.rules)
            self._index(best, new)
            return "match", best, best, score, parts
        return "new", self.add(_Object(row)), best, score, parts

    def step(self, row) -> tuple[str, int, float]:
        action, i, _, score, _ = self.follow(row)
        return action, i, score


PARTS = ("bbox_iou", "point_overlap", "semantic", "center", "temporal")
LOG = "scene bigint, obs bigint, frame bigint, action string, object_id string, score double, best_id string, " + ", ".join(f"{p} double" for p in PARTS) + ", tried bigint"
_LOG_NAMES = ["scene", "obs", "frame", "action", "object_id", "score", "best_id", *PARTS, "tried"]


@dataclass(slots=True)
class _Row:
    obs: int
    frame: int
    label: str
    low: list[float]
    high: list[float]
    center: list[float] | None
    points: list[int] | None
    score: float | None


def _name(i: int) -> str:
    return f"obj_{i:06d}"


def _entry(key: int, row: _Row, scene: Scene) -> tuple:
    """The log's row of an observation that the scene takes."""
    if row.points is None or not len(row.points) or row.low is None or row.high is None:
        return (key, row.obs, row.frame, "skipped_missing_hit_points", None, None, None, *[None] * 5, 0)
    before = scene.tried
    action, i, best, score, parts = scene.follow(row)
    return (key, row.obs, row.frame, action, _name(i), score, _name(best) if best >= 0 else None, *(parts or [None] * 5), scene.tried - before)


_COLUMNS = ["scene", "obs", "frame", "label", "low", "high", "center", "points", "score"]


def _taken(observations: DataFrame) -> DataFrame:
    """The columns that the fold reads, labels in their normal form, numbers as the log has them."""
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    reals = lambda c: F.col(c).cast("array<double>").alias(c)
    return observations.select(whole("scene"), whole("obs"), whole("frame"), L.collapsed(F.col("label")).alias("label"), reals("low"), reals("high"), reals("center"), F.col("points").cast("array<bigint>").alias("points"), F.col("score").cast("double").alias("score"))


def _plain(column: pa.Array) -> list:
    """A column's values; lists of numbers are cut from one list of all, which takes a fraction of the time."""
    if not pa.types.is_list(column.type) or column.values.null_count:
        return column.to_pylist()
    values, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.tolist()
    return [values[a:b] if valid else None for a, b, valid in zip(ends, ends[1:], column.is_valid().tolist(), strict=False)]


def fold(observations: DataFrame, rules: FoldRules = FoldRules()) -> DataFrame:
    """The match log of observations (scene, obs, frame, label, low, high, center, points, score) taken in order of frame and obs.

    Each row tells what became of an observation, its object, and the best object before it
    with its score and five measures; `tried` counts the objects that were scored for it.
    Each step depends on all before it in its scene, so a scene is followed in one task, but
    never held there: rows stream through in order, and only the scene's objects are kept.
    Observations without points or box are logged as skipped. object_table makes the objects
    from the log.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scene = None, None
        for batch in batches:
            out = []
            for values in zip(*[_plain(c) for c in batch.columns], strict=True):
                if scene is None or values[0] != key:
                    key, scene = values[0], Scene(rules)
                out.append(_entry(key, _Row(*values[1:]), scene))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LOG_TYPES, strict=True)] if out else [pa.array([], t) for t in _LOG_TYPES], names=_LOG_NAMES)

    ship(observations.sparkSession)
    return spread(_taken(observations), "scene").sortWithinPartitions("scene", "frame", "obs").mapInArrow(follow, LOG)


_LOG_TYPES = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()] + [pa.float64()] * 5 + [pa.int64()]


def object_table(observations: DataFrame, log: DataFrame, rules: FoldRules = FoldRules()) -> DataFrame:
    """The objects that a log's observations made: one row for each scene and object.

    (scene, object_id, status, label, aliases, label_counts, first_frame, last_frame, frames,
    seen, points, low, high, center, size, mean_score). All of it are aggregates over the
    log joined with the observations, so no object is held whole: an object is confirmed if
    it was seen again and has enough frames or observations, its label is the most frequent,
    the first by name among equals, and its centre is the box's.
    """
    o = _taken(observations).join(log.where("object_id is not null").select("scene", "obs", "object_id"), ["scene", "obs"])
    key = ["scene", "object_id"]
    named = o.groupBy(*key, "label").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts")
    )
    frames = o.select(*key, "frame").distinct().groupBy(*key).agg(F.count("*").alias("frames"))
    points = object_points(observations, log).groupBy(*key).agg(F.count("*").alias("points"))
    edge = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(3)]
    whole = o.groupBy(*key).agg(F.count("*").alias("seen"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), _mean(F.coalesce("score", F.lit(0.0))).alias("mean_score"), *edge)
    made = whole.join(named, key).join(frames, key).join(points, key)
    status = F.when((F.col("seen") > 1) & ((F.col("frames") >= rules.confirm_frames) | (F.col("seen") >= rules.confirm_seen)), "confirmed").otherwise("candidate")
    low, high = F.array(*[F.col(f"low{i}") for i in range(3)]), F.array(*[F.col(f"high{i}") for i in range(3)])
    center = F.array(*[F.round((F.col(f"low{i}") + F.col(f"high{i}")) * 0.5, 6) for i in range(3)])
    size = F.array(*[F.round(F.greatest(F.col(f"high{i}") - F.col(f"low{i}"), F.lit(0.0)), 6) for i in range(3)])
    return made.select(
        *key, status.alias("status"), "label", F.map_keys("label_counts").alias("aliases"), "label_counts", "first_frame", "last_frame", "frames", "seen", "points",
        low.alias("low"), high.alias("high"), center.alias("center"), size.alias("size"), "mean_score",
    )


def _mean(c: Column) -> Column:
    """The mean of numbers, the same in whatever order they come: they are added as decimals of 18 places, where all are below a billion."""
    fine = F.abs(c) < 1e9
    added = F.sum(F.when(fine, c.cast("decimal(38,18)"))).cast("double")
    return F.when(F.count_if(~fine) > 0, F.avg(c)).otherwise(added / F.count("*"))


def object_points(observations: DataFrame, log: DataFrame) -> DataFrame:
    """(scene, object_id, point): the union of the points of each object's observations, in long form."""
    o = _taken(observations).select("scene", "obs", "points").join(log.where("object_id is not null").select("scene", "obs", "object_id"), ["scene", "obs"])
    return o.select("scene", "object_id", F.explode("points").alias("point")).distinct()


def _association(rules: FoldRules) -> StatefulProcessor:
    """A scene's objects as a map state, one entry an object: a micro-batch writes only those that it changed or made. The class imports this module in tasks alone, as what plans it may not have the package."""
    given = asdict(rules)

    class Association(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getMapState("objects", StructType([StructField("n", LongType())]), StructType([StructField("object", BinaryType())]))

        def handleInputRows(self, key, rows, timerValues):
            from skein.operators import associate as A

            scene = A.Scene(A.FoldRules(**given))
            for _, value in sorted((k[0], v[0]) for k, v in self.state.iterator()):
                scene.add(pickle.loads(value))
            out, changed = [], set()
            for row in pd.concat(list(rows)).sort_values(["frame", "obs"]).itertuples():
                own = A._Row(row.obs, row.frame, row.label, *[None if x is None else list(x) for x in (row.low, row.high, row.center, row.points)], None if row.score != row.score else row.score)
                out.append(A._entry(key[0], own, scene))
                if out[-1][4] is not None:
                    changed.add(int(out[-1][4][4:]))
            for i in changed:
                self.state.updateValue((i,), (pickle.dumps(scene.objects[i]),))
            yield pd.DataFrame(out, columns=A._LOG_NAMES)

        def close(self) -> None:
            pass

    return Association()


def fold_stream(observations: DataFrame, rules: FoldRules = FoldRules()) -> DataFrame:
    """fold on a stream: a scene's objects are kept between micro-batches in Spark's state store, an entry each.

    Within a micro-batch a scene's observations are put in order; between batches they must
    come in order, as a queue's do. The session's state store is set to RocksDB, which map
    states need.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)
    return _taken(observations).groupBy("scene").transformWithStateInPandas(_association(rules), LOG, "Append", "None")


def frame_events(log: DataFrame) -> DataFrame:
    """(scene, frame, events, counts): each frame's matches and new objects in order, and how many of each; skipped ones leave no event."""
    made = log.where(~F.col("action").startswith("skipped"))
    each = made.groupBy("scene", "frame", "action").agg(F.count("*").alias("c"), F.collect_list(F.struct("obs", "action", "object_id")).alias("own"))
    events, counts = F.array_sort(F.flatten(F.collect_list("own"))), F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "c"))))
    return each.groupBy("scene", "frame").agg(events.alias("events"), counts.alias("counts"))
