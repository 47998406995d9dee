"""Point clouds (PLY) and named arrays (NPZ) as tables, read through Spark so that any store will do."""

from __future__ import annotations

import math
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.scratch import store
from skein.sources.ship import ship

# The scalar types of a PLY header, as numpy types.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
PLY_REQUIRED = ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2")
#: Rows that a reading task hands on at once.
ROWS = 65_536


def parse_ply_header(head: bytes) -> tuple[int, list[tuple[str, str]], int]:
    """(vertices, properties, where the data begins); only binary little-endian files with a vertex element, its properties scalars."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file, or its header has no end")
    start = head.index(b"\n", end) + 1
    count, properties, element, binary = None, [], "", False
    for line in head[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        match words[:2]:
            case ["format", form]:
                binary = form == "binary_little_endian"
            case ["element", name]:
                element = name
                count = int(words[2]) if name == "vertex" else count
            case ["property", "list"] if element == "vertex":
                raise ValueError("vertex lists aren't supported")
            case ["property", kind] if element == "vertex":
                properties.append((words[2], PLY_TYPES[kind]))
    if not binary or count is None:
        raise ValueError("only binary_little_endian PLY files with a vertex element are supported")
    return count, properties, start


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark names it, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def _read_header(path: str) -> tuple[int, list[tuple[str, str]], int]:
    where, inside = _open(path)
    with where.open_input_file(inside) as file:
        return parse_ply_header(file.read(65536))


def read_ply(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    """(file, point_idx, properties…) of the vertices of PLY files of one layout, that of the first. Colour and place are required.

    Vertices have a fixed width, so a file is read in ranges of about `rows` vertices, each by
    a task of its own that opens it there; files may have any size. Spark lists the files.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists, without reading what they hold
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no file at {path}")
    _, properties, _ = _read_header(first)
    missing = [p for p in PLY_REQUIRED if p not in dict(properties)]
    if missing:
        raise ValueError(f"PLY properties missing: {missing}")
    kinds = {"i1": "tinyint", "u1": "smallint", "<i2": "smallint", "<u2": "int", "<i4": "int", "<u4": "bigint", "<f4": "float", "<f8": "double"}
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    width = np.dtype(properties).itemsize
    # ranges of bytes of the whole file, header included: at least as many as its vertices need
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("length") / (rows * width)))).alias("part"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count, own, start = _read_header(name)
                where, inside = _open(name)
                with where.open_input_file(inside) as file:
                    upto = min(count, (part + 1) * rows)
                    for at in range(part * rows, upto, ROWS):
                        n = min(ROWS, upto - at)
                        file.seek(start + at * np.dtype(own).itemsize)
                        some = np.frombuffer(file.read(n * np.dtype(own).itemsize), dtype=np.dtype(own), count=n)
                        columns = [pa.array([name] * n), pa.array(np.arange(at, at + n), pa.int64())]
                        columns += [pa.array(some[p].astype(arrow[kinds[t]].to_pandas_dtype()), arrow[kinds[t]]) for p, t in properties]
                        yield pa.RecordBatch.from_arrays(columns, names=["file", "point_idx", *dict(properties)])

    schema = "file string, point_idx bigint, " + ", ".join(f"`{p}` {kinds[t]}" for p, t in properties)
    return ranges.mapInArrow(run, schema)


def _begin(path: str) -> str:
    """A fresh folder below `path` for what tasks write until all of it is whole."""
    where, folder = _open(path)
    where.create_dir(made := f"{folder.rstrip('/')}/.{uuid.uuid4().hex}")
    return made


def _commit(path: str, made: str, parts: dict[str, str]) -> list[str]:
    """Move the parts (final name by written file) from the folder of _begin to `path` and delete what an earlier run or a failed attempt left; their paths."""
    where, folder = _open(path)
    folder = folder.rstrip("/")
    kinds = {os.path.splitext(name)[1] for name in parts.values()}
    for source, name in parts.items():
        where.move(source, f"{folder}/{name}")
    for f in where.get_file_info(fs.FileSelector(folder)):
        if f.type == fs.FileType.File and f.base_name.startswith("part-") and (not parts or os.path.splitext(f.base_name)[1] in kinds) and f.base_name not in parts.values():
            where.delete_file(f.path)
    where.delete_dir(made)
    return sorted(f"{folder}/{name}" for name in parts.values())


def write_ply(df: DataFrame, path: str, properties: tuple[str, ...] | dict[str, str], files: int = 1) -> list[str]:
    """PLY files in the folder `path`, rows by point_idx; the names of the files. properties are columns, written as float, or columns with their PLY types.

    Each file is written by one task as its rows come, in a folder of the run's own; when all
    are whole they are moved to their names, and part files of an earlier run go. A large
    cloud goes into several files, each a range of point_idx; no rows pass through the
    driver. An empty table gives no file.
    """
    ship(df.sparkSession)
    kinds = properties if isinstance(properties, dict) else dict.fromkeys(properties, "float")
    layout = [(p, PLY_TYPES[t]) for p, t in kinds.items()]
    dealt = df.select("point_idx", *kinds)
    dealt = dealt.withColumn("part", F.lit(0)) if files == 1 else dealt.repartitionByRange(files, "point_idx").withColumn("part", F.spark_partition_id())
    placed = store(dealt).df  # written once: a header, which holds the count, comes before the rows
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()} or {0: 0}  # a row a file
    columns = "".join(f"property {t} {p}\n" for p, t in kinds.items())
    folder = _begin(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, out, names, parts = TaskContext.get().taskAttemptId(), None, None, [], []
        where, _ = _open(path)
        for batch in batches:
            part = batch.column(0).to_numpy()
            for cut in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(cut) and part[cut[0]] != now:
                    if out is not None:
                        out.close()
                    now = int(part[cut[0]])
                    parts.append(f"part-{now:05d}.ply")
                    names.append(f"{folder}/{parts[-1]}.{attempt}")
                    out = where.open_output_stream(names[-1])
                    out.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {counts[now]}\n{columns}end_header\n".encode("ascii"))
                if len(cut):
                    rows = np.zeros(len(cut), np.dtype(layout))
                    for (p, t), c in zip(layout, batch.columns[2:], strict=True):
                        rows[p] = c.to_numpy(zero_copy_only=False)[cut].astype(t)
                    out.write(rows.tobytes())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["file", "part"])

    rows = placed.select("part", "point_idx", *kinds).repartition(len(counts), "part").sortWithinPartitions("part", "point_idx")
    return _commit(path, folder, {r.file: r.part for r in rows.mapInArrow(run, "file string, part string").collect()})  # a row a file


def _member(file, info: zipfile.ZipInfo) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(type, shape, column-major, bytes of header) of a zip's array; only numbers and truth values."""
    major, _ = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    if kind.kind not in "biuf":
        raise ValueError(f"{info.filename}: arrays of {kind} aren't supported")
    return kind, shape, fortran, file.tell()


def list_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, dtype, shape, fortran, n, begin) of the arrays of NPZ files, from the zips' directories: begin is where a stored array's numbers are, null for a compressed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                where, inside = _open(name)
                with where.open_input_file(inside) as raw, zipfile.ZipFile(raw) as z:
                    for info in z.infolist():
                        if info.filename.endswith(".npy"):
                            with z.open(info) as file:
                                kind, shape, fortran, head = _member(file, info)
                            begin = None
                            if info.compress_type == zipfile.ZIP_STORED:
                                raw.seek(info.header_offset + 26)
                                begin = info.header_offset + 30 + sum(struct.unpack("<HH", raw.read(4))) + head
                            out.append((name, info.filename[:-4], kind.str, list(shape), fortran, math.prod(shape), begin))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["file", "key", "dtype", "shape", "fortran", "n", "begin"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path")  # lists, without reading what they hold
    return files.mapInArrow(run, "file string, key string, dtype string, shape array<bigint>, fortran boolean, n bigint, begin bigint")


#: Value types of read_npz: the Arrow type, and which numpy types it holds without loss.
_HOLDS = {"bigint": (pa.int64(), "biu"), "double": (pa.float64(), "biuf"), "float": (pa.float32(), "biuf"), "decimal(20,0)": (pa.decimal128(20, 0), "biu")}


def _exactly(values: np.ndarray, value: str, key: str) -> pa.Array:
    """Values of an array as a column's type, or an error if that would change one."""
    kind, holds = _HOLDS[value]
    if values.dtype.kind not in holds:
        raise ValueError(f"{key}: {values.dtype} doesn't fit {value}")
    if value == "decimal(20,0)":
        return pa.array(values.astype(np.uint64 if values.dtype.kind in "bu" else np.int64)).cast(pa.decimal128(20, 0))
    made = values.astype(kind.to_pandas_dtype())
    if values.dtype.kind != "f" or values.dtype.itemsize > made.dtype.itemsize:
        back = made.astype(values.dtype)
        if ((back != values) & ~((values != values) & (back != back))).any() or (values.dtype.kind == "u" and made.dtype.kind == "i" and (made < 0).any()):
            raise ValueError(f"{key}: a value doesn't fit {value}")
    return pa.array(made, kind)


def read_npz(spark: SparkSession, path: str, value: str = "bigint", keys: list[str] | None = None, rows: int = 1 << 22) -> DataFrame:
    """(file, key, place, idx): the arrays of NPZ files, or those named, a row an element, idx of the type `value`.

    value is bigint, double, float or decimal(20,0), which holds unsigned 64-bit numbers; an
    array with a number that it can't hold as it is raises an error, nothing is cut. Stored
    arrays are read in ranges of `rows` elements, each by a task of its own, so they may have
    any size; compressed ones stream through one task each. Places count row by row. Empty
    arrays have no rows, see list_npz.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, key, dtype, shape, fortran, n, begin, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, first = np.dtype(dtype), part * rows
                where, inside = _open(name)
                with where.open_input_file(inside) as raw, ExitStack() as stack:
                    if begin is None:
                        file, upto = stack.enter_context(stack.enter_context(zipfile.ZipFile(raw)).open(f"{key}.npy")), n
                        _member(file, zipfile.ZipInfo(key))
                    else:
                        file, upto = raw, min(n, first + rows)
                        raw.seek(begin + first * kind.itemsize)
                    for at in range(first, upto, ROWS):
                        c = min(ROWS, upto - at)
                        values = np.frombuffer(file.read(c * kind.itemsize), kind, c)
                        place = np.arange(at, at + c)
                        if fortran and len(shape) > 1:
                            place = np.ravel_multi_index(np.unravel_index(place, shape[::-1])[::-1], shape)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * c), pa.array([key] * c), pa.array(place, pa.int64()), _exactly(values, value, key)], names=["file", "key", "place", "idx"])

    members = list_npz(spark, path).where("n > 0")
    members = members if keys is None else members.where(F.col("key").isin(keys))
    last = F.when(F.col("begin").isNotNull(), F.floor((F.col("n") - 1) / rows)).otherwise(0)
    ranges = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "key", "part")
    return dealt.mapInArrow(run, f"file string, key string, place bigint, idx {value}")


def write_npz(arrays: DataFrame, path: str, dtype: str, files: int = 1, compressed: bool = True) -> list[str]:
    """NPZ files in the folder `path` of arrays (key, place, idx), one-dimensional, of one numpy type; the names of the files.

    Keys are dealt over the files by their hash. A task writes a file as its rows come, an
    array after the other, in a folder of the run's own; when all are whole they are moved to
    their names, and part files of an earlier run go. A number that dtype can't hold, and
    places that aren't 0, 1, 2, …, are errors.
    """
    ship(arrays.sparkSession)
    kind = np.dtype(dtype)
    dealt = arrays.select(F.pmod(F.xxhash64("key"), F.lit(files)).cast("int").alias("part"), F.col("key").cast("string").alias("key"), F.col("place").cast("bigint").alias("place"), "idx")
    placed = store(dealt).df  # written once: an array's header, which holds the count, comes before its numbers
    counts = placed.groupBy("part", "key").agg(F.count("*").alias("n"))
    folder = _begin(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, at, names, parts = TaskContext.get().taskAttemptId(), (None, None), 0, [], []
        where, _ = _open(path)
        with ExitStack() as whole, ExitStack() as member:
            out = None
            for batch in batches:
                part, key, place, idx, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))) if len(part) else []
                for first, end in zip(cuts, [*cuts[1:], len(part)], strict=True):
                    if (part[first], key[first]) != now:
                        member.close()
                        if part[first] != now[0]:
                            whole.close()
                            parts.append(f"part-{part[first]:05d}.npz")
                            names.append(f"{folder}/{parts[-1]}.{attempt}")
                            raw = whole.enter_context(where.open_output_stream(names[-1]))
                            out = whole.enter_context(zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED))
                        now, at = (part[first], key[first]), 0
                        file = member.enter_context(out.open(f"{now[1]}.npy", "w", force_zip64=True))
                        np.lib.format.write_array_header_1_0(file, {"descr": kind.str, "fortran_order": False, "shape": (int(n[first]),)})
                    own = idx[first:end]
                    made = np.array([int(v) for v in own], kind) if own.dtype == object else own.astype(kind)
                    same = made.astype(own.dtype) == own if own.dtype != object else np.array([int(a) == int(b) for a, b in zip(made, own, strict=True)], bool)
                    if not (same | (own != own)).all() or (place[first:end] != np.arange(at, at + end - first)).any():
                        raise ValueError(f"{now[1]}: a value doesn't fit {kind}, or places have gaps")
                    at += end - first
                    file.write(made.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["file", "part"])

    rows = placed.join(counts, ["part", "key"]).select("part", "key", "place", "idx", "n").repartition(files, "part").sortWithinPartitions("part", "key", "place")
    return _commit(path, folder, {r.file: r.part for r in rows.mapInArrow(run, "file string, part string").collect()})  # a row a file


def write_sets(members: DataFrame, path: str) -> None:
    """Point sets (key, idx) as Parquet, dealt and sorted by key: what replaces a compressed file of arrays."""
    members.repartition("key").sortWithinPartitions("key", "idx").write.mode("overwrite").option("compression", "zstd").parquet(path)


def mask_pixels(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, u, v) of the set pixels of masks (mask, u, v, value, w, h), those of another size brought to this one by the nearest pixel."""
    cells = lambda c, size, own: F.sequence(F.ceil(F.col(c) * size / F.col(own)).cast("int"), (F.ceil((F.col(c) + 1) * size / F.col(own)) - 1).cast("int"))
    on = pixels.where("value > 127")
    wide = on.withColumn("us", cells("u", width, "w")).withColumn("vs", cells("v", height, "h"))
    wide = wide.where("us[0] <= us[size(us) - 1] and vs[0] <= vs[size(vs) - 1]")
    return wide.select("mask", F.explode("us").alias("nu"), "vs").select("mask", F.col("nu").alias("u"), F.explode("vs").alias("v")).where((F.col("u") < width) & (F.col("v") < height)).distinct()


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that is there; a pattern gives the last name it matches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        where = hadoop.Path(p)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        if found:
            return max(s.getPath().toString() for s in found)
    raise FileNotFoundError(", ".join(paths))
