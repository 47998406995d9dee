"""Image, mask and depth files (PNG) as rows and pixel tables, and masks back as files."""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.arrays import ROWS, _open
from skein.sources.ship import ship

# The format's first bytes, samples of a pixel by colour type, and where the passes of an interlaced image begin and how they step (x, y, dx, dy).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The bytes of an image's rows (height, units, bytes of a unit) before their filters.

    Where rows refer to both their left and upper neighbours, all units of a diagonal are
    done at once, as they need only those of the diagonals before; other rows are sums.
    """
    h, w, n = rows.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if not (kinds > 2).any():
        out = rows.copy()
        for y in range(h):
            if kinds[y] == 1:
                out[y] = np.cumsum(rows[y], axis=0, dtype=np.uint64).astype(np.uint8)
            elif kinds[y] == 2 and y:
                out[y] += out[y - 1]
        return out
    out = np.zeros((h + 1, w + 1, n), np.int16)
    for k in range(h + w - 1):
        y = np.arange(max(0, k - w + 1), min(h - 1, k) + 1)
        x = k - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.stack([np.zeros_like(left), left, up, (left + up) >> 1, nearest])[kinds[y], np.arange(len(y))]
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: bytes, at: int, w: int, h: int, bits: int, samples: int) -> tuple[np.ndarray, int]:
    """(samples of a (part of an) image as (height, width, samples), end of its bytes)."""
    unit, stride = max(1, bits * samples // 8), math.ceil(w * bits * samples / 8)
    end = at + h * (stride + 1)
    if len(data) < end:
        raise ValueError("too few pixels")
    raw = np.frombuffer(data, np.uint8, h * (stride + 1), at).reshape(h, stride + 1)
    flat = _unfiltered(raw[:, 1:].reshape(h, stride // unit, unit), raw[:, 0]).reshape(h, stride)
    if bits == 16:
        values = flat.view(">u2").astype(np.uint16)
    elif bits == 8:
        values = flat
    else:
        values = np.unpackbits(flat, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return values[:, : w * samples].reshape(h, w, samples), end


def decode_png(data: bytes) -> np.ndarray:
    """An image's samples (height, width, channels), uint16 where it has 16 bits and else uint8; palettes become their colours, shades of fewer than 8 bits stay as they are.

    Grey, colour, palette and alpha, 1 to 16 bits, interlaced or not. A ValueError says what
    isn't whole.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, palette, packed, ended = 8, None, None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"{kind.decode('latin-1')}: damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("cut off")
    w, h, bits, colour, _, _, laced = head
    if colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or laced > 1 or not w or not h or (bits < 8 and SAMPLES[colour] > 1):
        raise ValueError("unknown sort of PNG")
    try:
        pixels = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"IDAT: {e}") from None
    if laced:
        out, begin = np.zeros((h, w, SAMPLES[colour]), np.uint16 if bits == 16 else np.uint8), 0
        for x, y, dx, dy in PASSES:
            if x < w and y < h:
                some, begin = _samples(pixels, begin, -(-(w - x) // dx), -(-(h - y) // dy), bits, SAMPLES[colour])
                out[y::dy, x::dx] = some
    else:
        out, _ = _samples(pixels, 0, w, h, bits, SAMPLES[colour])
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("a colour is missing")
        out = palette[out[:, :, 0]]
    return out


def encode_grey(image: np.ndarray) -> bytes:
    """A grey image (height, width) of uint8 or uint16 as a PNG file."""
    bits = 8 * image.dtype.itemsize
    rows = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(image), -1)
    rows = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], bits, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(file, width, height, channels, bits, samples, error): the PNG files at a path or pattern, a row each.

    samples holds the image's bytes row by row, channels side by side, 16-bit ones least byte
    first; image_pixels takes them apart. Files are listed by Spark and dealt over `tasks`
    (the session's shuffle partitions unless given); a task has one file in memory at a time.
    A file that isn't a whole PNG is a row with its error and nulls. No files give no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path")  # lists, without reading what they hold
    dealt = files.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    types = [("file", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("samples", pa.binary()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, inside = _open(name)
                with where.open_input_file(inside) as f:
                    data = f.read()
                try:
                    image = decode_png(data)
                    row = (name, image.shape[1], image.shape[0], image.shape[2], 8 * image.dtype.itemsize, image.astype(image.dtype.newbyteorder("<")).tobytes(), None)
                except ValueError as e:
                    row = (name, None, None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, types, strict=True)], names=[n for n, _ in types])

    return dealt.mapInArrow(run, "file string, width int, height int, channels int, bits int, samples binary, error string")


def image_pixels(images: DataFrame, channel: int = 0, zeros: bool = False) -> DataFrame:
    """(file, u, v, value, w, h): one channel of images as read_images gives them, a row a pixel, those of value 0 only with `zeros`.

    Shaped as arrays.mask_pixels takes it; for lift.depth_meters value is the raw depth.
    Rows with an error, and images without that channel, have no pixels.
    """
    ship(images.sparkSession)
    whole = images.where(F.col("samples").isNotNull() & (F.col("channels") > channel)).select("file", "width", "height", "channels", "bits", "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, w, h, n, bits = (batch.column(k)[i].as_py() for k in range(5))
                values = np.frombuffer(batch.column(5)[i].as_buffer(), f"<u{bits // 8}").reshape(h * w, n)[:, channel]
                at = np.arange(h * w) if zeros else np.flatnonzero(values)
                for begin in range(0, len(at), ROWS):
                    some = at[begin : begin + ROWS]
                    fixed = [pa.array(np.full(len(some), x, np.int32)) for x in (w, h)]
                    made = [pa.array([name] * len(some), pa.string()), pa.array((some % w).astype(np.int32)), pa.array((some // w).astype(np.int32)), pa.array(values[some].astype(np.int32)), *fixed]
                    yield pa.RecordBatch.from_arrays(made, names=["file", "u", "v", "value", "w", "h"])

    return whole.mapInArrow(run, "file string, u int, v int, value int, w int, h int")


def write_masks(masks: DataFrame, pixels: DataFrame, path: str) -> DataFrame:
    """(mask, file): masks (mask, width, height) as PNG files in the folder `path`, 255 where pixels (mask, u, v) are set and else 0.

    A mask's name is its file's. Pixels come to the tasks in the masks' order, so a task has
    one mask in memory; it is written beside its place and then moved there, so nobody sees
    half a file, and a task that is run again replaces its own. Masks without pixels are all
    0; repeated pixels count once; a pixel outside its mask, of no mask, or without a place
    sets nothing. Two masks of one name, or a name that can't be a file's, are an error.
    The files are written before this returns.
    """
    from skein.sources.scratch import store

    spark = masks.sparkSession
    ship(spark)
    where, folder = _open(path)
    where.create_dir(folder)
    folder, run_id = folder.rstrip("/"), uuid.uuid4().hex
    named = masks.select(F.col("mask").cast("string").alias("mask"), "width", "height")
    bad = F.coalesce((F.col("mask") == "") | F.col("mask").rlike(r"[/\x00]") | F.col("mask").startswith("."), F.lit(True)) | (F.col("n") > 1)
    wrong = named.groupBy("mask").agg(F.count("*").alias("n")).where(bad).first()
    if wrong:
        raise ValueError(f"mask {wrong.mask!r}: {'two of one name' if wrong.n > 1 else 'no name of a file'}")
    set_ = pixels.select(F.col("mask").cast("string").alias("mask"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"))
    rows = named.join(set_, "mask", "left").repartition("mask").sortWithinPartitions("mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, image, files = TaskContext.get().taskAttemptId(), None, None, []

        def put() -> None:
            to, _ = _open(path)
            begun = f"{folder}/.{now}.{run_id}.{attempt}"
            with to.open_output_stream(begun) as f:
                f.write(encode_grey(image))
            to.move(begun, f"{folder}/{now}.png")
            files.append((now, f"{folder}/{now}.png"))

        def written() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], pa.string()) for k in (0, 1)], names=["mask", "file"])
            files.clear()
            return made

        for batch in batches:
            names, (w, h, u, v) = batch.column(0), (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2, 3, 4))
            own = np.asarray(names.to_pylist(), object)
            for cut in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1):
                if not len(cut):
                    continue
                if own[cut[0]] != now:
                    if now is not None:
                        put()
                    now, image = own[cut[0]], np.zeros((int(h[cut[0]]), int(w[cut[0]])), np.uint8)
                x, y = u[cut], v[cut]
                fine = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
                image[y[fine].astype(int), x[fine].astype(int)] = 255
            yield written()
        if now is not None:
            put()
        yield written()

    return store(rows.mapInArrow(run, "mask string, file string")).df
