"""PNG files in all their sorts against a plain encoder, and masks and depth from files to files."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import lift
from skein.sources import arrays, images


def filtered(rows: list[bytes], unit: int, kinds: list[int]) -> bytes:
    """Rows with their filters, byte by byte as the format's text has it."""
    out, before = bytearray(), bytes(len(rows[0]) if rows else 0)
    for row, kind in zip(rows, kinds, strict=True):
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = (row[i - unit] if i >= unit else 0), before[i], (before[i - unit] if i >= unit else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        before = row
    return bytes(out)


def packed(values: np.ndarray, bits: int) -> list[bytes]:
    """Each row's samples as bytes."""
    rows = []
    for row in values.reshape(len(values), -1).tolist():
        s = "".join(format(x, f"0{bits}b") for x in row)
        s += "0" * (-len(s) % 8)
        rows.append(bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)))
    return rows


def png(values: np.ndarray, bits: int, colour: int, palette: bytes = b"", laced: bool = False, seed: int = 0, kinds=None) -> bytes:
    rnd, unit = random.Random(seed), max(1, bits * values.shape[2] // 8)
    parts = [values[y::dy, x::dx] for x, y, dx, dy in images.PASSES] if laced else [values]
    data = b"".join(filtered(packed(p, bits), unit, [rnd.choice(kinds or range(5)) for _ in p]) for p in parts if p.size)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    z = zlib.compress(data)
    head = struct.pack(">IIBBBBB", values.shape[1], values.shape[0], bits, colour, 0, 0, laced)
    return images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("bits", "colour"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (8, 4), (16, 4), (8, 6), (16, 6), (4, 3), (8, 3)])
def test_all_sorts(bits, colour, laced):
    rnd = np.random.default_rng(bits * 10 + colour)
    for w, h in ((1, 1), (3, 2), (13, 9), (2, 17)):
        palette = rnd.integers(0, 256, (1 << bits, 3)).astype(np.uint8) if colour == 3 else None
        values = rnd.integers(0, 1 << bits, (h, w, images.SAMPLES[colour]))
        for kinds in (None, (0, 1, 2)):
            got = images.decode_png(png(values, bits, colour, palette.tobytes() if palette is not None else b"", laced, w, kinds))
            assert (got == (palette[values[:, :, 0]] if colour == 3 else values)).all() and got.dtype == (np.uint16 if bits == 16 else np.uint8)


def test_damage_is_named():
    good = png(np.arange(48).reshape(4, 4, 3), 8, 2)
    for bad in (b"", b"GIF89a", good[:-1], good[:40], good[:50] + bytes([good[50] ^ 1]) + good[51:], png(np.full((1, 1, 1), 3), 8, 3, b"abcdef")):
        with pytest.raises(ValueError):
            images.decode_png(bad)
    for kind in (np.uint8, np.uint16):
        grey = np.arange(600, dtype=kind).reshape(20, 30)
        assert (images.decode_png(images.encode_grey(grey))[:, :, 0] == grey).all()


def test_masks_and_depth_from_files_to_files(spark, tmp_path):
    """Masks of two sizes are brought to one, united by prompt and written; depth keeps its 16 bits; a broken file is a row."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    small, large = np.zeros((2, 2, 1), int), np.zeros((4, 4, 1), int)
    small[0, 1], large[3, 0], large[2, 0] = 255, 255, 100
    (source / "cup_1.png").write_bytes(png(small, 8, 0))
    (source / "cup_2.png").write_bytes(png(large, 8, 0))
    (source / "broken.png").write_bytes(png(large, 8, 0)[:60])
    depth = np.array([[0, 1500], [65535, 20]]).reshape(2, 2, 1)
    (tmp_path / "depth.png").write_bytes(png(depth, 16, 0))
    found = images.read_images(spark, f"{source}/*.png")
    assert {(r.file.split("/")[-1], r.width, r.error is None) for r in found.collect()} == {("cup_1.png", 2, True), ("cup_2.png", 4, True), ("broken.png", None, False)}
    on = images.image_pixels(found).withColumn("mask", F.regexp_extract("file", r"(\w+)_\d+\.png$", 1))
    union = arrays.mask_pixels(on, 4, 4)
    assert {(r.mask, r.u, r.v) for r in union.collect()} == {("cup", 2, 0), ("cup", 3, 0), ("cup", 2, 1), ("cup", 3, 1), ("cup", 0, 3)}
    sizes = spark.createDataFrame([("cup", 4, 4), ("no such thing", 3, 2)], "mask string, width int, height int")
    odd = spark.createDataFrame([("cup", 9, 9), ("cup", 0, None), ("cup", -1, 0), ("other", 0, 0), (None, 0, 0), ("cup", 0, 3)], "mask string, u int, v int")
    for _ in range(2):  # written again, it is the same
        made = images.write_masks(sizes, union.select("mask", "u", "v").unionByName(odd), str(out))
        assert sorted(r.mask for r in made.collect()) == ["cup", "no such thing"] and sorted(f.name for f in out.iterdir()) == ["cup.png", "no such thing.png"]
    back = images.decode_png((out / "cup.png").read_bytes())[:, :, 0]
    assert {tuple(x) for x in np.argwhere(back == 255)[:, ::-1].tolist()} == {(2, 0), (3, 0), (2, 1), (3, 1), (0, 3)} and set(back.ravel()) == {0, 255}
    assert images.decode_png((out / "no such thing.png").read_bytes()).shape == (2, 3, 1)
    raw = images.image_pixels(images.read_images(spark, str(tmp_path / "depth.png")), zeros=True)
    metres = lift.depth_meters(raw.select(F.lit(1).alias("camera"), "u", "v", F.col("value").alias("raw"), F.lit(1000.0).alias("depth_scale")))
    assert {(r.u, r.v, r.measured) for r in metres.collect()} == {(1, 0, 1.5), (0, 1, 65.535), (1, 1, 0.02)}
    for bad in ([("a/b", 1, 1)], [(None, 1, 1)], [("a", 1, 1), ("a", 2, 2)]):
        with pytest.raises(ValueError):
            images.write_masks(spark.createDataFrame(bad, "mask string, width int, height int"), odd, str(out))
