"""Sources and sinks as round trips, and the queue as a stream and as a log."""

from __future__ import annotations

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import schemas
from skein.sources import arrays, documents
from skein.streaming import tasks


def test_document_round_trip(spark, tmp_path):
    rows = [{"object_id": "obj_1", "canonical_label": "Stuhl é", "label_counts": {"stuhl": 3}, "center_3d": [0.0, 1.5, -2.0], "aliases": ["a"]}, {"object_id": "obj_2"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"format": "object_memory_v1", "objects": rows}, indent=2, ensure_ascii=False))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"format": "other", "objects": rows}))
    df = documents.read_document_rows(spark, str(tmp_path / "in"), "object_memory_v1")
    assert df.count() == 2 and df.where("object_id = 'obj_1'").first().label_counts == {"stuhl": 3}
    documents.write_document(df, str(tmp_path / "out"), "object_memory_v1")
    again = documents.read_document_rows(spark, str(tmp_path / "out"), "object_memory_v1")
    assert list(map(str, again.collect())) == list(map(str, df.collect()))
    documents.write_document(df.limit(0), str(tmp_path / "none"), "object_memory_v1")
    assert documents.read_document_rows(spark, str(tmp_path / "none"), "object_memory_v1").count() == 0


def test_every_schema_parses():
    assert all(schemas.row_schema(tag).fields for tag in schemas.FORMATS)


def test_pair_csv(spark, tmp_path):
    head = [*documents.PAIR_NAMES, *documents.PAIR_MEASURES, *documents.PAIR_COUNTS]
    line = ["r", "why", "a", "x", "b", "y", "", "0.5", "nan", "inf", "oops", "0.25", "1", "2", "3", "", "4.7", "5", "6"]
    (tmp_path / "p.csv").write_text(",".join(head) + "\n" + ",".join(line) + "\n")
    r = documents.read_pairs(spark, str(tmp_path / "p.csv")).first()
    assert (r.center_distance, r.bbox_iou, r.bbox_intersection_over_smaller, r.bbox_smaller_over_larger, r.point_intersection_over_smaller) == (None, 0.5, 0.0, 0.0, None)
    assert (r.point_intersection_count, r.support_frames_a) == (3, None)
    documents.write_csv(spark.createDataFrame([(1, [1, 2], {"k": 1})], "i int, a array<int>, m map<string,int>"), str(tmp_path / "o"), "i", "a", "m")
    got = spark.read.option("header", True).csv(str(tmp_path / "o")).first()
    assert (got.i, got.a, got.m) == ("1", "[1,2]", '{"k":1}')


def test_similarity_shapes(spark, tmp_path):
    shapes = ['{"pairs": {"A_b|c": 0.5}}', '{"a b|c": 0.5}', '[{"left": "a b", "right": "C", "score": 0.5}]']
    for n, s in enumerate(shapes):
        (tmp_path / f"{n}.json").write_text(s)
        got = {(r.a, r.b): r.similarity for r in documents.directed_similarity(spark, str(tmp_path / f"{n}.json")).collect()}
        assert got == {("a b", "c"): 0.5, ("c", "a b"): 0.5}
    items = spark.createDataFrame([(1, "b", "a", 0.1), (2, "A", "B", 0.2), (3, "", "x", 0.3), (4, "y", "Y", 0.4)], "ord int, label_a string, label_b string, s double")
    assert [tuple(r) for r in documents.undirected_similarity(items).collect()] == [("a", "b", 0.2)]


def test_prompts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"frame_stem": "f1", "prompts": ["The Cup", "cup"]}, {"frame_stem": "f2", "tags": "lamp | desk"}]}')
    (tmp_path / "b.txt").write_text("sofa, chair\n a table")
    p = documents.read_prompts(spark, str(tmp_path))
    assert {(r.frame_stem, r.prompt) for r in p.collect()} == {("f1", "cup"), ("f2", "lamp"), ("f2", "desk"), (None, "sofa"), (None, "chair"), (None, "table")}
    frames = spark.createDataFrame([("f1",), ("f9",)], "frame_stem string")
    got = {(r.frame_stem, r.prompt) for r in documents.prompts_of(frames, p).collect()}
    assert ("f1", "cup") in got and ("f1", "sofa") not in got and ("f9", "sofa") in got and ("f9", "lamp") in got
    text = spark.createDataFrame([('ok ```json\n{"a": {"b": 2}}\n```',), ("no",)], "t string")
    assert [r.v for r in text.select(F.try_variant_get(documents.json_inside(F.col("t")), "$.a.b", "int").alias("v")).collect()] == [2, None]


def test_cache_and_split(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "tag string, v int")
    got = documents.update_cache(cache, spark.createDataFrame([("b", 3), ("c", 4)], "tag string, v int"), "tag")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    rows = spark.createDataFrame([("f", "x", "keep", "X"), ("f", "y", "hold", None), ("f", "z", "keep", "X")], "frame_stem string, tag string, action string, normalized_label string")
    keep, hold = documents.split_kept(rows)
    assert keep.first().prompts == ["X"] and hold.first().held == ["y"]


PROPS = ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2")


def test_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(1000, 6)).astype("<f4")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(values)], "point_idx long, " + ", ".join(f"{p} float" for p in PROPS)).repartition(5)
    names = arrays.write_ply(df, str(tmp_path / "c"), PROPS)
    assert len(names) == 1
    for rows in (1 << 20, 64):  # whole, and in ranges
        got = arrays.read_ply(spark, names[0], rows).orderBy("point_idx").toPandas()
        assert (got[list(PROPS)].to_numpy() == values).all() and got["point_idx"].tolist() == list(range(1000))
    names = arrays.write_ply(df, str(tmp_path / "many"), PROPS, 3)
    got = arrays.read_ply(spark, str(tmp_path / "many")).orderBy("file", "point_idx").toPandas()
    assert len(names) == 3 and (got[list(PROPS)].to_numpy() == values).all()
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["part-00000.ply", "part-00001.ply", "part-00002.ply"]


@pytest.mark.parametrize("head", [b"ply\nformat ascii 1.0\nelement vertex 1\nend_header\n", b"ply\nformat binary_little_endian 1.0\nend_header\n", b"ply\nformat binary", b"obj\nend_header\n"])
def test_ply_errors(head):
    with pytest.raises(ValueError):
        arrays.parse_ply_header(head)


def test_npz_to_sets(spark, tmp_path):
    buffer = io.BytesIO()
    np.savez_compressed(buffer, a=np.array([3, 1], np.int32), b=np.zeros(0, np.int32), c=np.arange(70000, dtype=np.int32))
    (tmp_path / "x.npz").write_bytes(buffer.getvalue())
    df = arrays.read_npz(spark, str(tmp_path / "x.npz"))
    assert {(r.key, r.n, r.m) for r in df.groupBy("key").agg(F.count("*").alias("n"), F.max("idx").alias("m")).collect()} == {("a", 2, 3), ("c", 70000, 69999)}
    arrays.write_sets(df.select("key", "idx"), str(tmp_path / "sets"))
    assert spark.read.parquet(str(tmp_path / "sets")).count() == 70002


def test_npz_types_are_kept(spark, tmp_path):
    """Floats and large unsigned numbers come back as they are, or not at all."""
    data = {"f": np.array([0.5, 1.9, -2.7, np.nan]), "g": np.array([0.1, 3], np.float32), "u": np.array([0, 1 << 63, (1 << 64) - 1], np.uint64), "i": np.array([-5, (1 << 62) + 1]), "b": np.array([True, False]), "m": np.asfortranarray(np.arange(6, dtype=">i2").reshape(2, 3))}
    for save, folder in ((np.savez, "stored"), (np.savez_compressed, "packed")):
        (tmp_path / folder).mkdir()
        save(tmp_path / folder / "x.npz", **data)
        path = str(tmp_path / folder)
        listed = {r.key: (r.dtype, r.shape, r.n, r.begin is not None) for r in arrays.list_npz(spark, path).collect()}
        assert listed == {k: (v.dtype.str, list(v.shape), v.size, save is np.savez) for k, v in data.items()}
        read = lambda key, value, p=path: [r.idx for r in arrays.read_npz(spark, p, value, [key], rows=2).orderBy("place").collect()]
        got = read("f", "double")
        assert got[:3] == [0.5, 1.9, -2.7] and math.isnan(got[3])
        assert read("g", "float") == data["g"].tolist() == read("g", "double")
        assert [int(x) for x in read("u", "decimal(20,0)")] == [0, 1 << 63, (1 << 64) - 1]
        assert read("i", "bigint") == [-5, (1 << 62) + 1] and read("b", "bigint") == [1, 0] and read("m", "bigint") == list(range(6))
        for key, value in (("f", "bigint"), ("u", "bigint"), ("i", "float"), ("f", "float")):
            with pytest.raises(Exception, match="fit"):
                read(key, value)


def test_npz_round_trip_and_what_earlier_runs_left(spark, tmp_path):
    path = str(tmp_path / "out")
    for files, n in ((3, 5), (1, 2)):
        df = spark.range(n * 70_000).select(F.format_string("k%d", F.col("id") % n).alias("key"), F.floor(F.col("id") / n).alias("place"), (F.col("id") * 0.5).alias("idx"))
        names = arrays.write_npz(df, path, "float64", files)
        assert len(names) <= files and sorted(str(p) for p in (tmp_path / "out").iterdir()) == names
        back = arrays.read_npz(spark, path, "double")
        assert back.select("key", "place", "idx").exceptAll(df).count() == 0 and back.count() == df.count()
        held = {k: v for name in names for k, v in np.load(name).items()}
        assert held.keys() == {f"k{i}" for i in range(n)} and all(v.dtype == np.float64 and len(v) == 70_000 for v in held.values())
    with pytest.raises(Exception, match="fit"):
        arrays.write_npz(spark.createDataFrame([("a", 0, 300)], "key string, place long, idx long"), path, "uint8")
    with pytest.raises(Exception, match="gaps"):
        arrays.write_npz(spark.createDataFrame([("a", 1, 3)], "key string, place long, idx long"), path, "uint8")
    assert sorted(str(p) for p in (tmp_path / "out").iterdir() if p.suffix) == names
    big = spark.range(2).select(F.lit("u").alias("key"), F.col("id").alias("place"), F.expr("CASE WHEN id = 0 THEN 0BD ELSE 18446744073709551615BD END").cast("decimal(20,0)").alias("idx"))
    arrays.write_npz(big, str(tmp_path / "big"), "uint64")
    assert [int(r.idx) for r in arrays.read_npz(spark, str(tmp_path / "big"), "decimal(20,0)").orderBy("place").collect()] == [0, (1 << 64) - 1]


def test_ply_types_and_what_earlier_runs_left(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("point_idx"), *[F.col("id").cast("double").alias(c) for c in arrays.PLY_REQUIRED], (F.col("id") + (1 << 30)).alias("n"), (F.col("id") % 256).alias("red"))
    kinds = {**dict.fromkeys(arrays.PLY_REQUIRED, "double"), "n": "uint", "red": "uchar"}
    path = str(tmp_path / "cloud")
    arrays.write_ply(df, path, kinds, files=4)
    names = arrays.write_ply(df, path, kinds, files=2)
    assert sorted(str(p) for p in (tmp_path / "cloud").iterdir()) == names
    back = arrays.read_ply(spark, path)
    assert dict(back.dtypes)["x"] == "double" and dict(back.dtypes)["n"] == "bigint" and dict(back.dtypes)["red"] == "smallint"
    assert sorted((r.x, r.n, r.red) for r in back.collect()) == sorted((float(r.x), r.n, r.red) for r in df.collect())


def test_masks_are_resized(spark):
    on = spark.createDataFrame([(1, 0, 0, 255, 2, 2), (1, 1, 1, 127, 2, 2), (1, 1, 0, 200, 2, 2)], "mask int, u int, v int, value int, w int, h int")
    got = {(r.u, r.v) for r in arrays.mask_pixels(on, 4, 4).collect()}
    assert got == {(u, v) for u in range(4) for v in range(2)}
    assert {(r.u, r.v) for r in arrays.mask_pixels(on, 2, 2).collect()} == {(0, 0), (1, 0)}


def test_first_existing(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p2").mkdir()
    assert arrays.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/p*").endswith("p2")
    with pytest.raises(FileNotFoundError):
        arrays.first_existing(spark, f"{tmp_path}/none")


def test_queue_log(spark):
    at = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    new = spark.range(5).select(F.col("id").alias("task"), at(1).alias("at"))
    log = tasks.enqueue(spark.createDataFrame([], "task long, state string, at timestamp"), new).select("task", "state", "at")
    assert tasks.enqueue(log, new).count() == 0 and tasks.enqueue(log, new, overwrite=True).count() == 5
    log = log.unionByName(tasks.claim(tasks.latest(log, "at"), at(2), 3))
    now = tasks.latest(log, "at")
    log = log.unionByName(tasks.finish(now, now.select("task", (F.col("task") > 0).alias("ok")), at(3)))
    assert {r.state: r.n for r in tasks.counts(tasks.latest(log, "at")).collect()} == {"pending": 2, "processing": 0, "done": 2, "failed": 1}
    log = log.unionByName(tasks.retry(tasks.latest(log, "at"), "failed", at(4)))
    assert {r.task for r in tasks.latest(log, "at").where("state = 'pending'").collect()} == {0, 3, 4}
    with pytest.raises(Exception, match="no such task"):
        tasks.select_tasks(new.withColumn("state", F.lit("x")), spark.createDataFrame([(0, 99)], "ord long, task long")).collect()


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = spark.range(300).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") * 97)).alias("ts"), (F.col("id") % 3).alias("kind"), (F.col("id") * 1.0).alias("value"))
    rows.coalesce(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 300 // files).parquet(str(tmp_path / "in"))
    stream = tasks.late_safe(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), delay="3 hours")
    got = tasks.run_once(tasks.tumbling(stream, "1 hour", "kind"), str(tmp_path / "cp"), str(tmp_path / "out"))
    last = rows.agg(F.max("ts")).first()[0]
    want = tasks.tumbling(rows, "1 hour", "kind").where((F.col("start") + F.expr("interval 1 hour")) <= F.lit(last) - F.expr("interval 3 hours"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    once = tasks.run_once(tasks.first_of_each(stream, "kind"), str(tmp_path / "cp2"), str(tmp_path / "out2"))
    assert {r.kind for r in once.collect()} == {0, 1, 2}


def test_keyframes_arrive_one_after_another(spark, tmp_path):
    from skein.streaming import tasks

    for i in range(3):
        spark.createDataFrame([(i, i * 10)], "task long, frame long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _, writer = tasks.replay(spark, str(tmp_path / "in"), "task long, frame long", 0.2)
    sizes = []
    q = writer.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [n for n in sizes if n] == [1, 1, 1]
