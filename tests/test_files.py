"""Readers, writers and streams over small files of their own."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfield.operators import matching as X
from pairfield.sources import readers as D
from pairfield.sources import writers as W
from pairfield.sources.flo import read_flo, write_flo
from pairfield.streaming.logs import best_so_far, metric_windows, stream_best, typed_state


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_pascal_and_router(spark, tmp_path):
    put(tmp_path / "test_pairs.csv", "source_image,target_image,class\nJ/a.jpg,J/b.jpg,3\n")
    put(tmp_path / "trn_pairs.csv", "source_image,target_image,class,flip\nJ/a.jpg,J/b.jpg,3,1\n")
    r = D.read_pairs_pascal(spark, str(tmp_path / "trn_pairs.csv"), "trn").first()
    assert (r.src_image, r.category_id, r.flip) == ("a.jpg", 2, True)
    r = D.load_benchmark(spark, "pfpascal", str(tmp_path), "tst").first()
    assert (r.benchmark, r.split, r.trg_image, r.flip) == ("pfpascal", "test", "b.jpg", False)


def test_willow_caltech_spair(spark, tmp_path):
    head = "a,b," + ",".join(f"c{i}" for i in range(40))
    path = put(tmp_path / "w.csv", head + "\nroot/cat/1.png,root/cat/2.png," + ",".join(map(str, range(40))) + "\n")
    rows = D.read_pairs_willow(spark, path).orderBy("kp_idx").collect()
    assert len(rows) == 10 and (rows[1].src_x, rows[1].src_y, rows[1].trg_x, rows[1].trg_y) == (1.0, 11.0, 21.0, 31.0) and rows[0].category == "cat"
    path = put(tmp_path / "c.csv", 'a,b,c,d,e,f,g\ns.jpg,t.jpg,1,"1,2","3,4","5,6","7,8"\n')
    assert D.read_pairs_caltech(spark, path).count() == 2
    with pytest.raises(Exception, match="too many"):
        D.read_pairs_caltech(spark, path, 1).collect()
    path = put(tmp_path / "s.txt", "000001-a-b:cat\n\n000002-c-d:dog\n")
    assert [(r.pair_id, r.src_image, r.category) for r in D.read_pairs_spair(spark, path).orderBy("pair_id").collect()] == [(1, "a", "cat"), (2, "c", "dog")]


ANN = {"src_kps": [[1, 2]], "trg_kps": [[3, 4]], "src_bndbox": [0, 0, 9, 9], "trg_bndbox": [0, 0, 9, 9], "src_imsize": [9, 9, 3], "trg_imsize": [9, 9, 3], "category": "cat", "viewpoint_variation": 1, "scale_variation": 0, "truncation": 0, "occlusion": 2}


def test_annotations_and_compaction(spark, tmp_path):
    for n in ("p1", "p2", "p3"):
        put(tmp_path / "ann" / f"{n}.json", json.dumps(ANN, indent=1))
    ann = D.read_annotations_json(spark, str(tmp_path / "ann" / "*.json"))
    assert {r.name for r in ann.collect()} == {"p1", "p2", "p3"}
    assert D.annotation_points(ann, ["name"]).first().trg_y == 4.0
    path = put(tmp_path / "all.json", json.dumps({"p1": ANN, "p2": ANN}))
    assert D.read_annotations_map(spark, path).where("occlusion = 2").count() == 2
    pairs = spark.createDataFrame([("p1", "trn"), ("p2", "test")], "name string, split string")
    D.compact_annotations(spark, str(tmp_path / "ann" / "*.json"), pairs, str(tmp_path / "out"))
    assert {(r.name, r.split) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("p1", "trn"), ("p2", "test")}


def test_keyed_text_parts_joints_lists(spark, tmp_path):
    path = put(tmp_path / "images.txt", "1 a b.jpg\n2 c.jpg\n\n")
    assert [(r.id, r.name) for r in D.read_keyed_text(spark, path, ["name"]).orderBy("id").collect()] == [(1, "a b.jpg"), (2, "c.jpg")]
    path = put(tmp_path / "parts.txt", "1 1 10.5 20 1\n1 2 0 0 0\n")
    assert D.read_part_locs(spark, path).where("visible = 1").first().x == 10.5
    path = put(tmp_path / "awa.json", json.dumps({"cat": {"i1": {"a1": {"nose": [1, 2], "bbox": [0, 0, 5, 5]}}, "i2": {"a1": {"nose": [-1, -1]}}}}))
    rows = {r.image: r for r in D.read_nested_joints(spark, path).collect()}
    assert rows["i1"].box == [0, 0, 5, 5] and rows["i2"].box == [0, 0, 0, 0]
    put(tmp_path / "random_pairs.txt", "a b\nc d\ne f\n")
    assert [r.src_image for r in D.read_pair_list(spark, str(tmp_path), limit=2).orderBy("line_no").collect()] == ["a", "c"]


def test_scans(spark, tmp_path):
    for sub, pair, flag in (("B", "p1", "1"), ("A", "p1", "0")):
        put(tmp_path / "tss" / sub / pair / "flip_gt.txt", flag + "\n")
        put(tmp_path / "tss" / sub / pair / "image1.PNG", b"x")
    assert {(r.subset, r.label, r.flip) for r in D.scan_tss(spark, str(tmp_path / "tss")).collect()} == {("A", 0, False), ("B", 1, True)}
    assert D.scan_images(spark, str(tmp_path / "tss")).count() == 2
    put(tmp_path / "m" / "seg0.json", json.dumps({"b": {"offset": 5, "shape": [1, 2], "dtype": "u1"}, "a": {"offset": 0, "shape": [5], "dtype": "u1"}}))
    put(tmp_path / "m" / "seg1.json", json.dumps({"c": {"offset": 0, "shape": [1], "dtype": "u1"}}))
    assert [r.key for r in D.read_manifest(spark, str(tmp_path / "m"), 1, 1).collect()] == ["b"]
    put(tmp_path / "h.csv", "obj,im1,im2,H,W,a,b,c,d,e,f,g,h,i\no,1,2,4,5,1,0,0,0,1,0,0,0,1\n")
    assert D.read_homographies(spark, str(tmp_path / "h.csv")).first().mat == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    put(tmp_path / "objs" / "o1" / "img.npz", b"1")
    put(tmp_path / "objs" / "o1" / "geo.npz", b"1")
    put(tmp_path / "objs" / "o2" / "images.npz", b"1")
    assert {r.object_id: r.missing for r in D.build_manifest(spark, str(tmp_path / "objs")).collect()} == {"o1": [], "o2": ["geometry"]}
    path = put(tmp_path / "cat.json", json.dumps({"x": {"type": 1, "name": "X", "categories": ["w"]}, "y": {"type": 0, "name": "Y", "categories": []}}))
    assert [r.asset_id for r in D.read_catalog(spark, path, "textures").collect()] == ["x"]


def test_flow_files(spark, tmp_path):
    uv = np.arange(12, dtype="<f4").reshape(2, 3, 2)
    uv[1, 2] = 2e9
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.flo", b"PIEH" + struct.pack("<ii", 3, 2) + uv.tobytes())
    rows = {(r.y, r.x): (r.dx, r.dy) for r in read_flo(spark, str(tmp_path)).where("path = 'in/a.flo'").collect()}
    assert rows[0, 1] == (2.0, 3.0) and rows[1, 2] == (None, None) and len(rows) == 6
    put(tmp_path / "in" / "b.flo", b"XXXX" + struct.pack("<ii", 3, 2) + uv.tobytes())
    with pytest.raises(Exception, match="no flow file"):
        read_flo(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:  # the broken file is not even opened
        assert read_flo(spark, str(tmp_path)).where("path IN ('in/a.flo', 'none')").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_flow_files_are_read_in_ranges(spark, tmp_path):
    """Two large flows and a ragged one, written and read in parts of 100 pixels; columns that aren't asked for aren't made."""
    rng = np.random.default_rng(2)
    rows = [(name, int(y), int(x), float(np.float32(u)), float(np.float32(v))) for name, h, w in (("a/1.flo", 20, 30), ("b.flo", 7, 41)) for y in range(h) for x in range(w) for u, v in [rng.normal(size=2)]]
    rows += [("c.flo", 0, 3, 1.0, 2.0), ("c.flo", 4, 1, None, 5.0)]
    df = spark.createDataFrame(rows, "path string, y long, x long, dx double, dy double").repartition(4)
    write_flo(df, str(tmp_path / "out"))
    got = read_flo(spark, str(tmp_path / "out"), partition_bytes=800)
    assert got.rdd.getNumPartitions() >= 9
    want = {r[:3]: r[3:] if None not in r else (None, None) for r in rows}
    want |= {("c.flo", y, x): (None, None) for y in range(5) for x in range(4) if ("c.flo", y, x) not in want}
    assert {(r.path, r.y, r.x): (r.dx, r.dy) for r in got.collect()} == want
    assert read_flo(spark, str(tmp_path / "out"), "y long, x long").columns == ["y", "x"]
    assert read_flo(spark, str(tmp_path / "out"), "y long").count() == len(want)
    assert not [p for p in (tmp_path / "out").rglob(".*")]


def test_feature_sets_and_writers(spark, tmp_path):
    spark.createDataFrame([("a", [1.0]), ("b", [2.0, 3.0])], "dataset_name string, vec array<double>").write.partitionBy("dataset_name").parquet(str(tmp_path / "f"))
    rows, summary = D.read_feature_sets(spark, str(tmp_path / "f"))
    assert rows.count() == 2 and {r.dataset_name: r.dim for r in summary.collect()} == {"a": 1, "b": 2}
    s = spark.createDataFrame([(1, i, y, x, 0.01 * x, 0.01 * y, 0.01) for i in (1, 2) for y in range(1, 3) for x in range(1, 3)], "object_id long, image_id long, y long, x long, cx double, cy double, cz double")
    W.write_overlaps(X.view_overlap(s), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).first().overlap == 1.0
    m = X.pairwise_matches(s)
    for _ in range(2):
        W.write_matches(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    W.write_summary(spark.createDataFrame([("a",), ("a",), (None,)], "category string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().total == 2
    W.write_image_errors(spark.createDataFrame([(1, 0.5)], "pair_id long, epe double"), str(tmp_path / "e"))
    W.write_catalog(spark.createDataFrame([("x", "models", "1k", "jpg", "/p")], "asset_id string, kind string, resolution string, format string, path string"), str(tmp_path / "c"))
    assert W.read_chosen(spark, str(tmp_path / "c")).first().path == "/p"
    W.write_curvature(spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.5)], "object_id long, image_id long, mean_curv double"), str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k" / "objects")).first()["mean"] == 1.0


def test_compaction_of_more_rows_takes_more_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("name"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    pairs = rows.select("name", F.lit("trn").alias("split"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for size, n in ((before, [1]), ("200k", range(2, 200))):
            spark.conf.set(key, size)
            D.compact(rows, pairs, str(tmp_path / size), 1)
            assert len(list((tmp_path / size / "split=trn").glob("*.parquet"))) in n
            assert sorted(spark.read.parquet(str(tmp_path / size)).collect()) == sorted(rows.withColumn("split", F.lit("trn")).collect())
    finally:
        spark.conf.set(key, before)


def test_matches_of_many_objects_take_few_files(spark, tmp_path):
    m = spark.range(2000).select((F.col("id") % 500).alias("object_id"), F.col("id").alias("y2"))
    path = str(tmp_path / "m")
    for rows in (m, m.limit(1)):
        W.write_matches(rows, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, m.collect()))
    assert len(list((tmp_path / "m").rglob("*.parquet"))) <= 8
    files = spark.read.parquet(path).select("object_id", F.input_file_name()).distinct()
    assert files.count() == 500


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_streams_agree_with_batch(spark, tmp_path):
    logs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id % 4 run", "event_type benchmark", "event_id epoch", "value", "CAST(ts AS TIMESTAMP) ts").orderBy("epoch")
    logs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with typed_state(spark):
        drain(stream_best(stream), "best")
    assert sorted(map(tuple, spark.table("best").collect())) == sorted(map(tuple, best_so_far(logs).collect()))
    drain(metric_windows(stream, "6 hours", watermark="1 hour"), "windows")
    got, want = ({(r.run, r.benchmark, r.start): r.n for r in d.collect()} for d in (spark.table("windows"), metric_windows(logs, "6 hours")))
    assert got and all(want[k] == n for k, n in got.items())
