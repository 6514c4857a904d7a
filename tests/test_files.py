"""Readers, sinks and the sampler's stream on real files."""

import json

import numpy as np
from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.sinks import writers
from tarmac.sources import config, hashing, readers
from tarmac.streaming import progress

# Own small set: images with several boxes, with one, with none, with an unknown label, with boxes of no width or no height.
DRIVES = {
    "India": {"India_000210.jpg": [("D40", 61, 71, 95, 99), ("D00", 300, 12, 352, 590), ("D40", 410, 420, 470, 455)], "India_000211.jpg": [("D77", 5, 6, 70, 80)], "India_000212.jpg": []},
    "Norway": {"Norway_000031.jpg": [("D20", 100, 350, 480, 560)], "Norway_000032.jpg": [("D00", 40, 222, 90, 222)], "Norway_000033.jpg": [("D10", 77, 30, 77, 44), ("D10", 8, 300, 590, 340)]},
}


def test_annotation_files(spark, tmp_path):
    for country, images in DRIVES.items():
        d = tmp_path / country / "train" / "annotations" / "xmls"
        d.mkdir(parents=True, exist_ok=True)
        for name, boxes in images.items():
            head = "" if name == "India_000211.jpg" else f"<filename>{name}</filename>"  # its name comes from the file's
            body = "".join(f"<object><name>{n}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{e}</ymax></bndbox></object>" for n, a, b, c, e in boxes)
            (d / name.replace(".jpg", ".xml")).write_text(f"<annotation>{head}<size><width>600</width><height>600</height></size>{body}<object><name>no box</name></object></annotation>")
    v = readers.read_voc(spark, str(tmp_path)).withColumn("country", L.country_of_path(F.regexp_replace("path", ".*/test_annotation_files[^/]*/", ""))).cache()
    assert {(r.country, r.filename) for r in v.collect()} == {(c, n) for c, images in DRIVES.items() for n in images}
    m = spark.createDataFrame(sorted(L.LABEL_MAP["rdd2022"].items()), "label string, target string")
    j = v.filter("label is not null").join(m, "label", "left")
    assert [r.label for r in j.filter("target is null").collect()] == ["D77"]
    assert {r.filename for r in j.filter("xmax <= xmin or ymax <= ymin").collect()} == {"Norway_000032.jpg", "Norway_000033.jpg"}
    kept = j.filter("target is not null and xmax > xmin and ymax > ymin").groupBy("filename").count().collect()
    assert {(r.filename, r["count"]) for r in kept} == {("India_000210.jpg", 3), ("Norway_000031.jpg", 1), ("Norway_000033.jpg", 1)}


def test_label_files_round_trip(spark, tmp_path):
    im = spark.createDataFrame([("a", 600, 400), ("b", 100, 100), ("c", 10, 10)], "stem string, width int, height int")
    lab = spark.createDataFrame([("a", 1, 0.5, 0.5, 0.2, 0.1), ("a", 0, 0.1, 0.1, 0.1, 0.1)], "stem string, cls int, cx double, cy double, w double, h double")
    n = writers.write_label_files(writers.label_files(im, lab), str(tmp_path / "labels"))
    assert n == 3 and (tmp_path / "labels" / "b.txt").read_text() == "" and (tmp_path / "labels" / "a.txt").read_text().startswith("0 0.100000")
    (tmp_path / "labels" / "c.txt").write_text("1 2 3\nx 0 0 1 1\n2 0.5 0.5 1 1\n\n")
    got = {(r.stem, r.cls, round(r.x0), round(r.x1)) for r in readers.read_yolo(spark, str(tmp_path / "labels"), im).collect()}
    assert got == {("a", 1, 240, 360), ("a", 0, 30, 90), ("c", 2, 0, 10)}


def test_documents_and_dumps(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 5, "height": 6}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "severity": None}], "categories": [{"id": 2, "name": "x", "supercategory": "s"}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc, indent=1))
    i, a, c = readers.read_coco(spark, str(tmp_path / "coco.json"))
    assert i.first().file_name == "a.jpg" and a.first().bbox == [1, 2, 3, 4] and c.first().name == "x"
    back = writers.coco_document(i.withColumn("k", F.lit(1)), a.withColumn("k", F.lit(1)), c, "k").first()
    assert json.loads(back.document)["annotations"][0]["image_id"] == 1 and json.loads(back.document)["categories"] == doc["categories"]
    d = spark.createDataFrame([("s", [(1, 0.12345678, 1.239, 2.0, 3.0, 4.0)])], "stem string, dets array<struct<cls:int, conf:double, x0:double, y0:double, x1:double, y1:double>>")
    writers.write_dump(d, str(tmp_path / "dump"))
    b = readers.dump_boxes(readers.read_dump(spark, str(tmp_path / "dump"), 5), "dets").first()
    assert (b.cls, b.conf, b.x0) == (1, 0.123457, 1.24)
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "summary.json").write_text('{"run": "r1", "seed": 3}')
    (tmp_path / "runs" / "r2").mkdir()
    (tmp_path / "runs" / "r2" / "summary.json").write_text('{"run": ')
    assert [r.run for r in readers.read_summaries(spark, str(tmp_path / "runs" / "*" / "summary.json"), "run string, seed int").collect()] == ["r1"]
    (tmp_path / "runs" / "r1" / "results.csv").write_text("  epoch ,  time,   metrics/mAP50(B) , other\n 1, 12.5, 0.25, x\n 2, bad, nan?, y\n")
    r = readers.read_results(spark, str(tmp_path / "runs" / "*" / "results.csv")).orderBy("epoch").collect()
    assert (r[0].run, r[0].epoch, r[0].time, r[0].map50, r[1].time, r[1].map50) == ("r1", 1, 12.5, 0.25, None, None)
    (tmp_path / "a.PNG").write_bytes(b"1")
    assert {(x.stem, x.length) for x in readers.read_images(spark, str(tmp_path)).collect()} == {("a", 1)}


def test_listing(spark):
    text = ["D:.", "│   root.txt", "│", "├───Japan", "│   ├───train", "│   │   └───images", "│   │           a.jpg", "│   └───test", "│           b.jpg", "└───Czech", "        c.jpg"]
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "listing string, line_no int, value string")
    got = {r.path for r in readers.listing_paths(df).collect()}
    assert {"Japan/train/images/a.jpg", "Japan/test/b.jpg", "Czech/c.jpg"} <= got


def test_listing_of_any_depth(spark):
    deep = [" " * 0 + "│   " * d + f"├───f{d}" for d in range(40)] + ["│   " * 40 + "    last.jpg", "└───g", "        b.jpg"]
    df = spark.createDataFrame([(k, i, t) for k in "ab" for i, t in enumerate(deep)], "listing string, line_no int, value string")
    got = {(r.listing, r.path) for r in readers.listing_paths(df).collect()}
    assert got == {(k, p) for k in "ab" for p in ("/".join(f"f{d}" for d in range(40)) + "/last.jpg", "g/b.jpg")}


def test_segments_excludes_and_merges(spark):
    a = spark.createDataFrame([(1, 7, "[[0,0,4,0,4,4],[1,1]]"), (2, 7, '{"counts":[3,4],"size":[5,5]}'), (3, 8, '{"counts":"abc"}'), (4, 9, None)], "ann_id int, image_id int, segmentation string")
    polygons, skipped = readers.segment_points(a)
    assert [(r.ann_id, r.part, len(r.points)) for r in polygons.collect()] == [(1, 0, 6)]
    assert {(r.image_id, r.n_run_length) for r in skipped.collect()} == {(7, 1), (8, 1)}
    files = spark.createDataFrame([("a/b.pt",), ("a/b.json",), ("weights/last.pt",), ("x+y.txt",)], "path string")
    assert {r.path for r in writers.write_excluding(files, ["*.pt", "x+?.txt"]).collect()} == {"a/b.json"}
    old = spark.createDataFrame([("r", {"box": "1", "mask": "2"}), ("s", {"box": "3"})], "report string, stages map<string,string>")
    new = spark.createDataFrame([("r", {"mask": "9"}), ("t", {"box": "4"})], "report string, stages map<string,string>")
    assert {r.report: r.stages for r in writers.merged_reports(old, new).collect()} == {"r": {"box": "1", "mask": "9"}, "s": {"box": "3"}, "t": {"box": "4"}}


def test_polygons_and_configuration(spark):
    df = spark.createDataFrame([([0.0, 0.0, 50.0, 10.0, 120.0, -5.0, 7.0],)], "p array<double>")
    assert df.select(readers.polygon_points(F.col("p"), F.lit(100.0), F.lit(10.0)).alias("q")).first().q == [0.0, 0.0, 0.5, 1.0, 1.0, 0.0]
    text = "sources:\n\n  a:\n    format: x\n    label_map:\n      D00: C1  # note\n      \"Block crack\": __IGNORE__\n    notes: >\n      D99: no\n  b:\n    label_map:\n      D00: Z\n"
    assert config.class_map(text, "a") == {"D00": "C1", "Block crack": "__IGNORE__"} and config.class_map(text, "b") == {"D00": "Z"}
    d = config.data_description(writers.data_yaml("/d", {0: "x", 1: "y"}, {"train_sha256": "ab"}))
    assert d["names"] == {0: "x", 1: "y"} and d["val_labels"] == "labels/val" and d["provenance"]["train_sha256"] == "ab"
    assert r"a\_b & 0.500 & --" in writers.latex_table([r.line for r in writers.table_lines(spark.createDataFrame([(2, "z", 1.0), (1, "a_b", None)], "o int, k string, v double"), ["o"], [F.col("k"), F.lit("0.500"), F.col("v")]).orderBy("line_no").collect()], "lrr", ["k", "v", "w"], "c")


def test_hashes_of_images(spark, tmp_path):
    grey = np.tile(np.linspace(255, 0, 90), (80, 1))
    rng = np.random.default_rng(3)
    picture = np.kron(rng.random((8, 8)) * 255, np.ones((40, 40)))
    one = hashing.cosine_hash(picture)
    assert bin(one).count("1") == 32  # half of the frequencies lie above their median
    assert bin(one ^ hashing.cosine_hash(picture * 0.5 + 3)).count("1") <= 2  # darker and flatter: the same picture
    assert bin(one ^ hashing.cosine_hash(picture[::2, ::2])).count("1") <= 2  # half the size
    assert bin(one ^ hashing.cosine_hash(np.kron(rng.random((8, 8)) * 255, np.ones((40, 40))))).count("1") > 12
    # the transform against its definition
    x = hashing.reduced(picture)
    k, l = 3, 5
    want = 4 * sum(x[i, j] * np.cos(np.pi * k * (2 * i + 1) / 64) * np.cos(np.pi * l * (2 * j + 1) / 64) for i in range(32) for j in range(32))
    c = hashing._cosines(32)
    assert abs((c @ x @ c.T)[k, l] - want) < 1e-6
    (tmp_path / "a.bin").write_bytes(grey.astype("u1").tobytes())
    (tmp_path / "b.bin").write_bytes(b"xx")
    got = {r.path[-5:]: r.b0 for r in hashing.hashes(spark, str(tmp_path), lambda d: np.frombuffer(d, "u1").reshape(80, 90).astype(float)).collect()}
    assert got == {"a.bin": hashing.cosine_hash(grey.astype("u1").astype(float)) & 0xFFFF, "b.bin": None}


def test_sampler_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda t, run, u: json.dumps({"t": f"2024-01-01T00:0{t}:00Z", "run": run, "gpu_util": u})
    (src / "1.json").write_text("\n".join([line(0, "a", 0), line(1, "a", 3), "{bad", line(0, "b", 90)]))
    q = progress.append_to(progress.samples(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    (src / "2.json").write_text("\n".join([line(2, "a", 0), line(1, "b", 1)]))
    q = progress.append_to(progress.samples(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "samples")).count() == 5
    w = progress.idle_watch(progress.samples(spark, str(src)), 3).writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    rows = spark.sql("select run, streak, stop from idle order by run, t").collect()
    assert [tuple(r) for r in rows] == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 0, False), ("b", 1, False)]
