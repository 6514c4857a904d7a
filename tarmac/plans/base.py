"""Input tables of the core queries: cleaned annotation tables, and tables derived by integer formulas.

Each has a DataFrame and, as a list of common table expressions, the SQL that means the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.session import table

SIDES = {0: (512, 512), 1: (600, 600), 2: (640, 640), 3: (720, 720), 4: (3650, 2044), 5: (4040, 2035)}


def images(spark, sf):
    """Repeated rows once: image_id, file_name, width, height, source_dataset, country, view, split_hint, rel_path."""
    cols = ("file_name", "width", "height", "source_dataset", "country", "view", "split_hint", "rel_path")
    return table(spark, sf, "images").groupBy(F.col("id").alias("image_id")).agg(F.max_by(F.struct(*cols), "ingested_at").alias("r")).select("image_id", "r.*")


def annotations(spark, sf):
    """Repeated rows once, boxes as x, y, w, h."""
    cols = ("image_id", "category_id", "bbox", "area", "iscrowd", "orig_class", "severity", "source_dataset", "country", "object_uid")
    a = table(spark, sf, "annotations").groupBy(F.col("id").alias("ann_id")).agg(F.max_by(F.struct(*cols), "updated_at").alias("r")).select("ann_id", "r.*")
    return a.withColumns({k: F.get("bbox", i) for i, k in enumerate("xywh")})


def one_row(a, b):
    """Two one-row results as one row, without a join."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def split_name(c):
    h = F.lower(F.trim(c))
    return F.when(h.isin("train", "training"), "train").when(h.isin("val", "valid", "validation"), "val").when(h.isin("test", "testing"), "test")


def d_images(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    side = lambda k: F.element_at(F.array(*(F.lit(SIDES[i][k]) for i in range(6))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return j.select(F.col("o_orderkey").alias("image_id"), F.col("n_name").alias("country"), F.concat("n_name", F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("stem"), side(0).alias("width"), side(1).alias("height"))


ID = (("orderkey", 10), ("linenumber", 2), ("partkey", 8), ("suppkey", 8))


def _id(prefix=""):
    return F.concat_ws("-", *(F.lpad(F.col(f"l_{k}").cast("string"), n, "0") for k, n in ID))


def number_id():
    """What follows the order key in `_id`, as one number of the same order: it cuts what is too wide, as lpad does."""
    part = lambda k, n: F.when(F.col(k) < 10**n, F.col(k).cast("bigint")).otherwise(F.substring(F.col(k).cast("string"), 1, n).cast("bigint"))
    return part("l_linenumber", 2) * F.lit(10**16) + part("l_partkey", 8) * F.lit(10**8) + part("l_suppkey", 8)


def named_id(order, rest):
    """`_id` again, of the order key and `number_id`."""
    text = F.lpad(rest.cast("string"), 18, "0")
    return F.concat(F.lpad(order.cast("string"), 10, "0"), F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 3, 8), F.lit("-"), F.substring(text, 11, 8))


def d_annotations(spark, sf, more=(), parts=0):
    """parts: lays the rows out by image in so many tasks, however many the session would take."""
    li = table(spark, sf, "lineitem")
    im = d_images(spark, sf).select("image_id", "width", "height", *more)
    if parts:
        li = li.select(*(f"l_{k}" for k in ("orderkey", "linenumber", "partkey", "suppkey")), F.col("l_quantity").cast("bigint").alias("l_quantity")).repartition(parts, "l_orderkey")
        im = im.repartition(parts, "image_id").hint("shuffle_hash")
    x0 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 211) % F.col("width")
    y0 = (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % F.col("height")
    q = F.col("l_quantity").cast("bigint")
    j = li.join(im, li.l_orderkey == im.image_id)
    return j.select(
        *more, "image_id", "width", "height", _id().alias("gt_id"), (F.col("l_partkey") % 6).cast("int").alias("cls"), (F.col("l_partkey") % 12).cast("int").alias("label_ix"),
        x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), F.least(F.col("width"), x0 + q * 4).cast("long").alias("x1"), F.least(F.col("height"), y0 + q * 3).cast("long").alias("y1"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def detected():
    """Whether an annotation has a detection, and that one's columns."""
    conf = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 100003) / F.lit(100003.0)
    cls = F.when(F.col("l_suppkey") % 17 == 0, (F.col("cls") + 1) % 6).otherwise(F.col("cls"))
    sides = {k: (F.col(k) + F.col("l_suppkey") % m - s).cast("long") for k, m, s in (("x0", 9, 4), ("y0", 7, 3), ("x1", 5, 2), ("y1", 11, 5))}
    return F.expr("l_linenumber <> 7 and x1 - x0 > 4 and y1 - y0 > 8"), {"cls": cls, "conf": conf} | sides


def d_detections(spark, sf):
    found, columns = detected()
    return d_annotations(spark, sf).filter(found).select("image_id", "width", "height", F.col("gt_id").alias("pred_id"), *(c.alias(k) for k, c in columns.items()))


def d_hash(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 3).cast("long").alias("base"), (F.col("o_orderkey") % 3).alias("member"))
    flip = lambda i: F.when(F.col("member") == 1, F.lit(1 if i == 0 else 0)).when(F.col("member") == 2, F.lit(2)).otherwise(F.lit(0))
    band = lambda i, m, k: ((F.col("base") * m + k) % 65536).cast("int").bitwiseXOR(flip(i)).alias(f"b{i}")
    return o.select(F.col("o_orderkey").alias("image_id"), F.when(F.col("base") % 10 == 0, F.col("o_orderkey") % 25).otherwise(F.col("base") % 25).cast("int").alias("country_id"),
                    band(0, 40503, 11), band(1, 30011, 7), band(2, 52711, 3), band(3, 61979, 5))


def label_map(spark, source="rdd2022"):
    return spark.createDataFrame(sorted(L.LABEL_MAP[source].items()), "label string, target string")


def classes(spark):
    return spark.createDataFrame(L.CLASSES, "class_id int, name string, expected int")


LABELS = sorted(L.LABEL_MAP["rdd2022"])
VALUES = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)

CTE = {
    "im": "im AS (SELECT id AS image_id, max_by(struct_pack(file_name := file_name, width := width, height := height, source_dataset := source_dataset, country := country, view := view, split_hint := split_hint, rel_path := rel_path), ingested_at) AS r FROM images GROUP BY id), "
    "i AS (SELECT image_id, r.file_name AS file_name, r.width AS width, r.height AS height, r.source_dataset AS source_dataset, r.country AS country, r.view AS view, r.split_hint AS split_hint, r.rel_path AS rel_path FROM im)",
    "an": "an AS (SELECT id AS ann_id, any_value(image_id) AS image_id, any_value(category_id) AS category_id, any_value(bbox) AS bbox, any_value(area) AS area, any_value(iscrowd) AS iscrowd, any_value(orig_class) AS orig_class, any_value(severity) AS severity, any_value(country) AS country FROM annotations GROUP BY id), "
    "a AS (SELECT *, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, bbox[4] AS h FROM an)",
    "split": "sp AS (SELECT image_id, CASE WHEN lower(trim(split_hint)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split_hint)) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(trim(split_hint)) IN ('test', 'testing') THEN 'test' END AS split FROM i)",
    "lm": f"lm(label, target) AS (VALUES {VALUES(sorted(L.LABEL_MAP['rdd2022'].items()))})",
    "cl": f"cl(class_id, name, expected) AS (VALUES {VALUES(L.CLASSES)})",
    "di": "di AS (SELECT o_orderkey AS image_id, n_name AS country, concat(n_name, '_', lpad(CAST(o_orderkey AS VARCHAR), 6, '0')) AS stem, "
    + "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {s[0]}" for i, s in SIDES.items()) + " END AS width, "
    + "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {s[1]}" for i, s in SIDES.items()) + " END AS height "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "da": "da0 AS (SELECT di.*, l.*, concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 10, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), lpad(CAST(l_partkey AS VARCHAR), 8, '0'), lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS gt_id, "
    "(l_partkey * 37 + l_linenumber * 211) % width AS x0, (l_suppkey * 53 + l_linenumber * 97) % height AS y0 FROM lineitem l JOIN di ON l_orderkey = image_id), "
    "da AS (SELECT image_id, country, stem, width, height, gt_id, CAST(l_partkey % 6 AS INTEGER) AS cls, CAST(l_partkey % 12 AS INTEGER) AS label_ix, x0, y0, least(width, x0 + CAST(l_quantity AS BIGINT) * 4) AS x1, least(height, y0 + CAST(l_quantity AS BIGINT) * 3) AS y1, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM da0)",
    "dd": "dd AS (SELECT image_id, country, stem, width, height, gt_id AS pred_id, CASE WHEN l_suppkey % 17 = 0 THEN (cls + 1) % 6 ELSE cls END AS cls, "
    "CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17) % 100003 AS DOUBLE) / 100003.0 AS conf, "
    "x0 + l_suppkey % 9 - 4 AS x0, y0 + l_suppkey % 7 - 3 AS y0, x1 + l_suppkey % 5 - 2 AS x1, y1 + l_suppkey % 11 - 5 AS y1 FROM da WHERE l_linenumber <> 7 AND x1 - x0 > 4 AND y1 - y0 > 8)",
    "dh": "dh0 AS (SELECT o_orderkey, o_orderkey // 3 AS base, o_orderkey % 3 AS member FROM orders), "
    "dh AS (SELECT o_orderkey AS image_id, CAST(CASE WHEN base % 10 = 0 THEN o_orderkey % 25 ELSE base % 25 END AS INTEGER) AS country_id, "
    + ", ".join(f"xor(CAST((base * {m} + {k}) % 65536 AS INTEGER), CASE member WHEN 1 THEN {1 if i == 0 else 0} WHEN 2 THEN 2 ELSE 0 END) AS b{i}" for i, (m, k) in enumerate(((40503, 11), (30011, 7), (52711, 3), (61979, 5))))
    + " FROM dh0)",
}


def sql(parts: str, body: str, recursive: bool = False) -> str:
    """A query over the named table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(CTE[p] for p in parts.split()) + " " + body
