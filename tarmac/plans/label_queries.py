"""Scans, label mapping, filters, joins and counts over the annotation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.operators import gates, splits
from tarmac.operators.components import numbered
from tarmac.plans.base import annotations, classes, images, label_map, one_row, split_name, sql
from tarmac.session import table
from tarmac.sinks import writers
from tarmac.sources import readers

QUERIES, SQL = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def labelled(spark, sf):
    """Annotations with their target class; status unknown, ignored or kept."""
    a = annotations(spark, sf)
    j = a.join(F.broadcast(label_map(spark)), F.upper(a.orig_class) == F.col("label"), "left")
    return j.withColumn("status", F.when(F.col("target").isNull(), "unknown").when(F.col("target") == L.IGNORE, "ignored").otherwise("kept"))


LAB = "lb AS (SELECT a.*, target, CASE WHEN target IS NULL THEN 'unknown' WHEN target = '__IGNORE__' THEN 'ignored' ELSE 'kept' END AS status FROM a LEFT JOIN lm ON upper(orig_class) = label)"
SIZED = "bx AS (SELECT a.*, i.width, i.height, greatest(0.0, least(a.x, CAST(i.width AS DOUBLE))) AS x0, greatest(0.0, least(a.y, CAST(i.height AS DOUBLE))) AS y0, greatest(0.0, least(a.x + a.w, CAST(i.width AS DOUBLE))) AS x1, greatest(0.0, least(a.y + a.h, CAST(i.height AS DOUBLE))) AS y1 FROM a JOIN i USING (image_id) WHERE i.width > 0 AND i.height > 0 AND a.w > 0 AND a.h > 0)"


@query(sql("im an lm", f", {LAB} SELECT target, status, count(*) AS n FROM lb GROUP BY ALL").replace(" , ", ", "))
def f1_label_map(spark, sf):
    return labelled(spark, sf).groupBy("target", "status").agg(F.count("*").alias("n"))


def clamped(spark, sf):
    """Boxes of sized images: degenerate ones out, clamped, degenerate ones out again."""
    i = images(spark, sf).filter("width > 0 and height > 0").select("image_id", "width", "height")
    a = annotations(spark, sf).filter("w > 0 and h > 0").join(i, "image_id")
    c = lambda v, hi: F.greatest(F.lit(0.0), F.least(v, F.col(hi).cast("double")))
    return a.withColumns({"x0": c(F.col("x"), "width"), "y0": c(F.col("y"), "height"), "x1": c(F.col("x") + F.col("w"), "width"), "y1": c(F.col("y") + F.col("h"), "height")})


@query(sql("im an", f", {SIZED} SELECT (SELECT count(*) FROM a) AS n_all, (SELECT count(*) FROM a WHERE w IS NULL OR h IS NULL OR w <= 0 OR h <= 0) AS n_degenerate, (SELECT count(*) FROM bx) AS n_sized, (SELECT count(*) FROM bx WHERE x1 <= x0 OR y1 <= y0) AS n_degenerate_after"))
def f2_degenerate_boxes(spark, sf):
    a, b = annotations(spark, sf), clamped(spark, sf)
    before = a.agg(F.count("*").alias("n_all"), F.count_if(F.expr("w is null or h is null or w <= 0 or h <= 0")).alias("n_degenerate"))
    after = b.agg(F.count("*").alias("n_sized"), F.count_if(F.expr("x1 <= x0 or y1 <= y0")).alias("n_degenerate_after"))
    return one_row(before, after)


@query(sql("im an", f", {SIZED} SELECT ann_id, x0, y0, x1, y1 FROM bx WHERE x1 > x0 AND y1 > y0"))
def f3_clamp(spark, sf):
    return clamped(spark, sf).filter("x1 > x0 and y1 > y0").select("ann_id", "x0", "y0", "x1", "y1")


@query(sql("im an", f", {SIZED} SELECT ann_id, round(x0, 2) AS bx, round(y0, 2) AS by, round(x1 - x0, 2) AS bw, round(y1 - y0, 2) AS bh, (x1 - x0) * (y1 - y0) AS box_area FROM bx WHERE x1 > x0 AND y1 > y0"))
def f4_to_xywh(spark, sf):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return clamped(spark, sf).filter("x1 > x0 and y1 > y0").select("ann_id", F.round("x0", 2).alias("bx"), F.round("y0", 2).alias("by"), F.round(w, 2).alias("bw"), F.round(h, 2).alias("bh"), (w * h).alias("box_area"))


@query(sql("im", "SELECT image_id, CASE WHEN contains(lower(country), 'drone') THEN 'topdown' ELSE 'forward' END AS view_by_country FROM i"))
def f5_view_of_country(spark, sf):
    return images(spark, sf).select("image_id", L.view_of(F.col("country")).alias("view_by_country"))


@query(sql("im", """, q AS (SELECT image_id, list_filter(string_split(rel_path, '/'), lambda x: x NOT IN ('', '.')) AS p FROM i),
r AS (SELECT *, list_transform(p, lambda x: lower(x)) AS l FROM q)
SELECT image_id, coalesce(CASE WHEN list_position(l, 'train') > 1 THEN p[list_position(l, 'train') - 1] END, CASE WHEN list_position(l, 'test') > 1 THEN p[list_position(l, 'test') - 1] END,
  list_filter(p[:-2], lambda x: lower(x) NOT IN ('images', 'annotations', 'xmls'))[-1], 'unknown') AS path_country FROM r"""))
def f6_country_of_path(spark, sf):
    return images(spark, sf).select("image_id", F.coalesce(L.country_of_path(F.col("rel_path")), F.lit("unknown")).alias("path_country"))


@query(sql("im an", "SELECT count(*) AS n_without_image FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.image_id = a.image_id)"))
def f7_missing_images(spark, sf):
    return annotations(spark, sf).join(images(spark, sf).select("image_id"), "image_id", "left_anti").agg(F.count("*").alias("n_without_image"))


@query(sql("im", "SELECT image_id FROM i WHERE coalesce(view, '') <> 'topdown' AND image_id NOT IN (SELECT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY file_name ORDER BY image_id) AS k FROM i WHERE file_name IS NOT NULL) WHERE k > 1)"))
def f8_exclude(spark, sf):
    """Images less a drop list and an excluded view. The drop list here: all but the first image of a file name."""
    i = images(spark, sf)
    first = i.filter("file_name is not null").groupBy("file_name").agg(F.min("image_id").alias("first"))
    drop = i.join(first, "file_name").filter("image_id <> first").select("image_id")
    return i.filter(F.coalesce("view", F.lit("")) != "topdown").join(drop, "image_id", "left_anti").select("image_id")


@query(sql("im an cl", "SELECT name, count(*) AS n FROM a JOIN cl ON category_id = class_id WHERE name IN ('C4_pothole', 'C1_longitudinal_crack') GROUP BY name"))
def f9_wanted_classes(spark, sf):
    wanted = spark.createDataFrame([("C4_pothole",), ("C1_longitudinal_crack",)], "name string")
    known = classes(spark)
    gates.enforce(wanted.join(known, "name", "left_anti"), "unknown classes")
    a = annotations(spark, sf)
    return a.join(F.broadcast(known.join(wanted, "name")), a.category_id == F.col("class_id")).groupBy("name").agg(F.count("*").alias("n"))


@query(sql("im an cl split", "SELECT name, EXISTS (SELECT 1 FROM a JOIN sp USING (image_id) WHERE split = 'val' AND category_id = class_id) AS in_val, EXISTS (SELECT 1 FROM a WHERE category_id = class_id) AS anywhere FROM cl"))
def f10_class_presence(spark, sf):
    """Presence of classes within a split and over all annotations; empty ones are dropped by either scope."""
    a = annotations(spark, sf).filter("category_id is not null")
    sp = images(spark, sf).select("image_id", split_name(F.col("split_hint")).alias("split")).filter("split = 'val'")
    val = a.join(sp, "image_id", "left_semi").select("category_id").distinct().withColumn("v", F.lit(True))
    every = a.select("category_id").distinct().withColumn("e", F.lit(True))
    c = classes(spark)
    j = c.join(val.withColumnRenamed("category_id", "class_id"), "class_id", "left").join(every.withColumnRenamed("category_id", "class_id"), "class_id", "left")
    return j.select("name", F.coalesce("v", F.lit(False)).alias("in_val"), F.coalesce("e", F.lit(False)).alias("anywhere"))


@query(sql("im an", "SELECT category_id, CAST(dense_rank() OVER (ORDER BY category_id) - 1 AS INTEGER) AS dense_id FROM (SELECT DISTINCT category_id FROM a WHERE category_id IN (SELECT id FROM categories WHERE supercategory = 'surface'))"))
def f11_dense_ids(spark, sf):
    """Dense ids of the kept classes (here those of the surface that occur); the window holds one row per class."""
    kept = table(spark, sf, "categories").filter("supercategory = 'surface'").select(F.col("id").alias("category_id"))
    c = annotations(spark, sf).select("category_id").distinct().join(kept, "category_id", "left_semi")
    return c.withColumn("dense_id", (F.dense_rank().over(Window.orderBy("category_id")) - 1).cast("int"))


NORM = "nm AS (SELECT a.ann_id, a.image_id, a.category_id AS cls, (a.x + a.w / 2) / i.width AS cx, (a.y + a.h / 2) / i.height AS cy, a.w / i.width AS nw, a.h / i.height AS nh FROM a JOIN i USING (image_id) WHERE i.width > 0 AND i.height > 0)"


def normalised(spark, sf):
    i = images(spark, sf).filter("width > 0 and height > 0").select("image_id", "width", "height")
    a = annotations(spark, sf).join(i, "image_id")
    return a.select("ann_id", "image_id", F.col("category_id").alias("cls"), ((F.col("x") + F.col("w") / 2) / F.col("width")).alias("cx"), ((F.col("y") + F.col("h") / 2) / F.col("height")).alias("cy"), (F.col("w") / F.col("width")).alias("nw"), (F.col("h") / F.col("height")).alias("nh"))


@query(sql("im an", f", {NORM} SELECT ann_id, cls, least(1.0, greatest(0.0, cx)) AS cx, least(1.0, greatest(0.0, cy)) AS cy, least(1.0, nw) AS w, least(1.0, nh) AS h, (cx < 0 OR cx > 1 OR cy < 0 OR cy > 1 OR nw > 1 OR nh > 1) AS clipped FROM nm WHERE nw > 0 AND nh > 0"))
def f12_normalise(spark, sf):
    n = normalised(spark, sf).filter("nw > 0 and nh > 0")
    c = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(k)))
    return n.select("ann_id", "cls", c("cx").alias("cx"), c("cy").alias("cy"), c("nw").alias("w"), c("nh").alias("h"), F.expr("cx < 0 or cx > 1 or cy < 0 or cy > 1 or nw > 1 or nh > 1").alias("clipped"))


@query(sql("im", "SELECT count(*) AS n, count(*) FILTER (width IS NULL OR height IS NULL OR width <= 0 OR height <= 0) AS n_unsized FROM i"))
def f15_unsized_images(spark, sf):
    return images(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.expr("width is null or height is null or width <= 0 or height <= 0")).alias("n_unsized"))


@query(sql("im", "SELECT image_id, TRY_CAST(nullif(regexp_extract(file_name, '_(\\d+)\\.', 1), '') AS BIGINT) AS seq FROM i"))
def f19_sequence_number(spark, sf):
    return images(spark, sf).select("image_id", L.sequence_of(F.col("file_name")).alias("seq"))


@query(sql("im", ", n AS (SELECT concat_ws('__', lower(source_dataset), regexp_replace(regexp_replace(file_name, '^.*/', ''), '\\.[^.]*$', '')) AS written_name FROM i WHERE file_name IS NOT NULL) SELECT written_name, count(*) AS n_sources FROM n GROUP BY 1"))
def f22_unique_names(spark, sf):
    """Names written as dataset__stem, and how many images each would stand for: more than one is a collision."""
    i = images(spark, sf).filter("file_name is not null").select(F.concat_ws("__", F.lower("source_dataset"), L.stem_of(F.col("file_name"))).alias("written_name"))
    return i.groupBy("written_name").agg(F.count("*").alias("n_sources"))


@query(sql("im an", "SELECT image_id FROM i WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = i.image_id AND category_id IS NOT NULL)"))
def f24_negative_images(spark, sf):
    return images(spark, sf).select("image_id").join(annotations(spark, sf).filter("category_id is not null").select("image_id"), "image_id", "left_anti")


@query(sql("im an", "SELECT image_id, file_name FROM i WHERE EXISTS (SELECT 1 FROM a WHERE a.image_id = i.image_id AND category_id = 3)"))
def f25_images_of_class(spark, sf):
    return images(spark, sf).select("image_id", "file_name").join(annotations(spark, sf).filter("category_id = 3").select("image_id"), "image_id", "left_semi")


@query(sql("im", "SELECT country, count(*) AS n, CASE WHEN count(*) < 10 THEN 'skipped: fewer than 10 images' ELSE 'scored' END AS state FROM i GROUP BY country"))
def f26_small_countries(spark, sf):
    g = images(spark, sf).groupBy("country").agg(F.count("*").alias("n"))
    return g.withColumn("state", F.when(F.col("n") < 10, "skipped: fewer than 10 images").otherwise("scored"))


@query(sql("im an", "SELECT i.image_id, count(a.ann_id) AS n_boxes, coalesce(round(sum(a.area), 2), 0) AS total_area FROM i LEFT JOIN a USING (image_id) GROUP BY i.image_id"))
def j1_annotations_per_image(spark, sf):
    per = annotations(spark, sf).groupBy("image_id").agg(F.count("*").alias("n_boxes"), F.sum("area").alias("s"))
    return images(spark, sf).select("image_id").join(per, "image_id", "left").select("image_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("total_area"))


@query(sql("im an split", "SELECT count(*) AS n_images, count(*) FILTER (split IS NULL) AS n_no_split, (SELECT count(DISTINCT image_id) FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.image_id = a.image_id)) AS n_dangling FROM sp"))
def j3_split_membership(spark, sf):
    i = images(spark, sf)
    n = i.agg(F.count("*").alias("n_images"), F.count_if(split_name(F.col("split_hint")).isNull()).alias("n_no_split"))
    d = annotations(spark, sf).select("image_id").filter("image_id is not null").distinct().join(i.select("image_id"), "image_id", "left_anti").agg(F.count("*").alias("n_dangling"))
    return one_row(n, d)


@query(sql("im an cl lm", f", {LAB} SELECT name, i.country, count(*) AS n FROM lb JOIN cl ON target = name JOIN i ON i.image_id = lb.image_id GROUP BY ALL"))
def a1_boxes_per_class_country(spark, sf):
    a = labelled(spark, sf).filter("status = 'kept'").select("image_id", F.col("target").alias("name"))
    return a.join(images(spark, sf).select("image_id", "country"), "image_id").groupBy("name", "country").agg(F.count("*").alias("n"))


@query(sql("im an cl", "SELECT name, count(ann_id) AS n, expected, count(ann_id) / expected AS share FROM cl LEFT JOIN a ON category_id = class_id GROUP BY name, expected"))
def a1_against_expected(spark, sf):
    n = annotations(spark, sf).groupBy(F.col("category_id").alias("class_id")).agg(F.count("*").alias("n"))
    return classes(spark).join(n, "class_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) / F.col("expected")).alias("share"))


@query(sql("im an", "SELECT count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = i.image_id)) AS n_unlabelled, round(100.0 * count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = i.image_id)) / greatest(count(*), 1), 6) AS pct FROM i"))
def a2_unlabelled_images(spark, sf):
    has = annotations(spark, sf).select("image_id").distinct().withColumn("has", F.lit(True))
    g = images(spark, sf).select("image_id").join(has, "image_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("n_unlabelled"))
    return g.withColumn("pct", F.round(100.0 * F.col("n_unlabelled") / F.greatest("n", F.lit(1)), 6))


@query(sql("im split", "SELECT country, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, round(100.0 * count(*) FILTER (split = 'val') / greatest(count(*), 1), 6) AS val_pct FROM i JOIN sp USING (image_id) GROUP BY country"))
def a6_split_per_country(spark, sf):
    i = images(spark, sf).withColumn("split", split_name(F.col("split_hint")))
    g = i.groupBy("country").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"), F.count("*").alias("n"))
    return g.select("country", "n_train", "n_val", F.round(100.0 * F.col("n_val") / F.greatest("n", F.lit(1)), 6).alias("val_pct"))


@query(sql("im an split cl", "SELECT name, count(ann_id) FILTER (split = 'train') AS train, count(ann_id) FILTER (split = 'val') AS val, count(ann_id) FILTER (split = 'test') AS test FROM a JOIN sp USING (image_id) JOIN cl ON class_id = category_id GROUP BY name"))
def a7_class_counts_pivot(spark, sf):
    i = images(spark, sf).select("image_id", split_name(F.col("split_hint")).alias("split"))
    a = annotations(spark, sf).select("image_id", F.col("category_id").alias("class_id")).join(i, "image_id").join(F.broadcast(classes(spark)), "class_id")
    return a.groupBy("name").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).fillna(0)


@query(sql("im split", "SELECT split, count(*) AS n, sha256(string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY image_id)) AS sha256 FROM sp WHERE split IS NOT NULL GROUP BY split"))
def a8_split_hashes(spark, sf):
    i = images(spark, sf).select(F.col("image_id").alias("id"), split_name(F.col("split_hint")).alias("split"))
    return splits.id_hashes(i, "split")


@query(sql("im", "SELECT country, count(*) AS n, sha256(string_agg(file_name || chr(10), '' ORDER BY file_name)) AS sha256 FROM i WHERE file_name IS NOT NULL AND country IS NOT NULL GROUP BY country"))
def a9_name_hashes(spark, sf):
    return splits.name_hashes(images(spark, sf), "country", "file_name")


@query(sql("im", "SELECT country, view, count(*) AS n FROM i GROUP BY ALL"))
def a29_country_view(spark, sf):
    return images(spark, sf).groupBy("country", "view").agg(F.count("*").alias("n"))


@query(sql("im an lm", f", {LAB} SELECT orig_class AS label, count(*) AS n FROM lb WHERE status = 'unknown' AND orig_class IS NOT NULL GROUP BY orig_class"))
def q1_unknown_labels(spark, sf):
    return labelled(spark, sf).filter("status = 'unknown' and orig_class is not null").groupBy(F.col("orig_class").alias("label")).agg(F.count("*").alias("n"))


@query(sql("im", "SELECT regexp_replace(regexp_replace(file_name, '^.*/', ''), '\\.[^.]*$', '') AS written_name, count(*) AS n FROM i WHERE file_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
def q7_name_collisions(spark, sf):
    i = images(spark, sf).filter("file_name is not null").select(L.stem_of(F.col("file_name")).alias("written_name"))
    return gates.name_collisions(i)


@query(sql("im", "SELECT rel_path, CAST(row_number() OVER (ORDER BY rel_path, image_id) - 1 AS BIGINT) AS new_id, image_id FROM i WHERE rel_path IS NOT NULL"))
def w19_ids_in_path_order(spark, sf):
    return numbered(images(spark, sf).filter("rel_path is not null").select("rel_path", "image_id"), ["rel_path", "image_id"], "new_id", 0)


@query(sql("im", "SELECT image_id, CASE WHEN row_number() OVER (PARTITION BY country ORDER BY file_name, image_id) > count(*) OVER (PARTITION BY country) - greatest(1, CAST(round_even(count(*) OVER (PARTITION BY country) * 0.2, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM i WHERE file_name IS NOT NULL AND country IS NOT NULL"))
def w17_tail_split(spark, sf):
    i = images(spark, sf).filter("file_name is not null and country is not null").select("country", "image_id", F.struct("file_name", "image_id").alias("name"))
    return splits.tail_split(i, "country", 0.2).select("image_id", "split")


@query(sql("im an", "SELECT orig_class, count(*) AS n FROM a WHERE orig_class IS NOT NULL GROUP BY orig_class ORDER BY n DESC, orig_class LIMIT 5"))
def t3_most_common_labels(spark, sf):
    return annotations(spark, sf).filter("orig_class is not null").groupBy("orig_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "orig_class").limit(5)


@query(sql("im an", "SELECT image_id FROM i UNION SELECT image_id FROM a WHERE image_id IS NOT NULL"))
def u1_all_ids(spark, sf):
    return images(spark, sf).select("image_id").union(annotations(spark, sf).filter("image_id is not null").select("image_id")).distinct()


@query("SELECT DISTINCT orig_class FROM annotations EXCEPT SELECT DISTINCT upper(orig_class) FROM annotations")
def u2_respelled_labels(spark, sf):
    a = table(spark, sf, "annotations")
    return a.select("orig_class").distinct().subtract(a.select(F.upper("orig_class").alias("orig_class")).distinct())


@query(sql("im an", "SELECT image_id FROM i WHERE view = 'street' INTERSECT SELECT image_id FROM a WHERE category_id = 0"))
def u3_eligible(spark, sf):
    return images(spark, sf).filter("view = 'street'").select("image_id").intersect(annotations(spark, sf).filter("category_id = 0").select("image_id"))


@query(sql("im an", "SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, 0) AS n_low, coalesce(y.n, 0) AS n_high FROM (SELECT category_id AS k, count(*) AS n FROM a WHERE severity = 'low' AND category_id IS NOT NULL GROUP BY 1) x FULL JOIN (SELECT category_id AS k, count(*) AS n FROM a WHERE severity = 'high' AND category_id IS NOT NULL GROUP BY 1) y ON x.k = y.k"))
def u5_key_union(spark, sf):
    a = annotations(spark, sf).filter("category_id is not null")
    side = lambda s, n: a.filter(F.col("severity") == s).groupBy(F.col("category_id").alias("k")).agg(F.count("*").alias(n))
    return side("low", "n_low").join(side("high", "n_high"), "k", "full").fillna(0, ["n_low", "n_high"])


@query(sql("im an", "SELECT ann_id, category_id AS cls, (x + w / 2) / width AS cx FROM a JOIN i USING (image_id) WHERE width > 0 AND height > 0 AND category_id IS NOT NULL AND w > 0 AND h > 0").replace("(x + w / 2) / width AS cx", "round(x, 2) AS x0, round(y, 2) AS y0, round(x + w, 2) AS x1, round(y + h, 2) AS y1"))
def sc6_yolo_round_trip(spark, sf):
    """Boxes written as label lines with enough digits and read back by the line reader."""
    n = normalised(spark, sf).filter("cls is not null and nw > 0 and nh > 0")
    i = images(spark, sf).select("image_id", "width", "height")
    line = F.format_string("%d %.12f %.12f %.12f %.12f", "cls", "cx", "cy", "nw", "nh")
    back = readers.yolo_boxes(n.join(i, "image_id").select("ann_id", line.alias("value"), "width", "height"))
    return back.select("ann_id", "cls", *(F.round(k, 2).alias(k) for k in ("x0", "y0", "x1", "y1")))


@query(sql("im an", "SELECT a.ann_id, trim(file_name) AS file_name, trim(orig_class) AS label, round(x, 2) AS xmin, round(y, 2) AS ymin FROM a JOIN i USING (image_id) WHERE a.image_id <> 1 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND orig_class IS NOT NULL AND file_name IS NOT NULL").replace("a.image_id <> 1 AND ", ""))
def sc2_voc_round_trip(spark, sf):
    """Annotations written as one VOC document per box and read back by the document parser."""
    a = annotations(spark, sf).join(images(spark, sf).select("image_id", "file_name", "width", "height"), "image_id").filter("file_name is not null")
    doc = F.format_string(
        "<annotation><filename>%s</filename><size><width>%d</width><height>%d</height></size><object><name>%s</name><bndbox><xmin>%.2f</xmin><ymin>%.2f</ymin><xmax>%.2f</xmax><ymax>%.2f</ymax></bndbox></object></annotation>",
        "file_name", F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)), "orig_class", "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    ok = a.filter("x is not null and y is not null and w is not null and h is not null and orig_class is not null")
    v = readers.voc_objects(ok.select(F.col("ann_id").cast("string").alias("path"), F.from_xml(doc, readers.VOC, {"rowTag": "annotation"}).alias("v")))
    return v.select(F.col("path").cast("long").alias("ann_id"), F.col("filename").alias("file_name"), "label", F.round("xmin", 2).alias("xmin"), F.round("ymin", 2).alias("ymin"))


@query(sql("im an", "SELECT ann_id, image_id, category_id, round(x, 2) AS x, iscrowd FROM a WHERE image_id IS NOT NULL"))
def sc3_coco_round_trip(spark, sf):
    """Annotations written as COCO documents of bounded shards and read back."""
    a = annotations(spark, sf).filter("image_id is not null").withColumn("shard", F.floor(F.col("ann_id") / 500))
    doc = a.groupBy("shard").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", "bbox", "iscrowd")).alias("annotations"))).alias("d"))
    _, back, _ = readers.coco_parts(doc, F.from_json("d", readers.COCO))
    return back.select(F.col("id").alias("ann_id"), "image_id", "category_id", F.round(F.get("bbox", 0), 2).alias("x"), "iscrowd")


@query(sql("im an", f", {NORM} SELECT i.image_id, count(ok.image_id) AS n_lines, count(ok.image_id) = 0 AS is_negative FROM i LEFT JOIN (SELECT image_id FROM nm WHERE cls IS NOT NULL AND nw > 0 AND nh > 0) ok USING (image_id) WHERE i.image_id <> 1 GROUP BY i.image_id").replace(" WHERE i.image_id <> 1", ""))
def sk4_label_files(spark, sf):
    """Label files of all images; the empty ones are negatives. Lines are counted from the written text."""
    n = normalised(spark, sf).filter("cls is not null and nw > 0 and nh > 0").select("image_id", "cls", "cx", "cy", F.col("nw").alias("w"), F.col("nh").alias("h"))
    f = writers.label_files(images(spark, sf), n, "image_id")
    return f.select("image_id", F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n"))).cast("long").alias("n_lines"), (F.col("content") == "").alias("is_negative"))
