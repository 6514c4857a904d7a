"""Queries over the reports and images of the test tables: manifests, provenance, per-class figures, cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.operators import curves, gates, matching, tiling
from tarmac.plans.base import annotations, images, split_name, sql
from tarmac.plans.detection_queries import CLIPPED, CURVE, FRAG, IOU, SUBSETS, TILES, TP, lines, tile_detections, tiles_and_boxes
from tarmac.session import cut, table
from tarmac.sources import config

QUERIES, SQL = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


RUNS = "ru AS (SELECT file_id, any_value(run) AS run, any_value(campaign) AS campaign, any_value(batch_no) AS batch_no, any_value(body) AS body, any_value(file_name) AS file_name FROM run_files GROUP BY file_id), ok AS (SELECT * FROM ru WHERE json_valid(body))"


def runs(spark, sf):
    r = table(spark, sf, "run_files").groupBy("file_id").agg(F.max(F.struct("run", "campaign", "batch_no", "body", "file_name")).alias("r")).select("file_id", "r.*")
    return r.withColumn("v", F.expr("try_parse_json(body)"))


def field(path, kind):
    return F.try_variant_get("v", path, kind)


@query(f"WITH {RUNS} SELECT file_id, TRY_CAST(json_extract_string(body, '$.seed') AS INTEGER) AS seed, json_extract_string(body, '$.model') AS model FROM ok WHERE json_type(body, '$.seed') IN ('UBIGINT', 'BIGINT') AND json_type(body, '$.model') = 'VARCHAR'")
def sc7_run_summaries(spark, sf):
    """sc16: summaries that parse, with fields by path; others are left out."""
    r = runs(spark, sf).filter("v is not null")
    return r.filter("schema_of_variant(try_variant_get(v, '$.seed', 'variant')) = 'BIGINT' and schema_of_variant(try_variant_get(v, '$.model', 'variant')) = 'STRING'").select("file_id", field("$.seed", "int").alias("seed"), field("$.model", "string").alias("model"))


@query(f"WITH {RUNS} SELECT campaign, count(*) AS n, count(*) FILTER (NOT coalesce(json_valid(body), false)) AS n_bad FROM ru GROUP BY campaign")
def sc8_unreadable(spark, sf):
    r = runs(spark, sf)
    return r.groupBy("campaign").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_bad"))


@query(f"WITH {RUNS}, k AS (SELECT run, c.key AS cls, c.value AS v FROM ok, json_each(CAST(json_extract(body, '$.per_class') AS JSON)) c WHERE json_type(body, '$.per_class') = 'OBJECT') SELECT cls, count(*) AS n, round(avg(TRY_CAST(json_extract_string(v, '$.AP50') AS DOUBLE)), 6) AS ap50 FROM k GROUP BY cls")
def a35_per_class(spark, sf):
    """Per-class blocks under whatever class names the reports hold."""
    m = runs(spark, sf).select(F.explode(field("$.per_class", "map<string,variant>")).alias("cls", "c"))
    return m.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg(F.try_variant_get("c", "$.AP50", "double")), 6).alias("ap50"))


@query(f"WITH {RUNS}, p AS (SELECT file_id, TRY_CAST(json_extract_string(body, '$.pooled.precision') AS DOUBLE) AS p, TRY_CAST(json_extract_string(body, '$.pooled.recall') AS DOUBLE) AS r FROM ok) SELECT file_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p WHERE p IS NOT NULL AND r IS NOT NULL")
def a36_f1(spark, sf):
    p = runs(spark, sf).select("file_id", field("$.pooled.precision", "double").alias("p"), field("$.pooled.recall", "double").alias("r")).filter("p is not null and r is not null")
    return p.select("file_id", F.round(matching.f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query(f"WITH {RUNS} SELECT campaign, count(DISTINCT coalesce(json_extract_string(body, '$.n_classes'), '<none>')) AS n_values FROM ok GROUP BY campaign HAVING count(DISTINCT coalesce(json_extract_string(body, '$.n_classes'), '<none>')) > 1")
def q5_class_counts(spark, sf):
    """Campaigns whose runs disagree on the number of classes."""
    r = runs(spark, sf).filter("v is not null").select("campaign", F.to_json(field("$.n_classes", "variant")).alias("n"))
    return gates.disagreeing(r.withColumn("n", F.nullif("n", F.lit("null"))), ["campaign"], "n").select("campaign", "n_values")


@query(f"WITH {RUNS}, f AS (SELECT file_id, TRY_CAST(json_extract_string(body, '$.fraction') AS DOUBLE) AS fraction FROM ok) SELECT file_id, fraction >= 1 AS valid_for_reporting FROM f WHERE fraction IS NOT NULL")
def q10_valid_for_reporting(spark, sf):
    f = runs(spark, sf).select("file_id", field("$.fraction", "double").alias("fraction")).filter("fraction is not null")
    return f.select("file_id", (F.col("fraction") >= 1).alias("valid_for_reporting"))


@query(sql("im split", "SELECT split, count(*) AS n, min(image_id) AS first_id, max(image_id) AS last_id FROM sp WHERE split IS NOT NULL GROUP BY split"))
def sk3_split_manifest(spark, sf):
    """The split manifest written as one JSON document per split and read back."""
    i = images(spark, sf).select("image_id", split_name(F.col("split_hint")).alias("split")).filter("split is not null")
    parts = i.groupBy("split", F.floor(F.col("image_id") / 1000).alias("part")).agg(F.to_json(F.struct(F.count("*").alias("count"), F.array_sort(F.collect_list("image_id")).alias("image_ids"))).alias("d"))
    back = parts.select("split", F.from_json("d", "count bigint, image_ids array<bigint>").alias("d"))
    return back.groupBy("split").agg(F.sum("d.count").alias("n"), F.min(F.get("d.image_ids", 0)).alias("first_id"), F.max(F.element_at("d.image_ids", -1)).alias("last_id"))


@query(sql("im an", "SELECT orig_class, count(*) AS n FROM a WHERE orig_class IS NOT NULL AND upper(trim(orig_class)) NOT IN ('D00', 'D01', 'D10', 'D11', 'D20', 'D40', 'D43', 'D44') GROUP BY orig_class"))
def f20_whitelist(spark, sf):
    allowed = spark.createDataFrame([(k,) for k, v in sorted(L.LABEL_MAP["rdd2022"].items()) if v != L.IGNORE], "label string")
    a = annotations(spark, sf).filter("orig_class is not null")
    return a.join(F.broadcast(allowed), F.upper(F.trim(a.orig_class)) == F.col("label"), "left_anti").groupBy("orig_class").agg(F.count("*").alias("n"))


@query(sql("im an", "SELECT ann_id, 6 AS category_id FROM a WHERE lower(trim(orig_class)) IN ('rut', 'rutting')"))
def f23_remap_rutting(spark, sf):
    return annotations(spark, sf).filter("lower(trim(orig_class)) in ('rut', 'rutting')").select("ann_id", F.lit(6).alias("category_id"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(mAP50|epoch [0-9]+)')")
def f27_log_lines(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike("(?i)(mAP50|epoch [0-9]+)")).select("doc_id")


STEM = "regexp_replace(regexp_replace(file_name, '^.*/', ''), '\\.[^.]*$', '')"


@query(sql("im", f"SELECT i.image_id, count(r.p) AS n_paths, min(r.p) AS chosen FROM i LEFT JOIN (SELECT DISTINCT rel_path AS p, {STEM.replace('file_name', 'rel_path')} AS s FROM i WHERE rel_path IS NOT NULL) r ON r.s = {STEM} WHERE file_name IS NOT NULL GROUP BY i.image_id"))
def j18_files_by_stem(spark, sf):
    """j19: images and files joined by stem; of several files the least path, never whichever comes first."""
    i = images(spark, sf)
    f = i.filter("rel_path is not null").select(F.col("rel_path").alias("p"), L.stem_of(F.col("rel_path")).alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n_paths"), F.min("p").alias("chosen"))
    return i.filter("file_name is not null").select("image_id", L.stem_of(F.col("file_name")).alias("s")).join(f, "s", "left").select("image_id", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "chosen")


@query(sql("di da", f", {TILES}, {CLIPPED}, k AS (SELECT image_id, tile_index, count(*) FILTER (retained >= 0.3) AS kept FROM cb GROUP BY ALL), t AS (SELECT country, ti.image_id, coalesce(kept, 0) AS kept FROM ti LEFT JOIN k USING (image_id, tile_index)) SELECT country, count(*) AS tiles, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS pct FROM t WHERE kept > 0 GROUP BY country").replace("(SELECT count(*) FROM t)", "(SELECT count(*) FROM t WHERE kept > 0)"))
def a13_tiled_country_mix(spark, sf):
    from pyspark.sql import Window

    g, c = tiles_and_boxes(spark, sf)
    kept = c.filter("retained >= 0.3").select("image_id", "tile_index").distinct()
    n = g.select("country", "image_id", "tile_index").join(kept, ["image_id", "tile_index"], "left_semi").groupBy("country").agg(F.count("*").alias("tiles"))
    return n.select("country", "tiles", F.round(100.0 * F.col("tiles") / F.sum("tiles").over(Window.partitionBy()), 6).alias("pct"))


@query("SELECT event_type, round(sum(value), 4) AS spend FROM events GROUP BY event_type HAVING sum(value) > 0")
def a34_spend(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("spend")).filter("spend > 0")


def _fragments(spark, sf):
    return tile_detections(spark, sf)


CUT = {
    "right": "({t}.tx1 < {t}.width AND {t}.x1 >= {t}.tx1 - 4)", "left": "({t}.tx0 > 0 AND {t}.x0 <= {t}.tx0 + 4)",
    "bottom": "({t}.ty1 < {t}.height AND {t}.y1 >= {t}.ty1 - 4)", "top": "({t}.ty0 > 0 AND {t}.y0 <= {t}.ty0 + 4)",
}
ANY = "(" + " OR ".join(CUT.values()) + ")"
LAP = lambda a, b, k: f"greatest(0, least({a}.{k}1, {b}.{k}1) - greatest({a}.{k}0, {b}.{k}0))"


def _seam(l, r, ends, along, across):
    span = f"least({l}.{across}1 - {l}.{across}0, {r}.{across}1 - {r}.{across}0)"
    return f"({CUT[ends[0]].format(t=l)} AND {CUT[ends[1]].format(t=r)} AND {r}.{along}0 - {l}.{along}1 <= 8 AND {span} > 0 AND {LAP(l, r, across)} >= 0.5 * {span})"


SEAM = f"((CASE WHEN a.x0 <= b.x0 THEN {_seam('a', 'b', ('right', 'left'), 'x', 'y')} ELSE {_seam('b', 'a', ('right', 'left'), 'x', 'y')} END) OR (CASE WHEN a.y0 <= b.y0 THEN {_seam('a', 'b', ('bottom', 'top'), 'y', 'x')} ELSE {_seam('b', 'a', ('bottom', 'top'), 'y', 'x')} END))"
INTER = f"CAST({LAP('a', 'b', 'x')} * {LAP('a', 'b', 'y')} AS DOUBLE)"
AREA = "(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"
LINK = f"""fx AS MATERIALIZED (SELECT f.*, unnest(generate_series(CAST(floor((x0 - 9) / 512) AS BIGINT), CAST(floor((x1 + 9) / 512) AS BIGINT))) AS cx FROM f),
fc AS MATERIALIZED (SELECT *, unnest(generate_series(CAST(floor((y0 - 9) / 512) AS BIGINT), CAST(floor((y1 + 9) / 512) AS BIGINT))) AS cy FROM fx),
lk0 AS MATERIALIZED (SELECT DISTINCT a.det_id AS a, b.det_id AS b FROM fc a JOIN fc b ON a.image_id = b.image_id AND a.cls = b.cls AND a.cx = b.cx AND a.cy = b.cy AND a.det_id < b.det_id AND a.tile_index <> b.tile_index
  WHERE {INTER} / ({AREA.format(t='a')} + {AREA.format(t='b')} - {INTER}) >= 0.5 OR ({INTER} / least({AREA.format(t='a')}, {AREA.format(t='b')}) >= 0.7 AND ({ANY.format(t='a')} OR {ANY.format(t='b')})) OR {SEAM})"""


@query(sql("di da dd", f", {TILES}, {FRAG} SELECT det_id, {ANY.format(t='f')} AS truncated FROM f"))
def g6_truncated(spark, sf):
    d = _fragments(spark, sf)
    cols = {f"b_{k}": F.col(k) for k in ("x0", "y0", "x1", "y1")} | {f"t_{k}": F.col(f"t{k}") for k in ("x0", "y0", "x1", "y1")}
    return d.withColumns(cols).select("det_id", tiling.any_truncated("b_", "t_").alias("truncated"))


@query(sql("di da dd", f", {TILES}, {FRAG}, {LINK} SELECT a, b FROM lk0"))
def g7_seam_relations(spark, sf):
    """j9: fragments of one object in different tiles: duplicates, truncated views, seam continuations."""
    return tiling.relations(cut(_fragments(spark, sf))).select("a", "b")


@query(sql("di da dd", f", {TILES}, {FRAG}, {LINK}, e AS (SELECT a AS u, b AS v FROM lk0 UNION SELECT b, a FROM lk0), cc(n, l) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, cc.l FROM cc JOIN e ON cc.n = e.u), lb AS (SELECT n, min(l) AS label FROM cc GROUP BY n) SELECT coalesce(label, det_id) AS group_id, count(*) AS n_parts, CAST(greatest(0, min(x0)) AS DOUBLE) AS x0, CAST(least(max(width), max(x1)) AS DOUBLE) AS x1 FROM f LEFT JOIN lb ON n = det_id GROUP BY 1", True))
def g8_stitched_hulls(spark, sf):
    return tiling.stitch(_fragments(spark, sf)).select("group_id", "n_parts", "x0", "x1")


@query(sql("di da dd", f", {TILES}, {FRAG}, {LINK}, e AS (SELECT a AS u, b AS v FROM lk0 UNION SELECT b, a FROM lk0), cc(n, l) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, cc.l FROM cc JOIN e ON cc.n = e.u), lb AS (SELECT n, min(l) AS label FROM cc GROUP BY n) SELECT coalesce(label, det_id) AS group_id, image_id, cls, round(max(conf * retained), 5) AS score, CAST(greatest(0, min(x0)) AS DOUBLE) AS x0, CAST(greatest(0, min(y0)) AS DOUBLE) AS y0, CAST(least(max(width), max(x1)) AS DOUBLE) AS x1, CAST(least(max(height), max(y1)) AS DOUBLE) AS y1, count(*) AS n_parts, array_to_string(list_sort(list(DISTINCT tile_index)), ',') AS tiles FROM f LEFT JOIN lb ON n = det_id GROUP BY 1, 2, 3", True))
def g8_stitch(spark, sf):
    """Fragments joined across seams; whole images pass through."""
    return tiling.stitch(_fragments(spark, sf)).withColumn("score", F.round("score", 5)).select("group_id", "image_id", "cls", "score", "x0", "y0", "x1", "y1", "n_parts", "tiles")


@query(sql("di da dd", f", {IOU}, {TP}, {SUBSETS}, {CURVE}, lv AS (SELECT cu.subset, cu.cls, cu.thr, i, max(tpc / CAST(rk AS DOUBLE)) AS m FROM cu JOIN range(101) g(i) ON tpc / CAST(n AS DOUBLE) * 100 + 1e-9 >= i GROUP BY ALL) SELECT sg.subset, sg.cls, th.thr, round(coalesce(sum(m), 0) / 101, 6) AS ap FROM sg JOIN th ON TRUE LEFT JOIN lv ON lv.subset = sg.subset AND lv.cls = sg.cls AND lv.thr = th.thr GROUP BY ALL"))
def w15_mean_of_recalls(spark, sf):
    """The independent scorer over the same matches."""
    return lines(spark, sf).scores().select("subset", "cls", "thr", F.round("mean", 6).alias("ap"))


@query(sql("im", "SELECT country, count(*) AS n FROM i WHERE country IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 10"))
def t2_top_countries(spark, sf):
    """t5."""
    return images(spark, sf).filter("country is not null").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10)


@query(sql("im an", "SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM i WHERE i.image_id = a.image_id)) > 50 AS too_many_missing FROM a"))
def q8_missing_threshold(spark, sf):
    m = annotations(spark, sf).join(images(spark, sf).select("image_id"), "image_id", "left_anti")
    return m.limit(51).agg((F.count("*") > 50).alias("too_many_missing"))


@query(sql("di", "SELECT image_id, CAST(nullif(regexp_extract('# tile=' || width || ' overlap=0.2', 'tile=(\\d+)', 1), '') AS INTEGER) AS tile, 0.2::DOUBLE AS overlap FROM di"))
def sc17_tiling_header(spark, sf):
    """sc15: tiling parameters read from header texts."""
    from tarmac.plans.base import d_images

    h = F.concat(F.lit("# source=x tile="), F.col("width").cast("string"), F.lit(" overlap=0.2"))
    return d_images(spark, sf).select("image_id", config.tiling_of(h).alias("t")).select("image_id", "t.tile", "t.overlap")


