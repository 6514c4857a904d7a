"""What an evaluation hands over: export counts, reports and tables, merged documents, and gates that can refuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geometry as G
from tarmac.functions import labels as L
from tarmac.operators import curves, dedup, gates, matching, monitor, stats, tiling
from tarmac.plans.base import annotations, d_annotations, d_detections, d_hash, d_images, images, split_name, sql
from tarmac.plans.detection_queries import CURVE, IOU, SUBSETS, TILES, TP, _fold, lines
from tarmac.plans.group_queries import CC, NAMES, NEAR, REPS, SEQS, names, seqs
from tarmac.plans.label_queries import NORM, normalised
from tarmac.plans.report_queries import RUNS, field, runs
from tarmac.plans.stats_queries import METRICS, PER, RES, per_run
from tarmac.session import cut, table
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


EXPORT = """, e AS (SELECT sp.split, sp.image_id, i.file_name IS NOT NULL AS here, i.width, i.height FROM sp JOIN i USING (image_id) WHERE sp.split IS NOT NULL),
b AS (SELECT i.image_id, (x + w / 2) / width AS cx, (y + h / 2) / height AS cy, w / width AS nw, h / height AS nh FROM a JOIN i USING (image_id) WHERE width > 0 AND height > 0 AND file_name IS NOT NULL AND category_id IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(w) AND isfinite(h)),
p AS (SELECT image_id, count(*) FILTER (nw > 0 AND nh > 0) AS boxes, count(*) FILTER (NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND nw BETWEEN 0 AND 1 AND nh BETWEEN 0 AND 1)) AS clipped FROM b GROUP BY 1)
SELECT split, count(*) FILTER (here) AS images, CAST(coalesce(sum(boxes) FILTER (here), 0) AS BIGINT) AS boxes, count(*) FILTER (here AND coalesce(boxes, 0) = 0) AS empty, count(*) FILTER (NOT here) AS missing, CAST(coalesce(sum(clipped) FILTER (here), 0) AS BIGINT) AS clipped FROM e LEFT JOIN p USING (image_id) GROUP BY split"""


@query(sql("im an split", EXPORT))
def a10_export_stats(spark, sf):
    """Per split: images, boxes, empty, missing (here: without a file name) and clipped."""
    i = images(spark, sf)
    members = i.select(split_name(F.col("split_hint")).alias("split"), "image_id").filter("split is not null")
    b = annotations(spark, sf).filter("category_id is not null and " + " and ".join(f"{k} between -1e300 and 1e300" for k in "xywh"))
    return stats.export_counts(members, i.filter("file_name is not null").select("image_id", "width", "height"), b.select("image_id", *"xywh"))


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, g AS (SELECT cluster_id, count(*) AS size, count(DISTINCT image_id % 3) > 1 AS crossing FROM ms GROUP BY 1) SELECT count(*) AS duplicate_groups, CAST(sum(size - 1) AS BIGINT) AS drop_count, max(size) AS largest, count(*) FILTER (crossing) AS cross_country_groups FROM g", True))
def sk2_dedup_report(spark, sf):
    """a5: figures of the report on duplicates; here images are spread over three owners, so that groups can cross."""
    m = cut(dedup.clusters(d_hash(spark, sf)))
    owners = d_images(spark, sf).select("image_id", (F.col("image_id") % 3).alias("country_id"))
    return dedup.report(m, dedup.keepers(m, names(spark, sf)), owners)


@query(sql("dh", f", {SEQS}, q AS (SELECT dh.*, seq FROM dh JOIN sq USING (image_id)) SELECT x.image_id AS a, y.image_id AS b, abs(x.seq - y.seq) AS gap FROM q x JOIN q y ON x.country_id = y.country_id AND x.image_id // 3 = y.image_id // 3 AND x.image_id < y.image_id WHERE abs(x.seq - y.seq) <= 20 AND bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)) <= 4"))
def j5_near_in_sequence(spark, sf):
    """Near-duplicates of one country whose frame numbers are close too."""
    return dedup.near_in_sequence(d_hash(spark, sf), seqs(spark, sf), 20).select("a", "b", "gap")


PAIRS = """, ad AS (SELECT x.country_id, x.image_id, x.b0, x.b1, x.b2, x.b3, bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)) AS d,
  row_number() OVER (PARTITION BY x.country_id ORDER BY md5('5:pair:' || x.image_id), x.image_id) AS k FROM dh x JOIN dh y ON x.country_id = y.country_id AND y.image_id = x.image_id + 1),
ot AS (SELECT *, row_number() OVER (PARTITION BY country_id ORDER BY md5('5:other:' || image_id), image_id) AS k FROM dh),
rd AS (SELECT ad.country_id, bit_count(xor(ad.b0, ot.b0)) + bit_count(xor(ad.b1, ot.b1)) + bit_count(xor(ad.b2, ot.b2)) + bit_count(xor(ad.b3, ot.b3)) AS d FROM ad JOIN ot USING (country_id, k) WHERE ad.image_id <> ot.image_id AND k <= 300),
al AS (SELECT country_id, 'adjacent' AS kind, d FROM ad WHERE k <= 300 UNION ALL SELECT country_id, 'random', d FROM rd)"""


@query(sql("dh", PAIRS + " SELECT country_id, kind, count(*) AS n, median(d) AS median_distance FROM al GROUP BY 1, 2"))
def j12_random_pairs(spark, sf):
    """t7: at most 300 adjacent pairs per country, in hashed order, and as many pairs at random."""
    p = dedup.pair_distances(d_hash(spark, sf), 300, 5)
    return p.groupBy("country_id", "kind").agg(F.count("*").alias("n"), F.median("d").alias("median_distance"))


@query(sql("dh", PAIRS + ", m AS (SELECT country_id, median(d) FILTER (kind = 'adjacent') AS ma, median(d) FILTER (kind = 'random') AS mr, round(100.0 * count(*) FILTER (kind = 'adjacent' AND d <= 4) / count(*) FILTER (kind = 'adjacent'), 4) AS pa FROM al GROUP BY 1) SELECT country_id, ma AS median_adjacent, mr AS median_random, pa AS pct_adjacent, ma < mr - 2 AS temporal FROM m WHERE ma IS NOT NULL AND mr IS NOT NULL"))
def a30_locality(spark, sf):
    """Whether numbering carries locality: adjacent images against random pairs."""
    d = dedup.locality(dedup.pair_distances(d_hash(spark, sf), 300, 5))
    return d.select("country_id", "median_adjacent", "median_random", F.round("pct_adjacent", 4).alias("pct_adjacent"), "temporal")


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, {SEQS}, gp AS (SELECT cluster_id, seq - lag(seq) OVER (PARTITION BY cluster_id ORDER BY seq) AS gap FROM ms JOIN sq USING (image_id)), g AS (SELECT cluster_id, count(*) AS size, median(gap) AS median_gap FROM gp GROUP BY 1 HAVING count(*) >= 3 AND median(gap) > 10) SELECT * FROM g ORDER BY size DESC, median_gap DESC, cluster_id LIMIT 12", True))
def t2_top_suspects(spark, sf):
    """The largest and most scattered groups."""
    s = dedup.suspects(dedup.gap_medians(dedup.clusters(d_hash(spark, sf)), seqs(spark, sf)), 3, 10)
    return s.orderBy(F.desc("size"), F.desc("median_gap"), "cluster_id").limit(12)


@query(f"WITH {METRICS}, {PER.format(k='country,')} SELECT country, round(avg(v), 6) AS base FROM pr WHERE config = 'base6' AND metric = 'AP50' GROUP BY country ORDER BY base DESC, country LIMIT 8")
def t5_countries_by_baseline(spark, sf):
    m = per_run(spark, sf, "country").filter("config = 'base6' and metric = 'AP50'").groupBy("country").agg(F.round(F.avg("value"), 6).alias("base"))
    return m.orderBy(F.desc("base"), "country").limit(8)


# --- tables and documents ----------------------------------------------------------------------
MEAN = "m AS (SELECT config, {k}, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd FROM pr WHERE metric = 'AP50' GROUP BY ALL)"


def _pm(mean, sd):
    return F.format_string("$%.2f \\pm %.2f$", F.col(mean), F.col(sd))


@query(f"WITH {METRICS}, {PER.format(k='cls,')}, {MEAN.format(k='cls')}, w AS (SELECT b.cls, b.mean AS bm, b.sd AS bs, c.mean AS cm, c.sd AS cs FROM m b LEFT JOIN m c ON c.config = 'ctrl4' AND c.cls = b.cls AND c.cls < 4 WHERE b.config = 'base6') "
       "SELECT row_number() OVER (ORDER BY cls) AS line_no, 'class\\_' || cls || ' & ' || printf('$%.2f \\pm %.2f$', bm, bs) || ' & ' || coalesce(printf('$%.2f \\pm %.2f$', cm, cs), '--') || ' & ' || coalesce(printf('%+.2f', cm - bm), '--') || ' \\\\' AS line FROM w")  # fmt: skip
def sk8_six_versus_four(spark, sf):
    """Body of the table of six classes against four."""
    m = stats.mean_sample_std(per_run(spark, sf, "cls").filter("metric = 'AP50'"), ["config", "cls"])
    b = m.filter("config = 'base6'").select("cls", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    c = m.filter("config = 'ctrl4' and cls < 4").select("cls", F.col("mean").alias("cm"), F.col("std").alias("cs"))
    gain = F.when(F.col("cm").isNotNull(), F.format_string("%+.2f", F.col("cm") - F.col("bm")))
    cells = [F.concat(F.lit("class_"), F.col("cls").cast("string")), _pm("bm", "bs"), F.when(F.col("cm").isNotNull(), _pm("cm", "cs")), gain]
    return writers.table_lines(b.join(c, "cls", "left"), ["cls"], cells)


@query(f"WITH {METRICS}, {PER.format(k='country,')}, {MEAN.format(k='country')} SELECT row_number() OVER (ORDER BY country) AS line_no, replace(country, '_', '\\_') || ' & ' || printf('$%.2f \\pm %.2f$', mean, sd) || ' \\\\' AS line FROM m WHERE config = 'base6'")
def sk8_per_country(spark, sf):
    """Body of the table by country."""
    m = stats.mean_sample_std(per_run(spark, sf, "country").filter("metric = 'AP50' and config = 'base6'"), ["country"])
    return writers.table_lines(m, ["country"], [F.col("country"), _pm("mean", "std")])


@query(f"WITH {METRICS}, {PER.format(k='country,')}, m AS (SELECT country, avg(v) FILTER (config = 'base6') AS b, avg(v) FILTER (config = 'ctrl4') AS c FROM pr WHERE metric = 'AP50' GROUP BY ALL) SELECT row_number() OVER (ORDER BY country) AS line_no, replace(country, '_', '\\_') || ' & ' || coalesce(printf('%.3f', b), '--') || ' & ' || coalesce(printf('%+.3f', c - b), '--') || ' \\\\' AS line FROM m")
def sk9_variants(spark, sf):
    """Body of the table of variants: the baseline, and what the variant adds."""
    of = lambda c: F.avg(F.when(F.col("config") == c, F.col("value")))
    m = per_run(spark, sf, "country").filter("metric = 'AP50'").groupBy("country").agg(of("base6").alias("b"), of("ctrl4").alias("c"))
    num = lambda f, c: F.when(c.isNotNull(), F.format_string(f, c))
    return writers.table_lines(m, ["country"], [F.col("country"), num("%.3f", F.col("b")), num("%+.3f", F.col("c") - F.col("b"))])


@query(f"WITH {METRICS}, {PER.format(k='cls,')}, {MEAN.format(k='cls')}, r AS (SELECT config, list_sort(list(cls || ':' || printf('%.3f', mean))) AS cells FROM m GROUP BY 1), n AS (SELECT config, count(DISTINCT run) AS n_runs FROM pr GROUP BY 1) SELECT config, n_runs, array_to_string(cells, ' ') AS cells FROM r JOIN n USING (config)")
def sk7_aggregate_document(spark, sf):
    """One JSON document per configuration with its runs and means by class, read back field by field."""
    p = cut(per_run(spark, sf, "cls").filter("metric = 'AP50'"))
    doc = writers.document({"runs": p.select("config", "run").distinct(), "per_class": stats.mean_sample_std(p, ["config", "cls"])}, "config")
    v = doc.select("config", F.from_json("document", "runs array<struct<run string>>, per_class array<struct<cls int, mean double, std double, n bigint>>").alias("v"))
    cells = F.array_sort(F.transform("v.per_class", lambda x: F.concat(x["cls"].cast("string"), F.lit(":"), F.format_string("%.3f", x["mean"]))))
    return v.select("config", F.size("v.runs").cast("long").alias("n_runs"), F.array_join(cells, " ").alias("cells"))


@query(f"WITH {RUNS}, s AS (SELECT run, batch_no, file_id, k.key AS stage, k.type AS kind FROM ok, json_each(CAST(body AS JSON)) k WHERE json_type(CAST(body AS JSON)) = 'OBJECT'), l AS (SELECT run, stage, max(CAST(batch_no AS BIGINT) * 1000000000 + file_id) AS latest FROM s WHERE run IS NOT NULL AND batch_no IS NOT NULL GROUP BY ALL) SELECT run, count(*) AS n_stages, CAST(sum(latest % 1000000000) AS BIGINT) AS from_files FROM l GROUP BY run")
def sk12_merged_reports(spark, sf):
    """Reports of a run merged stage by stage, later ones over earlier: stages, and the files that they come from."""
    r = runs(spark, sf).filter("v is not null and run is not null and batch_no is not null and schema_of_variant(v) like 'OBJECT%'")
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    line = r.select("run", F.explode(keys).alias("stage"), (F.col("batch_no").cast("long") * 1000000000 + F.col("file_id")).alias("at"))
    w = line.groupBy("run", "stage").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    of = lambda c: w.groupBy(F.col("run").alias("report")).agg(F.map_from_entries(F.collect_list(F.struct("stage", F.col(c).cast("string")))).alias("stages"))
    m = writers.merged_reports(of("first"), of("last"))
    total = F.aggregate(F.map_values("stages"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") % 1000000000)
    return m.select(F.col("report").alias("run"), F.size("stages").cast("long").alias("n_stages"), total.alias("from_files"))


@query(sql("di da dd", f", {IOU}, {_fold('hi', '0.25')} SELECT gt_id, cls, CAST(x1 - x0 AS DOUBLE) AS box_w, round((x1 - x0) * (y1 - y0) / CAST(width * height AS DOUBLE), 8) AS box_area_frac FROM da WHERE gt_id NOT IN (SELECT gt_id FROM hi)", True))
def sk11_missed_rows(spark, sf):
    """The rows of the dump of missed boxes, written as JSON lines and read back."""
    f = matching.false_negatives(d_annotations(spark, sf).drop("width", "height"), d_detections(spark, sf), d_images(spark, sf))
    back = f.select(F.from_json(F.to_json(F.struct(*f.columns)), "gt_id string, cls int, box_w double, box_area_frac double").alias("r")).select("r.*")
    return back.withColumn("box_area_frac", F.round("box_area_frac", 8))


@query("SELECT id AS ann_id, image_id FROM (SELECT id, any_value(image_id) AS image_id, any_value(iscrowd) AS c, any_value(bbox) AS b FROM annotations GROUP BY id) WHERE c = 0 AND len(b) = 4 AND list_aggregate(list_transform(b, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0")
def sc13_segments(spark, sf):
    """Boxes as polygon segmentations; crowds have run lengths instead, which are skipped."""
    a = annotations(spark, sf).filter("iscrowd is not null and size(bbox) = 4 and " + " and ".join(f"{k} between -1e300 and 1e300" for k in "xywh"))
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corners = F.to_json(F.array(F.array("x", "y", x1, F.col("y"), x1, y1, F.col("x"), y1)))
    seg = F.when(F.col("iscrowd") == 1, F.to_json(F.struct(F.array(F.lit(5), F.lit(9)).alias("counts"), F.array(F.lit(4), F.lit(4)).alias("size")))).otherwise(corners)
    polygons, _ = readers.segment_points(a.select("ann_id", "image_id", seg.alias("segmentation")))
    return polygons.select("ann_id", "image_id")


# --- gates that can refuse ----------------------------------------------------------------------
@query(f"WITH {RUNS} SELECT campaign, count(*) FILTER (coalesce(json_valid(body), false)) AS n FROM ru GROUP BY campaign HAVING count(*) FILTER (coalesce(json_valid(body), false)) < 50")
def sc8_too_few_reports(spark, sf):
    """Campaigns with fewer readable reports than a comparison needs (fifty here)."""
    return gates.too_few(runs(spark, sf).select("campaign", F.col("v").isNotNull().alias("readable")), "campaign", 50)


@query(sql("di da dd", f", {IOU}, {TP}, {SUBSETS}, {CURVE}, lv AS (SELECT cu.subset, cu.cls, cu.thr, i, max(tpc / CAST(rk AS DOUBLE)) AS m FROM cu JOIN range(101) g(i) ON tpc / CAST(n AS DOUBLE) * 100 + 1e-9 >= i GROUP BY ALL), ot AS (SELECT sg.subset, sg.cls, th.thr, coalesce(sum(m), 0) / 101 AS ap FROM sg JOIN th ON TRUE LEFT JOIN lv ON lv.subset = sg.subset AND lv.cls = sg.cls AND lv.thr = th.thr GROUP BY ALL) SELECT ot.subset, count(*) AS n, count(*) FILTER (abs(ap.ap - ot.ap) <= 0.004) AS n_ok, count(*) = count(*) FILTER (abs(ap.ap - ot.ap) <= 0.004) AS passed FROM ot JOIN ap ON ot.subset = ap.subset AND ot.cls = ap.cls AND ot.thr = ap.thr GROUP BY ot.subset"))
def q9_metric_gate(spark, sf):
    """Two scorers over the same matches must agree within 0.004 at every class and threshold, or the subset is refused."""
    both = lines(spark, sf).scores()
    got, other = (both.select("subset", "cls", "thr", F.col(c).alias(n)) for c, n in (("ap", "got"), ("mean", "expected")))
    g = gates.metric_gate(got, other, ["subset", "cls", "thr"], 0.004)
    return g.groupBy("subset").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.bool_and("ok").alias("passed"))


@query(f"WITH {RUNS}, h AS (SELECT file_id, coalesce(json_extract_string(body, '$.data_yaml_header'), '') AS x FROM ok) SELECT file_id, unnest(list_filter(['train', 'val'], lambda s: NOT regexp_matches(x, s || '_sha256[:=]\\s*[0-9a-f]{{64}}\\b'))) AS split FROM h")
def q3_headers_without_hash(spark, sf):
    """Reports whose data header states no split hash, by split."""
    h = runs(spark, sf).filter("v is not null").select(F.col("file_id").alias("run"), F.coalesce(field("$.data_yaml_header", "string"), F.lit("")).alias("data_yaml_header"))
    return gates.without_hash(h).withColumnRenamed("run", "file_id")


@query(sql("im an", ", k AS (SELECT image_id AS k, 1 AS l, 0 AS r FROM i WHERE image_id IS NOT NULL UNION ALL SELECT DISTINCT image_id, 0, 1 FROM a WHERE image_id IS NOT NULL) SELECT k AS image_id, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM k GROUP BY k HAVING sum(l) <> 1 OR sum(r) <> 1"))
def q12_unpaired_images(spark, sf):
    """Images without annotations and annotations without image: the two must pair one to one."""
    return gates.unpaired(images(spark, sf).select("image_id"), annotations(spark, sf).select("image_id").distinct(), "image_id")


@query(sql("im an lm", ", m AS (SELECT label, CASE WHEN label LIKE 'D4%' THEN target || '_old' ELSE target END AS target FROM lm) SELECT label, target FROM m WHERE target <> '__IGNORE__' AND target NOT IN (SELECT name FROM categories)"))
def q2_missing_targets(spark, sf):
    """Targets of a label map that are no category: here a map that still has old names."""
    from tarmac.plans.base import label_map

    old = label_map(spark).withColumn("target", F.when(F.col("label").startswith("D4"), F.concat("target", F.lit("_old"))).otherwise(F.col("target")))
    return gates.missing_targets(old, table(spark, sf, "categories"), L.IGNORE).select("label", "target")


@query("SELECT doc_id, strlen(text) = n AS size_ok, sha256(text) = sha256(trim(text)) AS hash_ok FROM (SELECT doc_id, any_value(text) AS text, max(n_chars) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY doc_id) WHERE n IS NOT NULL")
def sc19_file_integrity(spark, sf):
    """Files against what was recorded of them; documents stand in: recorded sizes may be stale, and the recorded hash is that of the trimmed text."""
    d = table(spark, sf, "documents").filter("text is not null and text <> '' and n_chars is not null").groupBy("doc_id").agg(F.first("text").alias("text"), F.max("n_chars").alias("size"))
    files = d.select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    expected = d.select(F.col("doc_id").alias("name"), F.col("size"), F.sha2(F.trim("text").cast("binary"), 256).alias("sha256"))
    return gates.file_integrity(files, expected).withColumnRenamed("name", "doc_id")


@query(sql("di da dd", ", w AS (SELECT gt_id, pred_id, CAST((least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS DOUBLE) / least((g.x1 - g.x0) * (g.y1 - g.y0), (p.x1 - p.x0) * (p.y1 - p.y0)) AS iom FROM da g JOIN dd p ON g.image_id = p.image_id AND g.cls = p.cls WHERE g.x1 > g.x0 AND g.y1 > g.y0 AND p.x1 > p.x0 AND p.y1 > p.y0 AND least(g.x1, p.x1) > greatest(g.x0, p.x0) AND least(g.y1, p.y1) > greatest(g.y0, p.y0)) SELECT gt_id, pred_id, round(iom, 6) AS iom FROM w WHERE iom >= 0.7"))
def w3_over_smaller(spark, sf):
    """All pairs of one image and class of which the smaller box lies in the other by 0.7 or more."""
    cells = lambda df, p, i: df.filter("x1 > x0 and y1 > y0").select("image_id", "cls", i, *(F.col(k).alias(f"{p}{k}") for k in ("x0", "y0", "x1", "y1"))).withColumn("_cx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / 1024), F.floor(F.col(f"{p}x1") / 1024))))
    pair = cells(d_annotations(spark, sf), "g_", "gt_id").join(cells(d_detections(spark, sf), "p_", "pred_id"), ["image_id", "cls", "_cx"])
    pair = pair.filter(F.col("_cx") == F.floor(F.greatest("g_x0", "p_x0") / 1024)).withColumn("iom", G.over_smaller("g_", "p_")).filter("iom >= 0.7")
    return pair.select("gt_id", "pred_id", F.round("iom", 6).alias("iom"))


@query(sql("di", f", {TILES} SELECT image_id, count(*) AS n_tiles, CAST(sum((tx1 - tx0) * (ty1 - ty0)) AS BIGINT) AS pixels FROM ti GROUP BY image_id"))
def g10_predict_tiles(spark, sf):
    """Tiles through a predictor, in batches; this one detects each tile as a whole."""

    def whole(pdf):
        return pdf.assign(pixels=(pdf["tx1"] - pdf["tx0"]) * (pdf["ty1"] - pdf["ty0"]))[["image_id", "pixels"]]

    t = tiling.grid(d_images(spark, sf)).select("image_id", "tx0", "ty0", "tx1", "ty1")
    out = tiling.predict_tiles(t, whole, "image_id long, pixels long")
    return out.groupBy("image_id").agg(F.count("*").alias("n_tiles"), F.sum("pixels").alias("pixels"))


@query(sql("im an", f", {NORM} SELECT i.image_id FROM i LEFT JOIN (SELECT DISTINCT image_id FROM nm WHERE cls IS NOT NULL AND nw > 0 AND nh > 0) ok USING (image_id) WHERE ok.image_id IS NULL"))
def f24_blank_label_files(spark, sf):
    """Negatives as an export shows them: images whose label file is there and blank."""
    n = normalised(spark, sf).filter("cls is not null and nw > 0 and nh > 0").select("image_id", "cls", "cx", "cy", F.col("nw").alias("w"), F.col("nh").alias("h"))
    return writers.label_files(images(spark, sf), n, "image_id").filter(F.trim("content") == "").select("image_id")


@query(f"WITH {RES}, pl AS (SELECT 'run' || i AS run, 6 AS epochs FROM range(8) q(i)), g AS (SELECT run, max(epoch) AS done, max(time) AS t FROM re GROUP BY run), p AS (SELECT run, greatest(epochs - coalesce(done, 0), 0) AS remaining, coalesce(t / done, 600) AS pace FROM pl LEFT JOIN g USING (run)) SELECT run, round(remaining * pace, 3) AS eta_s, printf('%dd %02dh %02dm %02ds', CAST(floor(remaining * pace / 86400) AS BIGINT), CAST(floor(remaining * pace % 86400 / 3600) AS BIGINT), CAST(floor(remaining * pace % 3600 / 60) AS BIGINT), CAST(floor(remaining * pace % 60) AS BIGINT)) AS left_over, round(remaining * pace / 3600.0 * 0.526, 4) AS cost FROM p")
def a32_eta_and_cost(spark, sf):
    """What planned runs still take, as a duration, and cost at an hourly rate."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 2 + l_suppkey % 7")
    r = li.groupBy(F.concat(F.lit("run"), (F.col("l_suppkey") % 7).cast("string")).alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 5).alias("map50")).withColumn("time", F.col("epoch") * 550.0)
    planned = spark.range(8).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run"), F.lit(6).alias("epochs"))
    p = monitor.progress(r, planned)
    return p.select("run", F.round("eta_s", 3).alias("eta_s"), monitor.duration(F.col("eta_s")).alias("left_over"), F.round(monitor.cost(F.col("eta_s"), 0.526), 4).alias("cost"))


@query("SELECT CASE WHEN grouping(n_name) = 1 THEN 'TOTAL' ELSE n_name END AS country, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS split, count(*) AS n, min(o_orderkey) AS sample_first, max(o_orderkey) AS sample_last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
def a31_rollup_levels(spark, sf):
    """Counts by country and split, by country, and in all, with samples of each."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    level = lambda k, all_: F.when(F.grouping(k) == 1, all_).otherwise(F.col(k))
    g = j.rollup("n_name", "o_orderstatus").agg(level("n_name", "TOTAL").alias("country"), level("o_orderstatus", "all").alias("split"), F.count("*").alias("n"), F.min("o_orderkey").alias("sample_first"), F.max("o_orderkey").alias("sample_last"))
    return g.select("country", "split", "n", "sample_first", "sample_last")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, strftime(max(o_orderdate) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS last_and_half FROM orders GROUP BY 1")
def d_months(spark, sf):
    """Month starts, and times shifted by a duration."""
    o = table(spark, sf, "orders")
    shifted = F.date_format(F.max("o_orderdate") + F.expr("interval 36 hours"), "yyyy-MM-dd HH:mm")
    return o.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), shifted.alias("last_and_half"))
