"""Seed statistics, comparisons, gates, latency and progress over metric tables derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import gates, monitor, stats
from tarmac.plans.base import sql
from tarmac.session import table
from tarmac.sources import readers

QUERIES, SQL = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


# run (config and seed in its name), cls, country, metric, value: six runs of two configurations.
METRICS = """mt AS (SELECT run, CAST(l_partkey % 6 AS INTEGER) AS cls, n_name AS country, metric, avg(value) AS value FROM (
  SELECT *, CASE l_linenumber % 2 WHEN 0 THEN 'base6' ELSE 'ctrl4' END || '_s' || (l_suppkey % 3) AS run, unnest(['AP50', 'AP50_95']) AS metric, unnest([l_discount * 10, l_tax * 10]) AS value FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL),
me AS (SELECT *, regexp_replace(run, '_s\\d+$', '') AS config FROM mt)"""


def metrics(spark, sf):
    li, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    run = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "base6").otherwise("ctrl4"), F.lit("_s"), (F.col("l_suppkey") % 3).cast("string"))
    m = j.select(run.alias("run"), (F.col("l_partkey") % 6).cast("int").alias("cls"), F.col("n_name").alias("country"), F.explode(F.create_map(F.lit("AP50"), F.col("l_discount") * 10, F.lit("AP50_95"), F.col("l_tax") * 10)).alias("metric", "value"))
    return m.groupBy("run", "cls", "country", "metric").agg(F.avg("value").alias("value")).withColumn("config", stats.config_of(F.col("run")))


def _rounded(df, keys, cols, places=6):
    return df.select(*keys, *(F.round(c, places).alias(c) for c in cols))


def sq(body):
    return f"WITH {METRICS} {body}"


PER = "pr AS (SELECT config, run, {k} metric, avg(value) AS v FROM me GROUP BY ALL)"


def per_run(spark, sf, *keys):
    return metrics(spark, sf).groupBy("config", "run", *keys, "metric").agg(F.avg("value").alias("value"))


@query(sq(f", {PER.format(k='')} SELECT config, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n FROM pr GROUP BY ALL"))
def a16_pooled(spark, sf):
    """a14: mean and sample deviation over seeds."""
    return _rounded(stats.mean_sample_std(per_run(spark, sf), ["config", "metric"]).withColumn("k", F.col("n")), ["config", "metric"], ["mean", "std"]).join(
        stats.mean_sample_std(per_run(spark, sf), ["config", "metric"]).select("config", "metric", "n"), ["config", "metric"])


@query(sq(f", {PER.format(k='cls,')} SELECT config, cls, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM pr GROUP BY ALL"))
def a17_per_class(spark, sf):
    return _rounded(stats.mean_sample_std(per_run(spark, sf, "cls"), ["config", "cls", "metric"]), ["config", "cls", "metric"], ["mean", "std"])


@query(sq(f", {PER.format(k='country,')} SELECT config, country, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, min(run) AS first_run FROM pr WHERE metric = 'AP50' GROUP BY ALL"))
def a18_per_country(spark, sf):
    p = per_run(spark, sf, "country").filter("metric = 'AP50'")
    first = p.groupBy("config", "country").agg(F.min("run").alias("first_run"))
    return _rounded(stats.mean_sample_std(p, ["config", "country"]), ["config", "country"], ["mean", "std"]).join(first, ["config", "country"])


@query(sq(f", {PER.format(k='country,')}, m AS (SELECT config, country, avg(v) AS mean FROM pr WHERE metric = 'AP50' GROUP BY ALL) SELECT config, round(max(mean) - min(mean), 6) AS spread FROM m GROUP BY config HAVING count(*) > 1"))
def a19_country_spread(spark, sf):
    m = stats.mean_sample_std(per_run(spark, sf, "country").filter("metric = 'AP50'"), ["config", "country"])
    return _rounded(stats.spread(m, ["config"]), ["config"], ["spread"])


EFF = f", {PER.format(k='cls,')}, m AS (SELECT config, cls, metric, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std FROM pr GROUP BY ALL), ef AS (SELECT b.cls, b.metric, c.mean - b.mean AS delta, CASE WHEN b.std > 0 THEN (c.mean - b.mean) / b.std END AS effect FROM m b JOIN m c ON b.config = 'base6' AND c.config = 'ctrl4' AND b.cls = c.cls AND b.metric = c.metric WHERE b.cls < 4)"


def _effects(spark, sf):
    m = stats.mean_sample_std(per_run(spark, sf, "cls").filter("cls < 4"), ["config", "cls", "metric"])
    return stats.effects(m.filter("config = 'base6'"), m.filter("config = 'ctrl4'"), ["cls", "metric"])


@query(sq(EFF + " SELECT cls, metric, round(delta, 6) AS delta, round(effect, 4) AS effect FROM ef"))
def j15_effects(spark, sf):
    """a20: baseline against control on the shared classes."""
    return _effects(spark, sf).select("cls", "metric", F.round("delta", 6).alias("delta"), F.round("effect", 4).alias("effect"))


@query(sq(EFF + " SELECT round(avg(delta), 6) AS mean_delta, round(max(abs(effect)), 4) AS max_abs_effect, coalesce(max(abs(effect)) <= 2, true) AS within_noise FROM ef"))
def a20_verdict(spark, sf):
    v = stats.verdict(_effects(spark, sf))
    return v.select(F.round("mean_delta", 6).alias("mean_delta"), F.round("max_abs_effect", 4).alias("max_abs_effect"), "within_noise")


@query(sq(", lf AS (SELECT config, 'pooled' AS grain, NULL AS country, NULL AS cls, metric, run, avg(value) AS v FROM me GROUP BY ALL UNION ALL SELECT config, 'class', NULL, cls, metric, run, avg(value) FROM me GROUP BY ALL UNION ALL SELECT config, 'country', country, NULL, metric, run, avg(value) FROM me GROUP BY ALL UNION ALL SELECT config, 'class_country', country, cls, metric, run, avg(value) FROM me GROUP BY ALL) SELECT config, grain, country, cls, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max FROM lf GROUP BY ALL"))
def a21_seed_spread(spark, sf):
    """a15, u4: population deviation over seeds at four grains, from values of each grain."""
    m = metrics(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    part = lambda grain, *k: m.groupBy("config", "run", "metric", *k).agg(F.avg("value").alias("value")).select("config", F.lit(grain).alias("grain"), (F.col("country") if "country" in k else none("string")).alias("country"), (F.col("cls") if "cls" in k else none("int")).alias("cls"), "metric", "run", "value")
    lf = part("pooled").unionByName(part("class", "cls")).unionByName(part("country", "country")).unionByName(part("class_country", "country", "cls"))
    s = stats.mean_population_std(lf, ["config", "grain", "country", "cls", "metric"])
    return s.select("config", "grain", "country", "cls", "metric", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query(sq(f", {PER.format(k='cls,')}, m AS (SELECT config, cls, avg(v) AS mean FROM pr WHERE metric = 'AP50' GROUP BY ALL) SELECT b.cls, round(b.mean, 6) AS base, CASE WHEN b.cls < 4 THEN round(c.mean, 6) END AS variant, coalesce(CASE WHEN b.cls < 4 THEN printf('%+.4f', c.mean - b.mean) END, '-') AS diff FROM m b JOIN m c ON b.config = 'base6' AND c.config = 'ctrl4' AND b.cls = c.cls"))
def j14_variants(spark, sf):
    """Baseline and a variant side by side; a class that the variant lacks shows '-'."""
    m = stats.mean_sample_std(per_run(spark, sf, "cls").filter("metric = 'AP50'"), ["config", "cls"])
    b = m.filter("config = 'base6'").select("cls", F.col("mean").alias("b"))
    v = m.filter("config = 'ctrl4' and cls < 4").select("cls", F.col("mean").alias("v"))
    return b.join(v, "cls", "left").select("cls", F.round("b", 6).alias("base"), F.round("v", 6).alias("variant"), F.coalesce(F.when(F.col("v").isNotNull(), F.format_string("%+.4f", F.col("v") - F.col("b"))), F.lit("-")).alias("diff"))


LAT = "sm AS (SELECT CAST(l_partkey % 5 AS INTEGER) AS variant, l_quantity * 0.25 + l_linenumber AS ms FROM lineitem)"


@query(f"WITH {LAT}, o AS (SELECT variant, ms, row_number() OVER (PARTITION BY variant ORDER BY ms) AS k, count(*) OVER (PARTITION BY variant) AS n FROM sm) SELECT variant, round(avg(ms), 6) AS mean_ms, median(ms) AS median_ms, round(stddev_pop(ms), 6) AS std_ms, min(ms) AS min_ms, count(*) AS n, min(CASE WHEN k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1 THEN ms END) AS p95_ms, round(1000 / avg(ms), 6) AS fps FROM o GROUP BY variant".replace("count(*) AS n, min(CASE", "max(n) AS n, min(CASE"))
def a25_latency(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_partkey") % 5).cast("int").alias("variant"), (F.col("l_quantity") * 0.25 + F.col("l_linenumber")).alias("ms"))
    return stats.latency(s, ["variant"]).select("variant", F.round("mean_ms", 6).alias("mean_ms"), "median_ms", F.round("std_ms", 6).alias("std_ms"), "min_ms", "n", "p95_ms", F.round("fps", 6).alias("fps"))


RUNS = "rs AS (SELECT DISTINCT 'cfg' || (o_custkey % 4) || '_s' || (o_custkey % 3) AS run, CASE WHEN o_custkey % 4 = 2 AND o_custkey % 3 = 1 THEN sha256('x') ELSE sha256('y' || (o_custkey % 4)) END AS h FROM orders)"


@query(f"WITH {RUNS} SELECT regexp_replace(run, '_s\\d+$', '') AS config, count(DISTINCT h) AS n_values FROM rs GROUP BY 1 HAVING count(DISTINCT h) > 1")
def q4_split_identity(spark, sf):
    """q3, q6, u6: split hashes read from the runs' data headers; configurations whose runs disagree."""
    k = table(spark, sf, "orders").select("o_custkey").withColumn("run", F.concat(F.lit("cfg"), (F.col("o_custkey") % 4).cast("string"), F.lit("_s"), (F.col("o_custkey") % 3).cast("string")))
    h = F.when((F.col("o_custkey") % 4 == 2) & (F.col("o_custkey") % 3 == 1), F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.concat(F.lit("y"), (F.col("o_custkey") % 4).cast("string")), 256))
    header = k.select("run", F.concat(F.lit("# train_sha256: "), h, F.lit("\n# val_sha256="), h).alias("data_yaml_header")).distinct()
    hashes = gates.split_hash_of(header).filter("split = 'train'").withColumn("config", stats.config_of(F.col("run")))
    return gates.disagreeing(hashes, ["config"], "sha256").select("config", "n_values")


@query("WITH c AS (SELECT o_orderstatus AS k, count(*) AS counted FROM orders GROUP BY 1), p(k, expected) AS (VALUES ('F', 100), ('O', 200), ('Z', 0)) SELECT p.k, expected, coalesce(counted, 0) AS counted, coalesce(counted, 0) = expected AS agrees FROM p LEFT JOIN c USING (k)")
def j13_published_counts(spark, sf):
    """q11: published figures against what was counted; nothing counts as 0."""
    c = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("counted"))
    p = spark.createDataFrame([("F", 100), ("O", 200), ("Z", 0)], "k string, expected int")
    return stats.against_published(c, p, ["k"]).select("k", "expected", "counted", "agrees")


@query("SELECT coalesce(n_name, 'TOTAL') AS country, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def a31_rollup(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("n_name").agg(F.count("*").alias("n")).select(F.coalesce("n_name", F.lit("TOTAL")).alias("country"), "n")


RES = "re AS (SELECT 'run' || (l_suppkey % 7) AS run, l_linenumber AS epoch, round(avg(l_discount), 5) AS map50, l_linenumber * 550.0 AS time FROM lineitem WHERE l_linenumber <= 2 + l_suppkey % 7 GROUP BY ALL)"


@query(f"WITH {RES}, pl AS (SELECT 'run' || i AS run, 6 AS epochs FROM range(8) q(i)), g AS (SELECT run, max(epoch) AS done, max(time) AS t, max(map50) AS best, first(epoch ORDER BY map50 DESC, epoch) AS best_epoch, first(map50 ORDER BY epoch DESC) AS last FROM re GROUP BY run) SELECT run, epochs, coalesce(done, 0) AS done, round(coalesce(t / done, 600), 3) AS sec_per_epoch, best, best_epoch, last, greatest(epochs - coalesce(done, 0), 0) AS remaining, CASE WHEN done IS NULL THEN 'pending' WHEN done >= epochs THEN 'done' ELSE 'running' END AS status FROM pl LEFT JOIN g USING (run)")
def a32_progress(spark, sf):
    """a33, j17: planned runs with their results; a run without any is pending."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 2 + l_suppkey % 7")
    r = li.groupBy(F.concat(F.lit("run"), (F.col("l_suppkey") % 7).cast("string")).alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 5).alias("map50")).withColumn("time", F.col("epoch") * 550.0)
    planned = spark.range(8).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run"), F.lit(6).alias("epochs"))
    return monitor.progress(r, planned).select("run", "epochs", "done", F.round("sec_per_epoch", 3).alias("sec_per_epoch"), "best", "best_epoch", "last", "remaining", "status")


@query("WITH s AS (SELECT user_id, ts, event_id, value <= 15 AS idle FROM events), g AS (SELECT *, sum(CASE WHEN idle THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT event_id, CAST(sum(CASE WHEN idle THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g")
def w18_idle_streaks(spark, sf):
    """Consecutive low samples per machine, with reset."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("t"), F.col("value").alias("util"))
    return monitor.idle_streaks(e, ["user_id"], 5, 15).select("event_id", "streak")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc7_json_fields(spark, sf):
    """sc8, sc16: fields of JSON documents by schema; documents that don't parse give null."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def sc18_last_samples(spark, sf):
    """t6: the last N samples of each kind."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("k", F.row_number().over(w)).filter("k <= 20").select("event_type", "event_id", "value")


@query("SELECT l_suppkey AS suppkey, count(*) AS n, bool_and(l_quantity >= 1) AS all_positive FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def q12_having(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"), F.every(F.col("l_quantity") >= 1).alias("all_positive"))
    return g.filter("n > 10")


@query("WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS epoch, printf('%.3f', o_totalprice) AS time FROM orders) SELECT CAST(epoch AS INTEGER) AS epoch, CAST(time AS DOUBLE) AS time FROM l")
def sc10_results_table(spark, sf):
    """Comma-separated lines with padded fields, parsed with numbers by name."""
    line = table(spark, sf, "orders").select(F.format_string("   %d ,  %.3f", "o_orderkey", "o_totalprice").alias("value"))
    r = line.select(F.from_csv("value", "epoch string, time string", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return r.select(F.col("r.epoch").try_cast("int").alias("epoch"), F.col("r.time").try_cast("double").alias("time"))


@query("SELECT n_regionkey AS listing, concat('Data/', r_name, '/', n_name, '.jpg') AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc11_listing(spark, sf):
    """Indented folder listings written from nations and read back as paths."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    files = n.select(F.col("n_regionkey").alias("listing"), (F.col("n_nationkey") + 10).alias("line_no"), F.concat(F.lit("        "), "n_name", F.lit(".jpg")).alias("value"))
    dirs = r.select(F.col("r_regionkey").alias("listing"), F.lit(2).alias("line_no"), F.concat(F.lit("    └───"), "r_name").alias("value"))
    top = r.select(F.col("r_regionkey").alias("listing"), F.lit(1).alias("line_no"), F.lit("├───Data").alias("value"))
    return readers.listing_paths(top.unionByName(dirs).unionByName(files)).select("listing", "path")
