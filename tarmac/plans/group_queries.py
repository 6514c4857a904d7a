"""Near-duplicate groups, grouped splits and reports about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import dedup, splits
from tarmac.operators.components import least_labels
from tarmac.plans.base import d_hash, d_images, sql
from tarmac.session import cut

QUERIES, SQL = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


DIST = "bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3))"
REPS = "rp AS (SELECT country_id, b0, b1, b2, b3, min(image_id) AS rep FROM dh GROUP BY ALL)"
# All images of one base share their near pairs; the oracle joins them by the base that the formula gave them.
NEAR = f"np AS (SELECT x.rep AS a, y.rep AS b, CAST({DIST} AS INTEGER) AS distance FROM rp x JOIN rp y ON x.country_id = y.country_id AND x.rep // 3 = y.rep // 3 AND x.rep < y.rep WHERE {DIST} <= 4)"
CC = """lk AS (SELECT a AS u, b AS v FROM np UNION SELECT b, a FROM np),
cc(n, l) AS (SELECT DISTINCT u, u FROM lk UNION SELECT lk.v, cc.l FROM cc JOIN lk ON cc.n = lk.u),
lb AS (SELECT n, min(l) AS label FROM cc GROUP BY n),
mb AS (SELECT image_id, coalesce(label, rep) AS cluster_id FROM dh JOIN rp USING (country_id, b0, b1, b2, b3) LEFT JOIN lb ON n = rep),
ms AS (SELECT * FROM mb WHERE cluster_id IN (SELECT cluster_id FROM mb GROUP BY 1 HAVING count(*) > 1))"""
NAMES = "nm AS (SELECT o_orderkey AS image_id, o_orderkey % 7 AS n, concat('img_', lpad(CAST((o_orderkey * 31) % 1000 AS VARCHAR), 4, '0'), '.jpg') AS file_name FROM orders)"


def names(spark, sf):
    i = d_images(spark, sf)
    return i.select("image_id", (F.col("image_id") % 7).alias("n"), F.concat(F.lit("img_"), F.lpad(((F.col("image_id") * 31) % 1000).cast("string"), 4, "0"), F.lit(".jpg")).alias("file_name"))


@query(sql("dh", f", {REPS}, {NEAR} SELECT * FROM np"))
def j4_near_pairs_exact(spark, sf):
    """j5: pairs of one country within distance 4, by pigeonhole over five pieces."""
    reps, _ = dedup.representatives(d_hash(spark, sf))
    return dedup.near_pairs(reps, 4, True)


@query(sql("dh", f", {REPS}, {NEAR} SELECT np.* FROM np JOIN rp x ON x.rep = a JOIN rp y ON y.rep = b AND y.country_id = x.country_id WHERE x.b0 = y.b0 OR x.b1 = y.b1 OR x.b2 = y.b2 OR x.b3 = y.b3"))
def j4_near_pairs_banded(spark, sf):
    """Whole 16-bit bands only: misses pairs that differ in every band."""
    reps, _ = dedup.representatives(d_hash(spark, sf))
    return dedup.near_pairs(reps, 4, False)


@query(sql("dh", f", {REPS}, {NEAR}, {CC} SELECT image_id, cluster_id FROM ms", True))
def a3_clusters(spark, sf):
    return dedup.clusters(d_hash(spark, sf))


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, {NAMES} SELECT cluster_id, arg_min(image_id, (-n, file_name, image_id)) AS keep_id, count(*) AS size, count(*) - 1 AS n_drop FROM ms JOIN nm USING (image_id) GROUP BY cluster_id", True).replace("arg_min(image_id, (-n, file_name, image_id))", "first(image_id ORDER BY n DESC, file_name, image_id)"))
def a4_keep_best(spark, sf):
    return dedup.keepers(dedup.clusters(d_hash(spark, sf)), names(spark, sf))


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, {NAMES} SELECT image_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, file_name, image_id) AS k FROM ms JOIN nm USING (image_id)) WHERE k > 1", True))
def a5_drop_list(spark, sf):
    m = cut(dedup.clusters(d_hash(spark, sf)))
    keep = dedup.keepers(m, names(spark, sf)).select(F.col("keep_id").alias("image_id"))
    return m.join(keep, "image_id", "left_anti").select("image_id")


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, g AS (SELECT cluster_id, count(*) AS size FROM ms GROUP BY 1) SELECT size, count(*) AS n_groups, (size - 1) * count(*) AS n_drops, round((size - 1) * count(*) / (SELECT CAST(sum(size - 1) AS DOUBLE) FROM g), 6) AS share FROM g GROUP BY size", True))
def a26_group_sizes(spark, sf):
    g = dedup.clusters(d_hash(spark, sf)).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return dedup.group_sizes(g).withColumn("share", F.round("share", 6))


SEQS = "sq AS (SELECT o_orderkey AS image_id, (o_orderkey * 17) % 5000 AS seq FROM orders)"


def seqs(spark, sf):
    return d_images(spark, sf).select("image_id", ((F.col("image_id") * 17) % 5000).alias("seq"))


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, {SEQS}, gp AS (SELECT cluster_id, seq - lag(seq) OVER (PARTITION BY cluster_id ORDER BY seq) AS gap FROM ms JOIN sq USING (image_id)) SELECT cluster_id, count(*) AS size, median(gap) AS median_gap FROM gp GROUP BY 1", True))
def a27_gap_medians(spark, sf):
    return dedup.gap_medians(dedup.clusters(d_hash(spark, sf)), seqs(spark, sf))


@query(sql("dh", f", {REPS}, {NEAR}, {CC}, {SEQS}, gp AS (SELECT cluster_id, seq - lag(seq) OVER (PARTITION BY cluster_id ORDER BY seq) AS gap FROM ms JOIN sq USING (image_id)) SELECT cluster_id, count(*) AS size, median(gap) AS median_gap FROM gp GROUP BY 1 HAVING count(*) >= 3 AND median(gap) > 10", True))
def a28_suspects(spark, sf):
    return dedup.suspects(dedup.gap_medians(dedup.clusters(d_hash(spark, sf)), seqs(spark, sf)), 3, 10)


@query(sql("dh", ", p AS (SELECT x.country_id, bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)) AS d FROM dh x JOIN dh y ON x.country_id = y.country_id AND y.image_id = x.image_id + 1) SELECT country_id, count(*) AS n, median(d) AS median_distance, round(100.0 * count(*) FILTER (d <= 4) / count(*), 6) AS pct_near FROM p GROUP BY country_id"))
def a30_adjacent_distances(spark, sf):
    """j11: images numbered n and n + 1 of one country."""
    h = d_hash(spark, sf)
    a = h.select("country_id", (F.col("image_id") + 1).alias("image_id"), *(F.col(k).alias(f"a_{k}") for k in dedup.BANDS))
    b = h.select("country_id", "image_id", *(F.col(k).alias(f"b_{k}") for k in dedup.BANDS))
    p = a.join(b, ["country_id", "image_id"]).withColumn("d", dedup.distance("a_", "b_"))
    return p.groupBy("country_id").agg(F.count("*").alias("n"), F.median("d").alias("median_distance"), F.round(100.0 * F.count_if(F.col("d") <= 4) / F.count("*"), 6).alias("pct_near"))


@query(sql("dh", f", {REPS}, {NEAR}, {CC} SELECT n AS node, label FROM lb", True))
def a3_component_labels(spark, sf):
    reps, _ = dedup.representatives(d_hash(spark, sf))
    return least_labels(dedup.near_pairs(reps).select("a", "b"))


@query(sql("di dh", f""", {REPS}, {NEAR}, {CC},
gk AS (SELECT di.image_id, country, coalesce(CAST(cluster_id AS VARCHAR), 'solo:' || di.image_id) AS group_key FROM di LEFT JOIN ms USING (image_id)),
so AS (SELECT country, group_key, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY sha256('0:' || group_key)) AS rn, count(*) OVER (PARTITION BY country) AS c, CAST(sum(count(*)) OVER (PARTITION BY country) AS DOUBLE) * CAST(0.15 AS DOUBLE) AS target FROM gk GROUP BY country, group_key),
st(country, rn, val, train, group_key, took) AS (
  SELECT DISTINCT country, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', false FROM so
  UNION ALL
  SELECT country, rn, val + CASE WHEN tk THEN n ELSE 0 END, train + CASE WHEN tk THEN 0 ELSE n END, group_key, tk FROM (
    SELECT so.country, so.rn, so.n, so.group_key, val, train, abs(val + n - target) < abs(val - target) AND NOT (so.rn = c AND train = 0 AND c > 1) AS tk
    FROM st JOIN so ON so.country = st.country AND so.rn = st.rn + 1)),
en AS (SELECT country, max(train) AS train FROM st GROUP BY country)
SELECT image_id, gk.country, CASE WHEN took AND en.train > 0 THEN 'val' ELSE 'train' END AS split FROM gk JOIN st USING (country, group_key) JOIN en USING (country)""", True))
def w16_greedy_split(spark, sf):
    """Clusters stay whole; sequential per country over groups, not rows."""
    i = d_images(spark, sf).select("image_id", "country")
    g = cut(splits.groups_of(i, dedup.clusters(d_hash(spark, sf))))
    s = splits.greedy_split(g, 0.15)
    return g.join(s, ["country", "group_key"]).select("image_id", "country", "split")


@query(sql("dh", f", {REPS}, {NEAR}, {CC} SELECT image_id, coalesce(CAST(cluster_id AS VARCHAR), 'solo:' || image_id) AS group_key FROM dh LEFT JOIN ms USING (image_id)", True))
def j6_group_keys(spark, sf):
    i = d_images(spark, sf).select("image_id", "country")
    return splits.groups_of(i, dedup.clusters(d_hash(spark, sf))).select("image_id", "group_key")
