"""Queries of the training-data operators and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.llm import grouping, leakage, lexicon, overlap, sentences, splitting
from tarmac.session import table


def p2_found(spark, sf):
    return splitting.found(table(spark, sf, "tiles"), table(spark, sf, "clipped_boxes"), table(spark, sf, "cut_specs"))


def p3_found(spark, sf):
    return grouping.found(table(spark, sf, "images"), table(spark, sf, "annotations"))


def p3_splits(spark, sf):
    return grouping.assign(table(spark, sf, "images"), table(spark, sf, "annotations"), table(spark, sf, "split_targets"))


def p5_found(spark, sf):
    return overlap.found(table(spark, sf, "images"), table(spark, sf, "annotations"))


def p5_report(spark, sf):
    return overlap.report(table(spark, sf, "images"), table(spark, sf, "annotations"))


def p6_ids(spark, sf):
    return lexicon.encode(table(spark, sf, "documents"))


def p7_found(spark, sf):
    return leakage.found(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_evidence(spark, sf):
    """All pairs that the search checks on the text, with their cosine, common order and answer codes."""
    out = leakage.scored(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return out.withColumn("cosine", F.round("cosine", 4)).withColumn("lcs", F.round("lcs", 6))


def p7_paraphrases(spark, sf):
    return leakage.paraphrases(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark, sf):
    return sentences.found(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_splits, p5_found, p5_report, p6_ids, p7_found, p7_evidence, p7_paraphrases, p8_found)}

SQL = {
    "p2_found": """
WITH RECURSIVE t AS (
  SELECT tile_id, any_value(x0) AS x0, any_value(x1) AS x1, any_value(plan) AS plan FROM tiles GROUP BY tile_id
), w AS (
  SELECT t.*, limit_px, overlap_px, min_retained FROM t JOIN cut_specs USING (plan) WHERE t.x1 - t.x0 > limit_px
), b AS (
  SELECT DISTINCT w.tile_id, c.x0 + w.x0 AS b0, c.x1 + w.x0 AS b1
  FROM clipped_boxes c JOIN w USING (tile_id) WHERE c.x1 > c.x0 AND c.retained >= w.min_retained
), p AS (
  SELECT tile_id, 1 AS piece_no, x0 AS s, x0 AS first, x1, limit_px, overlap_px FROM w
  UNION ALL
  SELECT tile_id, piece_no + 1, e - overlap_px, first, x1, limit_px, overlap_px FROM (
    SELECT p.*, coalesce((
      SELECT max(q) FROM (SELECT unnest(generate_series(p.s + p.limit_px // 2 + 1, p.s + p.limit_px)) AS q) g
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tile_id = p.tile_id AND b.b0 < q AND q < b.b1)
    ), p.s + p.limit_px) AS e FROM p WHERE p.x1 - p.s > p.limit_px)
)
SELECT tile_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS x0,
  CAST(coalesce(lead(s) OVER (PARTITION BY tile_id ORDER BY piece_no) + overlap_px, x1) AS INTEGER) AS x1
FROM p""",
    "p3_found": r"""
WITH RECURSIVE i AS (SELECT id AS image_id, any_value(file_name) AS f FROM images WHERE id IS NOT NULL GROUP BY id),
b AS (SELECT image_id, lower(trim(regexp_replace(f, '^.*[/\\]', ''))) AS f FROM i),
k AS (SELECT image_id, regexp_extract(f, '^([^0-9]+?)[ ._-]*[ ._-]d(?:rive)?[ ._-]*([0-9]+)[ ._-]+(?:f(?:rame)?[ ._-]*)?([0-9]+)(?:$|[^0-9\p{L}])', ['country', 'drive', 'frame']) AS m FROM b),
ent AS (SELECT image_id, '0' || regexp_replace(m.country, '[ ._-]', '', 'g') || '-' || CAST(CAST(m.drive AS HUGEINT) AS VARCHAR) AS e FROM k WHERE m.drive <> '' AND NOT regexp_matches(m.country, '[^\p{L} ._-]') AND regexp_matches(m.country, '^\p{L}')
  UNION SELECT image_id, '1' || regexp_extract(lower(object_uid), '^\s*(ob-[0-9]+)\s*$', 1) FROM annotations WHERE regexp_matches(lower(object_uid), '^\s*(ob-[0-9]+)\s*$') AND image_id IN (SELECT image_id FROM i)),
lk AS (SELECT DISTINCT x.e AS u, y.e AS v FROM ent x JOIN ent y USING (image_id) WHERE x.e <> y.e),
cc(n, l) AS (SELECT DISTINCT e, e FROM ent UNION SELECT lk.v, cc.l FROM cc JOIN lk ON cc.n = lk.u),
lb AS (SELECT n, min(l) AS label FROM cc GROUP BY n),
g AS (SELECT image_id, min(label) AS label FROM ent JOIN lb ON n = e GROUP BY image_id),
s AS (SELECT label, count(*) AS n, min(image_id) AS first FROM g GROUP BY label HAVING count(*) > 1)
SELECT image_id, CASE WHEN label LIKE '0%' THEN substr(label, 2) ELSE 'image-' || first END AS group_key FROM g JOIN s USING (label)""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
