"""Queries of problems 1 and 4: drifting schemas and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import nested, schema_drift
from tarmac.session import cut, table


def p1_found(spark, sf):
    return schema_drift.found(table(spark, sf, "run_files"))


def p1_scores(spark, sf):
    """The pairs of a vanished and an appeared field that the settled scores select."""
    _, matches = schema_drift.prepared(table(spark, sf, "run_files"))
    return matches.withColumn("score", F.round("score", 6))


def p1_table(spark, sf):
    return schema_drift.united(table(spark, sf, "run_files"))


def p4_found(spark, sf):
    return nested.found(table(spark, sf, "report_docs"))


def p4_records(spark, sf):
    recs = nested.records(table(spark, sf, "report_docs"), "report_id", "body")
    return recs.withColumnRenamed("doc_id", "report_id").withColumn("fields", F.to_json("fields")).drop("kinds", "ordinal")


def p4_schema(spark, sf):
    schema = nested.merged_schema(table(spark, sf, "report_docs"), "report_id", "body")
    return schema.filter("column is not null").select("table", "column", F.concat_ws(",", "kinds").alias("kinds"), "n_records", "optional")


def p4_links(spark, sf):
    """Every child record of every table, with its ordinals and the parent that its surrogate key leads to."""
    recs = cut(nested.records(table(spark, sf, "report_docs"), "report_id", "body"))
    parents = recs.select(F.col("doc_id").alias("report_id"), F.col("record_key").alias("parent_key"), F.col("table").alias("parent_table"), F.col("path").alias("parent_path"))
    kids = recs.filter("parent_key is not null").select(F.col("doc_id").alias("report_id"), "parent_key", "table", F.col("path").alias("child_path"), F.concat_ws(",", F.col("ordinal").cast("array<string>")).alias("ordinal"))
    return kids.join(parents, ["report_id", "parent_key"]).select("report_id", "table", "child_path", "ordinal", "parent_table", "parent_path")


def _flat(path):
    def query(spark, sf):
        docs = table(spark, sf, "report_docs")
        schema = cut(nested.merged_schema(docs, "report_id", "body"))
        out = nested.flat_table(nested.records(docs, "report_id", "body", schema), schema, path)
        return out.withColumnRenamed("doc_id", "report_id").withColumn("ordinal", F.concat_ws(",", F.col("ordinal").cast("array<string>")))

    return query


FLAT = {"p4_groups": "/groups", "p4_members": "/groups/members", "p4_false_negatives": "/false_negatives", "p4_per_class": "/per_class/*", "p4_variants": "/variants/*", "p4_configs": "/configs/*"}
QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_table, p4_found, p4_records, p4_schema, p4_links)} | {name: _flat(path) for name, path in FLAT.items()}
SQL = {
    "p1_found": """
WITH RECURSIVE f AS (
  SELECT file_id, any_value(campaign) AS campaign, any_value(batch_no) AS batch_no, any_value(run) AS run, any_value(body) AS body
  FROM run_files WHERE campaign IS NOT NULL AND batch_no IS NOT NULL GROUP BY file_id
), ok AS (SELECT * FROM f WHERE json_valid(body)),
tree AS (
  SELECT campaign, batch_no, run, e.key AS field, e.value AS v, e.type AS t FROM ok, json_each(CAST(body AS JSON)) e WHERE json_type(CAST(body AS JSON)) = 'OBJECT'
  UNION ALL
  SELECT campaign, batch_no, run, tree.field || '.' || e.key, e.value, e.type FROM tree, json_each(tree.v) e WHERE tree.t = 'OBJECT'
), leaf AS (
  SELECT DISTINCT campaign, batch_no, run, field,
    CASE WHEN t = 'ARRAY' THEN 'array' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS type,
    CASE WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS value
  FROM tree WHERE t NOT IN ('OBJECT', 'NULL')
), b AS (
  SELECT campaign, batch_no, lag(batch_no) OVER (PARTITION BY campaign ORDER BY batch_no) AS prev_no FROM (SELECT DISTINCT campaign, batch_no FROM ok)
), runs AS (SELECT DISTINCT campaign, batch_no, run FROM ok WHERE run IS NOT NULL),
common AS (
  SELECT b.campaign, b.batch_no, b.prev_no, n.run FROM b
  JOIN runs n ON n.campaign = b.campaign AND n.batch_no = b.batch_no
  JOIN runs o ON o.campaign = b.campaign AND o.batch_no = b.prev_no AND o.run = n.run
), fields AS (SELECT campaign, batch_no, field, list_sort(list(DISTINCT type)) AS types FROM leaf GROUP BY ALL),
gone AS (
  SELECT b.campaign, b.batch_no, b.prev_no, o.field FROM b JOIN fields o ON o.campaign = b.campaign AND o.batch_no = b.prev_no
  WHERE NOT EXISTS (SELECT 1 FROM fields n WHERE n.campaign = b.campaign AND n.batch_no = b.batch_no AND n.field = o.field)
), come AS (
  SELECT b.campaign, b.batch_no, b.prev_no, n.field FROM b JOIN fields n ON n.campaign = b.campaign AND n.batch_no = b.batch_no
  WHERE b.prev_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields o WHERE o.campaign = b.campaign AND o.batch_no = b.prev_no AND o.field = n.field)
), ge AS (
  SELECT g.campaign, g.batch_no, g.field, count(l.value) AS n, list_sort(list(l.run || chr(1) || l.type || chr(1) || l.value)) AS ev
  FROM gone g JOIN common c USING (campaign, batch_no) JOIN leaf l ON l.campaign = g.campaign AND l.batch_no = g.prev_no AND l.field = g.field AND l.run = c.run GROUP BY ALL
), ce AS (
  SELECT g.campaign, g.batch_no, g.field, count(l.value) AS n, list_sort(list(l.run || chr(1) || l.type || chr(1) || l.value)) AS ev
  FROM come g JOIN common c USING (campaign, batch_no) JOIN leaf l ON l.campaign = g.campaign AND l.batch_no = g.batch_no AND l.field = g.field AND l.run = c.run GROUP BY ALL
), ren AS (
  SELECT campaign, batch_no, ge.field AS old_field, ce.field AS new_field FROM ge JOIN ce USING (campaign, batch_no) WHERE ge.n >= 2 AND ge.ev = ce.ev
)
SELECT campaign, batch_no, 'renamed' AS change, old_field, new_field FROM ren
UNION ALL SELECT campaign, batch_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.campaign = g.campaign AND r.batch_no = g.batch_no AND r.old_field = g.field)
UNION ALL SELECT campaign, batch_no, 'added', '', field FROM come g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.campaign = g.campaign AND r.batch_no = g.batch_no AND r.new_field = g.field)
UNION ALL SELECT b.campaign, b.batch_no, 'retyped', n.field, n.field FROM b
  JOIN fields o ON o.campaign = b.campaign AND o.batch_no = b.prev_no
  JOIN fields n ON n.campaign = b.campaign AND n.batch_no = b.batch_no AND n.field = o.field WHERE n.types <> o.types""",
    "p4_found": """
WITH RECURSIVE d AS (
  SELECT report_id, any_value(regexp_replace(body, '([:,\\[]\\s*)-?(NaN|Infinity)', '\\1 0', 'g')) AS body FROM report_docs WHERE report_id IS NOT NULL GROUP BY report_id
), t AS (
  SELECT report_id, '' AS path, '' AS holder, CAST(body AS JSON) AS v, json_type(CAST(body AS JSON)) AS kind FROM d WHERE json_valid(body)
  UNION ALL
  SELECT report_id, t.path || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), CASE WHEN t.kind = 'OBJECT' THEN t.path ELSE t.holder END, e.value, e.type
  FROM t, json_each(t.v) e WHERE t.kind IN ('OBJECT', 'ARRAY') AND e.type IN ('OBJECT', 'ARRAY')
)
SELECT report_id, path AS child_path, holder AS parent_path FROM t WHERE kind = 'OBJECT' AND path <> ''""",
    "p4_links": r"""
WITH RECURSIVE d AS (
  SELECT report_id, any_value(regexp_replace(body, '([:,\[]\s*)-?(NaN|Infinity)', '\1 0', 'g')) AS body FROM report_docs WHERE report_id IS NOT NULL GROUP BY report_id
), t AS (
  SELECT report_id, '' AS path, '' AS tab, '' AS pos, '' AS holder, '' AS holder_tab, CAST(body AS JSON) AS v, json_type(CAST(body AS JSON)) AS kind FROM d WHERE json_valid(body)
  UNION ALL
  SELECT report_id, t.path || '/' || k, CASE WHEN t.kind = 'OBJECT' THEN t.tab || '/' || k ELSE t.tab END,
    CASE WHEN t.kind = 'OBJECT' THEN '' WHEN t.pos = '' THEN k ELSE t.pos || ',' || k END,
    CASE WHEN t.kind = 'OBJECT' THEN t.path ELSE t.holder END, CASE WHEN t.kind = 'OBJECT' THEN t.tab ELSE t.holder_tab END, w, ty
  FROM t, (SELECT replace(replace(e.key, '~', '~0'), '/', '~1') AS k, e.value AS w, e.type AS ty FROM json_each(t.v) e) x
  WHERE t.kind IN ('OBJECT', 'ARRAY') AND ty IN ('OBJECT', 'ARRAY')
)
SELECT report_id, tab AS "table", path AS child_path, pos AS ordinal, holder_tab AS parent_table, holder AS parent_path FROM t WHERE kind = 'OBJECT' AND path <> ''""",
}
