"""All queries of the core library and the SQL that they are checked against."""

from __future__ import annotations

from tarmac.plans import delivery_queries, detection_queries, drift_and_nesting, group_queries, label_queries, report_queries, stats_queries

MODULES = (drift_and_nesting, label_queries, detection_queries, group_queries, stats_queries, report_queries, delivery_queries)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf):
    """Average precision of the derived detections by class, over all images and by country."""
    return detection_queries.w8_average_precision(spark, sf)
