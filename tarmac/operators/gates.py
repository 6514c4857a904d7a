"""Integrity gates: each returns its violations as rows; `enforce` refuses to go on if there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A gate found violations."""


def enforce(violations: DataFrame, what: str, most: int = 0) -> None:
    """Raises if there are more than `most` violations; reads no more than that many and one."""
    rows = violations.limit(most + 1).collect()
    if len(rows) > most:
        raise GateError(f"{what}: {rows[: min(5, len(rows))]}")


def unknown_labels(ann: DataFrame, label_map: DataFrame) -> DataFrame:
    """label, n of labels that the map doesn't have. ann: label."""
    return ann.filter("label is not null").join(label_map.select("label"), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


def missing_targets(label_map: DataFrame, classes: DataFrame, ignore: str) -> DataFrame:
    """Mapped targets that are no class."""
    return label_map.filter(F.col("target") != ignore).join(classes.select(F.col("name").alias("target")), "target", "left_anti")


def split_hash_of(header: DataFrame) -> DataFrame:
    """run, split, sha256 (null if absent or not 64 hex digits) of data headers. header: run, data_yaml_header."""
    h = lambda s: F.nullif(F.regexp_extract("data_yaml_header", rf"{s}_sha256[:=]\s*([0-9a-f]{{64}})\b", 1), F.lit(""))
    return header.select("run", F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("val")), F.array(h("train"), h("val")))).alias("split", "sha256"))


def disagreeing(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups that hold more than one distinct value (nulls count as one)."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("<none>"))
    return df.groupBy(*group).agg(F.count_distinct(v).alias("n_values"), F.min(v).alias("least"), F.max(v).alias("greatest")).filter("n_values > 1")


def metric_gate(got: DataFrame, expected: DataFrame, keys: list[str], tol: float = 0.0005) -> DataFrame:
    """Expected metrics with what was got; ok if it is there and within the tolerance."""
    j = expected.join(got, keys, "left")
    return j.withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("expected")) <= tol + 1e-12, F.lit(False)))


def name_collisions(names: DataFrame) -> DataFrame:
    """Written names that several sources share. names: source_name, written_name."""
    return names.groupBy("written_name").agg(F.count("*").alias("n")).filter("n > 1")


def file_integrity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, size_ok, hash_ok of expected files against those read. files: name, content. expected: name, size, sha256 (may be null)."""
    got = files.select("name", F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    j = expected.join(got, "name", "left")
    return j.select("name", F.coalesce(F.col("_size") == F.col("size"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("_sha") == F.lower("sha256"), F.col("sha256").isNull() & F.col("_sha").isNotNull()).alias("hash_ok"))


def every_passes(rows: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: n, n_ok and passed, which takes all rows; no row passes nothing."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("n_ok"), (F.count("*") == F.count_if(F.col(ok))).alias("all_ok")).select("n", "n_ok", (F.col("all_ok") & (F.col("n") > 0)).alias("passed"))


def without_hash(headers: DataFrame) -> DataFrame:
    """run, split of data headers that state no split hash: reports without one can't be compared. headers: run, data_yaml_header."""
    return split_hash_of(headers).filter("sha256 is null").select("run", "split")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right of keys that aren't in both exactly once: images and their annotation files."""
    side = lambda df, a, b: df.filter(F.col(key).isNotNull()).select(key, F.lit(a).alias("l"), F.lit(b).alias("r"))
    both = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return both.filter("n_left <> 1 or n_right <> 1")


def too_few(reports: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Groups with fewer than `least` readable reports: nothing can be said about their spread. reports: group, readable."""
    return reports.groupBy(group).agg(F.count_if("readable").alias("n")).filter(F.col("n") < least)
