"""Training progress: summaries of results tables and idle detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_PACE = 600.0  # seconds an epoch while nothing is timed yet


def trimmed(df: DataFrame) -> DataFrame:
    """Column names without outer white space."""
    return df.toDF(*(c.strip() for c in df.columns))


def progress(results: DataFrame, planned: DataFrame) -> DataFrame:
    """Per planned run (run, epochs): done, sec_per_epoch, best, best_epoch (earliest), last, remaining, eta_s, status.

    results: run, epoch, time (cumulated seconds), map50.
    """
    r = results.groupBy("run").agg(
        F.max("epoch").alias("done"), F.max("time").alias("time"), F.max("map50").alias("best"),
        F.max_by("epoch", F.when(F.col("map50").isNotNull(), F.struct("map50", -F.col("epoch")))).alias("best_epoch"),
        F.max_by("map50", F.when(F.col("map50").isNotNull(), F.col("epoch"))).alias("last"))
    p = planned.join(r, "run", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    pace = F.coalesce(F.try_divide(F.col("time"), F.col("done")), F.lit(FALLBACK_PACE))
    left = F.greatest(F.col("epochs") - F.col("done"), F.lit(0))
    status = F.when(F.col("done") == 0, "pending").when(F.col("done") >= F.col("epochs"), "done").otherwise("running")
    return p.select("run", "epochs", "done", pace.alias("sec_per_epoch"), "best", "best_epoch", "last", left.alias("remaining"), (left * pace).alias("eta_s"), status.alias("status"))


def duration(seconds):
    """'1d 02h 03m 04s'."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%dd %02dh %02dm %02ds", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)


def cost(uptime_s, rate: float):
    return uptime_s / 3600.0 * rate


def idle_streaks(samples: DataFrame, keys: list[str], limit: int, at_most: float = 5.0) -> DataFrame:
    """Adds streak (consecutive idle samples up to here) and stop (streak >= limit). samples: keys, t, util, t unique within keys."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    idle = F.coalesce(F.col("util") <= at_most, F.lit(False))
    s = samples.withColumn("_idle", idle).withColumn("_g", F.sum(F.when(F.col("_idle"), 0).otherwise(1)).over(w))
    wg = Window.partitionBy(*keys, "_g").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn("streak", F.sum(F.when(F.col("_idle"), 1).otherwise(0)).over(wg)).withColumn("stop", F.col("streak") >= limit).drop("_idle", "_g")
