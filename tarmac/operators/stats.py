"""Seed statistics, comparisons and rates over metric tables in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(v: Column) -> Column:
    """NaN means no data."""
    return F.when(v.isNull() | F.isnan(v), None).otherwise(v)


def mean_sample_std(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, mean, std (n - 1; 0 for one value; null without values), n."""
    v = clean(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), F.count(v).alias("n"))


def mean_population_std(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, mean, std (n), n, min, max; keys without values are left out."""
    v = clean(F.col(value).cast("double"))
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.filter("n > 0")


def config_of(run: Column) -> Column:
    """The run's name without its trailing seed."""
    return F.regexp_replace(run, r"_s\d+$", "")


def seed_of(run: Column) -> Column:
    return F.nullif(F.regexp_extract(run, r"_s(\d+)$", 1), F.lit("")).try_cast("int")


def spread(means: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spread (greatest less least mean) where there are at least two."""
    return means.groupBy(*keys).agg((F.max("mean") - F.min("mean")).alias("spread"), F.count("mean").alias("_n")).filter("_n > 1").drop("_n")


def effects(base: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """keys, delta, effect (delta in the baseline's standard deviations, null if that is 0)."""
    b = base.select(*keys, F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    c = control.select(*keys, F.col("mean").alias("control_mean"))
    d = b.join(c, keys).withColumn("delta", F.col("control_mean") - F.col("base_mean"))
    return d.withColumn("effect", F.when(F.col("base_std") > 0, F.col("delta") / F.col("base_std")))


def verdict(eff: DataFrame, noise: float = 2.0) -> DataFrame:
    return eff.agg(F.avg("delta").alias("mean_delta"), F.max(F.abs("effect")).alias("max_abs_effect")).withColumn("within_noise", F.coalesce(F.col("max_abs_effect") <= noise, F.lit(True)))


def latency(samples: DataFrame, keys: list[str]) -> DataFrame:
    """mean, median, p95 (nearest rank), population std, min, fps of ms, exact.

    The nearest rank value is found by counting equal values, so a task holds distinct values of a
    key at most, and those of one key only.
    """
    from pyspark.sql import Window

    base = samples.groupBy(*keys).agg(F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.stddev_pop("ms").alias("std_ms"), F.min("ms").alias("min_ms"), F.count("ms").alias("n"))
    per = samples.filter("ms is not null").groupBy(*keys, "ms").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("ms")
    cum = per.withColumn("k", F.sum("c").over(w)).join(base.select(*keys, "n"), keys)
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95).cast("long")) + 1
    p95 = cum.filter(F.col("k") >= rank).groupBy(*keys).agg(F.min("ms").alias("p95_ms"))
    return base.join(p95, keys).withColumn("fps", F.try_divide(F.lit(1000.0), F.col("mean_ms")))


def operating_counts(dets: DataFrame, images: DataFrame, conf: float, keys: list[str]) -> DataFrame:
    """keys, n_images, predictions, mean_conf, images_with, frac_with, fp_per_image of detections at or above conf. Both sides have keys and image_id."""
    d = dets.filter(F.col("conf") >= conf).groupBy(*keys, "image_id").agg(F.count("*").alias("_c"), F.sum("conf").alias("_s"))
    d = d.groupBy(*keys).agg(F.sum("_c").alias("predictions"), F.sum("_s").alias("_s"), F.count("*").alias("images_with"))
    n = images.groupBy(*keys).agg(F.count("*").alias("n_images"))
    j = n.join(d, keys, "left").fillna(0, ["predictions", "images_with"])
    return j.select(*keys, "n_images", "predictions", F.try_divide(F.col("_s"), F.col("predictions")).alias("mean_conf"), "images_with",
                    (F.col("images_with") / F.greatest(F.col("n_images"), F.lit(1))).alias("frac_with"), (F.col("predictions") / F.greatest(F.col("n_images"), F.lit(1))).alias("fp_per_image"))


def against_published(counts: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Published figures with what was counted (0 if nothing) and whether they agree."""
    return published.join(counts, keys, "left").withColumn("counted", F.coalesce("counted", F.lit(0))).withColumn("agrees", F.col("counted") == F.col("expected"))


def export_counts(members: DataFrame, images: DataFrame, boxes: DataFrame) -> DataFrame:
    """split, images, boxes, empty, missing, clipped of an export.

    members: split, image_id. images: image_id, width, height (only those whose file is there). boxes:
    image_id, x, y, w, h. Centre and size are taken relative to the image and cut to 0..1; what that
    changes is clipped, what it leaves without area is no box. Images without size have no boxes.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    b = boxes.join(images.filter("width > 0 and height > 0"), "image_id")
    rel = [(F.col("x") + F.col("w") / 2) / F.col("width"), (F.col("y") + F.col("h") / 2) / F.col("height"), F.col("w") / F.col("width"), F.col("h") / F.col("height")]
    changed = F.lit(False)
    for r in rel:
        changed = changed | (unit(r) != r)
    per = b.select("image_id", changed.alias("c"), ((unit(rel[2]) > 0) & (unit(rel[3]) > 0)).alias("k")).groupBy("image_id").agg(F.count_if("c").alias("clipped"), F.count_if("k").alias("boxes"))
    m = members.join(images.select("image_id", F.lit(True).alias("there")), "image_id", "left").join(per, "image_id", "left")
    here = F.coalesce("there", F.lit(False))
    n = lambda c: F.sum(F.when(here, F.coalesce(c, F.lit(0))).otherwise(0)).alias(c)
    return m.groupBy("split").agg(F.count_if(here).alias("images"), n("boxes"), F.count_if(here & (F.coalesce("boxes", F.lit(0)) == 0)).alias("empty"), F.count_if(~here).alias("missing"), n("clipped"))
