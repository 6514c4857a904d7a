"""Grouped train/val splits and their manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.components import numbered


def groups_of(images: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """country, group_key, size; images without a cluster stand alone. images: image_id, country."""
    img = images if clusters is None else images.join(clusters, "image_id", "left")
    key = F.concat(F.lit("solo:"), F.col("image_id").cast("string"))
    return img.withColumn("group_key", key if clusters is None else F.coalesce(F.col("cluster_id").cast("string"), key))


def greedy_split(grouped: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """country, group_key, split: which groups of each country go to val, in hashed order.

    With v images in val so far and a target of fraction times the country's images, a group of n
    goes to val if it halves the way or more: v + n - target < target - v. A country always keeps a
    group in train. Order is a hash of seed and key, so it doesn't depend on the order of the input.

    The rule looks at one group after the other. The engine sorts (and spills) the groups of a
    country, which then stream by: a country of any size takes constant memory.
    """
    sizes = grouped.groupBy("country", "group_key").agg(F.count("*").alias("n"))
    of_country = sizes.groupBy(F.col("country").alias("_c")).agg((F.sum("n") * F.lit(fraction)).alias("target"), F.count("*").alias("groups"))
    line = sizes.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "group_key"), 256)).join(of_country, F.col("country").eqNullSafe(F.col("_c")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = object()
        val = left = 0
        kept = False  # whether train has a group
        for pdf in batches:
            out = []
            for country, n, target, groups in zip(pdf["country"], pdf["n"], pdf["target"], pdf["groups"], strict=True):
                if country != now:
                    now, val, left, kept = country, 0, groups, False
                left -= 1
                closer = val + n - target < target - val and (kept or left > 0)
                val += n if closer else 0
                kept = kept or not closer
                out.append("val" if closer else "train")
            yield pd.DataFrame({"country": pdf["country"], "group_key": pdf["group_key"], "split": out})

    return line.repartition("country").sortWithinPartitions("country", "h").select("country", "group_key", "n", "target", "groups").mapInPandas(run, "country string, group_key string, split string")


def stream_hash(df: DataFrame, key: str, order: Column, text: Column, between: str = "", after: str = "") -> DataFrame:
    """key, n, sha256 of each key's texts in order, joined by `between` and ended by `after`.

    Rows of a key are sorted (and spilled) by the engine and hashed as they stream by, so a key of
    any size takes constant memory. Nulls of key or text are left out.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), order.alias("o"), text.cast("string").alias("t")).filter("k is not null and t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, n = None, None, 0
        done = []
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if k != now:
                    if digest is not None:
                        digest.update(after.encode())
                        done.append((now, n, digest.hexdigest()))
                    now, digest, n = k, hashlib.sha256(), 0
                digest.update(((between if n else "") + t).encode())
                n += 1
            if done:
                yield pd.DataFrame(done, columns=["k", "n", "sha256"])
                done = []
        if digest is not None:
            digest.update(after.encode())
            yield pd.DataFrame([(now, n, digest.hexdigest())], columns=["k", "n", "sha256"])

    out = rows.repartition("k").sortWithinPartitions("k", "o").select("k", "t").mapInPandas(run, "k string, n long, sha256 string")
    return out.withColumnRenamed("k", key)


def id_hashes(df: DataFrame, key: str, ids: str = "id") -> DataFrame:
    """Hash of the ids in numeric order, joined by commas."""
    return stream_hash(df, key, F.col(ids), F.col(ids), ",")


def name_hashes(df: DataFrame, key: str, names: str = "name") -> DataFrame:
    """Hash of the sorted names, a line break after each."""
    return stream_hash(df, key, F.col(names), F.concat(F.col(names), F.lit("\n")))


def tail_split(names: DataFrame, key: str, fraction: float) -> DataFrame:
    """The last max(1, round(n * fraction)) names of each key are val, the others train. names: key, name."""
    n = names.groupBy(key).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction), 0).cast("long")).alias("_v"), F.count("*").alias("_n"))
    placed = numbered(names, ["name"], "_k", keys=[key])
    return placed.join(n, key).withColumn("split", F.when(F.col("_k") > F.col("_n") - F.col("_v"), "val").otherwise("train")).drop("_k", "_n", "_v")
