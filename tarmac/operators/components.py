"""Connected components by least-label propagation, and numbering without a global sort in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import cut

MAX_ROUNDS = 64  # enough for chains of more links than there could be rows
FOREST_NODES = 1_000_000  # nodes that a task holds while it contracts links


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition contracted to stars: each node with the least node it is linked to, directly or not."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pd.DataFrame:
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        return pd.DataFrame(rows, columns=["u", "v"])

    for pdf in batches:
        for a, b in zip(pdf["u"], pdf["v"], strict=True):
            ra, rb = root(a) if a in parent else parent.setdefault(a, a), root(b) if b in parent else parent.setdefault(b, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > FOREST_NODES:  # hand over what is known: the rounds join it with the rest
            yield stars()
            parent.clear()
    yield stars()


def least_labels(links: DataFrame, near: list[str] | None = None) -> DataFrame:
    """node, label (the least node of its component) of every node that has a link. links: a, b of one ordered type.

    First every task contracts the links it holds to stars, in bounded memory; links with equal
    values of the columns `near` meet in one task, so components that lie within these are done.
    While stars still touch, large-star and small-star rounds alternate: rounds grow with the
    logarithm of the longest chain, every step is a join or a partial aggregate on node keys.
    Nulls and self-links are ignored, repeated links count once.
    """
    kind = dict(links.dtypes)["a"]
    pairs = links.filter("a is not null and b is not null and a <> b")
    pairs = (pairs.repartition(*near) if near else pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = cut(pairs.mapInPandas(_forest, f"u {kind}, v {kind}").distinct())
    for _ in range(MAX_ROUNDS):
        # Stars are whole if no node has two centres and no centre is itself a node with one.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("m")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("c").alias("c"), F.max("m").alias("m")).filter("c > 1 or (c = 1 and m = 1)").head(1):
            break
        # large star: every greater neighbour of a node links to the least one around it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours link to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
    else:
        raise RuntimeError("labels did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows in partitions that are ranges of the given order, numbered along it in `part`; each range holds about as many rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Adds consecutive numbers in the given (total) order, within keys if given.

    Ranges are sorted and numbered in parallel, then shifted by the sizes of the ranges before
    them; only those sizes (one per range and key in it) are gathered.
    """
    keys = keys or []
    ranged = ranges(df, [*keys, *order])
    sizes = ranged.groupBy(*keys, "part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    local = F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order))
    return ranged.join(before, [*keys, "part"]).withColumn(name, (local + F.coalesce("_before", F.lit(0)) + (start - 1)).cast("long")).drop("part", "_before")


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, agg: str = "sum", reverse: bool = False) -> DataFrame:
    """Running sum or max within keys, exact however large a key's group is. df has `part`, as `ranges` gives it.

    Rows run in the given order within their range, and each range adds what those before it (after
    it, if `reverse`) come to; only totals of (keys, part) meet in one task. A frame that runs to the
    end of its partition would cost the square of its rows, so whoever runs backwards orders backwards.
    """
    w = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = {"sum": F.sum, "max": F.max}[agg]
    wb = Window.partitionBy(*keys).orderBy(F.desc("part") if reverse else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "part").agg(f(value).alias("_t")).withColumn("_o", f("_t").over(wb)).drop("_t")
    out = df.withColumn("_r", f(value).over(w)).join(totals, [*keys, "part"])
    both = F.col("_r") + F.coalesce("_o", F.lit(0)) if agg == "sum" else F.greatest("_r", "_o")
    return out.withColumn(name, both).drop("_r", "_o")
