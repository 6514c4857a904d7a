"""Splits that keep related records together.

Records and the entities they name form a bipartite graph. Every component must land in one split.
Components come from iterative minimum-label propagation: the graph is first folded to entities
(a record links its least entity to its other ones), then each round gives every node and its
greater neighbours the least label around (large star, small star), until no link changes. Rounds
grow with the logarithm of the longest chain. All steps are joins and partial aggregates on node
keys; a hot entity only adds to a map-side minimum, never to a gathered group.

The assignment is stratified: groups become units (each large group alone, small groups hashed
into bins of their main class), and units are placed largest first where the deviation of sizes and
label counts from the targets stays least. Only unit totals reach the driver: at most 1/LARGE_SHARE
large groups and UNITS bins, or one bin per class where there are more classes than that, so their
number doesn't grow with the groups. The splits of `targets` are all taken.

Edge cases: records with null id are left out; records without entity stand alone; repeated rows
count once; entities named by records that don't exist link nothing; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import names
from tarmac.operators.components import least_labels
from tarmac.session import cut

LARGE_SHARE = 0.002  # at most 500 groups stand alone
UNITS = 4096  # bins of small groups, shared out among the classes


def groups(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, group_key of every image (alone ones included), grouped by drive and object.

    An entity is a string that sorts drives before objects: '0' + drive key or '1' + object id.
    """
    drives = cut(images.filter("id is not null").groupBy(F.col("id").alias("image_id")).agg(F.max(names.drive_key(F.col("file_name"))).alias("drive")))
    objects = annotations.select("image_id", names.object_key(F.col("object_uid")).alias("object")).filter("object is not null and image_id is not null").distinct()
    seen = cut(objects.join(drives, "image_id").select("image_id", "object", "drive"))
    # Each image has one home: its drive, or else its least object. Its other entities link to that.
    home = seen.filter("drive is null").groupBy("image_id").agg(F.min("object").alias("least"))
    drive, thing = F.concat(F.lit("0"), "drive"), F.concat(F.lit("1"), "object")
    links = seen.filter("drive is not null").select(drive.alias("a"), thing.alias("b")).unionByName(
        seen.filter("drive is null").join(home, "image_id").select(F.concat(F.lit("1"), "least").alias("a"), thing.alias("b")))
    labels = least_labels(links)
    placed = drives.join(home, "image_id", "left").select("image_id", F.coalesce(drive, F.concat(F.lit("1"), "least")).alias("node"))
    placed = placed.join(labels, "node", "left").select("image_id", F.coalesce("label", "node").alias("label"))
    # Components without a drive are named by their smallest image.
    firsts = placed.filter("label like '1%'").groupBy("label").agg(F.min("image_id").alias("first"))
    named = F.when(F.col("label").startswith("0"), F.expr("substring(label, 2)")).otherwise(F.concat(F.lit("image-"), F.coalesce("first", "image_id")))
    return placed.join(firsts, "label", "left").select("image_id", named.alias("group_key"))


def found(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, group_key of each image that must share its split with another one."""
    g = cut(groups(images, annotations))
    many = g.groupBy("group_key").agg(F.count("*").alias("n")).filter("n > 1").select("group_key")
    return g.join(many, "group_key").select("image_id", "group_key")


def place(units: list[tuple[str, int, dict]], targets: dict[str, float]) -> dict[str, str]:
    """unit -> split: largest first, where the deviation of size and labels from the targets stays least."""
    classes = sorted({c for _, _, h in units for c in h})
    splits = sorted(targets, key=lambda s: (-targets[s], s))
    share = np.array([targets[s] for s in splits]) / sum(targets.values())
    column = {c: i + 1 for i, c in enumerate(classes)}
    total = np.zeros(len(classes) + 1)
    vectors = {}
    for key, n, hist in units:
        v = np.zeros_like(total)
        v[0] = n
        for c, x in hist.items():
            v[column[c]] = x
        vectors[key] = v
        total += v
    weight = 1 / np.maximum(total, 1) ** 2
    weight[0] *= max(len(classes), 1)
    have = np.zeros((len(splits), len(total)))
    goal = np.outer(share, total)
    out = {}
    for key, n, _ in sorted(units, key=lambda u: (-u[1], u[0])):
        v = vectors[key]
        gap = have - goal
        cost = ((2 * gap + v) * v * weight).sum(axis=1)  # growth of the squared deviation
        k = int(np.argmin(cost))
        have[k] += v
        out[key] = splits[k]
    return out


def assign(images: DataFrame, annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """image_id, group_key, split of every image. targets: split, fraction."""
    goal = {r.split: float(r.fraction) for r in targets.filter("split is not null and fraction > 0").collect()}
    if not goal:
        raise ValueError("no split has a positive fraction")
    g = cut(groups(images, annotations))
    n_images = g.count()
    per_image = annotations.filter("image_id is not null").dropDuplicates(["id"]).groupBy("image_id", F.coalesce(F.col("category_id").cast("long"), F.lit(-1)).alias("c")).agg(F.count("*").alias("n"))
    sizes = g.groupBy("group_key").agg(F.count("*").alias("size"))
    labels = cut(g.join(per_image, "image_id").groupBy("group_key", "c").agg(F.sum("n").alias("n")))
    bins = max(1, UNITS // (labels.select("c").distinct().count() + 1))
    main = labels.groupBy("group_key").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    unit = F.when(F.col("size") > LARGE_SHARE * n_images, F.concat(F.lit("g:"), "group_key")).otherwise(
        F.concat(F.lit("b:"), F.coalesce("main", F.lit(-2)), F.lit(":"), F.pmod(F.xxhash64("group_key"), F.lit(bins))))
    units = cut(sizes.join(main, "group_key", "left").select("group_key", "size", unit.alias("unit")))
    totals = {r.unit: int(r.n) for r in units.groupBy("unit").agg(F.sum("size").alias("n")).collect()}
    hists: dict[str, dict] = {u: {} for u in totals}
    for r in labels.join(units, "group_key").groupBy("unit", "c").agg(F.sum("n").alias("n")).collect():
        hists[r.unit][int(r.c)] = int(r.n)
    placed = place([(u, n, hists[u]) for u, n in totals.items()], goal)
    spark = images.sparkSession
    where = F.broadcast(spark.createDataFrame(list(placed.items()) or [], "unit string, split string"))
    return g.join(units.select("group_key", "unit"), "group_key").join(where, "unit").select("image_id", "group_key", "split")
