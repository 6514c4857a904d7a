"""Matching of detections to ground truth.

gt: image_id, cls, gt_id, x0..y1. pred: image_id, cls, pred_id, conf, x0..y1. Ids are totally
ordered and break ties. Boxes meet by image, class and the cells they cover, so a crowded image
doesn't compare all with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geometry as G
from tarmac.operators.components import least_labels
from tarmac.operators.sweep import chains, doubles, lined_up
from tarmac.session import cut

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
CELL = 1024


def overlaps(gt: DataFrame, pred: DataFrame, least: float = 0.5, single: bool = False) -> DataFrame:
    """image_id, cls, gt_id, pred_id, conf, iou of all pairs of one image and class with iou >= least (> 0)."""
    def cells(df: DataFrame, p: str, keep: list[str]) -> DataFrame:  # noqa: E306
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL))
        out = df.filter("x1 > x0 and y1 > y0").select("image_id", "cls", *keep, *(F.col(k).alias(f"{p}{k}") for k in ("x0", "y0", "x1", "y1")))
        return out.withColumn("_cx", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("_cy", F.explode(span(f"{p}y0", f"{p}y1")))

    pair = cells(gt, "g_", ["gt_id"]).join(cells(pred, "p_", ["pred_id", "conf"]), ["image_id", "cls", "_cx", "_cy"])
    # A pair that shares several cells is kept in the one where its intersection starts.
    at = lambda k: F.floor(F.greatest(f"g_{k}", f"p_{k}") / CELL)
    pair = pair.filter((F.col("_cx") == at("x0")) & (F.col("_cy") == at("y0")))
    value = G.iou_single("g_", "p_").cast("double") if single else G.iou("g_", "p_")
    return pair.withColumn("iou", value).filter((F.col("iou") >= least) & (F.col("iou") > 0)).select("image_id", "cls", "gt_id", "pred_id", "conf", "iou")


def true_masks(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """image_id, cls, gt_id, pred_id, mask: the thresholds, as bits, at which a detection is true.

    Each detection takes its best ground truth, each ground truth its most confident detection. The
    best ground truth is the same at every threshold a detection reaches, so it is chosen once; a
    detection then is true at the thresholds up to its overlap that no more confident one has reached.
    """
    w = Window.partitionBy("image_id", "cls", "pred_id").orderBy(F.desc("iou"), "gt_id")
    best = pairs.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    before = F.max("iou").over(Window.partitionBy("image_id", "cls", "gt_id").orderBy(F.desc("conf"), "pred_id").rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_had", F.coalesce(before, F.lit(-1.0)))
    mask = F.lit(0)
    for i, t in enumerate(thresholds):
        mask = mask + F.when((F.col("iou") >= t) & (F.col("_had") < t), 1 << i).otherwise(0)
    return best.select("image_id", "cls", "gt_id", "pred_id", mask.alias("mask")).filter("mask <> 0")


def marked(boxes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, least: float = 0.5, place: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """subset, cls, pred_id, conf, mask of every detection, as `true_masks` has it (0: true nowhere); and counts of ground truth, as rows with n.

    boxes: subset, image_id, cls, id, gt (whether it is ground truth), conf, x0..y1. Pairs are found and settled
    where an image's boxes are, and never written. place: gives the range (part) of rows by their cls, conf, image_id
    and id, as numbers; the rows then also have image_id and part.
    """
    kind = dict(boxes.dtypes)
    sides = ("x0", "y0", "x1", "y1")

    def iou(t: pa.Table):
        c = {k: doubles(t, k) for k in sides}
        area = (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])

        def value(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            w, h = (np.minimum(c[f"{k}1"][i], c[f"{k}1"][j]) - np.maximum(c[f"{k}0"][i], c[f"{k}0"][j]) for k in "xy")
            lap = w * h
            with np.errstate(all="ignore"):
                return np.where((w > 0) & (h > 0), lap / (area[i] + area[j] - lap), 0.0)

        return value

    def linked(t: pa.Table):
        gt, value = t.column("gt").to_numpy(), iou(t)
        return lambda i, j: (gt[i] != gt[j]) & ((v := value(i, j)) >= least) & (v > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in chains(batches, ["image_id", "cls"], "x0", "x1", 0.0, linked):
            gt, conf = t.column("gt").to_numpy(), doubles(t, "conf")
            g, p = np.where(gt[a], a, b), np.where(gt[a], b, a)
            v = iou(t)(g, p)
            nth = np.empty(t.num_rows, int)
            nth[pc.sort_indices(t.column("id")).to_numpy()] = np.arange(t.num_rows)
            order = np.lexsort((nth[g], -v, p))
            order = order[np.diff(p[order], prepend=-1) != 0]
            g, p, v = g[order], p[order], v[order]
            order = np.lexsort((nth[p], -conf[p], g))
            g, p = g[order], p[order]
            # Thresholds reached, and the most that a more confident detection of the same ground truth has reached.
            level = np.searchsorted(np.asarray(thresholds), v[order], side="right")
            part = np.cumsum(np.diff(g, prepend=-1) != 0) * 64
            most = np.maximum.accumulate(level + part) - part if len(g) else level
            had = np.where(np.diff(g, prepend=-1) != 0, 0, np.append(0, most[:-1])) if len(g) else level
            mask = np.zeros(t.num_rows, "int32")
            mask[p] = (1 << level) - (1 << np.minimum(had, level))
            kept = t.filter(pa.array(~gt))
            rows = {"subset": kept.column("subset"), "cls": kept.column("cls"), "pred_id": kept.column("id"), "conf": kept.column("conf"), "mask": pa.array(mask[~gt]), "n": pa.nulls(kept.num_rows, pa.int64())}
            at = {"image_id": kept.column("image_id"), "part": pa.array(place(*(kept.column(k).to_numpy() for k in ("cls", "conf", "image_id", "id"))), pa.int32())} if place else {}
            yield from pa.table(rows | at).to_batches()
            n = t.filter(pa.array(gt)).group_by(["subset", "cls"]).aggregate([([], "count_all")])
            none = lambda k: pa.nulls(n.num_rows, t.schema.field(k).type)  # noqa: B023, E731
            rows = {"subset": n.column("subset"), "cls": n.column("cls"), "pred_id": none("id"), "conf": none("conf"), "mask": pa.array(np.zeros(n.num_rows, "int32")), "n": n.column("count_all")}
            at = {"image_id": none("image_id"), "part": pa.array(np.arange(n.num_rows, dtype="int32") % 16)} if place else {}
            yield from pa.table(rows | at).to_batches()

    needs = ["subset", "image_id", "cls", "id", "gt", "conf", *sides]
    more = f", image_id {kind['image_id']}, part int" if place else ""
    return lined_up(boxes.select(*needs), ["image_id", "cls"], "x0").mapInArrow(run, f"subset string, cls {kind['cls']}, pred_id {kind['id']}, conf {kind['conf']}, mask int, n long{more}")


def exploded(masks: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row per threshold (thr) of a mask."""
    each = F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(t))) for i, t in enumerate(thresholds)))
    return masks.withColumn("thr", F.explode(F.array_compact(each))).drop("mask")


def true_positives(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """image_id, cls, thr, gt_id, pred_id of all true detections at every threshold."""
    return exploded(true_masks(pairs, thresholds), thresholds).select("image_id", "cls", "thr", "gt_id", "pred_id")


def greedy(gt: DataFrame, pred: DataFrame, min_conf: float = 0.25, least: float = 0.5) -> DataFrame:
    """image_id, cls, gt_id, pred_id of the matcher that takes detections by confidence, each its best ground truth still free.

    Only overlapping pairs reach the sequential step, and each chain of pairs that share a box is settled by itself,
    so an image of any number of boxes meets no task as a whole.
    """
    pairs = overlaps(gt, pred, least).filter(F.col("conf") >= min_conf)
    kind = dict(pairs.dtypes)
    # Sorting is the engine's: falling confidence, detection, falling overlap, ground truth.
    line = F.struct((-F.col("conf")).alias("c"), F.col("pred_id").alias("p"), (-F.col("iou")).alias("i"), F.col("gt_id").alias("g"))
    pairs = cut(pairs)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    chains = least_labels(pairs.select("image_id", "cls", node("g", "gt_id").alias("a"), node("p", "pred_id").alias("b")), near=["image_id", "cls"])
    pairs = pairs.withColumn("node", node("g", "gt_id")).join(chains, "node")
    lists = pairs.groupBy("image_id", "cls", "label").agg(F.array_sort(F.collect_list(line)).alias("l")).select("image_id", "cls", F.col("l.p").alias("p"), F.col("l.g").alias("g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image, cls, ps, gs in pdf.itertuples(index=False, name=None):
                taken, used = set(), set()
                for p, g in zip(ps, gs, strict=True):
                    if p not in used and g not in taken:
                        used.add(p)
                        taken.add(g)
                        out.append((image, cls, g, p))
            yield pd.DataFrame(out, columns=["image_id", "cls", "gt_id", "pred_id"])

    return lists.mapInPandas(run, f"image_id {kind['image_id']}, cls {kind['cls']}, gt_id {kind['gt_id']}, pred_id {kind['pred_id']}")


def false_negatives(gt: DataFrame, pred: DataFrame, images: DataFrame, report_conf: float = 0.25, floor_conf: float = 0.001) -> DataFrame:
    """Ground truth missed at report_conf: its box, size and share of the image, and whether a detection at floor_conf finds it."""
    hit = greedy(gt, pred, report_conf).select("gt_id")
    low = greedy(gt, pred, floor_conf).select("gt_id", F.lit(True).alias("_low"))
    size = images.select("image_id", "country", "stem", "width", "height")
    miss = gt.join(hit, "gt_id", "left_anti").join(low, "gt_id", "left").join(size, "image_id")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return miss.select(
        "gt_id", F.col("stem").alias("image"), "country", "cls", "x0", "y0", "x1", "y1", w.alias("box_w"), h.alias("box_h"), (w * h).alias("box_area_px"),
        ((w * h).cast("double") / (F.col("width") * F.col("height"))).alias("box_area_frac"), F.col("width").alias("image_w"), F.col("height").alias("image_h"),
        F.coalesce("_low", F.lit(False)).alias("detected_at_floor"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
