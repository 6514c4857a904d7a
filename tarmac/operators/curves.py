"""Precision, recall and average precision curves, per subset, class and threshold.

Running counts and maxima go through `running`, so no class or subset has to fit into one task.
Only true positives carry the curve: between two of them the envelope is a straight line whose ends
their ranks and the later maximum give, so false positives count by rank alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.components import ranges, running
from tarmac.session import cut, shared

GRID = 1000
HELD = 65_536  # rows of a range that are looked at together


def ranked(pred: DataFrame) -> DataFrame:
    """pred: subset, cls, pred_id, conf. Adds rank by falling confidence within subset and class, and part, the range it lies in.

    Ranges follow the confidences that there are, so it doesn't matter how these are distributed.
    """
    order = [F.desc("conf"), F.col("pred_id")]
    return running(ranges(pred, ["subset", "cls", *order]), ["subset", "cls"], order, F.lit(1).cast("long"), "rank")


def curve_points(ranks: DataFrame, tps: DataFrame, n_gt: DataFrame) -> DataFrame:
    """subset, cls, thr, k (true positives so far), rank, recall, precision, envelope at every true positive.

    ranks: as `ranked` gives them. tps: pred_id, thr. n_gt: subset, cls, n.
    """
    t = cut(tps.select("pred_id", "thr").join(ranks, "pred_id"))
    t = running(t, ["subset", "cls", "thr"], [F.col("rank")], F.lit(1).cast("long"), "k")
    t = cut(t.join(n_gt, ["subset", "cls"]).withColumn("recall", F.col("k") / F.col("n")).withColumn("precision", F.col("k") / F.col("rank")))
    return running(t, ["subset", "cls", "thr"], [F.desc("rank")], F.col("precision"), "envelope", "max", reverse=True)


def masks(tps: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """pred_id, mask: the thresholds at which a detection is true, as bits. tps: pred_id and mask, or pred_id and thr."""
    if "mask" in tps.columns:
        return tps.select("pred_id", "mask")
    bit = F.lit(0)
    for i, t in enumerate(thresholds):
        bit = F.when(F.abs(F.col("thr") - t) < 1e-9, F.lit(1 << i)).otherwise(bit)
    return tps.groupBy("pred_id").agg(F.bit_or(bit).alias("mask"))


def average_precision(ranks: DataFrame, tps: DataFrame, n_gt: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """subset, cls, thr, ap for every class with ground truth: the envelope at 101 recalls, joined by trapezoids.

    A class without detections has 0; a class without ground truth is left out. All thresholds run
    in one row per detection: counts forwards, envelopes backwards, both within ranges of
    confidence and shifted by the ranges before them. A segment between true positives is spelled out only if
    one of the 101 recalls lies in it.
    """
    n = len(thresholds)
    flag = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    key = ["subset", "cls"]
    rows = cut(ranks.join(masks(tps, thresholds), "pred_id").select(*key, F.col("part").alias("_b"), "rank", "mask"))
    w = Window.partitionBy(*key, "_b").orderBy("rank")
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # Rows that are true nowhere are gone; the one before a row counts as its neighbour only if its rank is one less.
    per = rows.groupBy(*key, "_b").agg(F.max_by(F.struct("rank", "mask"), "rank").alias("last"), *(F.count_if(flag(i)).alias(f"c{i}") for i in range(n)))
    per = per.select(*key, "_b", F.last("last").over(before).alias("last"), *(F.coalesce(F.sum(f"c{i}").over(before), F.lit(0)).alias(f"c{i}") for i in range(n)))
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = rows.select(*key, "_b", "rank", "mask", F.lag(F.struct("rank", "mask")).over(w).alias("prev"), *(F.sum(flag(i).cast("long")).over(up).alias(f"k{i}") for i in range(n)))
    prev = F.coalesce("prev", "last")
    near = F.when(prev["rank"] == F.col("rank") - 1, prev["mask"]).otherwise(F.lit(0))
    k = cut(k.join(per, [*key, "_b"]).select(*key, "_b", "rank", near.alias("near"), *(F.when(flag(i), F.col(f"k{i}") + F.col(f"c{i}")).alias(f"k{i}") for i in range(n))))
    p = lambda i: F.col(f"k{i}") / F.col("rank")
    after = Window.partitionBy(*key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = k.groupBy(*key, "_b").agg(*(F.max(p(i)).alias(f"m{i}") for i in range(n))).select(*key, "_b", *(F.max(f"m{i}").over(after).alias(f"m{i}") for i in range(n)))
    # Backwards by order: a frame that runs to the end of its partition would cost the square of its rows.
    down = Window.partitionBy(*key, "_b").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = k.select(*key, "_b", "rank", "near", *(f"k{i}" for i in range(n)), *(F.max(p(i)).over(down).alias(f"e{i}") for i in range(n))).join(tops, [*key, "_b"]).join(n_gt, key)
    each = F.array(*(F.struct(F.lit(float(t)).alias("thr"), F.col(f"k{i}").alias("k"), F.greatest(f"e{i}", f"m{i}").alias("e"), (F.col("near").bitwiseAND(F.lit(1 << i)) != 0).alias("next")) for i, t in enumerate(thresholds)))
    s = e.select(*key, "n", "rank", F.explode(F.filter(each, lambda x: x["k"].isNotNull())).alias("s")).select(*key, "n", "rank", "s.*")
    s = s.withColumn("x0", (F.col("k") - 1) / F.col("n")).withColumn("x1", F.col("k") / F.col("n"))
    lo, hi = F.floor(F.col("x0") * 100).cast("int"), F.ceil(F.col("x1") * 100).cast("int")
    s = s.filter((hi - lo > 1) | (lo * 0.01 >= F.col("x0")) | (hi * 0.01 < F.col("x1")))
    # The left end is the envelope at the true positive before, if the two are neighbours in rank (the start counts as
    # rank 0 with envelope 1), else what the envelope has fallen to.
    first = F.col("k") == 1
    y0 = F.when(first & (F.col("rank") == 1), 1.0).when(~first & F.col("next"), F.greatest((F.col("k") - 1) / (F.col("rank") - 1), F.col("e"))).otherwise(F.col("e"))
    g = s.withColumn("y0", y0).withColumn("i", F.explode(F.sequence(lo, hi))).withColumn("x", F.col("i") * 0.01).filter("i < 100 and x >= x0 and x < x1")
    y = F.col("y0") + (F.col("e") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    # Trapezoids over equal steps: every point counts 0.01, the first one half; the last (recall 1) is 0.
    ap = g.groupBy(*key, "thr").agg(F.sum(y * F.when(F.col("i") == 0, 0.005).otherwise(0.01)).alias("ap"))
    every = n_gt.select(*key, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("thr"))
    return every.join(ap, [*key, "thr"], "left").select(*key, "thr", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_precision(ap: DataFrame) -> DataFrame:
    """subset, map50, map50_95: unweighted means over the classes with ground truth."""
    per = ap.groupBy("subset", "cls").agg(F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("a50"), F.avg("ap").alias("a"))
    return per.groupBy("subset").agg(F.avg("a50").alias("map50"), F.avg("a").alias("map50_95"), F.count("*").alias("n_classes"))


def confidence_curves(ranks: DataFrame, tps: DataFrame, n_gt: DataFrame) -> DataFrame:
    """subset, cls, i (0..999), p, r: precision and recall at 1000 confidences, linear between detections; thr 0.5.

    Above the greatest confidence precision is 1 and recall 0; below the least they stay as they end.
    """
    key = ["subset", "cls"]
    half = tps.filter("mask & 1 <> 0") if "mask" in tps.columns else tps.filter("thr = 0.5")
    t = cut(ranks.join(half.select("pred_id", F.lit(1).cast("long").alias("tp")), "pred_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0).cast("long"))))
    t = running(t, key, [F.col("rank")], F.col("tp"), "k").join(n_gt, key)
    t = cut(t.select(*key, "part", "conf", "rank", (F.col("k") / F.col("n")).alias("r"), (F.col("k") / F.col("rank")).alias("p")))
    # The next detection is the next row of the range, or the first of the next range that the class has.
    point = F.struct("conf", "r", "p")
    firsts = t.groupBy(*key, "part").agg(F.min_by(point, "rank").alias("first"))
    firsts = firsts.select(*key, "part", F.lead("first").over(Window.partitionBy(*key).orderBy("part")).alias("after"))
    s = t.withColumn("next", F.lead(point).over(Window.partitionBy(*key, "part").orderBy("rank"))).join(firsts, [*key, "part"])
    s = s.withColumn("next", F.coalesce("next", "after")).select(*key, "conf", "r", "p", F.col("next.conf").alias("c1"), F.col("next.r").alias("r1"), F.col("next.p").alias("p1"))
    step = 1.0 / (GRID - 1)
    lo = F.when(F.col("c1").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.col("c1") * (GRID - 1)).cast("int")))
    s = s.withColumn("i", F.explode(F.sequence(lo, F.least(F.lit(GRID - 1), F.ceil(F.col("conf") * (GRID - 1)).cast("int"))))).withColumn("x", F.col("i") * step)
    s = s.filter("x <= conf and (c1 is null or x > c1)")
    w = F.when(F.col("c1").isNull(), F.lit(0.0)).otherwise((F.col("conf") - F.col("x")) / (F.col("conf") - F.col("c1")))
    pts = s.select("subset", "cls", "i", (F.col("p") + w * (F.coalesce("p1", "p") - F.col("p"))).alias("p"), (F.col("r") + w * (F.coalesce("r1", "r") - F.col("r"))).alias("r"))
    top = n_gt.join(ranks.select("subset", "cls").distinct(), ["subset", "cls"], "left_semi").select("subset", "cls", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i"))
    some = top.join(pts, ["subset", "cls", "i"], "left").select("subset", "cls", "i", F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("r", F.lit(0.0)).alias("r"))
    none = n_gt.join(ranks.select("subset", "cls").distinct(), ["subset", "cls"], "left_anti").select("subset", "cls", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r"))
    return some.unionByName(none)


def operating_point(curves: DataFrame) -> DataFrame:
    """subset, i, p, r, f1: means over classes where the box-filtered mean F1 curve (101 wide, edges repeated) first peaks."""
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 1e-16)).otherwise(0.0)
    m = curves.groupBy("subset", "i").agg(F.avg(f).alias("f"), F.avg("p").alias("p"), F.avg("r").alias("r"))
    half = 50
    w = Window.partitionBy("subset").orderBy("i").rowsBetween(-half, half)
    edge = Window.partitionBy("subset").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("f").over(edge), F.last("f").over(edge)
    s = (F.sum("f").over(w) + F.greatest(F.lit(0), half - F.col("i")) * first + F.greatest(F.lit(0), F.col("i") - (GRID - 1 - half)) * last) / (2 * half + 1)
    return m.withColumn("s", F.round(s, 12)).groupBy("subset").agg(F.max_by(F.struct("i", "p", "r", "f"), F.struct(F.col("s"), -F.col("i"))).alias("b")).select("subset", "b.i", "b.p", "b.r", F.col("b.f").alias("f1"))


def mean_of_recalls(ranks: DataFrame, tps: DataFrame, n_gt: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """subset, cls, thr, ap as the mean of the envelope at 101 recalls, without interpolation: an independent cross-check.

    A recall level takes the envelope of the first true positive that reaches it, or 0.
    """
    p = curve_points(ranks, tps, n_gt)
    before = F.coalesce(F.floor((F.col("k") - 1) / F.col("n") * 100 + 1e-9).cast("int") + 1, F.lit(0))
    lo = F.when(F.col("k") == 1, F.lit(0)).otherwise(before)
    hi = F.floor(F.col("k") / F.col("n") * 100 + 1e-9).cast("int")
    ap = p.groupBy("subset", "cls", "thr").agg((F.sum(F.when(hi >= lo, (hi - lo + 1) * F.col("envelope")).otherwise(0.0)) / 101).alias("ap"))
    every = n_gt.select("subset", "cls", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("thr"))
    return every.join(ap, ["subset", "cls", "thr"], "left").select("subset", "cls", "thr", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def bounded(like: DataFrame, rows: int, parts: int) -> Callable[..., np.ndarray]:
    """What gives rows their range, of `parts` that follow cls, falling conf, image_id and id.

    like: rows of these columns, numbers, about as the detections are spread, so that nothing has to be matched to find
    bounds; `rows` is how many. Bounds come from a hash of the ids and decide only how even the ranges are.
    """
    one_in = max(1, rows // (64 * parts))
    some = like.select(F.col("cls").cast("double"), -F.col("conf"), "image_id", "id").filter(F.pmod(F.xxhash64("image_id", "id"), F.lit(one_in)) == 0).dropna()
    got = sorted(tuple(r) for r in some.collect())
    cuts = [got[len(got) * i // parts] for i in range(1, parts)] if got else []
    bounds = [np.array([c[k] for c in cuts]) for k in range(4)]

    def place(cls: np.ndarray, conf: np.ndarray, image: np.ndarray, id_: np.ndarray) -> np.ndarray:
        keys = [np.concatenate(x) for x in zip(bounds, (cls, -conf, image, id_), strict=True)]
        order = np.lexsort(keys[::-1])  # stable: a row that equals a bound comes after it
        part = np.empty(len(order), "int32")
        part[order] = np.cumsum(order < len(cuts))
        return part[len(cuts):]

    return place


class Lines:
    """The curves of marked detections, of all subsets (ALL) and of each, in one pass over detections sorted once.

    marked: as `matching.marked` gives them. They are laid out in ranges of class and confidence, shuffled once and
    kept nowhere else; how many rows and true positives of each subset and class lie before a range goes to the driver.
    If they have their range already (part, of `parts`), equal confidences are in order of image_id and pred_id, and
    matching runs once; else in order of pred_id, and the bounds are sampled from the matched rows.
    """

    def __init__(self, marked: DataFrame, thresholds: tuple[float, ...], parts: int = 0):
        placed = "part" in marked.columns
        order = ["cls", F.desc("conf"), *["image_id"] * placed, "pred_id"]
        parts = parts or int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = shared(marked.repartitionById(parts, F.col("part")) if placed else marked.repartitionByRange(parts, *order))
        self.rows, self.thresholds, self.kind = laid.drop("part").sortWithinPartitions(*order), thresholds, dict(marked.dtypes)
        self.ids = [*["image_id"] * placed, "pred_id"]
        bits = [F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"c{i}") for i in range(len(thresholds))]
        found = laid.groupBy(F.spark_partition_id().alias("at"), "subset", "cls").agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("c"), *bits).collect()
        self.n: dict = {}
        self.before: dict = {}
        so_far: dict = {}
        for r in sorted(found, key=lambda r: r["at"]):
            if r["at"] not in self.before:
                self.before[r["at"]] = dict(so_far)
            for key in {(r.subset, r.cls), ("ALL", r.cls)}:
                if r.n is not None:
                    self.n[key] = self.n.get(key, 0) + r.n
                if r.c:
                    so_far[key] = so_far.get(key, 0) + np.array(r[4:], "int64")

    def ground_truth(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(*k, v) for k, v in self.n.items()], f"subset string, cls {self.kind['cls']}, n long")

    def _walk(self):
        """A function from batches to (subset, cls, n, table, counts) of rows that are true somewhere; counts: rank, then true positives at each threshold."""
        before, n, bits = self.before, self.n, np.arange(len(self.thresholds))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            wait, held = [], 0
            for batch in batches:
                wait.append(batch)
                held += batch.num_rows
                if held >= HELD:
                    yield pa.Table.from_batches(wait).combine_chunks()
                    wait, held = [], 0
            if held:
                yield pa.Table.from_batches(wait).combine_chunks()

        def walk(batches: Iterator[pa.RecordBatch]):
            here = dict(before.get(TaskContext.get().partitionId(), {}))
            for t in joined(batches):
                t = t.filter(t.column("n").is_null())
                if not t.num_rows:  # only counts of ground truth
                    continue
                mask, cls = t.column("mask").to_numpy(), t.column("cls").to_numpy()
                one = np.column_stack((np.ones(t.num_rows, "int64"), (mask[:, None] >> bits) & 1))
                own = t.column("subset").combine_chunks().dictionary_encode()
                for codes, names in ((np.zeros(t.num_rows, int), ["ALL"]), (own.indices.fill_null(len(own.dictionary)).to_numpy(), [*own.dictionary.to_pylist(), None])):
                    order = np.lexsort((codes, cls))
                    at = np.flatnonzero((np.diff(codes[order], prepend=-1) != 0) | (np.diff(cls[order], prepend=cls[:1] - 1) != 0))
                    for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
                        at_rows = order[lo:hi]  # in order of rank, as sorting is stable
                        key = (names[codes[at_rows[0]]], cls[at_rows[0]].item())
                        k = here.get(key, 0) + np.cumsum(one[at_rows], axis=0)
                        here[key] = k[-1]
                        true = mask[at_rows] != 0
                        if key in n and true.any():
                            yield *key, n[key], t.take(pa.array(at_rows[true])), k[true]

        return walk

    def points(self, name: Column | None = None) -> DataFrame:
        """subset, cls, thr, pred_id (and image_id, if ranges were given), rank, k (true positives so far), recall, precision at every true positive.

        name: what pred_id is to be, of these columns; it is made once a detection.
        """
        walk, ids = self._walk(), self.ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for subset, cls, n, t, k in walk(batches):
                rows = t.num_rows
                ks = pa.ListArray.from_arrays(pa.array(np.arange(0, k[:, 1:].size + 1, k.shape[1] - 1), pa.int32()), pa.array(k[:, 1:].ravel()))
                yield from pa.table({"subset": pa.repeat(subset, rows), "cls": pa.repeat(pa.scalar(cls, t.schema.field("cls").type), rows), **{c: t.column(c) for c in ids}, "mask": t.column("mask"), "rank": k[:, 0], "n": pa.repeat(pa.scalar(n, pa.int64()), rows), "k": ks}).to_batches()

        wide = self.rows.mapInArrow(run, f"subset string, cls {self.kind['cls']}, {', '.join(f'{c} {self.kind[c]}' for c in ids)}, mask int, rank long, n long, k array<long>")
        if name is not None:
            wide = wide.select("subset", "cls", name.alias("pred_id"), "mask", "rank", "n", "k")
        rows = wide.withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(len(self.thresholds)))))).filter("shiftright(mask, i) & 1 <> 0")
        thr = F.get(F.array(*(F.lit(float(x)) for x in self.thresholds)), F.col("i"))
        rows = rows.select("subset", "cls", thr.alias("thr"), *(["pred_id"] if name is not None else ids), "rank", F.get("k", F.col("i")).alias("k"), "n")
        return rows.select("*", (F.col("k") / F.col("n")).alias("recall"), (F.col("k") / F.col("rank")).alias("precision")).drop("n")

    def scores(self) -> DataFrame:
        """subset, cls, thr, ap (`average_precision`) and mean (of the envelope at 101 recalls, without interpolation: an independent cross-check).

        The envelope is constant between two true positives, as a rank that is none lies below it. So both scores ask
        at each recall level for the greatest precision among true positives beyond it (mean: at or beyond it): a
        range keeps the greatest precision per number of levels reached.
        """
        walk, thresholds = self._walk(), self.thresholds
        levels = np.arange(100) * 0.01

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for subset, cls, n, t, k in walk(batches):
                mask = t.column("mask").to_numpy()
                for i in range(len(thresholds)):
                    rows = mask & (1 << i) != 0
                    r, p = k[rows, i + 1] / n, k[rows, i + 1] / k[rows, 0]
                    top = best.setdefault((subset, cls, i), np.zeros((2, 102)))
                    np.maximum.at(top[0], np.searchsorted(levels, r), p)
                    np.maximum.at(top[1], np.floor(r * 100 + 1e-9).astype(int) + 1, p)
            out = [(s, c, float(thresholds[i]), kind, b, top[kind, b]) for (s, c, i), top in best.items() for kind in (0, 1) for b in np.flatnonzero(top[kind]).tolist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("subset", "cls", "thr", "kind", "reached", "p"), r, strict=True)) for r in out], schema)

        small = self.rows.select("cls").schema
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("subset", pa.string()), ("cls", to_arrow_type(small["cls"].dataType)), ("thr", pa.float64()), ("kind", pa.int32()), ("reached", pa.int32()), ("p", pa.float64())])
        tops = self.rows.mapInArrow(run, f"subset string, cls {self.kind['cls']}, thr double, kind int, reached int, p double").groupBy("subset", "cls", "thr", "kind", "reached").agg(F.max("p").alias("p"))
        w = Window.partitionBy("subset", "cls", "thr", "kind")
        e = tops.withColumn("e", F.max("p").over(w.orderBy(F.desc("reached")))).withColumn("_from", F.coalesce(F.lag("reached").over(w.orderBy("reached")), F.lit(0)))
        steps = F.col("reached") - F.col("_from")
        half = F.when((F.col("_from") == 0) & (F.col("reached") > 0), 0.5).otherwise(0.0)
        area = F.when(F.col("kind") == 0, F.col("e") * (steps - half) * 0.01).otherwise(F.col("e") * steps / 101)
        got = e.groupBy("subset", "cls", "thr").agg(F.sum(F.when(F.col("kind") == 0, area)).alias("ap"), F.sum(F.when(F.col("kind") == 1, area)).alias("mean"))
        every = self.ground_truth().select("subset", "cls", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("thr"))
        return every.join(got, ["subset", "cls", "thr"], "left").fillna(0.0, ["ap", "mean"])
