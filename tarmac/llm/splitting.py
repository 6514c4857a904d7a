"""Splitting of oversized tiles into overlapping pieces at natural boundaries.

Dynamic programming over boundary positions. A piece from s may end at s + limit or at the last clean
position before any forbidden run between s + limit/2 and s + limit; the next piece starts overlap
before that end. The starts that can be reached this way are the states. From the right to the left,
each state compares all its ends by the piece's own cost, the cut penalty and the size it falls
short of the limit by, together with the best value of the start that follows. Two ways of adding up:

* ``first`` (default, the rule of the project's data): values are sequences of (cut, shortness)
  compared in order, piece by piece from the left, so no later gain makes up for an earlier loss;
* ``total``: values are sums, ``penalty`` per cut box and the squared relative shortness.

Boxes reach a tile's task as merged forbidden runs of whole positions. They are reduced to one row
per tile and first forbidden position before they are gathered, so a tile gathers at most as many
entries as it has pixels of width, however many boxes lie in it.

Edge cases: tiles with null id, plan or extent, with an unknown plan, or not wider than the limit
give no pieces; repeated tile and box ids count once; boxes with null, NaN or swapped edges
or null or NaN retained don't count, edges beyond a billion pixels are taken as that far; specs with null or senseless values (limit < 2, overlap < 0 or not below
half the limit) raise an error; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = "tile_id long, piece_no int, x0 int, x1 int"


def merged_runs(lo, hi) -> tuple[list[int], list[int]]:
    """Disjoint sorted runs of whole positions from runs [lo, hi], both ends included."""
    starts, ends = [], []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if ends and a <= ends[-1] + 1:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def boundaries(s: int, limit: int, starts: list[int], ends: list[int]) -> list[tuple[int, bool]]:
    """Where a piece from s may end, and whether that cuts: at the limit, or right before a run in the second half."""
    low, high = s + limit // 2 + 1, s + limit
    k = bisect_right(starts, high) - 1
    out = [(high, k >= 0 and ends[k] >= high)]
    while k >= 0 and starts[k] - 1 >= low:  # runs are merged, so what lies right before one is clean
        out.append((starts[k] - 1, False))
        k -= 1
    return out


def pieces(x0: int, x1: int, limit: int, overlap: int, starts: list[int], ends: list[int], objective: str = "first", penalty: float = 10.0) -> list[tuple[int, int]]:
    """The optimal pieces of one extent."""
    todo, ways = [x0], {}
    while todo:
        s = todo.pop()
        if s not in ways:
            ways[s] = boundaries(s, limit, starts, ends) if x1 - s > limit else []
            todo += [e - overlap for e, _ in ways[s]]
    # Values from the right to the left. For ``first`` a value is (cost of the piece, value of the rest): nested pairs compare
    # in order, as the sequences of costs that they are, and share their tails.
    value: dict[int, tuple | float] = {}
    best: dict[int, int] = {}
    for s in sorted(ways, reverse=True):
        if not ways[s]:
            value[s], best[s] = (() if objective == "first" else (1 - (x1 - s) / limit) ** 2), x1
        elif objective == "first":
            cost, rest, e = min(((cut, s + limit - e), value[e - overlap], e) for e, cut in ways[s])
            value[s], best[s] = (cost, rest), e
        else:
            value[s], back = min((penalty * cut + (1 - (e - s) / limit) ** 2 + value[e - overlap], -e) for e, cut in ways[s])
            best[s] = -back
    out, s = [], x0
    while True:
        out.append((s, best[s]))
        if not ways[s]:
            return out
        s = best[s] - overlap


def found(tiles: DataFrame, boxes: DataFrame, specs: DataFrame, objective: str = "first") -> DataFrame:
    """tile_id, piece_no, x0, x1 of every tile wider than its plan's limit."""
    named = specs.select("plan", "limit_px", "overlap_px", "min_retained").filter("plan is not null")
    bad = named.filter("limit_px is null or overlap_px is null or min_retained is null or limit_px < 2 or overlap_px < 0 or overlap_px >= limit_px / 2").head(1)
    if bad:
        raise ValueError(f"plan {bad[0].plan}: {bad[0]}")
    spec = named.select("plan", F.col("limit_px").alias("_limit"), F.col("overlap_px").alias("_overlap"), F.col("min_retained").alias("_least"))
    wide = (
        tiles.select("tile_id", "plan", F.col("x0").alias("_x0"), F.col("x1").alias("_x1")).filter("tile_id is not null")
        .join(spec, "plan").filter("_x1 - _x0 > _limit").dropDuplicates(["tile_id"])
    )
    # A position p is inside a box if x0 < p < x1, in full-image pixels. The same box counted twice forbids nothing more.
    far = lambda c: F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.col(c).cast("double")))
    runs = (
        boxes.filter("not isnan(x0) and not isnan(x1) and not isnan(retained)").select("tile_id", far("x0").alias("_b0"), far("x1").alias("_b1"), "retained").filter("_b1 > _b0")
        .join(wide, "tile_id").filter("retained >= _least")
        .select("tile_id", (F.floor(F.col("_b0")) + 1 + F.col("_x0")).cast("int").alias("lo"), (F.ceil(F.col("_b1")) - 1 + F.col("_x0")).cast("int").alias("hi"), "_x0", "_x1")
        .select("tile_id", F.greatest("lo", "_x0").alias("lo"), F.least("hi", "_x1").alias("hi")).filter("lo <= hi")
        .groupBy("tile_id", "lo").agg(F.max("hi").alias("hi"))
        .groupBy("tile_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    )
    full = wide.join(runs, "tile_id", "left").select("tile_id", "_x0", "_x1", "_limit", "_overlap", "lo", "hi")

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tile, a, b, limit, overlap, lo, hi in pdf.itertuples(index=False, name=None):
                starts, ends = merged_runs(lo.tolist(), hi.tolist()) if lo is not None else ([], [])
                out += [(tile, i, s, e) for i, (s, e) in enumerate(pieces(a, b, limit, overlap, starts, ends, objective), 1)]
            yield pd.DataFrame(out, columns=["tile_id", "piece_no", "x0", "x1"])

    return full.mapInPandas(cut_all, PIECE)
