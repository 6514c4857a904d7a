"""Chains of boxes that touch, found within the tasks that hold an image's boxes, without pairs or labels on disk.

Boxes come sorted by group (image and class) and left side. A line moves over them from left to
right: a box can only touch later ones that start before the boxes so far have ended, so what lies
behind the line is settled and handed on. A task holds the boxes of a batch and, of a group larger
than that, the chains that the line still meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HELD = 65_536  # rows that are looked at together


def lined_up(df: DataFrame, keys: list[str], lo: str) -> DataFrame:
    """The rows sorted by keys and lo, each group in one task. What is already laid out by some of the keys is not moved again."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(lo))).filter("_n > 0")


def doubles(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return t.column(name).to_numpy().astype("float64")


def groups(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of the groups of sorted rows, from 0."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def touching(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of one group whose spans come as near as gap, by distance of their places."""
    ends, span = np.where(np.isfinite(hi), hi, -np.inf), np.nanmax(np.abs(np.where(np.isfinite(hi), hi, 0.0)), initial=1.0) * 2 + 1
    # The farthest end so far in the group, rounded up; where numbers are too large for that, nothing is left out.
    top = np.maximum.accumulate(ends + g * span) - g * span + 1 if span < 1e6 else np.full(len(g), np.inf)
    j = np.arange(1, len(g))
    d = 1
    while j.size:
        i = j - d
        near = (i >= 0) & (g[i] == g[j]) & ~(lo[j] > top[i] + gap)
        i, j = i[near], j[near]
        meet = lo[j] <= hi[i] + gap
        yield i[meet], j[meet]
        d += 1


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row number of each row's chain of pairs."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def chains(batches: Iterator[pa.RecordBatch], keys: list[str], lo: str, hi: str, gap: float, linked: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], held: int = 0) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole chains, and the row numbers of their linked pairs.

    batches: as `lined_up` sorts them. linked: for a table, whether its rows i and j, which may come
    in either order, are linked.
    """
    held = held or HELD

    def settled(t: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Table]:
        g = groups(t, keys)
        at = t.num_rows if last else int(np.searchsorted(g, g[-1]))
        rest = t.slice(at)
        if rest.num_rows <= held:
            t, g = t.slice(0, at), g[:at]
        x0, x1 = doubles(t, lo), doubles(t, hi)
        link, found = linked(t), [(np.empty(0, int), np.empty(0, int))]
        for i, j in touching(g, x0, x1, gap):
            ok = link(i, j)
            found.append((i[ok], j[ok]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if t.num_rows == at:
            return t, a, b, rest
        # Of a large group, chains that the line still meets wait.
        root = roots(t.num_rows, a, b)
        waits = np.zeros(t.num_rows, bool)
        waits[root[at:][~(x1[at:] + gap < x0[-1])]] = True
        waits = waits[root]
        place = np.cumsum(~waits) - 1
        done = ~waits[a]
        return t.filter(pa.array(~waits)), place[a[done]], place[b[done]], t.filter(pa.array(waits))

    wait, n, need = [], 0, held
    for batch in batches:
        wait.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= need:
            t, a, b, rest = settled(pa.concat_tables(wait).combine_chunks(), False)
            yield t, a, b
            wait, n = [rest], rest.num_rows
            need = max(held, 2 * n)
    if n:
        yield settled(pa.concat_tables(wait).combine_chunks(), True)[:3]
