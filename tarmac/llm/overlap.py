"""Same or near-same records across splits, by Aho-Corasick scans of sharded evaluation passages.

Every evaluation image (val, test) gives normalised passages: its frame name, and for every box
each grid cell that a box within the tolerance could lie in. Every training image gives a text: its
frame name and the one cell of each box. Passages are sharded by hash; each shard compiles its
distinct passages into an Aho-Corasick automaton and streams the training texts sent to it. Matched
intervals merge into a coverage per training record: a record with fewer covered boxes than a match
needs is dropped, and of c covered boxes, of which `need` must pair, any c - need + 1 hold a paired
one, so only that many probes, those with the rarest passages, look up evaluation records. An exact
check follows: box pairs within the tolerance, then the largest one-to-one pairing.

No step gathers a group that grows with the data: shards stream, tokens that a large share of the
texts hold are spread over several shards, probes are numbered over ranges of (record, rarity), boxes
meet in near vertical strips, and only box pairs that share boxes, directly or not, are matched
together. All records go the same way, whatever their number of boxes.

Edge cases: nulls in id, category, box or size, non-finite numbers, boxes without positive width or
height and images without positive size give no box; images in no split take no part; repeated ids
count once; boxes with equal coordinates pair one to one; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm import names
from tarmac.operators.components import least_labels, numbered
from tarmac.session import cut

TOLERANCE = 0.01
CELL = 0.05  # side of a grid cell, a fraction of the image
MIN_BOXES = 3
SLACK = 1e-9  # for rounding in the grid only; the exact check has none
SHARD_ROWS = 200_000
SPREAD = 16


def need(n: Column) -> Column:
    """Least number of paired boxes for a record of n boxes: at least 3, at least 0.8 n, in whole numbers."""
    return F.greatest(F.lit(MIN_BOXES), F.floor((4 * n + 4) / 5).cast("int"))


def split_images(images: DataFrame) -> DataFrame:
    """Cut, as several steps read it: image_id, split, source, frame, w, h of every image in a split, once each."""
    src = F.lower(F.regexp_replace("source_dataset", r"[^0-9\p{L}]", "")) if "source_dataset" in images.columns else F.lit(None).cast("string")
    one = images.filter("id is not null").groupBy(F.col("id").alias("image_id")).agg(
        F.max(F.struct(names.split_of(F.col("split_hint")).alias("split"), src.alias("source"), names.frame_key(F.col("file_name")).alias("frame"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))).alias("i"))
    return cut(one.select("image_id", "i.*").filter("split is not null"))


def boxes(known: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, train, n, box, cat and the edges as fractions, of images with at least three counting boxes. known: as `split_images` gives it."""
    b = F.col("bbox")
    edge = [F.get(b, i).cast("double") for i in range(4)]
    a = annotations.select("id", "image_id", F.col("category_id").alias("cat"), *(e.alias(k) for e, k in zip(edge, "xywh", strict=True)))
    finite = " and ".join(f"{k} between -1e15 and 1e15" for k in "xywh")
    a = a.filter(f"id is not null and image_id is not null and cat is not null and w > 0 and h > 0 and {finite}")
    a = a.groupBy("id").agg(F.max(F.struct("image_id", "cat", "x", "y", "w", "h")).alias("r")).select("id", "r.*")
    counts = a.groupBy("image_id").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") >= MIN_BOXES)
    sized = known.filter("w > 0 and h > 0").select("image_id", (F.col("split") == "train").alias("train"), F.col("w").alias("iw"), F.col("h").alias("ih"))
    return a.join(sized.join(counts, "image_id"), "image_id").select(
        "image_id", "train", "n", F.col("id").alias("box"), "cat",
        (F.col("x") / F.col("iw")).alias("l"), (F.col("y") / F.col("ih")).alias("t"),
        ((F.col("x") + F.col("w")) / F.col("iw")).alias("r"), ((F.col("y") + F.col("h")) / F.col("ih")).alias("b"),
    )


def _cell(v: Column) -> Column:
    return F.greatest(F.lit(-100.0), F.least(F.lit(1000.0), F.floor(v / CELL).cast("double"))).cast("int")


def _within(v: Column, cell: Column) -> Column:
    """Place of a value relative to its cell in 1/256 of the cell's side, for a coarse check without the exact values."""
    return F.greatest(F.lit(-4096.0), F.least(F.lit(4096.0), F.floor((v / CELL - cell) * 256).cast("double"))).cast("int")


def _token(*cells: Column) -> Column:
    return F.concat(F.lit(";"), F.concat_ws(",", "cat", *cells), F.lit(";"))


def texts(b: DataFrame) -> DataFrame:
    """One token per training box, and its place in the cell as four bytes and two bits each (code)."""
    out = b.filter("train").withColumn("token", _token(*(_cell(F.col(c)) for c in "ltrb")))
    code = F.lit(0).cast("long")
    for c in "ltrb":
        code = code * 16384 + (_within(F.col(c), _cell(F.col(c))) + 8192)
    return out.withColumn("code", code)


def _decoded(i: int) -> Column:
    return F.expr(f"cast(shiftright(code, {14 * (3 - i)}) & 16383 as int) - 8192")


def passages(b: DataFrame) -> DataFrame:
    """Every token that a box within the tolerance of an evaluation box could have."""
    out = b.filter("not train")
    for c in "ltrb":
        lo, hi = _cell(F.col(c) - (TOLERANCE + SLACK)), _cell(F.col(c) + (TOLERANCE + SLACK))
        out = out.withColumn(f"c_{c}", F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))))
    return out.select("image_id", "n", *(_within(F.col(c), F.col(f"c_{c}")).alias(f"q_{c}") for c in "ltrb"), _token(*(F.col(f"c_{c}") for c in "ltrb")).alias("token"))


HIT = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("image_id", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("box", T.LongType()), T.StructField("code", T.LongType()), T.StructField("freq", T.LongType()),
])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard: its passages come first and become an automaton, then its texts stream through."""
    auto, ready = ahocorasick.Automaton(), False
    for pdf in batches:
        is_text = pdf["kind"].to_numpy() == 1
        for token, freq in zip(pdf["token"][~is_text], pdf["freq"][~is_text], strict=True):
            auto.add_word(token, int(freq))
        rows = pdf[is_text]
        if not len(rows) or not len(auto):
            continue
        if not ready:
            auto.make_automaton()
            ready = True
        token = rows["token"].tolist()
        last = np.cumsum([len(t) for t in token]) - 1
        hits = [(end, freq) for end, freq in auto.iter("".join(token))]
        if not hits:
            continue
        at = np.searchsorted(last, [e for e, _ in hits])
        out = rows.iloc[at][["token", "image_id", "n", "box", "code"]].copy()
        out["freq"] = [f for _, f in hits]
        yield out


def scan(pats: DataFrame, text: DataFrame, n_rows: int) -> DataFrame:
    """The text rows (token, image_id, n, box, code) whose token is a passage, with freq of the passage. n_rows: about how many rows both have."""
    spark = text.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // SHARD_ROWS + 1)
    # Tokens that hold more than a quarter of a shard's share: at most 4 times as many as there are shards.
    heavy = text.groupBy("token").count().filter(F.col("count") > max(n_rows // (4 * shards), 1000)).select("token", F.lit(True).alias("heavy"))
    heavy = F.broadcast(cut(heavy))
    pats = pats.join(heavy, "token", "left").withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    text = text.join(heavy, "token", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("box", "image_id"), F.lit(SPREAD)).cast("int")).otherwise(0))
    null = lambda t: F.lit(None).cast(t)
    both = pats.select(F.lit(0).alias("kind"), "token", "salt", null("long").alias("image_id"), null("int").alias("n"), null("long").alias("box"), null("long").alias("code"), "freq").unionByName(
        text.select(F.lit(1).alias("kind"), "token", "salt", "image_id", "n", "box", "code", null("long").alias("freq")))
    return both.repartition(shards, "token", "salt").sortWithinPartitions("kind").mapInPandas(_scan, HIT)


def probes(hits: DataFrame) -> DataFrame:
    """The hits that must look up evaluation records: image_id, n, token, code."""
    covered = hits.groupBy("image_id").agg(F.count("*").alias("covered"), F.max("n").alias("_n")).filter(F.col("covered") >= need(F.col("_n"))).select("image_id", "covered")
    few = hits.join(covered, "image_id").select("image_id", "n", "token", "code", "freq", "box", "covered")
    few = numbered(few, ["freq", "token", "box"], "k", keys=["image_id"]).filter(F.col("k") <= F.col("covered") - need(F.col("n")) + 1)
    return few.select("image_id", "n", "token", "code")


def pairing(edges: list[tuple[int, int]]) -> int:
    """Size of the largest one-to-one pairing, by augmenting paths without recursion."""
    adj: dict[int, list[int]] = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    mate: dict[int, int] = {}
    size = 0
    for root in adj:
        path, its, seen = [root], [iter(adj[root])], set()
        via: list[int] = []
        while path:
            for b in its[-1]:
                if b in seen:
                    continue
                seen.add(b)
                via.append(b)
                if b not in mate:
                    for a, x in zip(path, via, strict=True):
                        mate[x] = a
                    size += 1
                    path = []
                else:
                    path.append(mate[b])
                    its.append(iter(adj[mate[b]]))
                break
            else:
                path.pop()
                its.pop()
                if via:
                    via.pop()
    return size


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        m = []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            n = min(len(set(a)), len(set(b)))
            m.append(n if n == len(a) else pairing(list(zip(a.tolist(), b.tolist(), strict=True))))
        yield pd.DataFrame({"image_t": pdf["image_t"], "image_e": pdf["image_e"], "n_t": pdf["n_t"], "n_e": pdf["n_e"], "m": m})


def agreeing(b: DataFrame, candidates: DataFrame) -> DataFrame:
    """image_t, image_e of the candidates whose boxes agree. candidates: image_t, image_e, n_t, n_e."""
    near = " and ".join(f"abs({c}_t - {c}_e) <= {TOLERANCE}" for c in "ltrb")

    def side(k: str, keep: str, key: Column | None = None) -> DataFrame:
        cols = [F.col("image_id").alias(f"image_{k}"), F.col("box").alias(f"box_{k}"), "cat", *(F.col(c).alias(f"{c}_{k}") for c in "ltrb")]
        return b.filter(keep).select(*cols, *([] if key is None else [key.alias("strip")]))

    at = F.floor(F.col("l") / TOLERANCE)
    pair = ["image_t", "image_e"]
    edges = candidates.join(side("t", "train", at), "image_t").join(side("e", "not train", F.explode(F.array(at - 1, at, at + 1))), ["image_e", "cat", "strip"]).filter(near)
    edges = cut(edges.select(*pair, "n_t", "n_e", "box_t", "box_e").distinct())
    # The largest pairing of a record pair is the sum of those of its chains of box pairs.
    node = lambda kind, c: F.concat_ws(",", "image_t", "image_e", F.lit(kind), c)
    chains = least_labels(edges.select(*pair, node("e", "box_e").alias("a"), node("t", "box_t").alias("b")), near=pair)
    per = edges.withColumn("node", node("e", "box_e")).join(chains, "node").groupBy(*pair, "n_t", "n_e", "label").agg(F.collect_list("box_t").alias("a"), F.collect_list("box_e").alias("b"))
    m = per.mapInPandas(_paired, "image_t long, image_e long, n_t int, n_e int, m long").groupBy("image_t", "image_e", "n_t", "n_e").agg(F.sum("m").alias("m"))
    return m.filter(f"m >= {MIN_BOXES} and 5 * m >= 4 * greatest(n_t, n_e)").select("image_t", "image_e")


def pairs(known: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_t, image_e of all training and evaluation images that agree by frame or boxes. known: as `split_images` gives it."""
    b = cut(boxes(known, annotations))
    evals = passages(b)
    frames = known.filter("frame is not null").select("image_id", "split", F.concat(F.lit(";#"), "frame", F.lit(";")).alias("token"))
    eval_frames = frames.filter("split <> 'train'")
    pats = evals.groupBy("token").agg(F.count("*").alias("freq")).unionByName(eval_frames.groupBy("token").agg(F.count("*").alias("freq")))
    text = texts(b).select("token", "image_id", "n", "box", "code").unionByName(
        frames.filter("split = 'train'").select("token", "image_id", F.lit(0).alias("n"), F.lit(None).cast("long").alias("box"), F.lit(None).cast("long").alias("code")))
    hits = cut(scan(pats, text, 4 * b.count()))
    ask = probes(hits.filter("n > 0")).withColumnRenamed("image_id", "image_t").withColumnRenamed("n", "n_t")
    look = evals.withColumnRenamed("image_id", "image_e").withColumnRenamed("n", "n_e")
    reach = int(TOLERANCE / CELL * 256) + 2
    close = F.lit(True)
    for i, c in enumerate("ltrb"):
        close = close & (F.abs(F.col(f"q_{c}") - _decoded(i)) <= reach)
    candidates = ask.join(look, "token").filter("5 * n_e >= 4 * n_t and 5 * n_t >= 4 * n_e").filter(close).select("image_t", "image_e", "n_t", "n_e").distinct()
    same = hits.filter("n = 0").select("token", F.col("image_id").alias("image_t")).join(eval_frames.select("token", F.col("image_id").alias("image_e")), "token").select("image_t", "image_e")
    return same.unionByName(agreeing(b, cut(candidates))).distinct()


def found(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_a, image_b, image_a < image_b."""
    return pairs(split_images(images), annotations).select(F.least("image_t", "image_e").alias("image_a"), F.greatest("image_t", "image_e").alias("image_b"))


def report(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """split, source: evaluation images that overlap training, and pairs."""
    known = split_images(images)
    which = known.select(F.col("image_id").alias("image_e"), "split", "source")
    return pairs(known, annotations).join(which, "image_e").groupBy("split", "source").agg(F.count_distinct("image_e").alias("n_images"), F.count("*").alias("n_pairs"))
