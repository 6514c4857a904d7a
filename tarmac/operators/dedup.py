"""Near-duplicates by hash banding, and the reports about their groups.

hashes: image_id, country_id, b0..b3 (16-bit bands of a 64-bit hash). Images with equal hashes and
countries collapse to one representative before any pairing, so a flat frame shared by a third of
all images costs a map-side aggregate and not a bucket of pairs. Links join each member to its
representative and representatives to each other; no link between different hashes is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.components import least_labels, numbered

BANDS = ("b0", "b1", "b2", "b3")


def distance(a: str, b: str):
    out = F.lit(0)
    for k in BANDS:
        out = out + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return out


def representatives(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct hashes per country with their least image id (rep), and image_id -> rep."""
    keys = ["country_id", *BANDS]
    reps = hashes.groupBy(*keys).agg(F.min("image_id").alias("rep"), F.count("*").alias("n"))
    return reps, hashes.join(reps.select(*keys, "rep"), keys).select("image_id", "rep")


def near_pairs(reps: DataFrame, limit: int = 4, exact: bool = True) -> DataFrame:
    """a, b, distance of representatives of one country within the limit.

    exact=False pairs hashes that share at least one whole band, the classic blocking: it misses
    pairs whose differing bits touch every band. exact=True cuts the 64 bits into limit + 1 pieces,
    one of which any pair within the limit must share.
    """
    if exact:
        size = 64 // (limit + 1)
        bits = F.concat(*(F.lpad(F.bin(F.col(k).cast("long")), 16, "0") for k in BANDS))
        cuts = [(i * size + 1, size if i < limit else 64 - i * size) for i in range(limit + 1)]
        pieces = F.array(*(F.substring(bits, s, n) for s, n in cuts))
    else:
        pieces = F.array(*(F.col(k).cast("string") for k in BANDS))
    cells = reps.select("country_id", "rep", *BANDS, F.posexplode(pieces).alias("band", "piece"))
    keys = ["country_id", "band", "piece"]
    a = cells.select(*keys, F.col("rep").alias("a"), *(F.col(k).alias(f"a_{k}") for k in BANDS))
    b = cells.select(*keys, F.col("rep").alias("b"), *(F.col(k).alias(f"b_{k}") for k in BANDS))
    return a.join(b, keys).filter("a < b").withColumn("distance", distance("a_", "b_")).filter(F.col("distance") <= limit).select("a", "b", "distance").distinct()


def near_in_sequence(hashes: DataFrame, seqs: DataFrame, max_gap: int, limit: int = 4) -> DataFrame:
    """a, b, distance, gap of images of one country within both limits. seqs: image_id, seq; images without one take no part.

    Images meet by a piece of their hash and by strips of max_gap frames, two of which hold any pair within the gap.
    """
    size = 64 // (limit + 1)
    bits = F.concat(*(F.lpad(F.bin(F.col(k).cast("long")), 16, "0") for k in BANDS))
    pieces = F.array(*(F.substring(bits, i * size + 1, size if i < limit else 64 - i * size) for i in range(limit + 1)))
    rows = hashes.join(seqs.filter("seq is not null"), "image_id").select("country_id", "image_id", "seq", *BANDS, F.posexplode(pieces).alias("band", "piece"))
    strip = F.floor(F.col("seq") / (max_gap + 1))
    keys = ["country_id", "band", "piece", "strip"]
    side = lambda p, s: rows.withColumn("strip", s).select(*keys, F.col("image_id").alias(p), F.col("seq").alias(f"{p}_seq"), *(F.col(k).alias(f"{p}_{k}") for k in BANDS))
    pair = side("a", strip).join(side("b", F.explode(F.array(strip - 1, strip, strip + 1))), keys).filter("a < b")
    pair = pair.withColumn("gap", F.abs(F.col("a_seq") - F.col("b_seq"))).withColumn("distance", distance("a_", "b_"))
    return pair.filter((F.col("gap") <= max_gap) & (F.col("distance") <= limit)).select("a", "b", "distance", "gap").distinct()


def report(members: DataFrame, kept: DataFrame, countries: DataFrame) -> DataFrame:
    """One row: duplicate_groups, drop_count, largest, cross_country_groups. kept: as `keepers` gives it. countries: image_id, country_id."""
    spread = members.join(countries, "image_id").groupBy("cluster_id").agg((F.min("country_id") != F.max("country_id")).alias("cross"))
    return kept.join(spread, "cluster_id", "left").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n_drop"), F.lit(0)).alias("drop_count"), F.max("size").alias("largest"), F.count_if("cross").alias("cross_country_groups"))


def pair_distances(hashes: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """country_id, kind, d: distances of images numbered n and n + 1, and of as many pairs in hashed order.

    Of the adjacent pairs, `sample` per country are taken in hashed order. Random pairs join the k-th
    adjacent pair's first image with the k-th image of another hashed order.
    """
    order = lambda salt, c: F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col(c).cast("string")))
    h = hashes.select("country_id", "image_id", *BANDS)
    nxt = h.select("country_id", (F.col("image_id") - 1).alias("image_id"), *(F.col(k).alias(f"n_{k}") for k in BANDS))
    pairs = numbered(h.join(nxt, ["country_id", "image_id"]).withColumn("o", order("pair", "image_id")), ["o", "image_id"], "k", keys=["country_id"]).filter(F.col("k") <= sample)
    other = numbered(h.withColumn("o", order("other", "image_id")), ["o", "image_id"], "k", keys=["country_id"]).filter(F.col("k") <= sample)
    other = other.select("country_id", "k", F.col("image_id").alias("other"), *(F.col(b).alias(f"r_{b}") for b in BANDS))
    adjacent = pairs.select("country_id", F.lit("adjacent").alias("kind"), distance("", "n_").alias("d"))
    random = pairs.join(other, ["country_id", "k"]).filter("image_id <> other").select("country_id", F.lit("random").alias("kind"), distance("", "r_").alias("d"))
    return adjacent.unionByName(random)


def locality(distances: DataFrame) -> DataFrame:
    """country_id, and median and share within 4 of both kinds of pairs; temporal: adjacent images are nearer by more than 2."""
    of = lambda kind, f: F.when(F.col("kind") == kind, f)
    g = distances.groupBy("country_id").agg(*(x for k in ("adjacent", "random") for x in (F.median(of(k, F.col("d"))).alias(f"median_{k}"), (100.0 * F.count_if((F.col("kind") == k) & (F.col("d") <= 4)) / F.count_if(F.col("kind") == k)).alias(f"pct_{k}"))))
    return g.filter("median_adjacent is not null and median_random is not null").withColumn("temporal", F.col("median_adjacent") < F.col("median_random") - 2)


def clusters(hashes: DataFrame, limit: int = 4, exact: bool = True) -> DataFrame:
    """image_id, cluster_id (least image id) of images with a near-duplicate."""
    reps, members = representatives(hashes)
    labels = least_labels(near_pairs(reps, limit, exact).select("a", "b"))
    placed = members.join(labels, members["rep"] == labels["node"], "left").select("image_id", F.coalesce("label", "rep").alias("cluster_id"))
    many = placed.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id")
    return placed.join(many, "cluster_id").select("image_id", "cluster_id")


def keepers(members: DataFrame, counts: DataFrame) -> DataFrame:
    """cluster_id, keep_id, size, n_drop: the member with most annotations, then the least name. counts: image_id, file_name, n."""
    m = members.join(counts, "image_id", "left")
    best = F.struct(F.coalesce("n", F.lit(0)).alias("n"))
    # The least name wins among the most annotated: a two-step minimum keeps it a partial aggregate.
    return m.groupBy("cluster_id").agg(F.min_by("image_id", F.struct((-best["n"]).alias("k"), F.col("file_name"), F.col("image_id"))).alias("keep_id"), F.count("*").alias("size")).withColumn("n_drop", F.col("size") - 1)


def group_sizes(groups: DataFrame) -> DataFrame:
    """size, n_groups, n_drops, share of all drops."""
    g = groups.groupBy("size").agg(F.count("*").alias("n_groups")).withColumn("n_drops", (F.col("size") - 1) * F.col("n_groups"))
    # One row per size: the window over all of them is small.
    total = F.greatest(F.sum("n_drops").over(Window.partitionBy()), F.lit(1))
    return g.select("size", "n_groups", "n_drops", (F.col("n_drops") / total).alias("share"))


def gap_medians(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """cluster_id, size, median_gap of the sorted frame numbers (null below two numbers). seqs: image_id, seq.

    Gaps come from a window over one cluster; clusters are groups of near-duplicate frames.
    """
    w = Window.partitionBy("cluster_id").orderBy("seq")
    g = members.join(seqs, "image_id").withColumn("gap", F.when(F.col("seq").isNotNull(), F.col("seq") - F.lag(F.col("seq")).over(w)))
    return g.groupBy("cluster_id").agg(F.count("*").alias("size"), F.median("gap").alias("median_gap"))


def suspects(medians: DataFrame, size: int = 5, gap: int = 10) -> DataFrame:
    """Large groups of scattered frames, probably hash collisions."""
    return medians.filter((F.col("size") >= size) & (F.col("median_gap") > gap))
