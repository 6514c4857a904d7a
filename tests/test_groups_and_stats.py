"""Near-duplicates, splits, statistics, gates and monitoring on literal cases and brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tarmac.operators import components, dedup, gates, monitor, splits, stats


def hashes(spark, rows):
    return spark.createDataFrame([(i, c, *((h >> 16 * k) & 0xFFFF for k in range(4))) for i, c, h in rows], "image_id long, country_id int, b0 int, b1 int, b2 int, b3 int")


def test_blind_spot_of_whole_bands(spark):
    base = 0x1234567890ABCDEF
    spot = base ^ (1 | 1 << 16 | 1 << 32 | 1 << 48)  # distance 4, no equal band
    h = hashes(spark, [(1, 0, base), (2, 0, spot), (3, 0, base ^ 1), (4, 1, base), (5, 0, base)])
    assert {tuple(sorted((r.a, r.b))) for r in dedup.near_pairs(dedup.representatives(h)[0], 4, False).collect()} == {(1, 3), (2, 3)}
    assert {tuple(sorted((r.a, r.b))) for r in dedup.near_pairs(dedup.representatives(h)[0]).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.image_id, r.cluster_id) for r in dedup.clusters(h).collect()} == {(1, 1), (2, 1), (3, 1), (5, 1)}


def test_near_pairs_like_brute_force(spark):
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(15)]
    rows = []
    for i in range(160):
        h = rnd.choice(seeds)
        for _ in range(rnd.randint(0, 5)):
            h ^= 1 << rnd.randint(0, 63)
        rows.append((i, rnd.randint(0, 1), h))
    reps = {}
    for i, c, h in rows:
        reps.setdefault((c, h), i)
    want = {(a, b) for (c, g), a in reps.items() for (d, h), b in reps.items() if a < b and c == d and bin(g ^ h).count("1") <= 4}
    assert {(r.a, r.b) for r in dedup.near_pairs(dedup.representatives(hashes(spark, rows))[0]).collect()} == want


def test_components_and_numbering(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(500, k) for k in range(501, 700)] + [(5, 5), (None, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components.least_labels(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.least_labels(spark.createDataFrame([], "a int, b int")).count() == 0
    vals = [rnd.randint(0, 10**6) for _ in range(500)]
    n = components.numbered(spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v int, i int"), ["v", "i"], "k", 0)
    assert [(r.v, r.i) for r in n.orderBy("k").collect()] == sorted((v, i) for i, v in enumerate(vals)) and {r.k for r in n.collect()} == set(range(500))


def test_running_over_ranges_of_skewed_values(spark):
    rnd = random.Random(5)
    # almost all values in a thousandth of their span, as confidences are
    rows = [("a" if rnd.random() < 0.8 else "b", rnd.random() * (1 if i % 50 == 0 else 0.001), i, rnd.randint(-5, 9)) for i in range(400)]
    df = components.ranges(spark.createDataFrame(rows, "k string, c double, i int, v int"), ["k", "c"])
    sizes = [r["count"] for r in df.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 200
    s = {r.i: r.s for r in components.running(df, ["k"], [F.col("c")], F.col("v"), "s").collect()}
    m = {r.i: r.s for r in components.running(df, ["k"], [F.desc("c")], F.col("v"), "s", "max", True).collect()}
    n = {r.i: r.n for r in components.numbered(df.drop("part"), ["c"], "n", keys=["k"]).collect()}
    for k, c, i, _ in rows:
        assert s[i] == sum(v for q, d, _, v in rows if q == k and d <= c) and m[i] == max(v for q, d, _, v in rows if q == k and d >= c)
        assert n[i] == sum(q == k and d <= c for q, d, *_ in rows)


def test_split_of_groups_keeps_its_promises(spark):
    import hashlib
    from itertools import accumulate

    rnd = random.Random(6)
    rows = [(c, f"k{rnd.randint(0, n)}") for c, n in (("x", 60), ("y", 3), ("z", 0), (None, 9)) for _ in range(200)] + [("one", f"solo{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "country string, group_key string")
    got = {(r.country, r.group_key): r.split for r in splits.greedy_split(df, 0.15, 3).collect()}
    assert len(got) == len(set(rows))  # each group is in one split
    assert got == {(r.country, r.group_key): r.split for r in splits.greedy_split(df.orderBy(F.rand(1)), 0.15, 3).collect()}
    for c in ("x", "y", "z", None, "one"):
        mine = sorted((k for k in got if k[0] == c), key=lambda k: hashlib.sha256(f"3:{k[1]}".encode()).hexdigest())
        size = [rows.count(k) for k in mine]
        in_val = [got[k] == "val" for k in mine]
        goal = 0.15 * sum(size)
        filled = [0, *accumulate(n * v for n, v in zip(size, in_val, strict=True))]
        off = [abs(f - goal) for f in filled]
        assert "train" in {got[k] for k in mine}
        for i, v in enumerate(in_val):
            if v:  # a group went over because val came nearer to its share
                assert off[i + 1] < off[i]
            elif i < len(mine) - 1 or not all(in_val[:i]):  # one stayed because it wouldn't have
                assert abs(filled[i] + size[i] - goal) >= off[i]


def test_last_names_of_each_key(spark):
    rnd = random.Random(8)
    rows = [(k, f"n{rnd.randint(0, 10**6):06}") for k, n in (("a", 300), ("b", 1), ("c", 7), ("hot", 2000)) for _ in range(n)]
    got = splits.tail_split(spark.createDataFrame(rows, "k string, name string"), "k", 0.1).collect()
    assert len(got) == len(rows)
    for k, v in (("a", 30), ("b", 1), ("c", 1), ("hot", 200)):
        names = sorted(n for x, n in rows if x == k)
        assert sorted(r.name for r in got if r.k == k and r.split == "val") == names[-v:]


def test_hashes_of_ids(spark):
    import hashlib

    df = spark.createDataFrame([("a", i, f"n{i}") for i in (10, 9, 100)] + [("b", 7, "é"), ("b", None, None), (None, 1, "z")], "k string, id long, name string")
    ids = {r.k: (r.n, r.sha256) for r in splits.id_hashes(df, "k").collect()}
    names = {r.k: r.sha256 for r in splits.name_hashes(df, "k").collect()}
    assert ids == {"a": (3, hashlib.sha256(b"9,10,100").hexdigest()), "b": (1, hashlib.sha256(b"7").hexdigest())}
    assert names == {"a": hashlib.sha256(b"n10\nn100\nn9\n").hexdigest(), "b": hashlib.sha256("é\n".encode()).hexdigest()}
    assert splits.id_hashes(df.limit(0), "k").count() == 0


def test_seed_statistics(spark):
    vals = [0.2364, 0.2377, 0.2374]
    df = spark.createDataFrame([("a", v) for v in vals] + [("a", float("nan")), ("a", None), ("one", 0.5), ("none", None)], "k string, value double")
    s = {r.k: r for r in stats.mean_sample_std(df, ["k"]).collect()}
    p = {r.k: r for r in stats.mean_population_std(df, ["k"]).collect()}
    assert s["a"].mean == pytest.approx(0.2371667, abs=1e-7) and s["a"].std == pytest.approx(0.00068069, abs=1e-8) and p["a"].std == pytest.approx(0.00055578, abs=1e-8)
    assert s["one"].std == 0.0 and s["none"].mean is None and "none" not in p
    c = spark.createDataFrame([("a", 0.2271)], "k string, mean double")
    e = stats.effects(stats.mean_sample_std(df, ["k"]), c, ["k"])
    assert round(e.first().effect, 1) == -14.8 and stats.verdict(e).first().within_noise is False
    assert stats.verdict(e.limit(0)).first().within_noise is True
    names = spark.createDataFrame([("tierA_base6_s0",), ("us17b_strip",), ("x_s12",)], "r string").select(stats.config_of(F.col("r")).alias("c"), stats.seed_of(F.col("r")).alias("s")).collect()
    assert [tuple(r) for r in names] == [("tierA_base6", 0), ("us17b_strip", None), ("x", 12)]


def test_latency_nearest_rank(spark):
    ms = [float(x) for x in random.Random(1).sample(range(1000), 137)] * 2 + [5.0]
    r = stats.latency(spark.createDataFrame([("v", x) for x in ms] + [("v", None)], "variant string, ms double"), ["variant"]).first()
    s = sorted(ms)
    assert r.p95_ms == s[min(len(s) - 1, int(0.95 * len(s)))] and r.median_ms == statistics.median(s) and r.std_ms == pytest.approx(statistics.pstdev(s)) and r.n == len(s)


def test_gates(spark):
    m = spark.createDataFrame([("D00", "C1"), ("D50", "__IGNORE__"), ("X", "C9")], "label string, target string")
    a = spark.createDataFrame([("D00",), ("D99",), ("D99",), (None,)], "label string")
    bad = gates.unknown_labels(a, m)
    assert [tuple(r) for r in bad.collect()] == [("D99", 2)]
    with pytest.raises(gates.GateError):
        gates.enforce(bad, "labels")
    gates.enforce(bad, "labels", most=1)
    assert [r.label for r in gates.missing_targets(m, spark.createDataFrame([("C1",)], "name string"), "__IGNORE__").collect()] == ["X"]
    h = "ab" * 32
    head = spark.createDataFrame([("r1", f"# train_sha256: {h}\n# val_sha256={h}"), ("r2", "# train_sha256: short"), ("r3", None)], "run string, data_yaml_header string")
    got = {(r.run, r.split): r.sha256 for r in gates.split_hash_of(head).collect()}
    assert got["r1", "train"] == got["r1", "val"] == h and got["r2", "train"] is None
    g = gates.metric_gate(spark.createDataFrame([("a", 0.5004)], "k string, got double"), spark.createDataFrame([("a", 0.5), ("b", 0.1)], "k string, expected double"), ["k"])
    assert {r.k: r.ok for r in g.collect()} == {"a": True, "b": False}
    f = spark.createDataFrame([("x", bytearray(b"abc"))], "name string, content binary")
    e = spark.createDataFrame([("x", 3, None), ("y", 1, None)], "name string, size int, sha256 string")
    assert {(r.name, r.size_ok, r.hash_ok) for r in gates.file_integrity(f, e).collect()} == {("x", True, True), ("y", False, False)}


def test_progress_and_idle(spark):
    r = spark.createDataFrame([("a", e, 100.0 * e, v) for e, v in ((1, 0.2), (2, 0.5), (3, 0.5), (4, None))] + [("b", 5, 500.0, 0.1)], "run string, epoch int, time double, map50 double")
    p = {x.run: x for x in monitor.progress(r, spark.createDataFrame([("a", 10), ("b", 5), ("c", 7)], "run string, epochs int")).collect()}
    assert (p["a"].done, p["a"].best_epoch, p["a"].last, p["a"].remaining, p["a"].eta_s, p["a"].status) == (4, 2, 0.5, 6, 600.0, "running")
    assert p["b"].status == "done" and p["c"].status == "pending" and p["c"].eta_s == 4200.0
    s = spark.createDataFrame([("m", t, u) for t, u in enumerate([0, 0, 50, 0, None, 1, 2, 3])], "k string, t int, util int")
    assert [x.streak for x in monitor.idle_streaks(s, ["k"], 3).orderBy("t").collect()] == [1, 2, 0, 1, 0, 1, 2, 3]
    assert spark.range(1).select(monitor.duration(F.lit(93784)).alias("d")).first().d == "1d 02h 03m 04s"


def test_gates_refuse(spark):
    from tarmac.operators import gates

    rows = spark.createDataFrame([("a", True), ("b", False)], "k string, ok boolean")
    assert gates.every_passes(rows).first().passed is False and gates.every_passes(rows.filter("ok")).first().passed is True
    assert gates.every_passes(rows.limit(0)).first().passed is False
    heads = spark.createDataFrame([("x", "train_sha256: " + "a" * 64 + " val_sha256=" + "b" * 64), ("y", "train_sha256: " + "a" * 64), ("z", None)], "run string, data_yaml_header string")
    assert {tuple(r) for r in gates.without_hash(heads).collect()} == {("y", "val"), ("z", "train"), ("z", "val")}
    with pytest.raises(gates.GateError):
        gates.enforce(gates.without_hash(heads), "split hash")
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {tuple(r) for r in gates.unpaired(left, right, "k").collect()} == {(2, 2, 1), (3, 0, 1)}
    reports = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True)], "g string, readable boolean")
    assert [tuple(r) for r in gates.too_few(reports, "g").collect()] == [("a", 1)]
    labels = spark.createDataFrame([("D00",), ("D99",)], "label string")
    with pytest.raises(gates.GateError):
        gates.enforce(gates.unknown_labels(labels, spark.createDataFrame([("D00", "C1")], "label string, target string")), "labels")
