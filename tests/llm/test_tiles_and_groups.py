"""Tile splitting and grouped splits against brute force, and the defined edge cases."""

import random

import pytest

from tarmac.llm import grouping, splitting

TILE = "tile_id long, image_id long, plan string, x0 int, x1 int, retained double, lo int, limit_px int"
BOX = "box_id long, tile_id long, x0 double, x1 double, retained double, plan string"
SPEC = "plan string, limit_px int, overlap_px int, min_retained double"


def brute(tiles, boxes, specs):
    out = set()
    for tid, a, b, plan in {t[0]: t for t in tiles}.values():
        if plan not in specs or a is None or b is None or b - a <= specs[plan][0]:
            continue
        limit, overlap, least = specs[plan]
        own = [(x + a, y + a) for _, t, x, y, r in {b[0]: b for b in boxes}.values() if t == tid and x is not None and y is not None and y > x and r is not None and r >= least]
        s, n = a, 1
        while b - s > limit:
            e = next((p for p in range(s + limit, s, -1) if p > s + limit / 2 and not any(u < p < v for u, v in own)), s + limit)
            out.add((tid, n, s, e))
            n, s = n + 1, e - overlap
        out.add((tid, n, s, b))
    return out


def run(spark, tiles, boxes, specs):
    t = spark.createDataFrame([(i, 7, p, a, b, 1.0, 3, 9) for i, a, b, p in tiles], TILE)
    b = spark.createDataFrame([(i, t, x, y, r, "g") for i, t, x, y, r in boxes], BOX)
    s = spark.createDataFrame([(p, *v) for p, v in specs.items()], SPEC)
    return [tuple(r) for r in splitting.found(t, b, s).collect()]


def test_pieces_like_brute_force(spark):
    rnd = random.Random(1)
    specs = {"g": (20, 4, 0.3), "h": (31, 9, 0.5)}
    tiles = [(i, rnd.choice([0, 5, -7]), rnd.randint(0, 200), rnd.choice(["g", "h", "x", None])) for i in range(80)] + [(900, 0, None, "g"), (901, None, 90, "g"), (902, 50, 50, "g"), (903, 60, 20, "g")]
    boxes = [(i, rnd.randint(0, 79), x, x + rnd.choice([-3, 0, 0.5, 4, 12, 25]), rnd.choice([None, 0.1, 0.3, 0.5, 1.02])) for i in range(900) for x in [round(rnd.uniform(-5, 190), 1)]]
    boxes += [(5000, 3, None, 4.0, 1.0), (5001, 3, 1.0, None, 1.0), (None, None, 1.0, 9.0, 1.0)]
    nan, inf = float("nan"), float("inf")
    odd = [(6000, 5, nan, 40.0, 1.0), (6001, 5, 2.0, nan, 1.0), (6002, 5, 2.0, 40.0, nan)]
    boxes += [(6003, 6, -inf, 3.0, 1.0), (6004, 7, 30.0, inf, 1.0)]
    got = run(spark, tiles + tiles[:9], boxes + boxes[:50] + odd, specs)
    assert len(got) == len(set(got))
    assert set(got) == brute(tiles, boxes, specs)


def test_many_boxes_on_one_tile_and_empty_tables(spark):
    boxes = [(i, 1, float(i % 97), i % 97 + 1.5, 1.0) for i in range(20_000)]
    assert set(run(spark, [(1, 0, 100, "g")], boxes, {"g": (20, 4, 0.3)})) == brute([(1, 0, 100, "g")], boxes[:97], {"g": (20, 4, 0.3)})
    assert run(spark, [], [], {"g": (20, 4, 0.3)}) == []
    assert set(run(spark, [(1, 0, 45, "g")], [], {"g": (20, 4, 0.3)})) == {(1, 1, 0, 20), (1, 2, 16, 36), (1, 3, 32, 45)}


def test_senseless_specs_are_refused(spark):
    for bad in ((20, 10, 0.3), (1, 0, 0.3), (20, -1, 0.3), (None, 4, 0.3)):
        with pytest.raises(ValueError):
            run(spark, [(1, 0, 45, "g")], [], {"g": bad})


def test_total_objective_is_never_dearer_than_greedy():
    rnd, differ = random.Random(2), 0
    for _ in range(40):
        lo = sorted(rnd.sample(range(150), 12))
        starts, ends = splitting.merged_runs(lo, [x + rnd.randint(0, 9) for x in lo])
        cost = lambda ps: sum(10 * any(s <= e <= t for s, t in zip(starts, ends, strict=True)) * (e != 160) + (1 - (e - a) / 20) ** 2 for a, e in ps)  # noqa: B023, E731
        first = splitting.pieces(0, 160, 20, 4, starts, ends)
        total = splitting.pieces(0, 160, 20, 4, starts, ends, "total")
        assert total[0][0] == 0 and total[-1][1] == 160 and all(b - a <= 20 for a, b in total) and all(x[1] - 4 == y[0] for x, y in zip(total, total[1:], strict=False))
        assert cost(total) <= cost(first) + 1e-9
        differ += total != first
    assert differ > 10


def test_pieces_against_all_divisions():
    """Every whole position may end a piece here: boundary positions lose nothing of the ordered objective."""
    rnd = random.Random(4)

    def divisions(s, x1, limit, overlap):
        if x1 - s <= limit:
            yield [(s, x1)]
            return
        for e in range(s + limit // 2 + 1, s + limit + 1):
            for rest in divisions(e - overlap, x1, limit, overlap):
                yield [(s, e), *rest]

    for _ in range(150):
        limit = rnd.randint(6, 9)
        overlap, x1 = rnd.randint(0, 2), rnd.randint(5, 24)
        lo = [rnd.randrange(25) for _ in range(rnd.randint(0, 5))]
        starts, ends = splitting.merged_runs(lo, [x + rnd.randint(0, 4) for x in lo])
        inside = lambda p: any(a <= p <= b for a, b in zip(starts, ends, strict=True))  # noqa: B023, E731
        every = list(divisions(0, x1, limit, overlap))
        ordered = min(every, key=lambda ps: [(inside(e), limit - (e - s)) for s, e in ps[:-1]])  # noqa: B023
        assert splitting.pieces(0, x1, limit, overlap, starts, ends) == ordered
        few = [ps for ps in every if all((e, inside(e)) in splitting.boundaries(s, limit, starts, ends) for s, e in ps[:-1])]
        cost = lambda ps: sum(10 * inside(e) + (1 - (e - s) / limit) ** 2 for s, e in ps[:-1]) + (1 - (ps[-1][1] - ps[-1][0]) / limit) ** 2  # noqa: B023, E731
        total = splitting.pieces(0, x1, limit, overlap, starts, ends, "total")
        assert abs(cost(total) - min(map(cost, few))) < 1e-9


IMG = "id long, file_name string, object string, drive string"
ANN = "id long, image_id long, category_id int, object_uid string, label string"


def groups(spark, images, objects):
    i = spark.createDataFrame([(*r, "o", "d") for r in images], IMG)
    a = spark.createDataFrame([(k, i, 0, o, "l") for k, (i, o) in enumerate(objects)], ANN)
    return i, a, {tuple(r) for r in grouping.found(i, a).collect()}


def test_groups_of_drives_and_objects(spark):
    images = [
        (1, "Japan_d0003_000005.jpg"), (2, "batch07/JAPAN__d0003__000013 (1).jpg"), (3, "United States d000034 000001.png"), (4, "UnitedStates.Drive-0034.000019.JPG"), (5, "IMG_0039.jpg"), (6, None), (7, "scan_1.jpeg"),
        (8, "china-motorbike-D196-6.jpg"), (9, "9dde1d0302b3.jpg"), (10, "frame (21).png"), (11, "Norway_d0007_f3.jpg"), (12, "30d61696ab12.jpg"), (None, "Japan_d0003_000005.jpg"),
    ]
    objects = [(5, "ob-00000001"), (6, " OB-00000001 "), (7, "Ob-00000002"), (8, "ob-00000002"), (8, "none"), (9, "none"), (9, "ob-3"), (10, "0"), (10, ""), (99, "ob-3"), (None, "ob-3"), (11, "ob-9"), (3, "ob-9"), (12, "ob-12x"), (6, None)]
    _, _, got = groups(spark, images + images[:4], objects + objects[:3])
    assert got == {(1, "japan-3"), (2, "japan-3"), (3, "norway-7"), (4, "norway-7"), (11, "norway-7"), (5, "image-5"), (6, "image-5"), (7, "chinamotorbike-196"), (8, "chinamotorbike-196")}
    assert groups(spark, [], [])[2] == set()
    assert groups(spark, [(1, None)], [])[2] == set()


def test_long_chains_and_hot_groups(spark):
    n = 400
    chain = [(i, f"IMG_{i}.jpg") for i in range(n)]
    objects = [(i, f"ob-{i:08d}") for i in range(n)] + [(i + 1, f"ob-{i:08d}") for i in range(n - 1)]
    hot = [(1000 + i, f"Czech_d0001_{i:06d}.jpg") for i in range(800)]
    _, _, got = groups(spark, chain + hot, objects)
    assert got == {(i, "image-0") for i in range(n)} | {(1000 + i, "czech-1") for i in range(800)}


def test_splits_keep_groups_whole_and_near_targets(spark):
    rnd = random.Random(3)
    images = [(i, f"Japan_d{rnd.randint(1, 300):04d}_{i:06d}.jpg") for i in range(4000)] + [(9000, None)]
    i, a, _ = groups(spark, images, [(rnd.randint(0, 3999), None) for _ in range(3000)])
    t = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split string, fraction double")
    rows = grouping.assign(i, a, t).collect()
    assert len(rows) == 4001 and len({r.image_id for r in rows}) == 4001
    by = {}
    for r in rows:
        assert by.setdefault(r.group_key, r.split) == r.split
    share = lambda s: sum(r.split == s for r in rows) / len(rows)
    assert abs(share("train") - 0.7) < 0.03 and abs(share("val") - 0.15) < 0.03
    assert grouping.assign(i.limit(0), a.limit(0), t).count() == 0
    with pytest.raises(ValueError):
        grouping.assign(i, a, t.limit(0))


def deviation(units, placed, targets):
    """Squared relative deviation of sizes and label counts from the targets."""
    classes = sorted({c for _, _, h in units for c in h})
    out = 0.0
    for column in (lambda u: u[1], *(lambda u, c=c: u[2].get(c, 0) for c in classes)):
        total = sum(map(column, units))
        out += sum((sum(column(u) for u in units if placed[u[0]] == s) / total - f) ** 2 for s, f in targets.items())
    return out


def test_labels_are_spread_nearly_as_well_as_can_be():
    """Several classes, against the best of all assignments of a few groups."""
    import itertools

    rnd = random.Random(9)
    targets = {"train": 0.6, "val": 0.2, "test": 0.2}
    near, chance = [], []
    for _ in range(12):
        units = [(f"u{i}", n, {c: rnd.randint(0, 3 * n) for c in range(4)}) for i, n in enumerate(rnd.randint(1, 30) for _ in range(9))]
        best = min(deviation(units, dict(zip((u[0] for u in units), way, strict=True)), targets) for way in itertools.product(targets, repeat=9))
        near.append(deviation(units, grouping.place(units, targets), targets) - best)
        chance.append(deviation(units, {u[0]: rnd.choices(list(targets), list(targets.values()))[0] for u in units}, targets) - best)
    assert sum(near) < 0.2 * sum(chance) and max(near) < 0.2


def test_every_class_keeps_its_shares(spark):
    """Many classes, ids far apart, more splits than a hundred."""
    images = spark.createDataFrame([(i, f"Japan_d{i // 3:04d}_{i:06d}.jpg", "o", "d") for i in range(3000)], IMG)
    cls = [7, 1007, 2007, 5]  # equal by remainder, yet classes of their own
    a = spark.createDataFrame([(k, k % 3000, cls[(k % 3000) // 3 % 4], None, "l") for k in range(9000)], ANN)
    many = spark.createDataFrame([("train", 0.7), ("val", 0.3)], "split string, fraction double")
    got = {r.image_id: r.split for r in grouping.assign(images, a, many).collect()}
    for c in cls:
        of = [got[k % 3000] for k in range(9000) if cls[(k % 3000) // 3 % 4] == c]
        assert abs(of.count("val") / len(of) - 0.3) < 0.05
    lots = spark.createDataFrame([(f"s{i}", 1.0) for i in range(150)], "split string, fraction double")
    assert len({r.split for r in grouping.assign(images, a, lots).collect()}) == 150
