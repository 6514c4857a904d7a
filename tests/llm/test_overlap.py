"""Cross-split overlaps against brute force, and the defined edge cases."""

import itertools
import random


from tarmac.llm import overlap

IMG = "id long, file_name string, width int, height int, split_hint string, source_dataset string, n int, token string"
ANN = "id long, image_id long, category_id int, bbox array<double>, train boolean, cat string"


def tables(spark, images, boxes):
    i = spark.createDataFrame([(*r, "s", 3, "t") for r in images], IMG)
    a = spark.createDataFrame([(k, im, c, b, True, "c") for k, (im, c, b) in enumerate(boxes)], ANN)
    return i, a


def brute(images, boxes):
    split = {i: {"t": "train", "v": "val"}.get((s or "").strip().lower()[:1]) for i, _, _, _, s in images}
    size = {i: (w, h) for i, _, w, h, _ in images}
    own = {}
    for im, c, b in boxes:
        w, h = size.get(im, (0, 0))
        if c is None or b is None or not w or not h or None in b or b[2] <= 0 or b[3] <= 0:
            continue
        own.setdefault(im, []).append((c, b[0] / w, b[1] / h, (b[0] + b[2]) / w, (b[1] + b[3]) / h))
    out = set()
    for a, b in itertools.product([i for i in own if split[i] == "train"], [i for i in own if split[i] == "val"]):
        big = max(len(own[a]), len(own[b]))
        edges = [(x, y) for x, p in enumerate(own[a]) for y, q in enumerate(own[b]) if p[0] == q[0] and all(abs(u - v) <= 0.01 for u, v in zip(p[1:], q[1:], strict=True))]
        m = largest(edges)
        if m >= 3 and m >= 0.8 * big:
            out.add((min(a, b), max(a, b)))
    return out


def largest(edges):
    if not edges:
        return 0
    a, b = edges[0]
    return max(largest(edges[1:]), 1 + largest([e for e in edges if e[0] != a and e[1] != b]))


def test_near_boxes_like_brute_force(spark):
    rnd = random.Random(5)
    images, boxes, known = [], [], []
    for i in range(120):
        w, h = rnd.choice([(600, 600), (4040, 2035), (300, 500)])
        images.append((i, f"IMG_{i}.jpg", w, h, rnd.choice(["train", "Val "])))
        if known and rnd.random() < 0.6:
            base = [x for x in rnd.choice(known) if rnd.random() < 0.9]
            base += [(0, rnd.random(), rnd.random(), 0.1, 0.1)] * (rnd.random() < 0.2)
        else:
            base = [(rnd.randint(0, 1), rnd.uniform(-0.05, 0.95), rnd.random() * 0.95, rnd.uniform(0.01, 0.3), rnd.uniform(0.01, 0.3)) for _ in range(rnd.choice([2, 3, 4, 5, 6]))]
        known.append(base)
        j = lambda: rnd.uniform(-0.0055, 0.0055)
        boxes += [(i, c, [(x + j()) * w, (y + j()) * h, a * w, b * h]) for c, x, y, a, b in base]
    i, a = tables(spark, images, boxes)
    got = [tuple(r) for r in overlap.found(i.union(i.limit(20)), a.union(a.limit(100))).collect()]
    want = brute(images, boxes)
    assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want


def test_ambiguous_boxes_pair_one_to_one(spark):
    same = [10.0, 10.0, 50.0, 50.0]
    near = [11.0, 10.0, 50.0, 50.0]
    images = [(1, None, 600, 600, "train"), (2, None, 600, 600, "val"), (3, None, 600, 600, "test")]
    boxes = [(1, 0, same)] * 3 + [(2, 0, near)] * 3 + [(3, 0, same)] * 2 + [(3, 0, [300.0, 300.0, 9.0, 9.0])]
    assert {tuple(r) for r in overlap.found(*tables(spark, images, boxes)).collect()} == {(1, 2)}
    assert overlap.pairing([(1, 1), (1, 2), (2, 1), (3, 3), (4, 3)]) == 3
    assert overlap.pairing([(a, b) for a in range(30) for b in range(30) if a >= b]) == 30


def test_frames_and_edge_cases(spark):
    images = [
        (1, "Japan_d0003_000005.jpg", 600, 600, "training"), (2, "x/JAPAN__d03__5 (1).png", 0, None, "VAL"), (3, "japan-D3-6.jpg", 600, 600, "test"), (4, "Japan_drive3_frame005.jpg", 1, 1, None),
        (5, "IMG_5.jpg", 600, 600, "train"), (6, "IMG_5.jpg", 600, 600, "val"), (7, None, None, 5, "other"),
    ]
    nan = float("nan")
    odd = [None, [1.0], [1.0, 2.0, 0.0, 4.0], [1.0, 2.0, -3.0, 4.0], [nan, 1.0, 2.0, 3.0], [1.0, None, 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0]]
    boxes = [(im, c, b) for im in (5, 6, 2, None, 99) for b in odd for c in (1, None)]
    assert {tuple(r) for r in overlap.found(*tables(spark, images, boxes)).collect()} == {(1, 2)}
    i, a = tables(spark, images, boxes)
    assert overlap.found(i.limit(0), a.limit(0)).count() == 0
    assert [tuple(r) for r in overlap.report(i, a).collect()] == [("val", "s", 1, 1)]


def test_records_of_very_many_boxes(spark):
    """More boxes than any usual record has go the same way."""
    rnd = random.Random(4)
    grid = [[float(x), float(y), 6.0, 6.0] for x in range(0, 590, 12) for y in range(0, 590, 6)]  # 5,000 boxes
    part = rnd.sample(grid, 4100)
    images = [(1, None, 600, 600, "train"), (2, None, 600, 600, "val"), (3, None, 600, 600, "test")]
    boxes = [(1, 0, b) for b in grid] + [(2, 0, b) for b in part] + [(3, 0, b) for b in part[:3900]]
    assert {tuple(r) for r in overlap.found(*tables(spark, images, boxes)).collect()} == {(1, 2)}


def test_hot_tokens_and_wide_records(spark):
    images = [(i, None, 600, 600, "train" if i % 4 else "val") for i in range(60)]
    whole = [0.0, 0.0, 600.0, 600.0]
    boxes = [(i, 0, whole) for i in range(60)] + [(i, 1, [float(7 * (i // 8)), 5.0, 20.0 + k * 30, 60.0]) for i in range(60) for k in range(3)]
    got = {tuple(r) for r in overlap.found(*tables(spark, images, boxes)).collect()}
    assert got == brute(images, boxes) and got
