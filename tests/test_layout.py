"""Greedy layout operators against loops over tiny pages."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import layout as L
from foliospark.operators.blocks import group_neighbours

SCHEMA = "page_id long, box_idx int, cls_id int, label string, score double, x1 int, y1 int, x2 int, y2 int, read_order int"


def pages(seed=3, n=25):
    rng = random.Random(seed)
    out = []
    for page in range(n):
        for i in range(rng.randint(1, 9)):
            c, x, y = rng.randrange(25), rng.randrange(60), rng.randrange(60)
            out.append((page, i, c, L.LABELS[c], rng.choice([0.2, 0.5, 0.9]), x, y, x + rng.randrange(3, 60), y + rng.randrange(3, 60), i))
    return out


def area(b):
    return max(0, b[7] - b[5]) * max(0, b[8] - b[6])


def shared(a, b, one=0):
    w, h = min(a[7], b[7]) - max(a[5], b[5]) + one, min(a[8], b[8]) - max(a[6], b[6]) + one
    return max(0, w) * max(0, h)


def by_page(rows):
    return [[r for r in rows if r[0] == p] for p in sorted({r[0] for r in rows})]


def test_nms(spark):
    rows, want = pages(), []
    for page in by_page(rows):
        page, kept = sorted(page, key=lambda r: (-r[4], -r[1])), []
        for b in page:
            size = lambda r: (r[7] - r[5] + 1) * (r[8] - r[6] + 1)
            if all(shared(a, b, 1) / (size(a) + size(b) - shared(a, b, 1)) < (0.6 if a[2] == b[2] else 0.98) for a in kept):
                kept.append(b)
        want += [(b[0], b[1], k + 1) for k, b in enumerate(kept)]
    got = L.nms(spark.createDataFrame(rows, SCHEMA)).select("page_id", "box_idx", "nms_rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


BIG, SAME, HALF, IN, APART, THIN = (0, 0, 100, 100), (0, 0, 100, 100), (0, 0, 100, 60), (10, 10, 50, 50), (200, 0, 300, 100), (20, 20, 24, 90)


@pytest.mark.parametrize(
    "boxes,stay",
    [
        ([("text", BIG), ("text", APART)], [0, 1]),
        ([("text", BIG), ("text", SAME)], [0]),  # the later of equals goes
        ([("text", IN), ("text", BIG)], [1]),  # the smaller goes
        ([("text", BIG), ("reference", IN), ("text", THIN)], [0]),
        ([("text", THIN), ("text", BIG)], [1]),  # tiny: gone before it is compared
        ([("text", IN), ("text", THIN), ("text", (10, 10, 50, 51))], [2]),
        ([("image", BIG), ("text", IN)], [0, 1]),  # a visual one among different labels
        ([("image", BIG), ("image", IN)], [0]),
        ([("table", BIG), ("text", IN)], [0]),  # a table and one that isn't visual
        ([("table", BIG), ("chart", IN)], [0, 1]),
        ([("inline_formula", BIG), ("text", (0, 0, 100, 60))], [1]),
        ([("inline_formula", IN), ("inline_formula", IN)], []),
        ([("text", HALF), ("inline_formula", (0, 50, 100, 70))], [0, 1]),  # just half
        ([("text", BIG), ("text", (0, 0, 100, 140))], [1]),
        ([("text", BIG), ("text", (0, 30, 100, 130))], [0, 1]),  # seven tenths are not beyond it
    ],
)
def test_greedy_overlap(spark, boxes, stay):
    rows = [(1, i, 0, label, 0.5, *box, i) for i, (label, box) in enumerate(boxes)]
    got = L.greedy_overlap_filter(spark.createDataFrame(rows, SCHEMA)).select("box_idx").collect()
    assert sorted(r[0] for r in got) == stay


def square(x, y, n):
    return [[x, y], [x + n, y], [x + n, y + n], [x, y + n]]


NOTCHED = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]]  # of area 10


@pytest.mark.parametrize(
    "a,b,want",
    [
        (square(0, 0, 4), square(0, 0, 4), 1.0),
        (square(0, 0, 4), square(2, 2, 4), 0.25),
        (square(0, 0, 4)[::-1], square(1, 1, 2), 1.0),
        (square(0, 0, 4), square(9, 9, 1), 0.0),
        (square(0, 0, 4), [[2, 0], [4, 2], [2, 4], [0, 2]], 1.0),
        (NOTCHED, square(0, 0, 4), 1.0),
        (NOTCHED, [[1.0, 1.0], [3.0, 1.0], [3.0, 4.0], [1.0, 4.0]], 0.25),
        (square(0, 0, 4), [[0, 0], [1, 1]], 0.0),
        (square(0, 0, 4), [], 0.0),
    ],
)
def test_polygon_overlap(a, b, want):
    assert L.polygon_overlap(a, b) == pytest.approx(want) and L.polygon_overlap(b, a) == pytest.approx(want)


def test_polygons_keep_boxes(spark):
    """Two triangles of one square overlap as boxes only; without a polygon the box counts."""
    up, down = [[0.0, 0.0], [90.0, 0.0], [0.0, 90.0]], [[90.0, 90.0], [0.0, 90.0], [90.0, 0.0]]
    rows = [(p, i, "text", 0, 0, 100, 100, shape) for p, shapes in enumerate([(up, down), (up, up), (up, None)]) for i, shape in enumerate(shapes)]
    df = spark.createDataFrame(rows, "page_id long, box_idx int, label string, x1 int, y1 int, x2 int, y2 int, polygon array<array<double>>")
    got = L.greedy_overlap_filter(df, "polygon").select("page_id", "box_idx").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (1, 0), (2, 0)]


def test_overlap_modes(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 8, 8)], ", ".join(f"{p}{c} int" for p in ("a_", "b_") for c in L.BOX))
    got = df.select(*[L.overlap(m) for m in ("small", "union", "large")]).first()
    assert list(got) == pytest.approx([1.0, 0.09, 0.09])


def test_unclip_kinds(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 20)], "page_id long, box_idx int, cls_id int, x1 int, y1 int, x2 int, y2 int")
    same = L.unclip(df).select(*L.BOX).first()
    assert list(same) == [0, 0, 10, 20]
    assert list(L.unclip(df, (2.0, 1.0)).select(*L.BOX).first()) == [-5, 0, 15, 20]
    assert list(L.unclip(df, {7: (2.0, 2.0)}).select(*L.BOX).first()) == [0, 0, 10, 20]


def test_neighbour_groups(spark):
    """Two columns of one text, an image, and a text that stands apart."""
    rows = [(1, 0, "text", 0, 0, 100, 300), (1, 1, "image", 0, 310, 50, 330), (1, 2, "text", 110, 0, 210, 250), (1, 3, "text", 0, 400, 100, 420)]
    got = group_neighbours(spark.createDataFrame(rows, "page_id long, idx int, label string, x1 int, y1 int, x2 int, y2 int"))
    out = {r.idx: (r.group_id, r.merged, r.out_pos) for r in got.collect()}
    # the pair is 550 high over 100 wide: more than three times as high as wide, so it isn't merged
    assert out[0][:2] == (None, False) and [out[i][2] for i in (0, 2, 1, 3)] == [1, 2, 3, 4]
    wide = [(1, 0, "text", 0, 0, 400, 300), (1, 1, "image", 0, 310, 50, 330), (1, 2, "text", 410, 0, 810, 250)]
    out = {r.idx: (r.group_id, r.merged, r.out_pos) for r in group_neighbours(spark.createDataFrame(wide, "page_id long, idx int, label string, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert out == {0: (0, True, 1), 2: (0, True, 2), 1: (None, False, 3)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (L.nms(none), L.greedy_overlap_filter(none), L.suppress_contained(none), L.box_pairs(none), L.reading_order(none)):
        assert df.count() == 0
    assert L.numbered(none, F.lit(False), "box_idx").count() == 0


def crowded(n=400, seed=5, side=900):
    """A page of many boxes of all sizes, most small, and a few with odd corners."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (int(2 ** rng.uniform(0, 9)) for _ in "wh")
        x, y = rng.randrange(-50, side), rng.randrange(-50, side)
        c = rng.choice([5, 14, 15, 21, 22])
        out.append((90, i, c, L.LABELS[c], rng.choice([0.2, 0.5, 0.9]), x, y, x + w, y + h, i))
    near = [(90, n + i, *out[i][2:5], out[i][5] + 1, out[i][6], out[i][7] + 1, out[i][8], i) for i in range(0, n, 5)]
    return out + near + [(90, 2 * n, 5, "formula", 0.5, 10, 10, 10, 40, 0), (90, 2 * n + 1, 5, "formula", 0.5, 40, 40, 10, 60, 0), (80, 0, 5, "formula", 0.5, 0, 0, 9, 9, 0), (80, 1, 5, "formula", 0.5, 9, 0, 18, 9, 0), (80, 2, 5, "formula", 0.5, 0, 0, 9, 9, 0)]


@pytest.mark.parametrize("few", [64, 2, 10_000])
def test_meeting(spark, monkeypatch, few):
    """Pairs of the grids against all pairs: self-join and two sets, at every limit."""
    from foliospark.operators import grid

    monkeypatch.setattr(grid, "FEW", few)
    rows = crowded() + pages()
    want = sorted((a[0], a[1], b[1]) for p in by_page(rows) for a in p for b in p if a[1] < b[1] and a[7] > a[5] and b[7] > b[5] and shared(a, b))
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.overlapping_pairs(df).select("page_id", "a_box_idx", "b_box_idx").collect()
    assert sorted(map(tuple, got)) == want
    left, right = df.where("box_idx % 3 = 0"), df.where("box_idx % 3 > 0")
    got = grid.meeting(left, right, ("box_idx",)).select("page_id", "a.box_idx", F.col("b.box_idx").alias("other")).collect()
    pairs = {(p, *sorted((a, b), key=lambda k: k % 3 > 0)) for p, a, b in want if (a % 3 > 0) != (b % 3 > 0)}
    assert len(got) == len(pairs) and set(map(tuple, got)) == pairs


def test_contained_on_a_full_page(spark):
    rows = crowded()
    big = lambda a, b: area(a) > 0 and shared(a, b) / area(a) >= 0.9
    want = sorted(a[1] for a in rows if a[0] == 90 and not any(b[0] == 90 and b[1] != a[1] and b[2] in L.LARGE_CLASSES and big(a, b) for b in rows))
    got = L.suppress_contained(spark.createDataFrame(rows, SCHEMA)).where("page_id = 90").select("box_idx").collect()
    assert sorted(r[0] for r in got) == want


def test_full_pages_as_small_ones(spark, monkeypatch):
    """Box by box as with the matrix of all pairs, for both greedy filters."""
    df = spark.createDataFrame(crowded() + pages(), SCHEMA)
    runs = {}
    for limit in (0, 256, 1 << 20):
        monkeypatch.setattr(L, "MATRIX", limit)
        runs[limit] = [sorted(map(tuple, f(df).collect())) for f in (L.nms, L.greedy_overlap_filter)]
    assert runs[0] == runs[256] == runs[1 << 20] and all(len(r) > 100 for r in runs[0])


def test_boxes_without_a_place(spark, monkeypatch):
    """Null, NaN and infinite corners meet nothing and stay, on small and full pages."""
    inf, nan = float("inf"), float("nan")
    corners = [(0.0, 0.0, 9.0, 9.0), (1.0, 1.0, 9.0, 9.0), (nan, 0.0, 9.0, 9.0), (0.0, 0.0, inf, 9.0), (None, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, nan)]
    rows = [(1, i, 5, "text", 0.5, *c, i) for i, c in enumerate(corners)] + [(None, 0, 5, "text", 0.5, 0.0, 0.0, 9.0, 9.0, 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA.replace("x1 int, y1 int, x2 int, y2 int", "x1 double, y1 double, x2 double, y2 double"))
    assert [(r.a_box_idx, r.b_box_idx) for r in L.overlapping_pairs(df).collect()] == [(0, 1)]
    monkeypatch.setattr(L, "MATRIX", 0)
    assert {2, 3, 4, 5} <= {r.box_idx for r in L.nms(df.where("page_id = 1")).collect()}


def test_page_of_20000_boxes(spark):
    import time

    rng = random.Random(1)
    rows = [(1, i, i % 25, "text", rng.random(), x := rng.randrange(6000), y := rng.randrange(6000), x + 40, y + rng.randrange(8, 30), i) for i in range(20_000)]
    rows.append((1, 20_000, 3, "text", 0.1, 0, 0, 6100, 6100, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for f in (L.overlapping_pairs, L.suppress_contained, L.nms, L.greedy_overlap_filter):
        began = time.time()
        assert f(df).count() > 0
        assert time.time() - began < 60, f.__name__


def test_groups_in_runs(spark):
    """With `many`, whole groups reach the function in runs, each group once, also where batches cut
    through groups and one group is longer than a batch."""
    from foliospark.operators.groupwise import chosen_rows

    sizes = [1 + k % 7 for k in range(3000)] + [25_000] + [2] * 3000
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "g int, n int").selectExpr("g", "n", "explode(sequence(1, n)) AS i", "array(array(n)) AS a")

    def pick(cuts, g, n, a):
        assert cuts[0] == 0 and cuts[-1] == len(g) == len(a) and all(len(set(g[x:y])) == 1 and y - x == n[x] for x, y in zip(cuts, cuts[1:]))
        ends = cuts[1:] - 1
        return ends, n[ends].astype("int32")

    got = chosen_rows(df.repartition(1), "g", ["i"], ("g", "n", "a"), pick, {"last": "int"}, many=True).collect()
    assert sorted((r.g, r.n, r.i, r.last, r.a) for r in got) == [(k, n, n, n, [[n]]) for k, n in enumerate(sizes)]


def test_polygon_overlap_of_many_pairs():
    """20,000 pairs take a second or so."""
    import time

    a, b = [[0, 0], [8, 0], [8, 6], [0, 6]], [[4, 0], [8, 3], [4, 6], [0, 3]]
    began = time.time()
    assert {L.polygon_overlap(a, b) for _ in range(20_000)} == {1.0} and time.time() - began < 4


def test_small_and_full_pages_in_one_run(spark, monkeypatch):
    """Pages under and over the limit, some of one box, as with a limit that none reaches."""
    rng = random.Random(11)
    rows = []
    for page in range(200):
        for k in range(rng.choice((1, 2, 5, 12, 40))):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((page, k, rng.choice(("text", "table", "image", "inline_formula", "reference")), x, y, x + rng.randrange(40), y + rng.randrange(40)))
    df = spark.createDataFrame(rows, "page_id int, box_idx int, label string, x1 int, y1 int, x2 int, y2 int")
    diamond = "array(array((x1 + x2) / 2D, y1 + 0D), array(x2 + 0D, (y1 + y2) / 2D), array((x1 + x2) / 2D, y2 + 0D), array(x1 + 0D, (y1 + y2) / 2D))"
    df = df.selectExpr("*", f"CASE WHEN box_idx % 3 > 0 THEN {diamond} END AS polygon")
    found = {}
    for limit in (10, 1000):
        monkeypatch.setattr(L, "MATRIX", limit)
        found[limit] = [sorted(map(tuple, f.select("page_id", "box_idx").collect())) for f in (L.greedy_overlap_filter(df), L.greedy_overlap_filter(df, "polygon"))]
    assert found[10] == found[1000] and 0 < len(found[10][0]) < len(found[10][1]) < len(rows)


def test_only_aligned_texts_ask_for_neighbours(spark, monkeypatch):
    """What stands beside two texts is looked for where these are aligned, not for every pair; groups
    are the same."""
    from foliospark.operators import blocks as B

    labels = ("text", "text", "text", "table", "image")
    rng = random.Random(9)
    rows = []
    for page in range(300):
        for k in range(rng.randrange(2, 9)):
            x, y = rng.choice((0, 3, 40)), 20 * k
            rows.append((page, k, rng.choice(labels), x, y, x + rng.choice((100, 140)), y + rng.randrange(15, 25)))
    df = spark.createDataFrame(rows, "page_id int, idx int, label string, x1 int, y1 int, x2 int, y2 int")
    plain, asked = B.meets_non_merge, []

    def every(pairs, blocks):
        asked.append(pairs.count())
        return plain(B.with_previous(blocks), blocks)

    found = [sorted(map(tuple, group_neighbours(df).select("page_id", "idx", "group_id", "merged", "out_pos").collect()), key=str)]
    monkeypatch.setattr(B, "meets_non_merge", every)
    found.append(sorted(map(tuple, group_neighbours(df).select("page_id", "idx", "group_id", "merged", "out_pos").collect()), key=str))
    assert found[0] == found[1] and any(r[3] for r in found[0]) and 0 < asked[0] < B.with_previous(df).count() / 2
