"""Layout boxes: filters, clipping, overlap joins, suppression and order.

Boxes have page_id, box_idx, cls_id, score, x1, y1, x2, y2 and read_order; pages have page_id,
width and height. Everything is partitioned by page_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.grid import BOX, Neighbours, meeting
from foliospark.operators.groupwise import chosen_rows

# Class names in the order of their ids.
LABELS = (
    "abstract algorithm aside_text chart content display_formula doc_title figure_title footer footer_image footnote formula_number header "
    "header_image image inline_formula number paragraph_title reference reference_content seal table text vertical_text vision_footnote"
).split()
# Labels without a place in the reading order; labels that Markdown leaves out; images;
# labels that are never merged with a neighbour; classes whose boxes swallow what they contain.
SKIP_ORDER = "figure_title vision_footnote image chart table header header_image footer footer_image footnote aside_text".split()
MARKDOWN_IGNORED = "number footnote header header_image footer footer_image aside_text".split()
IMAGES = "image header_image footer_image".split()
NON_MERGE = [*IMAGES, "chart", "seal", "table"]
LARGE_CLASSES = (3, 5, 6, 15, 17)
VISUAL = ("image", "table", "seal", "chart")


def label_dimension(spark: SparkSession) -> DataFrame:
    """The 25 classes with the flags that operators ask for (a fixed-size dimension)."""
    rows = [(i, n, n in SKIP_ORDER, n in MARKDOWN_IGNORED, n in IMAGES, n in NON_MERGE, "large" if i in LARGE_CLASSES else "union") for i, n in enumerate(LABELS)]
    return spark.createDataFrame(rows, "cls_id int, label string, skip_order boolean, md_ignore boolean, is_image boolean, non_merge boolean, merge_mode string")


def with_labels(boxes: DataFrame) -> DataFrame:
    return boxes.join(F.broadcast(label_dimension(boxes.sparkSession)), "cls_id", "left")  # 25 rows


def confidence_filter(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Whole coordinates (half to even); scores above the threshold of a known class."""
    return boxes.where((F.col("score") > threshold) & (F.col("cls_id") > -1)).withColumns({c: F.bround(F.col(c).cast("double"), 0).cast("int") for c in BOX})


def area(a: str = "") -> Column:
    x1, y1, x2, y2 = (F.col(a + c).cast("double") for c in BOX)
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def drop_oversized_images(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Drops images that fill the page, where it has other boxes and something would be left."""
    sized = boxes.join(pages, "page_id")
    w = F.greatest(F.least("x2", "width") - F.greatest("x1", F.lit(0)), F.lit(0)).cast("double")
    h = F.greatest(F.least("y2", "height") - F.greatest("y1", F.lit(0)), F.lit(0)).cast("double")
    share = F.when(F.col("width") > F.col("height"), 0.82).otherwise(0.93)
    fits = (F.col("cls_id") != LABELS.index("image")) | (w * h <= share * F.col("width") * F.col("height"))
    page = Window.partitionBy("page_id")
    marked = sized.withColumn("__fits", fits).withColumn("__n", F.count(F.lit(1)).over(page)).withColumn("__any", F.max("__fits").over(page))
    return marked.where("__fits OR __n = 1 OR NOT __any").drop("__fits", "__n", "__any", "width", "height")


def unclip(boxes: DataFrame, ratio=1.0) -> DataFrame:
    """Scales boxes about their centres: by a number, a (width, height) pair, or a mapping from
    class to a pair; classes that a mapping lacks stay as they are."""
    if isinstance(ratio, dict):
        rows = [(int(k), float(v[0]), float(v[1])) for k, v in ratio.items()]
        by = boxes.sparkSession.createDataFrame(rows, "cls_id int, __rw double, __rh double")
        boxes = boxes.join(F.broadcast(by), "cls_id", "left")  # one row a class
        rw, rh = F.coalesce("__rw", F.lit(1.0)), F.coalesce("__rh", F.lit(1.0))
    else:
        rw, rh = (F.lit(float(r)) for r in (ratio if isinstance(ratio, tuple) else (ratio, ratio)))
    half = {"x": (F.col("x2") - F.col("x1")) * rw / 2, "y": (F.col("y2") - F.col("y1")) * rh / 2}
    mid = {"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2}
    return boxes.withColumns({f"{a}{i}": mid[a] + (half[a] if i == 2 else -half[a]) for a in "xy" for i in (1, 2)}).drop("__rw", "__rh")


def in_order(boxes: DataFrame, by: Column | None = None) -> Window:
    return Window.partitionBy("page_id").orderBy(*([by] if by is not None else [F.col("read_order")]), F.col("tie").desc() if "tie" in boxes.columns else F.lit(0), "box_idx")


def reading_order(boxes: DataFrame) -> DataFrame:
    """pos: rank by reading order, ties by the larger tie-break, then by position."""
    return boxes.withColumn("pos", F.row_number().over(in_order(boxes)))


def clip_to_page(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes within the page; ord counts them before empty ones are dropped, so it may have gaps."""
    sized = boxes.withColumn("ord", F.row_number().over(in_order(boxes))).join(pages, "page_id")
    clipped = sized.withColumns(
        {c: F.least(F.greatest(F.col(c), F.lit(0)), F.col(side)).cast("int") for c, side in (("x1", "width"), ("x2", "width"), ("y1", "height"), ("y2", "height"))}
    )
    return clipped.where("x2 > x1 AND y2 > y1").drop("width", "height")


def with_polygon(boxes: DataFrame) -> DataFrame:
    """polygon: the given one, or the four corners."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in BOX)
    corners = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))
    return boxes.withColumn("polygon", F.coalesce("polygon", corners) if "polygon" in boxes.columns else corners)


def inter(a: str = "a_", b: str = "b_") -> Column:
    w = F.least(a + "x2", b + "x2") - F.greatest(a + "x1", b + "x1")
    h = F.least(a + "y2", b + "y2") - F.greatest(a + "y1", b + "y1")
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0)).cast("double")


def overlap(mode: str = "union", a: str = "a_", b: str = "b_") -> Column:
    """Intersection over union, or over the smaller or larger area; 0 without an area."""
    areas = area(a), area(b)
    below = {"small": F.least(*areas), "large": F.greatest(*areas)}.get(mode, areas[0] + areas[1] - inter(a, b))
    return F.when(below > 0, inter(a, b) / below).otherwise(0.0)


def pixel_iou(a: str = "a_", b: str = "b_") -> Column:
    """Intersection over union of boxes whose last pixel counts: extents are one more."""
    size = lambda p: ((F.col(p + "x2") - F.col(p + "x1") + 1) * (F.col(p + "y2") - F.col(p + "y1") + 1)).cast("double")
    w = F.greatest(F.least(a + "x2", b + "x2") - F.greatest(a + "x1", b + "x1") + 1, F.lit(0))
    h = F.greatest(F.least(a + "y2", b + "y2") - F.greatest(a + "y1", b + "y1") + 1, F.lit(0))
    both = (w * h).cast("double")
    return both / (size(a) + size(b) - both)


def projection_overlap(direction: str, mode: str = "union", a: str = "a_", b: str = "b_") -> Column:
    """Overlap of the boxes' shadows on an axis over their union, smaller or larger length."""
    lo, hi = ("x1", "x2") if direction == "horizontal" else ("y1", "y2")
    both = F.least(a + hi, b + hi) - F.greatest(a + lo, b + lo)
    lengths = F.col(a + hi) - F.col(a + lo), F.col(b + hi) - F.col(b + lo)
    below = {"small": F.least(*lengths), "large": F.greatest(*lengths)}.get(mode, F.greatest(a + hi, b + hi) - F.least(a + lo, b + lo))
    return F.when((both > 0) & (below > 0), both / below).otherwise(0.0)


def _side(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select("page_id", *[F.col(c).alias(prefix + c) for c in boxes.columns if c != "page_id"])


def box_pairs(boxes: DataFrame) -> DataFrame:
    """All pairs a before b of a page's boxes, also of such that are apart: a result as large as the
    square of a page. `overlapping_pairs` gives those that meet."""
    return _side(boxes, "a_").join(_side(boxes, "b_"), "page_id").where("a_box_idx < b_box_idx")


def overlapping_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs a before b of a page's boxes with an area in common, with their corners and classes, by
    the cells of nested grids instead of the square of a page."""
    met = meeting(boxes, None, ("box_idx", "cls_id"))
    return met.select("page_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("box_idx", "cls_id", *BOX)])


def suppress_contained(boxes: DataFrame, modes: dict[int, str] | None = None, share: float = 0.9) -> DataFrame:
    """Class-wise containment: a box is contained where the intersection is `share` of its area.

    A `large` class drops what its boxes contain. A `small` class drops, of the boxes that
    contain one of its boxes, those that aren't contained themselves in that sense.
    """
    modes = {c: "large" for c in LARGE_CLASSES} if modes is None else modes
    large, small = ([c for c, m in modes.items() if m == kind] for kind in ("large", "small"))
    met = meeting(boxes, None, ("box_idx", "cls_id"))
    both = met.select("page_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    pairs = both.select("page_id", *[F.col(f"p.{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("box_idx", "cls_id", *BOX)])
    held = pairs.where((area("a_") > 0) & (inter() / area("a_") >= share))
    gone = held.where(F.col("b_cls_id").isin(large)).select("page_id", F.col("a_box_idx").alias("box_idx"))
    if small:
        own = held.where(F.col("a_cls_id").isin(small))
        inside = own.select("page_id", F.col("a_cls_id").alias("c"), F.col("a_box_idx").alias("box_idx"))
        around = own.select("page_id", F.col("a_cls_id").alias("c"), F.col("b_box_idx").alias("box_idx"))
        gone = gone.union(around.join(inside, ["page_id", "c", "box_idx"], "left_anti").select("page_id", "box_idx"))
    return boxes.join(gone.distinct(), ["page_id", "box_idx"], "left_anti")


#: A page of so few boxes is worked on as a matrix of all pairs, a fuller one box by box.
MATRIX = 256


def nms(boxes: DataFrame, same: float = 0.6, different: float = 0.98) -> DataFrame:
    """Greedy suppression by score within each page: a box stays if its pixel IoU with every
    better box that stayed is below the limit for equal or different classes. Ties go to the
    later box. nms_rank counts the survivors in score order. On full pages each survivor looks
    for what it suppresses among the boxes that touch it, so memory is linear in the boxes."""

    def pick(cls, *corners):
        n = len(cls)
        x1, y1, x2, y2 = (v.astype(float) for v in corners)
        size = (x2 - x1 + 1) * (y2 - y1 + 1)

        def beaten(i, j):
            w = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]) + 1
            h = np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]) + 1
            both = np.maximum(w, 0) * np.maximum(h, 0)
            return both / (size[i] + size[j] - both) >= np.where(cls[i] == cls[j], same, different)

        alive = np.ones(n, bool)
        if n > MATRIX:
            near = Neighbours(x1, y1, x2 + 1, y2 + 1)
            for i in range(n):
                if alive[i]:
                    j = near.after(i)
                    j = j[alive[j]]
                    alive[j[beaten(i, j)]] = False
        elif n > 1:
            every = np.arange(n)
            beats = beaten(every[:, None], every)
            for i in range(n - 1):
                if alive[i]:
                    alive[i + 1 :] &= ~beats[i, i + 1 :]
        left = np.flatnonzero(alive)
        return left, np.arange(1, len(left) + 1, dtype=np.int32)

    return chosen_rows(boxes, "page_id", [F.desc("score"), F.desc("box_idx")], ("cls_id", *BOX), pick, {"nms_rank": "int"})


def _clipped(shape: list, triangle: list) -> list:
    """The part of a convex shape within a triangle of positive turn: half-plane by half-plane."""
    for k in range(3):
        if not shape:
            break
        (ax, ay), (bx, by) = triangle[k], triangle[(k + 1) % 3]
        dx, dy = bx - ax, by - ay
        side = [dx * (y - ay) - dy * (x - ax) for x, y in shape]
        out = []
        for p, q, s, t in zip(shape, [*shape[1:], shape[0]], side, [*side[1:], side[0]]):
            if s >= 0:
                out.append(p)
            if s * t < 0:
                along = s / (s - t)
                out.append((p[0] + (q[0] - p[0]) * along, p[1] + (q[1] - p[1]) * along))
        shape = out
    return shape


def _turn(shape: list) -> float:
    """Twice the signed area of a polygon."""
    turned = [*shape[1:], shape[0]]
    return sum(p[0] * q[1] for p, q in zip(shape, turned)) - sum(p[1] * q[0] for p, q in zip(shape, turned))


def polygon_overlap(a, b) -> float:
    """The common area of two polygons without self-crossings over the smaller of their areas. Each
    is the signed sum of its triangles about its first corner, so it needn't be convex."""
    a, b = ([(float(x), float(y)) for x, y in shape] for shape in (a, b))
    least = min(abs(_turn(a)), abs(_turn(b))) if min(len(a), len(b)) > 2 else 0.0
    if not least:
        return 0.0
    both = 0.0
    fans = [[(t, turn) for i in range(1, len(x) - 1) if (turn := _turn(t := [x[0], x[i], x[i + 1]]))] for x in (a, b)]
    for s, turn_s in fans[0]:
        for t, turn_t in fans[1]:
            part = _clipped(s if turn_s > 0 else s[::-1], t if turn_t > 0 else t[::-1])
            if len(part) > 2:
                both += _turn(part) * (1 if (turn_s > 0) == (turn_t > 0) else -1)
    return abs(both) / least


#: Boxes of different labels that both stay however much they overlap, by what they show.
_SHOWS = {"table": "table"} | {label: "picture" for label in VISUAL if label != "table"}
_BOTH_STAY = {("picture", "picture"), ("picture", "table"), ("picture", "text")}


def greedy_overlap_filter(boxes: DataFrame, polygon: str | None = None) -> DataFrame:
    """Overlaps resolved in order of box_idx; needs label. References and boxes with a side under
    6 pixels go. Of two live boxes an inline formula goes beyond half the smaller area; beyond
    0.7 the smaller goes (the later of equals), but different labels with a visual one among
    them both stay, unless one is a table and the other isn't visual. With a polygon column,
    corners as pairs, two boxes that both have one and whose polygons overlap by less than 0.7
    of the smaller both stay as well. On full pages a box is compared with those that touch it."""

    rules: dict[tuple, tuple[bool, bool, bool]] = {}

    def rule(a, b):
        """Of two labels: whether either is an inline formula, and whether both stay."""
        shown = tuple(sorted(_SHOWS.get(x, "text") for x in (a, b)))
        return a == "inline_formula", b == "inline_formula", a != b and shown in _BOTH_STAY

    def pick(cuts, labels, *given):
        x1, y1, x2, y2 = (v.astype(float) for v in given[:4])
        shapes = given[4] if polygon else None
        size = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)

        def ratio(i, j):
            w, h = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]), np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j])
            least = np.minimum(size[i], size[j])
            return np.maximum(w, 0) * np.maximum(h, 0) / np.where(least > 0, least, 1)

        # a tiny box goes when its turn comes: it may beat boxes before it, none behind it
        lasts = (x2 - x1 >= 6) & (y2 - y1 >= 6)
        alive = [True] * len(labels)

        def settle(i, later):
            """Pairs in the order of their turns; they count while both boxes live."""
            shares = ratio(i, later)
            hits = np.flatnonzero((shares > 0.5) & lasts[i])
            for i, j, share in zip(i[hits].tolist(), later[hits].tolist(), shares[hits].tolist()):
                if not (alive[i] and alive[j]):
                    continue
                pair = labels[i], labels[j]
                if pair not in rules:
                    rules[pair] = rule(*pair)
                inline_i, inline_j, stay = rules[pair]
                if inline_i or inline_j:
                    alive[i], alive[j] = not inline_i, not inline_j
                elif share > 0.7 and not stay:
                    if shapes is not None and (a := shapes[i].as_py()) is not None and (b := shapes[j].as_py()) is not None and polygon_overlap(a, b) < 0.7:
                        continue
                    alive[j if size[i] >= size[j] else i] = False

        # runs of small pages as all their pairs at once, a full page box by box
        full = np.flatnonzero(np.diff(cuts) > MATRIX).tolist()
        begin = 0
        for k in [*full, len(cuts) - 1]:
            if k > begin:
                ends = np.repeat(cuts[begin + 1 : k + 1], np.diff(cuts[begin : k + 1]))
                at = np.arange(cuts[begin], cuts[k])
                after = ends - at - 1
                first = np.repeat(at, after)
                settle(first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after))
            if k < len(cuts) - 1:
                lo, hi = cuts[k], cuts[k + 1]
                a, b, c, d = (v[lo:hi] for v in (x1, y1, x2, y2))
                near = Neighbours(a, b, np.maximum(a, c), np.maximum(b, d))
                for i in range(lo, hi):
                    if alive[i] and lasts[i]:
                        later = lo + near.after(i - lo)
                        settle(np.full(len(later), i), later)
            begin = k + 1
        return np.flatnonzero(lasts & np.array(alive, bool))

    columns = ("label", *BOX, polygon) if polygon else ("label", *BOX)
    return chosen_rows(boxes.where(F.coalesce(F.col("label") != "reference", F.lit(True))), "page_id", ["box_idx"], columns, pick, many=True)


def numbered(rows: DataFrame, skip: Column, order: str, name: str = "order") -> DataFrame:
    """Counts the rows that aren't skipped along `order` within a page; skipped ones get null."""
    w = Window.partitionBy("page_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.when(~skip, F.sum(F.when(~skip, 1)).over(w)))


def figures_in_tables(tables: DataFrame, figures: DataFrame, min_side: int = 25) -> DataFrame:
    """(page_id, table_idx, figure_idx, path, token): figures wholly within a table. Those with a
    side under min_side have no token; tokens number a page's figures."""
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("box_idx"))
    f = _side(figures.withColumn("path", asset_path()).withColumn("number", number), "f_")
    t = _side(tables, "t_")
    inside = (F.col("f_x1") >= F.col("t_x1")) & (F.col("f_y1") >= F.col("t_y1")) & (F.col("f_x2") <= F.col("t_x2")) & (F.col("f_y2") <= F.col("t_y2"))
    side = F.least(F.col("f_x2") - F.col("f_x1"), F.col("f_y2") - F.col("f_y1"))
    token = F.when(side >= min_side, F.concat(F.lit("[F"), F.col("f_number").cast("string"), F.lit("]")))
    return t.join(f, "page_id").where(inside).select("page_id", F.col("t_box_idx").alias("table_idx"), F.col("f_box_idx").alias("figure_idx"), F.col("f_path").alias("path"), token.alias("token"))


def asset_path() -> Column:
    """Where a cropped figure is stored; needs label and the box."""
    return F.format_string("imgs/img_in_%s_box_%d_%d_%d_%d.jpg", F.col("label"), *[F.col(c).cast("long") for c in BOX])


def figures_of(boxes: DataFrame) -> DataFrame:
    return boxes.where(F.col("label").isin("image", "figure", "seal")).withColumn("path", asset_path())


def prompt_for(label: Column, chart: bool = False, seal: bool = False) -> Column:
    """The recognition prompt of a region, null where it has none."""
    # The prompts of the recognition model.
    prompts = {"table": "Table Recognition:", "chart": "Chart Recognition:", "seal": "Seal Recognition:", "spotting": "Spotting:"}
    out = F.when(label.isin(*IMAGES), None)
    out = out if chart else out.when(label == "chart", None)
    out = out if seal else out.when(label == "seal", None)
    out = out.when(label.contains("formula") & (label != "formula_number"), "Formula Recognition:")
    for k, v in prompts.items():
        out = out.when(label == k, v)
    return out.otherwise("OCR:")
