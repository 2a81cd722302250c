"""Boxes of a page that meet: an equi-join over the cells of nested grids, and neighbours in arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
#: A page of so few boxes is one cell. A box of a fuller one has its home in the grid whose cells are
#: at least as wide and high as it is, so in four cells at most; the finest cells have a side of 8.
FEW, FINEST, WHOLE = 64, 3, 62


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _cells(rows: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of the grid `level` that a box touches."""
    span = lambda lo, hi: F.when(level == WHOLE, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col(lo) / _side(level)), F.floor(F.col(hi) / _side(level))))
    return rows.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def meeting(left: DataFrame, right: DataFrame | None, fields: tuple[str, ...], page: str = "page_id") -> DataFrame:
    """(page, a, b): boxes of one page that have an area in common, a of `left` and b of `right`, as
    structs of `fields` and the corners. Without `right` each pair of `left` comes once, the one
    that is less by `fields` first.

    Every box stands in the cells of its own grid and looks for others there and in all coarser
    grids that its page uses; a pair is kept in the one cell that holds the common corner. So
    work grows with the boxes and the pairs found, not with the square of a page. Boxes without
    an area, or with a corner that is no finite number, meet nothing; equal boxes meet. A null
    page has no pairs.
    """
    told = lambda df, k: df.select(page, F.lit(k).alias("side"), F.struct(*fields).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    rows = told(left, 0) if right is None else told(left, 0).unionByName(told(right, 1))
    whole = Window.partitionBy(page)
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = F.greatest(F.ceil(F.log2(extent)), F.lit(FINEST)).cast("int")
    finite = reduce(lambda x, y: x & y, [F.abs(F.col(c)) < float("inf") for c in BOX])
    rows = rows.where(finite & F.expr("x2 > x1 AND y2 > y1")).withColumn("own", F.when(F.count(F.lit(1)).over(whole) <= FEW, F.lit(WHOLE)).otherwise(F.least(own, F.lit(WHOLE - 1))))
    rows = rows.withColumn("used", F.collect_set("own").over(whole))
    home = _cells(rows.select(page, "side", "own", F.col("own").alias("level"), "id", *BOX), F.col("level"))
    probe = _cells(rows.select(page, "side", "own", F.explode(F.filter("used", lambda g: g >= F.col("own"))).alias("level"), "id", *BOX), F.col("level"))
    named = lambda df, p: df.select(page, "level", "cx", "cy", *[F.col(c).alias(p + c) for c in ("side", "own", "id", *BOX)])
    h, p = named(home, "h_"), named(probe, "p_")
    on = [page, "level", "cx", "cy"]
    if right is None:
        met = h.join(p, on).where((F.col("p_own") < F.col("h_own")) | (F.col("h_id") < F.col("p_id")))
    else:
        other = h.withColumn("other", 1 - F.col("h_side")).join(p.withColumn("other", F.col("p_side")), [*on, "other"])
        met = other.where((F.col("p_own") < F.col("h_own")) | (F.col("h_side") == 0))
    low = {c: F.greatest("h_" + c, "p_" + c) for c in ("x1", "y1")}
    met = met.where((F.least("h_x2", "p_x2") > low["x1"]) & (F.least("h_y2", "p_y2") > low["y1"]))
    corner = (F.floor(low["x1"] / _side(F.col("level"))) == F.col("cx")) & (F.floor(low["y1"] / _side(F.col("level"))) == F.col("cy"))
    met = met.where((F.col("level") == WHOLE) | corner)
    as_struct = lambda p: F.struct(*[F.col(f"{p}id")[f].alias(f) for f in fields], *[F.col(p + c).alias(c) for c in BOX])
    first = F.col("h_id") < F.col("p_id") if right is None else F.col("h_side") == 0
    return met.select(page, F.when(first, as_struct("h_")).otherwise(as_struct("p_")).alias("a"), F.when(first, as_struct("p_")).otherwise(as_struct("h_")).alias("b"))


class Neighbours:
    """Boxes of one page, as arrays, by the cells of nested grids; memory is linear in them. Boxes
    with a corner that is no finite number touch nothing."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        self.corners = x1, y1, x2, y2
        self.finite = np.isfinite(np.stack(self.corners)).all(0)
        extent = np.maximum(np.maximum(x2 - x1, y2 - y1), 1)
        level = np.where(self.finite, np.maximum(np.ceil(np.log2(np.where(self.finite, extent, 1))), FINEST), 0).astype(int)
        self.grids = []
        for g in np.unique(level[self.finite]):
            at, cells = np.flatnonzero(self.finite & (level == g)), {}
            for i, *box in zip(at.tolist(), *((v[at] // 2.0**g).astype(np.int64).tolist() for v in self.corners)):
                for cx in range(box[0], box[2] + 1):
                    for cy in range(box[1], box[3] + 1):
                        cells.setdefault((cx, cy), []).append(i)
            self.grids.append((2.0**g, at, {k: np.array(v) for k, v in cells.items()}))

    def after(self, i: int) -> np.ndarray:
        """Boxes behind i that touch it, in order."""
        if not self.finite[i]:
            return np.zeros(0, np.int64)
        x1, y1, x2, y2 = (v[i] for v in self.corners)
        found = []
        for side, at, cells in self.grids:
            xs, ys = range(int(x1 // side), int(x2 // side) + 1), range(int(y1 // side), int(y2 // side) + 1)
            if len(xs) * len(ys) > len(at):
                found.append(at)
            else:
                found += [cells[c] for cx in xs for cy in ys if (c := (cx, cy)) in cells]
        if not found:
            return np.zeros(0, np.int64)
        j = np.concatenate(found)
        j = j[j > i]
        a, b, c, d = (v[j] for v in self.corners)
        return np.unique(j[(a <= x2) & (c >= x1) & (b <= y2) & (d >= y1)])
