"""Table markup: six cell tokens as cell rows, squared, with spans, and as HTML.

Tokens: fcel full, ecel empty, lcel spans left, ucel spans up, xcel both, nl row end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import escape, strip
from foliospark.operators.groupwise import chosen_rows

_TAG = "<(?:fcel|ecel|lcel|ucel|xcel)>"
_CELL = rf"(?s)({_TAG}.*?)(?={_TAG}|$)"


def _lines(text: Column) -> Column:
    """Arrays of raw cells, a row each; rows without a cell are left out."""
    cut = F.transform(F.split(strip(text), "<nl>", -1), lambda line: F.regexp_extract_all(line, F.lit(_CELL), F.lit(1)))
    return F.filter(cut, lambda cells: F.size(cells) > 0)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body, or a loop in it, names it."""
    return F.transform(F.array(value), body)[0]


def squared(tables: DataFrame, text: str = "text", key: str = "table_id") -> DataFrame:
    """(key, rows): rows of raw cells at one width, of the widths from the last full cell to the
    longest row the smallest with the least sum of differences; longer rows are cut, shorter
    ones filled with empty cells. Text without a row end is one row; without a cell, none."""
    # place of the last full cell, counted from 1; 0 where there is none
    full = lambda cells: F.array_max(F.transform(cells, lambda x, i: F.when(x.startswith("<fcel>"), i + 1).otherwise(0)))
    cost = lambda sizes, w: F.aggregate(sizes, F.lit(0), lambda n, size: n + F.abs(size - w))

    def width(sizes: Column, low: Column) -> Column:
        widths = F.sequence(low, F.greatest(low, F.array_max(sizes)))
        return F.array_min(F.transform(widths, lambda w: F.struct(cost(sizes, w).alias("cost"), w.alias("w"))))["w"]

    def even(rows: Column) -> Column:
        sizes, low = F.transform(rows, F.size), F.array_max(F.transform(rows, full))
        wide = _let(sizes, lambda s: _let(low, lambda n: width(s, n)))
        return _let(wide, lambda w: F.transform(rows, lambda cells: F.slice(F.concat(cells, F.array_repeat(F.lit("<ecel>"), w)), F.lit(1), w)))

    squares = _let(_lines(F.col(text)), lambda rows: F.when(F.col(text).contains("<nl>") & (F.size(rows) > 0), even(rows)).otherwise(rows))
    return tables.select(key, squares.alias("rows")).where(F.size("rows") > 0)


def cells(tables: DataFrame, text: str = "text", key: str = "table_id") -> DataFrame:
    """(key, r, c, tag, text) of every cell of the squared table; text only in full cells."""
    rows = squared(tables, text, key).select(key, F.posexplode("rows").alias("r", "row")).select(key, "r", F.posexplode("row").alias("c", "cell"))
    tag = F.regexp_extract("cell", "^<(....)>", 1)
    return rows.select(key, "r", "c", tag.alias("tag"), F.when(tag == "fcel", strip(F.substring("cell", 7, 1 << 30))).otherwise("").alias("text"))


def _with_spans(cell_rows: DataFrame, key: str) -> DataFrame:
    right = Window.partitionBy(key, "r").orderBy("c").rowsBetween(1, Window.unboundedFollowing)
    down = Window.partitionBy(key, "c").orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    stop_c = F.min(F.when(~F.col("tag").isin("lcel", "xcel"), F.col("c"))).over(right)
    stop_r = F.min(F.when(~F.col("tag").isin("ucel", "xcel"), F.col("r"))).over(down)
    end_c, end_r = F.coalesce(stop_c, F.max("c").over(right) + 1, F.col("c") + 1), F.coalesce(stop_r, F.max("r").over(down) + 1, F.col("r") + 1)
    return cell_rows.withColumn("col_span", end_c - F.col("c")).withColumn("row_span", end_r - F.col("r"))


def spanned(cell_rows: DataFrame, key: str = "table_id") -> DataFrame:
    """Full and empty cells with col_span and row_span: up to the next cell of the row that doesn't
    span left, and the next of the column that doesn't span up."""
    return _with_spans(cell_rows, key).where(F.col("tag").isin("fcel", "ecel"))


def html_tables(cell_rows: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, html): each place of the grid belongs to the last cell that covers it; a cell is
    written where it begins, places that no cell covers as empty ones. Cells are dealt by table
    once. Spans and who owns a place are worked out for all tables of a batch at once, and where
    cells cover much more than there are cells, on a grid of cell numbers, a table at a time,
    four bytes a place; a cell's text stays with its one row."""
    tag = F.col("tag")
    stops = lambda *tags: F.coalesce(~tag.isin(*tags), F.lit(False))
    marks = {"full": F.coalesce(tag.isin("fcel", "ecel"), F.lit(False)), "ends_row": stops("lcel", "xcel"), "ends_column": stops("ucel", "xcel")}
    rows = cell_rows.select(key, "r", "c", "text", *[v.alias(k) for k, v in marks.items()])
    added = {"own": "boolean", "row_span": "int", "col_span": "int", "opens": "boolean", "begins": "boolean", "blank": "boolean", "at": "long"}
    shown = chosen_rows(rows, key, ["r", "c"], ("r", "c", *marks), _written, added, many=True)
    span = lambda name, n: F.when(F.col("own") & (F.col(n) > 1), F.concat(F.lit(f' {name}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), escape(F.when(F.col("own"), F.col("text")).otherwise("")), F.lit("</td>"))
    tr = F.when(F.col("begins"), "<tr>").when(F.col("opens"), "</tr><tr>").otherwise("")
    piece = F.concat(tr, F.when(F.col("blank"), "").otherwise(F.coalesce(td, F.lit(""))))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda x: x["piece"])
    return shown.groupBy(key).agg(F.concat(F.lit("<table>"), F.array_join(pieces, ""), F.lit("</tr></table>")).alias("html"))


def _next_stop(place: np.ndarray, stop: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each cell of lines one behind the other: the place of the next cell of its line that
    stops a span, or one more than the last place of the line."""
    n = len(place)
    last = np.append(np.flatnonzero(line[1:] != line[:-1]), n - 1)[line]
    at = np.where(stop, np.arange(n), n)
    following = np.append(np.minimum.accumulate(at[::-1])[::-1][1:], n)
    return np.where(following <= last, place[np.minimum(following, n - 1)], place[last] + 1)


def _lines_of(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    new = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


#: Tables whose places, and places covered, are more than so many times their cells are painted alone.
_MUCH = 8


def _written(cuts, r, c, full, ends_row, ends_column):
    """Of a run of tables, in order: the cells that are written, and one of each row without such."""
    sizes, tables = np.diff(cuts), len(cuts) - 1
    of = np.repeat(np.arange(tables), sizes)
    r, c, full = r.astype(np.int64), c.astype(np.int64), full.astype(bool)
    line = _lines_of(of, r)
    columns = _next_stop(c, ends_row.astype(bool), line) - c
    down = np.lexsort((r, c, of))
    rows = np.empty_like(r)
    rows[down] = _next_stop(r[down], ends_column.astype(bool)[down], _lines_of(of[down], c[down])) - r[down]
    own, shown = np.zeros(len(r), bool), np.zeros(len(r), bool)
    most = lambda x: np.maximum.reduceat(x, cuts[:-1])
    height, width = most(r) + 1, most(c) + 1
    area = np.where(full, rows * columns, 0)
    covered = np.add.reduceat(area, cuts[:-1])
    alone = (height * width > _MUCH * sizes + 64) | (covered > _MUCH * sizes + 64)

    # all others: owners of places, the grids one behind the other
    grid = np.where(alone, 0, height * width)
    base = np.cumsum(grid) - grid
    owner = np.full(int(grid.sum()), -1, np.int64)
    k = np.flatnonzero(full & ~alone[of])
    cell, within = np.repeat(k, area[k]), np.arange(area[k].sum()) - np.repeat(np.cumsum(area[k]) - area[k], area[k])
    # of cells that cover one place the last one stays
    owner[base[of[cell]] + (r[cell] + within // columns[cell]) * width[of[cell]] + c[cell] + within % columns[cell]] = cell
    i = np.flatnonzero(~alone[of])
    mine = owner[base[of[i]] + r[i] * width[of[i]] + c[i]]
    own[i], shown[i] = mine == i, (mine < 0) | (mine == i)

    for t in np.flatnonzero(alone).tolist():
        lo, hi = int(cuts[t]), int(cuts[t + 1])
        painted = np.full((int(height[t]), int(width[t])), -1, np.int32)
        for k in (lo + np.flatnonzero(full[lo:hi])).tolist():
            painted[r[k] : r[k] + rows[k], c[k] : c[k] + columns[k]] = k - lo
        mine = painted[r[lo:hi], c[lo:hi]]
        own[lo:hi], shown[lo:hi] = mine == np.arange(hi - lo), (mine < 0) | (mine == np.arange(hi - lo))

    # a row of the table that begins no cell stays as an empty one
    some = np.zeros(int(line[-1]) + 1, bool)
    some[line[shown]] = True
    starts = np.append(True, line[1:] != line[:-1])
    blank = starts & ~some[line]
    at = np.flatnonzero(shown | blank)
    opens = np.append(True, line[at][1:] != line[at][:-1])
    begins = np.append(True, of[at][1:] != of[at][:-1])
    return at, own[at], rows[at].astype(np.int32), columns[at].astype(np.int32), opens, begins, blank[at], at - cuts[of[at]]
