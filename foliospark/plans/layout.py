"""Queries on layout boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import layout as L
from foliospark.plans.views import oracle, table

_LABELS = "[" + ", ".join(f"'{n}'" for n in L.LABELS) + "]"
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def boxes(s, d):
    return table(s, d, "v_boxes")


def pages(s, d):
    return table(s, d, "v_page_dim")


KEY = ["page_id", "box_idx"]
_AREA = lambda p: f"(CAST(greatest({p}.x2 - {p}.x1, 0) AS DOUBLE) * CAST(greatest({p}.y2 - {p}.y1, 0) AS DOUBLE))"
_INTER = "(CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) AS DOUBLE) * CAST(greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS DOUBLE))"
_PAIRS = "FROM {v_boxes} a JOIN {v_boxes} b ON a.page_id = b.page_id AND a.box_idx < b.box_idx"


def _ratio(mode: str) -> str:
    below = {"small": f"least({_AREA('a')}, {_AREA('b')})", "large": f"greatest({_AREA('a')}, {_AREA('b')})"}.get(mode, f"({_AREA('a')} + {_AREA('b')} - {_INTER})")
    return f"CASE WHEN {below} > 0 THEN {_INTER} / {below} ELSE 0.0 END"


def pair_overlaps(s, d):
    p = L.box_pairs(boxes(s, d))
    return p.select("page_id", "a_box_idx", "b_box_idx", *[L.overlap(m).alias(f"overlap_{m}") for m in ("union", "small", "large")])


def meeting_overlaps(s, d):
    p = L.overlapping_pairs(boxes(s, d))
    return p.select("page_id", "a_box_idx", "b_box_idx", *[L.overlap(m).alias(f"overlap_{m}") for m in ("union", "small", "large")])


def projection_overlaps(s, d):
    p = L.box_pairs(boxes(s, d))
    return p.select("page_id", "a_box_idx", "b_box_idx", *[L.projection_overlap(x, m).alias(f"{x}_{m}") for x in ("horizontal", "vertical") for m in ("union", "small", "large")])


def _projection_sql() -> str:
    out = []
    for name, lo, hi in (("horizontal", "x1", "x2"), ("vertical", "y1", "y2")):
        both = f"(least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo}))"
        for m in ("union", "small", "large"):
            below = {"small": f"least(a.{hi} - a.{lo}, b.{hi} - b.{lo})", "large": f"greatest(a.{hi} - a.{lo}, b.{hi} - b.{lo})"}.get(m, f"(greatest(a.{hi}, b.{hi}) - least(a.{lo}, b.{lo}))")
            out.append(f"CASE WHEN {both} > 0 AND {below} > 0 THEN {both} / {below} ELSE 0.0 END AS {name}_{m}")
    return ", ".join(out)


def figure_tables(s, d):
    """Tables are widened, as few of the derived ones hold a figure."""
    b = L.with_labels(boxes(s, d))
    wide = b.where("label = 'table'").withColumns({"x1": F.col("x1") - 200, "y1": F.col("y1") - 300, "x2": F.col("x2") + 200, "y2": F.col("y2") + 300})
    return L.figures_in_tables(wide, L.figures_of(b))


def kept_figures(s, d):
    """Figures that stand in no table."""
    b = L.with_labels(boxes(s, d))
    gone = figure_tables(s, d).select("page_id", "path").distinct()
    return L.figures_of(b).join(gone, ["page_id", "path"], "left_anti").select("page_id", "box_idx", "label", "path")


_FIG = f"""
b AS (SELECT *, ({_LABELS})[cls_id + 1] AS label FROM {{v_boxes}}),
f AS (SELECT *, 'imgs/img_in_' || label || '_box_' || x1 || '_' || y1 || '_' || x2 || '_' || y2 || '.jpg' AS path,
        row_number() OVER (PARTITION BY page_id ORDER BY box_idx) AS number FROM b WHERE label IN ('image', 'figure', 'seal')),
held AS (SELECT f.page_id, t.box_idx AS table_idx, f.box_idx AS figure_idx, f.path,
        CASE WHEN least(f.x2 - f.x1, f.y2 - f.y1) >= 25 THEN '[F' || f.number || ']' END AS token
      FROM f JOIN b t ON f.page_id = t.page_id AND t.label = 'table' AND f.x1 >= t.x1 - 200 AND f.y1 >= t.y1 - 300 AND f.x2 <= t.x2 + 200 AND f.y2 <= t.y2 + 300)"""

def polygons(s, d):
    """Every second box is a diamond in its corners, every third has no polygon."""
    x, y = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    corner = lambda a, b: F.array(F.col(a).cast("double") if isinstance(a, str) else a, F.col(b).cast("double") if isinstance(b, str) else b)
    diamond = F.array(corner(x, "y1"), corner("x2", y), corner(x, "y2"), corner("x1", y))
    shaped = L.with_polygon(L.with_labels(boxes(s, d))).withColumn("polygon", F.when(F.col("box_idx") % 3 == 0, None).when(F.col("box_idx") % 2 == 0, diamond).otherwise(F.col("polygon")))
    return L.greedy_overlap_filter(shaped.select(*KEY, "label", *L.BOX, "polygon"), "polygon").select(*KEY, "label")


QUERIES = {
    "p1_confidence_filter": lambda s, d: L.confidence_filter(boxes(s, d).withColumns({c: F.col(c) + F.lit(0.5) for c in L.BOX}), 0.3).select(*KEY, "cls_id", "score", *L.BOX),
    "p2_oversized_images": lambda s, d: L.drop_oversized_images(boxes(s, d).withColumns({"x2": F.col("x2") + 300, "y2": F.col("y2") + 500}), pages(s, d)).select(*KEY, "cls_id"),
    "p3_unclip": lambda s, d: L.unclip(boxes(s, d), {0: (1.5, 2.0), 3: (0.5, 1.25)}).select(*KEY, *L.BOX),
    "p4_clip_to_page": lambda s, d: L.clip_to_page(boxes(s, d), pages(s, d)).select(*KEY, "ord", *L.BOX),
    "p5_default_polygon": lambda s, d: L.with_polygon(boxes(s, d)).select(*KEY, F.to_json("polygon").alias("polygon")),
    "p6_label_dimension": lambda s, d: L.with_labels(boxes(s, d)).groupBy("label", "skip_order", "md_ignore", "is_image", "non_merge", "merge_mode").agg(F.count(F.lit(1)).alias("n")),
    "p7_prompt_routing": lambda s, d: L.with_labels(boxes(s, d)).select(*KEY, "label", L.prompt_for(F.col("label")).alias("prompt"), L.prompt_for(F.col("label"), True, True).alias("prompt_all")),
    "p11_figure_assets": lambda s, d: L.figures_of(L.with_labels(boxes(s, d))).select(*KEY, "label", "path"),
    "j1_overlap_pairs": pair_overlaps,
    "j1_overlapping_pairs": meeting_overlaps,
    "j1b_pixel_iou": lambda s, d: L.box_pairs(boxes(s, d)).select("page_id", "a_box_idx", "b_box_idx", L.pixel_iou().alias("iou")),
    "j1c_projection_overlap": projection_overlaps,
    "j2_containment_large": lambda s, d: L.suppress_contained(boxes(s, d)).select(*KEY),
    "j2_containment_small": lambda s, d: L.suppress_contained(boxes(s, d), {3: "small", 7: "small", 22: "small"}).select(*KEY),
    "j3_class_nms": lambda s, d: L.nms(boxes(s, d)).select(*KEY, "nms_rank"),
    "j4_greedy_overlap": lambda s, d: L.greedy_overlap_filter(L.with_labels(boxes(s, d)).select(*KEY, "label", *L.BOX)).select(*KEY, "label"),
    "j4_polygon_overlap": polygons,
    "p8_reference_and_tiny": lambda s, d: L.greedy_overlap_filter(L.with_labels(boxes(s, d)).withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) % 40).select(*KEY, "label", *L.BOX)).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "j5_figures_in_tables": figure_tables,
    "j6_remaining_figures": kept_figures,
    "w1_reading_order": lambda s, d: L.reading_order(boxes(s, d).withColumn("tie", F.col("score"))).select(*KEY, "pos"),
    "w2_box_numbering": lambda s, d: L.numbered(L.with_labels(boxes(s, d)), F.col("skip_order"), "box_idx").select(*KEY, "label", "order"),
    "w2_block_numbering": lambda s, d: L.numbered(L.with_labels(boxes(s, d)), F.col("skip_order") | F.col("md_ignore"), "box_idx").select(*KEY, "label", "order"),
}

_TO_LABEL = f"({_LABELS})[cls_id + 1]"
_PROMPT = lambda extra: f"""CASE WHEN label IN {_in(L.IMAGES)} THEN NULL {extra} WHEN contains(label, 'formula') AND label <> 'formula_number' THEN 'Formula Recognition:'
  WHEN label = 'table' THEN 'Table Recognition:' WHEN label = 'chart' THEN 'Chart Recognition:' WHEN label = 'seal' THEN 'Seal Recognition:' WHEN label = 'spotting' THEN 'Spotting:' ELSE 'OCR:' END"""  # noqa: E731
_NUMBER = lambda skip: f"SELECT page_id, box_idx, label, CASE WHEN label NOT IN {_in(skip)} THEN CAST(sum(CASE WHEN label NOT IN {_in(skip)} THEN 1 END) OVER (PARTITION BY page_id ORDER BY box_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS \"order\" FROM (SELECT *, {_TO_LABEL} AS label FROM {{v_boxes}})"
_EVEN = lambda c: f"CAST(CASE WHEN {c} % 2 = 0 THEN {c} ELSE {c} + 1 END AS INT) AS {c}"  # noqa: E731  c + 0.5, half to even
_HELD = f"SELECT a.page_id, a.box_idx AS inner_idx, a.cls_id AS inner_cls, b.box_idx AS outer_idx, b.cls_id AS outer_cls FROM {{v_boxes}} a JOIN {{v_boxes}} b ON a.page_id = b.page_id AND a.box_idx <> b.box_idx WHERE {_AREA('a')} > 0 AND {_INTER} / {_AREA('a')} >= 0.9"

_IOU1 = """(CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0) AS DOUBLE)
  / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0)))"""
# One step a box: it is kept unless one of those kept before beats it.
_NMS = f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, box_idx DESC) AS k FROM {{v_boxes}}),
beats AS (SELECT a.page_id, b.k, list(a.k) AS winners FROM r a JOIN r b ON a.page_id = b.page_id AND a.k < b.k
  WHERE {_IOU1} >= CASE WHEN a.cls_id = b.cls_id THEN 0.6 ELSE 0.98 END GROUP BY a.page_id, b.k),
turn AS (SELECT r.page_id, r.k, coalesce(winners, []) AS winners FROM r LEFT JOIN beats USING (page_id, k)),
s AS (SELECT page_id, k, [k] AS kept FROM turn WHERE k = 1
  UNION ALL SELECT t.page_id, t.k, CASE WHEN list_has_any(s.kept, t.winners) THEN s.kept ELSE list_append(s.kept, t.k) END
  FROM s JOIN turn t ON t.page_id = s.page_id AND t.k = s.k + 1),
kept AS (SELECT page_id, unnest(arg_max(kept, k)) AS k FROM s GROUP BY page_id)
SELECT page_id, box_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS nms_rank FROM kept JOIN r USING (page_id, k)"""
_SHARE = f"CASE WHEN least({_AREA('a')}, {_AREA('b')}) > 0 THEN {_INTER} / least({_AREA('a')}, {_AREA('b')}) ELSE 0e0 END"


def _greedy_sql(boxes: str, out: str) -> str:
    """One step a pair, in order of the earlier and the later box: where both are still there, `lost` go."""
    seen = lambda p: f"{p}.label IN {_in(L.VISUAL)}"
    return f"""
WITH RECURSIVE v AS ({boxes}), b AS (SELECT * FROM v WHERE label <> 'reference'),
p AS (SELECT a.page_id, a.box_idx AS i, b.box_idx AS j, a.label = 'inline_formula' AS ai, b.label = 'inline_formula' AS bi, {_SHARE} AS share, {_AREA('a')} >= {_AREA('b')} AS later,
    a.label <> b.label AND ({seen('a')} OR {seen('b')}) AND ('table' NOT IN (a.label, b.label) OR {seen('a')} AND {seen('b')}) AS stay
  FROM b a JOIN b ON a.page_id = b.page_id AND a.box_idx < b.box_idx WHERE a.x2 - a.x1 >= 6 AND a.y2 - a.y1 >= 6),
l AS (SELECT page_id, i, j, CASE WHEN ai AND bi THEN [i, j] WHEN ai THEN [i] WHEN bi THEN [j] WHEN share <= 0.7 OR stay THEN [] WHEN later THEN [j] ELSE [i] END AS lost FROM p WHERE share > 0.5),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS n FROM l),
s AS (SELECT page_id, n, lost AS gone FROM e WHERE n = 1
  UNION ALL SELECT e.page_id, e.n, CASE WHEN list_has_any(s.gone, [e.i, e.j]) THEN s.gone ELSE list_concat(s.gone, e.lost) END FROM s JOIN e ON e.page_id = s.page_id AND e.n = s.n + 1),
gone AS (SELECT page_id, unnest(arg_max(gone, n)) AS box_idx FROM s GROUP BY page_id)
{out} FROM b ANTI JOIN gone USING (page_id, box_idx) WHERE x2 - x1 >= 6 AND y2 - y1 >= 6"""


ORACLES = {
    "p1_confidence_filter": oracle(f"SELECT page_id, box_idx, cls_id, score, {', '.join(map(_EVEN, L.BOX))} FROM {{v_boxes}} WHERE score > 0.3 AND cls_id > -1"),
    "p2_oversized_images": oracle("""
WITH m AS (SELECT page_id, box_idx, cls_id, cls_id <> 14 OR CAST(greatest(least(x2 + 300, 600) - greatest(x1, 0), 0) * greatest(least(y2 + 500, 800) - greatest(y1, 0), 0) AS DOUBLE) <= 0.93 * 600 * 800 AS fits FROM {v_boxes}),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, bool_or(fits) OVER (PARTITION BY page_id) AS any_fits FROM m)
SELECT page_id, box_idx, cls_id FROM n WHERE fits OR n = 1 OR NOT any_fits"""),
    "p3_unclip": oracle("""
WITH r AS (SELECT *, CASE cls_id WHEN 0 THEN 1.5e0 WHEN 3 THEN 0.5e0 ELSE 1e0 END AS rw, CASE cls_id WHEN 0 THEN 2e0 WHEN 3 THEN 1.25e0 ELSE 1e0 END AS rh FROM {v_boxes})
SELECT page_id, box_idx, (x1 + x2) / 2 - (x2 - x1) * rw / 2 AS x1, (y1 + y2) / 2 - (y2 - y1) * rh / 2 AS y1, (x1 + x2) / 2 + (x2 - x1) * rw / 2 AS x2, (y1 + y2) / 2 + (y2 - y1) * rh / 2 AS y2 FROM r"""),
    "p4_clip_to_page": oracle("""
WITH c AS (SELECT page_id, box_idx, row_number() OVER (PARTITION BY page_id ORDER BY read_order, box_idx) AS ord,
  least(greatest(x1, 0), 600) AS x1, least(greatest(y1, 0), 800) AS y1, least(greatest(x2, 0), 600) AS x2, least(greatest(y2, 0), 800) AS y2 FROM {v_boxes})
SELECT * FROM c WHERE x2 > x1 AND y2 > y1"""),
    "p5_default_polygon": oracle("SELECT page_id, box_idx, '[[' || x1 || '.0,' || y1 || '.0],[' || x2 || '.0,' || y1 || '.0],[' || x2 || '.0,' || y2 || '.0],[' || x1 || '.0,' || y2 || '.0]]' AS polygon FROM {v_boxes}"),
    "p6_label_dimension": oracle(f"SELECT label, label IN {_in(L.SKIP_ORDER)} AS skip_order, label IN {_in(L.MARKDOWN_IGNORED)} AS md_ignore, label IN {_in(L.IMAGES)} AS is_image, label IN {_in(L.NON_MERGE)} AS non_merge, CASE WHEN cls_id IN (3, 5, 6, 15, 17) THEN 'large' ELSE 'union' END AS merge_mode, count(*) AS n FROM (SELECT *, {_TO_LABEL} AS label FROM {{v_boxes}}) GROUP BY ALL"),
    "p7_prompt_routing": oracle(f"SELECT page_id, box_idx, label, {_PROMPT(chr(10) + ' WHEN label IN (' + chr(39) + 'chart' + chr(39) + ', ' + chr(39) + 'seal' + chr(39) + ') THEN NULL')} AS prompt, {_PROMPT('')} AS prompt_all FROM (SELECT *, {_TO_LABEL} AS label FROM {{v_boxes}})"),
    "p11_figure_assets": oracle(f"WITH {_FIG.strip()} SELECT page_id, box_idx, label, path FROM f"),
    "j1_overlap_pairs": oracle(f"SELECT a.page_id, a.box_idx AS a_box_idx, b.box_idx AS b_box_idx, {', '.join(f'{_ratio(m)} AS overlap_{m}' for m in ('union', 'small', 'large'))} {_PAIRS}"),
    "j1_overlapping_pairs": oracle(f"SELECT a.page_id, a.box_idx AS a_box_idx, b.box_idx AS b_box_idx, {', '.join(f'{_ratio(m)} AS overlap_{m}' for m in ('union', 'small', 'large'))} {_PAIRS} WHERE {_INTER} > 0"),
    "j1b_pixel_iou": oracle(f"""
WITH p AS (SELECT a.page_id, a.box_idx AS a_box_idx, b.box_idx AS b_box_idx,
  CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0) AS DOUBLE) AS i,
  CAST((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) AS DOUBLE) AS sa, CAST((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS DOUBLE) AS sb {_PAIRS})
SELECT page_id, a_box_idx, b_box_idx, i / (sa + sb - i) AS iou FROM p"""),
    "j1c_projection_overlap": oracle(f"SELECT a.page_id, a.box_idx AS a_box_idx, b.box_idx AS b_box_idx, {_projection_sql()} {_PAIRS}"),
    "j2_containment_large": oracle(f"WITH h AS ({_HELD}) SELECT page_id, box_idx FROM {{v_boxes}} v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = v.page_id AND h.inner_idx = v.box_idx AND h.outer_cls IN (3, 5, 6, 15, 17))"),
    "j2_containment_small": oracle(f"""
WITH h AS ({_HELD}), i AS (SELECT DISTINCT page_id, inner_cls AS c, inner_idx AS box_idx FROM h WHERE inner_cls IN (3, 7, 22)), o AS (SELECT DISTINCT page_id, inner_cls AS c, outer_idx AS box_idx FROM h WHERE inner_cls IN (3, 7, 22)),
gone AS (SELECT page_id, box_idx FROM o ANTI JOIN i USING (page_id, c, box_idx))
SELECT page_id, box_idx FROM {{v_boxes}} ANTI JOIN gone USING (page_id, box_idx)"""),
    "j3_class_nms": oracle(_NMS),
    "j4_greedy_overlap": oracle(_greedy_sql(f"SELECT *, {_TO_LABEL} AS label FROM {{v_boxes}}", "SELECT page_id, box_idx, label")),
    "p8_reference_and_tiny": oracle(_greedy_sql(f"SELECT * REPLACE (x1 + (x2 - x1) % 40 AS x2), {_TO_LABEL} AS label FROM {{v_boxes}}", "SELECT label, count(*) AS n") + " GROUP BY label"),
    "j5_figures_in_tables": oracle(f"WITH {_FIG.strip()} SELECT * FROM held"),
    "j6_remaining_figures": oracle(f"WITH {_FIG.strip()} SELECT page_id, box_idx, label, path FROM f ANTI JOIN held USING (page_id, path)"),
    "w1_reading_order": oracle("SELECT page_id, box_idx, row_number() OVER (PARTITION BY page_id ORDER BY read_order, score DESC, box_idx) AS pos FROM {v_boxes}"),
    "w2_box_numbering": oracle(_NUMBER(L.SKIP_ORDER)),
    "w2_block_numbering": oracle(_NUMBER([*L.SKIP_ORDER, *L.MARKDOWN_IGNORED])),
}
