"""Queries on blocks, texts, JSON values and table markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import json_values as J
from foliospark.functions import text as X
from foliospark.operators import blocks as B
from foliospark.operators import table_markup as M
from foliospark.operators.layout import MARKDOWN_IGNORED, NON_MERGE
from foliospark.plans.views import oracle, table

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def blocks(s, d):
    return table(s, d, "v_blocks")


def docs(s, d, **new):
    return table(s, d, "documents").select("doc_id", *[v.alias(k) for k, v in new.items()] or ["text"])


def _math():
    """Texts with LaTeX delimiters where commas and stops were."""
    return F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" \\(")), F.lit(". "), F.lit("\\) \\["))


_MATH = "replace(replace(text, ', ', ' \\('), '. ', '\\) \\[')"
_R = lambda x, *pairs: __import__("functools").reduce(lambda acc, p: f"replace({acc}, '{p[0]}', '{p[1]}')", pairs, x)
_MATH_OUT = _R(f"replace({_MATH}, '$', '')", ("\\(", " $ "), ("\\)", " $"), ("\\[\\[", "\\["), ("\\]\\]", "\\]"), ("\\[", " $$ "), ("\\]", " $$ "))
_HAS = "(contains({0}, '\\(') AND contains({0}, '\\)')) OR (contains({0}, '\\[') AND contains({0}, '\\]'))".format(_MATH)


def math_text(s, d):
    label = F.when(F.col("doc_id") % 3 == 0, "formula_number").otherwise("text")
    return table(s, d, "documents").select("doc_id", X.math_delimiters(_math(), label).alias("out"))


def compare_text(s, d):
    c = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\n<br>\n"), F.lit("end\r\n\n"))
    return table(s, d, "documents").select("doc_id", X.for_comparison(c).alias("out"))


def centred(s, d):
    c = F.concat(F.lit('<div style="text-align: center;"> <b>'), F.col("text"), F.lit('</b> &lt;x&gt;</div>\n\n\n\n<div style="text-align: center;"><img src="imgs/a.png" alt="i" /></div>'))
    return table(s, d, "documents").select("doc_id", X.flatten_centred(c).alias("out"))


def heading_text(s, d):
    c = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".4 ").otherwise(" "), F.col("source"), F.lit(" a-\nb\nc.."))
    return table(s, d, "documents").select("doc_id", B.heading(c).alias("out"))


_HEAD = "doc_id || CASE WHEN doc_id % 2 = 0 THEN '.4 ' ELSE ' ' END || source || ' a-' || chr(10) || 'b' || chr(10) || 'c'"


def urls(s, d):
    c = F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("Token=s3cret"), F.lit("&n="), F.col("page_id").cast("string"), F.lit("&api_key="))
    return table(s, d, "pages").select("page_id", X.redact_url(c).alias("url"))


def redacted_maps(s, d):
    m = F.create_map(F.lit("API_KEY"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("url"), F.concat(F.lit("http://h/?token="), F.col("source")))
    return table(s, d, "documents").select("doc_id", *[X.redact_map(m)[k].alias(k.lower()) for k in ("API_KEY", "lang", "url")])


def payloads(s, d):
    """Chat responses, some without a level, some with content that is no text."""
    good = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), F.col("doc_id").alias("id"), F.struct((F.col("n_chars") / 4).alias("mean"), F.col("lang")).alias("m")))
    bad = F.when(F.col("doc_id") % 5 == 0, '{"choices": []}').when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"choices":[{"message":{"content":'), F.col("doc_id").cast("string"), F.lit("}}]}")))
    return table(s, d, "documents").select("doc_id", "text", "source", "lang", "n_chars", F.coalesce(bad, good).alias("j"))


_ROWS = "(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) FROM {v_blocks})"


def observations(s, d):
    t = table(s, d, "documents")
    first = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, F.lit("bad")).otherwise(F.sha2("text", 256))
    o = J.observation(first, F.sha2("source", 256))
    p = J.observation(F.when(F.col("doc_id") % 6 == 0, F.sha2("text", 256)).otherwise(F.sha2("source", 256)))
    return t.select("doc_id", o["status"].alias("status"), o["fingerprint"].alias("fingerprint"), J.relation(o, p).alias("relation"))


def categories(s, d):
    return pair_rows(s, d).select("component", "img_id", "gt_position", X.pair_category(F.col("pred"), F.col("gt"), F.col("score"), F.col("ref_score"), F.col("edit")).alias("category"))


def pair_rows(s, d):
    """Sample pairs with an edit distance: predictions of the candidate against the truth."""
    key = ["component", "img_id", "gt_position"]
    ref = table(s, d, "v_samples_ref").select(*key, "gt", F.col("score").alias("ref_score"))
    cand = table(s, d, "v_samples_cand").select(*key, F.when(F.col("img_id") % 7 == 3, F.concat(F.lit("The "), "pred")).when(F.col("img_id") % 11 == 5, F.substring("pred", 1, 3)).otherwise(F.col("pred")).alias("pred"), "score")
    return ref.join(cand, key).withColumn("edit", F.levenshtein("gt", "pred") / F.greatest(F.length("gt"), F.length("pred"), F.lit(1)))


PAIRS = """
SELECT r.component, r.img_id, r.gt_position, r.gt, r.score AS ref_score, c.score,
  CASE WHEN r.img_id % 7 = 3 THEN 'The ' || c.pred WHEN r.img_id % 11 = 5 THEN substr(c.pred, 1, 3) ELSE c.pred END AS pred
FROM {v_samples_ref} r JOIN {v_samples_cand} c ON r.component = c.component AND r.img_id = c.img_id AND r.gt_position = c.gt_position"""
CATEGORY = f"""CASE WHEN trim(pred) = '' THEN 'EMPTY_PRED' WHEN length(pred) < {X.LEAST_LENGTH} * length(gt) THEN 'MISSING_CONTENT'
  WHEN {" OR ".join(f"(contains(pred, '{w}') AND NOT contains(gt, '{w}'))" for w in X.EXTRA_WORDS)} THEN 'EXTRA_TEXT'
  WHEN score = 0 AND ref_score > 0 THEN 'ZERO_TOKENS'
  WHEN levenshtein(gt, pred) / greatest(length(gt), length(pred), 1) > {X.MOST_EDIT} THEN 'CONTENT_DIFF' ELSE 'NOTATION_STYLE' END"""


def otsl_cells(s, d):
    return M.cells(table(s, d, "v_otsl_text"))


def grouped(s, d):
    return B.group_neighbours(blocks(s, d)).select("page_id", "idx", "group_id", "merged", "out_pos")


_AL = lambda c: f"(abs(a.{c} - b.{c}) <= 5)"
_GROUPS = f"""
WITH m AS (SELECT page_id, idx, label, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS k FROM {{v_blocks}} WHERE label NOT IN {_in(NON_MERGE)}),
o AS (SELECT * FROM {{v_blocks}} WHERE label IN {_in(NON_MERGE)}),
p AS (SELECT a.page_id, a.idx, a.x1, a.y1, a.x2, a.y2, a.k, a.label = 'text' AND b.label = 'text' AS both_text,
  least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0 AS shadow,
  a.x1 > b.x2 AND a.y1 < b.y2 AND a.x1 - b.x2 < greatest(b.x2 - b.x1, a.x2 - a.x1) * 0.3 AS beside,
  a.y2 >= b.y1 AND abs(a.y1 - b.y2) < greatest(b.y2 - b.y1, a.y2 - a.y1) * 0.5 AND {_AL('x1')} <> {_AL('x2')} AS below,
  least(a.x1, b.x1) AS mx1, least(a.y1, b.y1) AS my1, greatest(a.x2, b.x2) AS mx2, greatest(a.y2, b.y2) AS my2
  FROM m a LEFT JOIN m b ON a.page_id = b.page_id AND b.k = a.k - 1),
j AS (SELECT p.*, coalesce(both_text AND ((NOT shadow AND beside) OR (shadow AND below AND EXISTS (SELECT 1 FROM o WHERE o.page_id = p.page_id
  AND least(o.x2, p.mx2) > greatest(o.x1, p.mx1) AND least(o.y2, p.my2) > greatest(o.y1, p.my1)))), false) AS joins FROM p),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY idx) AS run FROM j),
g AS (SELECT page_id, idx, min(idx) OVER w AS first, max(idx) OVER w AS last, count(*) OVER w > 1 AS many, sum(y2 - y1) OVER w / max(x2 - x1) OVER w AS aspect FROM r WINDOW w AS (PARTITION BY page_id, run)),
x AS (SELECT v.page_id, v.idx, g.first, g.many, g.aspect < 3 AS flat, max(g.first) OVER u AS pf, max(g.last) OVER u AS pl FROM {{v_blocks}} v LEFT JOIN g USING (page_id, idx) WINDOW u AS (PARTITION BY v.page_id ORDER BY v.idx)),
y AS (SELECT *, CASE WHEN first IS NOT NULL THEN first WHEN idx < pl THEN pf ELSE idx END AS anchor FROM x)"""

QUERIES = {
    "f1_repetition_truncation": lambda s, d: X.truncate_repetition(docs(s, d), min_count=50).select("doc_id", "truncated"),
    "f2_math_delimiters": math_text,
    "f3_has_cjk": lambda s, d: table(s, d, "documents").select("doc_id", X.has_cjk(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "漢").otherwise(""))).alias("cjk")),
    "f4_heading": heading_text,
    "f5_block_markdown": lambda s, d: blocks(s, d).select("page_id", "idx", B.block_markdown().alias("md")),
    "p9_visible_blocks": lambda s, d: B.visible(blocks(s, d)).select("page_id", "idx", "label"),
    "f6_page_markdown": lambda s, d: B.page_markdown(blocks(s, d)),
    "f7_comparison_text": compare_text,
    "f8_centred_divs": centred,
    "f9_token_restore": lambda s, d: table(s, d, "documents").select("doc_id", X.restore_tokens(F.concat(F.lit("[F1] "), "source", F.lit(" [F2][F3]")), F.create_map(F.lit("[F1]"), F.col("lang"), F.lit("[F2]"), F.lit("a-\nb\nc"))).alias("out")),
    "f10_error_signature": lambda s, d: table(s, d, "v_page_runs").select("image", X.has_signature(F.col("status"), F.col("stage"), "e3\nerror").alias("hit")),
    "f11_sample_key": lambda s, d: table(s, d, "v_page_runs").select("image", *[f(F.concat("image", F.when(F.col("run_id") > 0, F.concat(F.lit("_["), F.col("run_id").cast("string"), F.lit("]"))).otherwise(""))).alias(n) for f, n in ((X.sample_page, "page"), (X.sample_id, "id"))]),
    "f12_redacted_urls": urls,
    "f12_redacted_maps": redacted_maps,
    "f13_unfenced_latex": lambda s, d: table(s, d, "documents").select("doc_id", X.unfenced_latex(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see ```latex\n"), "text", F.lit("``` after ```"))).otherwise(F.col("text"))).alias("out")),
    "f14_pair_categories": categories,
    "f15_canonical_index": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(X.canonical_index(F.array_sort(F.collect_list("l_linenumber"))).alias("gt_idx")),
    "f16_endpoints": lambda s, d: table(s, d, "pages").select("page_id", X.endpoint(F.concat("url", F.lit("//"))).alias("endpoint"), X.shown_endpoint(F.col("url")).alias("shown")),
    "a17_dominant_line": lambda s, d: X.dominant_lines(docs(s, d)),
    "w3_neighbour_groups": grouped,
    "j18_meets_non_merge": lambda s, d: B.meets_non_merge(B.with_previous(blocks(s, d)), blocks(s, d)),
    "s10_page_results": lambda s, d: B.result_blocks(B.page_results(blocks(s, d), table(s, d, "v_page_dim"))),
    "f20_table_cells": otsl_cells,
    "f21_row_squaring": lambda s, d: otsl_cells(s, d).groupBy("table_id", "r").agg(F.count(F.lit(1)).alias("width"), F.count_if(F.col("tag") == "ecel").alias("empty")),
    "f22_spans": lambda s, d: M.spanned(otsl_cells(s, d)),
    "f23_html_tables": lambda s, d: M.html_tables(otsl_cells(s, d)),
    "f30_fingerprints": lambda s, d: table(s, d, "documents").select("doc_id", J.fingerprint(F.to_json(F.struct("source", "lang", "doc_id"))).alias("fp")),
    "f31_nested_number": lambda s, d: payloads(s, d).select("doc_id", J.number_at(F.col("j"), "$.m.mean").alias("mean"), J.number_at(F.col("j"), "$.m.lang").alias("lang")),
    "f32_score_checks": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", J.is_score(F.col("l_discount") * 20 - F.lit(0.5)).alias("good")),
    "f33_rounding": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_tax", 2).alias("r2"), F.round("l_discount", 3).alias("r3"), F.round("l_discount", 15).alias("r15")),
    "f34_metric_direction": lambda s, d: table(s, d, "v_page_runs").select("image", J.lower_is_better(F.concat("stage", F.when(F.col("run_id") == 0, "_edit").otherwise("_score"))).alias("lower")),
    "f35_observations": observations,
    "f36_relations": lambda s, d: observations(s, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n")),
    "f38_response_content": lambda s, d: payloads(s, d).select("doc_id", J.response_content(F.col("j")).alias("content")),
    "f39_first_text_field": lambda s, d: payloads(s, d).select("doc_id", J.text_at(F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("md"), F.struct(F.col("lang").alias("markdown")).alias("res"))), "$.markdown", "$.md", "$.res.markdown").alias("out")),
}

_D = "SELECT doc_id, "
_DOMINANT = """
WITH l AS (SELECT doc_id, trim(x) AS line, pos FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(x) <> ''),
c AS (SELECT doc_id, line, count(*) AS n, min(pos) AS first FROM l GROUP BY ALL)
SELECT doc_id, arg_max(line, n * 1000000 - first) AS top_line, max(n) AS n_top, CAST(sum(n) AS BIGINT) AS n_lines FROM c GROUP BY doc_id"""
# A unit that ends a text five times over (the longest), how often it does, and the shortest one that makes up the
# whole text, by trying each length.
_REPEATS = f"""
WITH top AS ({_DOMINANT}), d AS (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
flat AS (SELECT doc_id, t, length(t) AS n FROM d WHERE length(text) >= 50 AND t <> '' AND NOT contains(t, chr(10))),
u AS (SELECT *, CASE WHEN n > 100 THEN list_max(list_filter(range(8, n // 5 + 1), lambda k: repeat(right(t, k), 5) = right(t, 5 * k))) END AS unit FROM flat),
k AS (SELECT *, list_max(list_filter(range(5, n // unit + 1), lambda m: repeat(right(t, unit), m) = right(t, m * unit))) AS times,
  list_min(list_filter(range(1, n // 10 + 1), lambda w: n % w = 0 AND repeat(left(t, w), n // w) = t)) AS whole FROM u),
cut AS (SELECT doc_id, CASE WHEN unit * times * 2 > n THEN left(t, n - unit * times) WHEN n > 10 AND whole IS NOT NULL THEN left(t, whole) END AS cut FROM k)
SELECT doc_id, coalesce(cut, CASE WHEN length(text) >= 50 AND contains(t, chr(10)) AND n_lines >= 10 AND n_top >= 10 AND n_top >= 0.8 * n_lines THEN top_line END, text) AS truncated
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN top USING (doc_id)"""
ORACLES = {
    "f1_repetition_truncation": _REPEATS,
    "f2_math_delimiters": oracle(f"SELECT doc_id, CASE WHEN {_HAS} THEN CASE WHEN doc_id % 3 = 0 THEN replace({_MATH_OUT}, '$', '') ELSE {_MATH_OUT} END ELSE {_MATH} END AS out FROM documents"),
    "f3_has_cjk": "SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN '漢' ELSE '' END, '[一-鿿]') AS cjk FROM documents",
    "f4_heading": oracle(f"WITH t AS (SELECT doc_id, {_HEAD} AS t FROM documents) SELECT doc_id, replace(replace(repeat('#', CAST(length(t) - length(replace(t, '.', '')) + 2 AS INT)) || ' ' || t, '-' || chr(10), ''), chr(10), ' ') AS out FROM t"),
    "f5_block_markdown": oracle("""
SELECT page_id, idx, CASE label WHEN 'doc_title' THEN replace(replace('# ' || content, '-' || chr(10), ''), chr(10), ' ')
  WHEN 'paragraph_title' THEN CASE WHEN content = '' THEN '## ' ELSE '### ' || rtrim(content, '.') END
  WHEN 'text' THEN replace(replace(content, chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10))
  WHEN 'table' THEN chr(10) || chr(10) || content
  WHEN 'image' THEN '![](imgs/img_in_image_box_' || x1 || '_' || y1 || '_' || x2 || '_' || y2 || '.jpg)' ELSE content END AS md FROM {v_blocks}"""),
    "p9_visible_blocks": oracle(f"SELECT page_id, idx, label FROM {{v_blocks}} WHERE label NOT IN {_in(MARKDOWN_IGNORED)}"),
    "f6_page_markdown": oracle(f"""
WITH b AS (SELECT page_id, idx, CASE label WHEN 'doc_title' THEN replace(replace('# ' || content, '-' || chr(10), ''), chr(10), ' ')
  WHEN 'paragraph_title' THEN CASE WHEN content = '' THEN '## ' ELSE '### ' || rtrim(content, '.') END
  WHEN 'text' THEN replace(replace(content, chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10))
  WHEN 'table' THEN chr(10) || chr(10) || content
  WHEN 'image' THEN '![](imgs/img_in_image_box_' || x1 || '_' || y1 || '_' || x2 || '_' || y2 || '.jpg)' ELSE content END AS md FROM {{v_blocks}} WHERE label NOT IN {_in(MARKDOWN_IGNORED)}),
w AS (SELECT *, bool_or(md <> '') OVER (PARTITION BY page_id ORDER BY idx) AS begun FROM b)
SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY idx) AS markdown FROM w WHERE begun GROUP BY page_id"""),
    "f7_comparison_text": "SELECT doc_id, text || chr(10) || chr(10) || 'end' AS out FROM documents",
    "f8_centred_divs": "SELECT doc_id, regexp_replace(text || ' <x>', '\\n{3,}', chr(10) || chr(10), 'g') || chr(10) || chr(10) || '![](imgs/a.png)' AS out FROM documents",
    "f9_token_restore": """SELECT doc_id, '<img src="' || lang || '" alt="Image"" /> ' || source || ' <img src="ab c" alt="Image"" />[F3]' AS out FROM documents""",
    "f10_error_signature": oracle("SELECT image, contains(status || chr(10) || stage, 'e3' || chr(10) || 'error') AS hit FROM {v_page_runs}"),
    "f11_sample_key": oracle("SELECT image, image AS page, CASE WHEN run_id > 0 THEN CAST(run_id AS VARCHAR) ELSE '' END AS id FROM {v_page_runs}"),
    "f12_redacted_urls": "SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Token=s3cret' || '&n=' || page_id || '&api_key=', '([?&](?i:authorization|api_key|apikey|token|access_token)=)[^&#]*', '\\1<redacted>', 'g') AS url FROM pages",
    "f12_redacted_maps": "SELECT doc_id, '<redacted>' AS api_key, lang, 'http://h/?token=<redacted>' AS url FROM documents",
    "f13_unfenced_latex": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE text END AS out FROM documents",
    "f14_pair_categories": oracle(f"SELECT component, img_id, gt_position, {CATEGORY} AS category FROM ({PAIRS})"),
    "f15_canonical_index": "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN CAST(min(l_linenumber) AS VARCHAR) ELSE '[' || string_agg(l_linenumber, ',' ORDER BY l_linenumber) || ']' END AS gt_idx FROM lineitem GROUP BY l_orderkey",
    "f16_endpoints": "SELECT page_id, rtrim(url, '/') AS endpoint, regexp_extract(url, '^[^?#]*') AS shown FROM pages",
    "a17_dominant_line": _DOMINANT,
    "w3_neighbour_groups": oracle(f"{_GROUPS} SELECT page_id, idx, CASE WHEN flat THEN first END AS group_id, coalesce(flat AND many, false) AS merged, row_number() OVER (PARTITION BY page_id ORDER BY anchor, first IS NULL AND anchor < idx, idx) AS out_pos FROM y"),
    "j18_meets_non_merge": oracle(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS k FROM {{v_blocks}} WHERE label NOT IN {_in(NON_MERGE)})
SELECT DISTINCT a.page_id, a.idx FROM m a JOIN m b ON a.page_id = b.page_id AND b.k = a.k - 1 JOIN {{v_blocks}} o ON o.page_id = a.page_id AND o.label IN {_in(NON_MERGE)}
WHERE least(o.x2, greatest(a.x2, b.x2)) > greatest(o.x1, least(a.x1, b.x1)) AND least(o.y2, greatest(a.y2, b.y2)) > greatest(o.y1, least(a.y1, b.y1))"""),
    "s10_page_results": oracle("SELECT page_id, idx, label, content, x1, y1, x2, y2 FROM {v_blocks}"),
    "f30_fingerprints": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fp FROM documents""",
    "f31_nested_number": "SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN n_chars / 4 END AS mean, CAST(NULL AS DOUBLE) AS lang FROM documents",
    "f32_score_checks": "SELECT l_orderkey, l_linenumber, l_discount * 20 - 0.5e0 BETWEEN 0 AND 1 AS good FROM lineitem",
    "f33_rounding": "SELECT l_orderkey, l_linenumber, round(l_tax, 2) AS r2, round(l_discount, 3) AS r3, round(l_discount, 15) AS r15 FROM lineitem",
    "f34_metric_direction": oracle("SELECT image, run_id = 0 AS lower FROM {v_page_runs}"),
    "f35_observations": """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'unobservable' ELSE 'observable' END AS status,
  CASE doc_id % 4 WHEN 0 THEN sha256(source) WHEN 1 THEN NULL ELSE sha256(text) END AS fingerprint,
  CASE WHEN doc_id % 4 = 1 THEN 'unobservable' WHEN CASE doc_id % 4 WHEN 0 THEN source ELSE text END = CASE WHEN doc_id % 6 = 0 THEN text ELSE source END THEN 'equal' ELSE 'different' END AS relation FROM documents""",
    "f36_relations": """
SELECT CASE WHEN doc_id % 4 = 1 THEN 'unobservable' WHEN CASE doc_id % 4 WHEN 0 THEN source ELSE text END = CASE WHEN doc_id % 6 = 0 THEN text ELSE source END THEN 'equal' ELSE 'different' END AS relation, count(*) AS n FROM documents GROUP BY ALL""",
    "f38_response_content": "SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN text ELSE '' END AS content FROM documents",
    "f39_first_text_field": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS out FROM documents",
}
_OTSL = """
WITH t AS (SELECT table_id, text, list_filter(list_transform(string_split(text, '<nl>'), lambda x: regexp_extract_all(x, '<(?:fcel|ecel|lcel|ucel|xcel)>[^<]*')), lambda c: len(c) > 0) AS rows FROM {v_otsl_text}),
w AS (SELECT *, list_max(list_transform(rows, lambda c: coalesce(list_max(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN starts_with(c[i], '<fcel>') THEN i ELSE 0 END)), 0))) AS lo, list_max(list_transform(rows, lambda c: len(c))) AS hi FROM t WHERE len(rows) > 0),
z AS (SELECT table_id, text, rows, unnest(range(lo, greatest(lo, hi) + 1)) AS width FROM w),
k AS (SELECT table_id, text, rows, arg_min(width, list_sum(list_transform(rows, lambda c: abs(len(c) - width))) * 100000 + width) AS width FROM z GROUP BY ALL),
r AS (SELECT table_id, unnest(range(len(rows))) AS r, unnest(rows) AS row, CASE WHEN contains(text, '<nl>') THEN width END AS width FROM k),
e AS (SELECT table_id, r, CASE WHEN width IS NULL THEN row ELSE list_concat(row, list_transform(range(width), lambda x: '<ecel>'))[1:width] END AS row FROM r),
c AS (SELECT table_id, r, unnest(range(len(row))) AS c, unnest(row) AS cell FROM e),
cells AS (SELECT table_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, cell[2:5] AS tag, CASE WHEN cell[2:5] = 'fcel' THEN trim(cell[7:]) ELSE '' END AS text FROM c)"""
ORACLES |= {
    "f20_table_cells": oracle(f"{_OTSL} SELECT * FROM cells"),
    "f21_row_squaring": oracle(f"{_OTSL} SELECT table_id, r, count(*) AS width, count(*) FILTER (tag = 'ecel') AS empty FROM cells GROUP BY table_id, r"),
    "f22_spans": oracle(f"""{_OTSL},
s AS (SELECT *, min(CASE WHEN tag NOT IN ('lcel', 'xcel') THEN c END) OVER (PARTITION BY table_id, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sc, max(c) OVER (PARTITION BY table_id, r) + 1 AS ec,
  min(CASE WHEN tag NOT IN ('ucel', 'xcel') THEN r END) OVER (PARTITION BY table_id, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sr, max(r) OVER (PARTITION BY table_id, c) + 1 AS er FROM cells)
SELECT table_id, r, c, tag, text, CAST(coalesce(sc, ec) - c AS INT) AS col_span, CAST(coalesce(sr, er) - r AS INT) AS row_span FROM s WHERE tag IN ('fcel', 'ecel')"""),
}
