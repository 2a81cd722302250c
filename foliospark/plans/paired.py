"""Queries that compare two runs: samples, traces, predictions, manifests, gates, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import json_values as J
from foliospark.functions import text as X
from foliospark.operators import gates as G
from foliospark.operators import paired as P
from foliospark.operators.runs import listed_digest
from foliospark.plans.texts import CATEGORY, PAIRS, pair_rows
from foliospark.plans.views import oracle, table

REF, CAND = "v_samples_ref", "v_samples_cand"


def samples(s, d):
    return table(s, d, REF), table(s, d, CAND)


def preds(s, d):
    return table(s, d, "v_pred_ref"), table(s, d, "v_pred_cand")


def traces(s, d):
    return table(s, d, "v_trace_ref"), table(s, d, "v_trace_cand")


_CLEAN = lambda c: f"regexp_replace(replace({c}, chr(10) || '<br>' || chr(10), chr(10) || chr(10)), '\\n+$', '')"
_FULL = """f AS (SELECT coalesce(r.component, c.component) AS component, coalesce(r.img_id, c.img_id) AS img_id, coalesce(r.gt_position, c.gt_position) AS gt_position,
  r.gt_idx AS ref_gt_idx, c.gt_idx AS cand_gt_idx, r.score AS ref_score, c.score AS cand_score, r.score - c.score AS delta,
  CASE WHEN r.img_id IS NOT NULL AND c.img_id IS NOT NULL THEN 'both' WHEN r.img_id IS NOT NULL THEN 'ref' ELSE 'cand' END AS side
  FROM {v_samples_ref} r FULL JOIN {v_samples_cand} c ON r.component = c.component AND r.img_id = c.img_id AND r.gt_position = c.gt_position AND sha256(r.gt) = sha256(c.gt))"""
_SHOWN = ["component", "img_id", "gt_position", "ref_gt_idx", "cand_gt_idx", "ref_score", "cand_score", "side", "delta"]


def pairs(s, d):
    return P.paired_samples(*samples(s, d))


def errors(s, d):
    base = table(s, d, REF).select("component", "img_id", "gt_idx")
    kinds = [base.where(f"(img_id + gt_idx) % {m} = 0") for m in (11, 7, 5)]
    return P.attach_errors(base, *[k.distinct() for k in kinds]).withColumn("error_cases", F.array_join("error_cases", ","))


def coverage(s, d):
    ref = table(s, d, REF)
    want = ref.groupBy("component").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("img_id").alias("pages"))
    value = P.macro_mean(ref).select("component", F.col("macro_mean").alias("value"))
    return P.coverage(table(s, d, CAND), want.join(value, "component"), 1e-6)


def page_table(s, d):
    t = table(s, d, REF).select(F.concat("img_id", F.lit("_["), "gt_idx", F.lit("]")).alias("key"), F.col("component").alias("metric"), "score")
    return P.page_metrics(t.withColumn("page", X.sample_page(F.col("key"))), ["formula", "table"]).withColumns({c: F.round(c, 9) for c in ("formula", "table")})


def losses(s, d):
    c = X.pair_category(F.col("pred"), F.col("gt"), F.col("score"), F.col("ref_score"), F.col("edit"))
    got = P.loss_by_category(pair_rows(s, d), c, F.col("ref_score") - F.col("score"))
    return got.withColumns({c: F.round(c, 6) for c in ("loss_sum", "avg_loss", "loss_pct")})


def worst_per_category(s, d):
    c = X.pair_category(F.col("pred"), F.col("gt"), F.col("score"), F.col("ref_score"), F.col("edit"))
    rows = pair_rows(s, d).select("component", "img_id", "gt_position", c.alias("category"), (F.col("ref_score") - F.col("score")).alias("loss"))
    return P.top_per_group(rows, "category", 5, F.desc("loss"), "img_id", "gt_position", "component")


def trace_rows(s, d):
    return P.trace_pairs(*traces(s, d))


def divergences(s, d):
    t = trace_rows(s, d).where("side = 'both'")
    b = J.first_divergence([("label", F.col("ref_label"), F.col("cand_label")), ("raw_result", F.sha2("ref_raw_result", 256), F.sha2("cand_raw_result", 256))])
    return t.select("page", "block_index", b.alias("boundary")).where("boundary IS NOT NULL")


_TRACE = """shared AS (SELECT DISTINCT page FROM {v_trace_ref} SEMI JOIN {v_trace_cand} USING (page)),
j AS (SELECT coalesce(r.page, c.page) AS page, coalesce(r.block_index, c.block_index) AS block_index, r.label AS ref_label, r.raw_result AS ref_raw_result, c.label AS cand_label, c.raw_result AS cand_raw_result,
  CASE WHEN r.page IS NOT NULL AND c.page IS NOT NULL THEN 'both' WHEN r.page IS NOT NULL THEN 'ref' ELSE 'cand' END AS side
  FROM (SELECT * FROM {v_trace_ref} SEMI JOIN shared USING (page)) r FULL JOIN (SELECT * FROM {v_trace_cand} SEMI JOIN shared USING (page)) c ON r.page = c.page AND r.block_index = c.block_index),
v AS (SELECT page, block_index, CASE WHEN ref_label IS DISTINCT FROM cand_label THEN 'label' WHEN ref_raw_result IS DISTINCT FROM cand_raw_result THEN 'raw_result' END AS boundary FROM j WHERE side = 'both')"""


def manifest_check(s, d):
    e, c = (t.select(F.col("stem").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")) for t in preds(s, d))
    return P.manifest_differences(e, c)


def records(s, d):
    m = table(s, d, "v_manifest").withColumn("image", F.concat(F.lit("p"), F.regexp_extract("image", r"(\d+)", 1), F.lit(".png")))
    runs = table(s, d, "v_page_runs").select("image", "status", "seconds")
    return P.page_records(m, runs, runs.where("status = 'ok'").select("image", F.col("seconds").alias("old")))


def edit(s, d, ascii=False):
    """Sentences of all documents as samples; every fourth has no prediction, others differ a
    little. In ASCII for the SQL twin, whose engine counts bytes."""
    text = F.regexp_replace("text", "[^\\x00-\\x7F]", "?") if ascii else F.col("text")
    docs = table(s, d, "documents").select(F.col("source").alias("page"), text.alias("text"))
    lines = docs.select("page", F.explode(F.split("text", r"\n|\. ", -1)).alias("gt"))
    return lines.withColumn("pred", F.when(F.length("gt") % 4 == 0, None).when(F.length("gt") % 4 == 1, F.concat("gt", F.lit("x"))).otherwise(F.regexp_replace("gt", "a", "")))


def edit_distance(s, d, ascii=False):
    return P.edit_scores(edit(s, d, ascii)).select(*[F.round(c, 9).alias(c) for c in ("page_avg", "whole", "sample_avg")])


def slices(s, d):
    t = table(s, d, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("v"))
    return P.slice_means(t, "v", ["lang", "source"]).withColumn("mean", F.round("mean", 6))


def attribution(s, d):
    t = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("b"), F.min("l_tax").alias("a"))
    t = t.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("b"), "l_linenumber").alias("boundary"), F.when(F.col("l_orderkey") % 6 != F.col("l_linenumber"), F.col("b")).alias("before"), F.col("a").alias("after"))
    return P.boundary_attribution(t)


def replay(s, d):
    """Scores of the outputs at each boundary before and after a change, then the attribution."""
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("ord")).distinct()
    named = lambda word, n: F.concat(F.lit(word), (F.col("ord") % n).cast("string"))
    t = t.select("case_id", "ord", named("boundary ", 100).alias("boundary"), named("line ", 9).alias("gt"), F.when(F.col("case_id") % 6 != F.col("ord"), named("lime ", 3)).alias("output_before"), named("line ", 4).alias("output_after"))
    return P.boundary_attribution(P.replayed_scores(t.withColumn("output_after", F.when(F.col("case_id") % 5 == 0, F.col("output_before")).otherwise(F.col("output_after")))))


def projections(s, d):
    pages = pair_rows(s, d).select("component", F.col("ref_score").alias("reference"), F.col("score").alias("candidate"))
    accepted = pages.select("component").distinct().select("component", F.lit(95.0).alias("accepted"), F.lit(100000.0).alias("denominator"), F.when(F.col("component") == "table", 1.0).otherwise(-1.0).alias("sign"))
    return P.projection(accepted, pages)


def evidence(s, d):
    a, b = traces(s, d)
    pages = P.page_sets(a, b, "page").where("side <> 'both'")
    missing = trace_rows(s, d).where("side <> 'both'").select("page", "block_index", "side")
    return P.evidence_rows(page=pages, missing=missing, block=divergences(s, d)).select("kind", "page", "block_index", "side", "boundary")


_EVIDENCE = f"""WITH {_TRACE}, p AS (SELECT DISTINCT coalesce(a.page, b.page) AS page, CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN 'both' WHEN a.page IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM {{v_trace_ref}} a FULL JOIN {{v_trace_cand}} b ON a.page = b.page),
e AS (SELECT 'page' AS kind, page, NULL AS block_index, side, NULL AS boundary FROM p WHERE side <> 'both' UNION ALL SELECT 'missing', page, block_index, side, NULL FROM j WHERE side <> 'both' UNION ALL SELECT 'block', page, block_index, NULL, boundary FROM v WHERE boundary IS NOT NULL)"""


def evidence_digest(s, d):
    """Of all evidence, by kind: hashed in buckets, as a kind has any number of rows."""
    return listed_digest(_hashed_evidence(s, d), "name", "h", "kind")


def _hashed_evidence(s, d):
    return evidence(s, d).select(F.concat_ws("|", "kind", "page", "block_index").alias("name"), F.sha2(F.concat_ws("|", "kind", "page", "block_index", "side", "boundary"), 256).alias("h"), F.col("kind"), "page")


def page_evidence_digest(s, d):
    """Of each page's evidence: one SHA-256 over its lines in name order."""
    return listed_digest(_hashed_evidence(s, d), "name", "h", "page")


def consistency(s, d):
    return P.inconsistent_pages(table(s, d, "v_trace_ref"), "page", "label")


def approved_failures(s, d):
    runs = table(s, d, "v_page_runs").where("status LIKE 'fail%'").select("image", F.regexp_extract("image", r"(\d+)", 1).cast("long").alias("stem"))
    return P.unexpected_predictions(runs, table(s, d, "v_pred_ref"), "stem", "stem")


def quality_pages(s, d):
    return P.classified_pages(*preds(s, d))


def gate_runs(s, d):
    runs = table(s, d, "v_page_runs")
    return runs, runs.where("status LIKE 'fail%' AND run_id < 2").select("image")


def run_gate(s, d):
    runs, approved = gate_runs(s, d)
    return G.run_contract_gate(runs.where("status NOT LIKE 'fallback%'"), 100, approved, "failed: e")


def latency_gate(s, d):
    return G.latency_gate(table(s, d, "v_page_runs"), "seconds", 13.0, 34.82)


def manifest_gate(s, d):
    return G.manifest_gate(table(s, d, "v_manifest"), 1000, 50, [f"src{i}" for i in range(19)])


def metric_rows(s, d):
    t = pair_rows(s, d)
    return t.select(F.concat_ws("/", "img_id", "gt_position").alias("image"), F.concat("component", F.when(F.col("component") == "table", "_edit").otherwise("")).alias("metric"), F.col("ref_score").alias("reference"), F.col("score").alias("candidate"))


def quality_gate(s, d):
    metrics = quality_pages(s, d).where("relation = 'scored'").select(F.col("stem").alias("image"), F.lit("text_edit").alias("metric"), F.lit(0.1).alias("reference"), F.lit(0.2).alias("candidate"))
    return G.quality_gate(quality_pages(s, d).select("stem", "relation"), metrics, P.projected_overall(projections(s, d)), 95.0)


def components(s, d):
    ref, cand = (P.macro_mean(t).select("component", F.col("macro_mean").alias(n)) for t, n in zip(samples(s, d), ("reference", "candidate")))
    return G.component_gate(ref.join(cand, "component", "left").withColumn("lower_is_better", F.col("component") == "table"), 90.0)


def strict(s, d):
    t = trace_rows(s, d)
    rel = J.relation(J.observation(F.sha2("ref_raw_result", 256)), J.observation(F.sha2("cand_raw_result", 256)))
    return G.strict_verdict(t.select(rel.alias("relation")))


def reports(s, d):
    a, b = (P.slice_means(t.withColumn("score", F.col("score")), "score", ["component"]).select(F.col("slice").alias("metric"), F.col("mean").alias("value")) for t in samples(s, d))
    return G.report_agreement(a, b, 3).select("metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def log_rows(s, d):
    e = table(s, d, "conversations")
    have = e.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("role").alias("command"), (F.col("turn") % 3).cast("int").alias("exit_code"))
    want = have.where("pos % 10 <> 4").withColumn("exit_code", F.when(F.col("pos") % 7 == 0, 9).otherwise(F.col("exit_code")))
    return G.log_gate(have, want)


def combined(s, d):
    return G.combined(manifest=manifest_gate(s, d), runs=run_gate(s, d), latency=latency_gate(s, d))


def decisions(s, d):
    now = combined(s, d)
    return G.stored_decision_agrees(now.withColumn("passed", F.when(F.col("check") == "runs", True).otherwise(F.col("passed"))), now)


def validity(s, d):
    t = table(s, d, REF).groupBy("img_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("score") < 0.91).alias("timeouts"), F.count_if(F.col("gt_idx") == 7).alias("errors"), F.max("score").alias("value"))
    return G.metric_validity(t).select("img_id", "valid", "value")


def overall(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("e"), "l_tax", "l_quantity")
    return t.select("l_orderkey", "l_linenumber", F.round(G.overall_score(F.col("e"), 1 - F.col("l_tax"), F.col("l_quantity") / 50), 6).alias("overall"))


def result_table(s, d):
    t = table(s, d, "documents").groupBy("source").agg((F.avg("n_chars") / 100).alias("overall"))
    return G.result_table(t, "src7", "source")


def schema(s, d):
    t = table(s, d, "v_manifest").withColumn("sha256", F.when(F.col("category") == "src3", "x").otherwise(F.sha2("image", 256)))
    return G.schema_gate(t, {"category": "string", "image": "string", "sha256": "string"}, ("sha256",))


def bounded(s, d):
    return P.bounded_details(divergences(s, d), 100, "page", "block_index")


_CATS = f"k AS (SELECT component, img_id, gt_position, ref_score - score AS loss, {CATEGORY} AS category FROM ({PAIRS}))"
_PAGES = lambda v: f"SELECT component, avg(m) AS v, count(*) AS pages, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT component, img_id, avg(score) AS m, count(*) AS n FROM {{{v}}} GROUP BY ALL) GROUP BY component"
_REL = f"q AS (SELECT a.stem, CASE WHEN a.text = b.text THEN 'exact' WHEN {_CLEAN('a.text')} = {_CLEAN('b.text')} THEN 'normalized' ELSE 'scored' END AS relation FROM {{v_pred_ref}} a JOIN {{v_pred_cand}} b ON a.stem = b.stem)"

QUERIES = {
    "j7_paired_samples": lambda s, d: pairs(s, d).select(*_SHOWN),
    "j7_duplicate_keys": lambda s, d: P.duplicate_keys(table(s, d, REF), "component", "img_id", "gt"),
    "j8_trace_pairs": trace_rows,
    "j9_positional_pairs": lambda s, d: P.positional_pairs(*traces(s, d), "page", "block_index", "label"),
    "j9_request_counts": lambda s, d: P.length_differences(*traces(s, d), "page"),
    "j10_prediction_pairs": lambda s, d: P.prediction_pairs(*preds(s, d), excluded="5"),
    "j11_error_cases": errors,
    "j13_page_records": records,
    "j14_subset": lambda s, d: P.subset_by_key(*preds(s, d), "stem"),
    "j14_uncovered": lambda s, d: P.uncovered_keys(*preds(s, d), "stem"),
    "j15_manifest_differences": manifest_check,
    "j16_unexpected_predictions": approved_failures,
    "a5_macro_mean": lambda s, d: P.macro_mean(table(s, d, CAND)).withColumn("macro_mean", F.round("macro_mean", 9)),
    "a6_coverage": coverage,
    "a7_page_metrics": page_table,
    "a8_loss_attribution": losses,
    "a9_score_overview": lambda s, d: P.score_overview(table(s, d, CAND), "score", 0.95),
    "a10_divergence_counts": lambda s, d: P.divergence_counts(divergences(s, d), ["prompt", "label", "raw_result", "final"]),
    "a12_overall_score": overall,
    "a13_metric_validity": validity,
    "a14_projection": lambda s, d: projections(s, d).withColumn("projected", F.round("projected", 6)),
    "a19_slice_metrics": slices,
    "a20_edit_scores": edit_distance,
    "a20_ascii_edit_scores": lambda s, d: edit_distance(s, d, True),
    "a21_evidence_digest": evidence_digest,
    "a21_page_evidence_digest": page_evidence_digest,
    "f37_first_divergence": divergences,
    "t1_loss_ranking": lambda s, d: P.loss_ranking(pairs(s, d), 100).select(*_SHOWN),
    "t2_worst_per_category": worst_per_category,
    "t3_lowest_scores": lambda s, d: table(s, d, CAND).orderBy("score", "img_id", "gt_position", "component").limit(50).select("component", "img_id", "gt_position", "score"),
    "t4_bounded_details": bounded,
    "u1_only_left": lambda s, d: P.page_sets(*preds(s, d), "stem").where("side = 'left'").select("stem"),
    "u2_page_sets": lambda s, d: P.page_sets(*preds(s, d), "stem").groupBy("side").agg(F.count(F.lit(1)).alias("n")),
    "u3_set_equality": lambda s, d: P.sets_equal(*[t.select("stem") for t in preds(s, d)]),
    "u4_evidence_rows": evidence,
    "w5_boundary_attribution": attribution,
    "x3_score_replay": replay,
    "w6_page_consistency": consistency,
    "g1_schema_gate": schema,
    "g2_manifest_gate": manifest_gate,
    "g3_run_contract_gate": run_gate,
    "g4_latency_gate": latency_gate,
    "g5_page_relations": lambda s, d: quality_pages(s, d).select("stem", "relation"),
    "g5_regressions": lambda s, d: G.regressions(metric_rows(s, d)),
    "g5_quality_gate": quality_gate,
    "g6_combined_verdict": combined,
    "g6_stored_decision": decisions,
    "g7_component_gate": components,
    "g8_strict_verdict": strict,
    "g9_report_agreement": reports,
    "g10_result_table": result_table,
    "g11_log_gate": log_rows,
}

_SIDE = "CASE WHEN a.stem IS NOT NULL AND b.stem IS NOT NULL THEN 'both' WHEN a.stem IS NOT NULL THEN 'left' ELSE 'right' END"
_VERDICT = "SELECT * FROM c UNION ALL SELECT 'verdict', bool_and(passed), CAST(count(*) FILTER (NOT passed) AS VARCHAR), '0' FROM c"
_ROW = lambda name, passed, observed, limit: f"SELECT '{name}' AS \"check\", {passed} AS passed, CAST({observed} AS VARCHAR) AS observed, '{limit}' AS \"limit\" FROM o"
_GATE2 = "o AS (SELECT (SELECT count(*) FROM {v_manifest}) AS rows, (SELECT count(*) FROM (SELECT image FROM {v_manifest} GROUP BY image HAVING count(*) > 1)) AS rep, (SELECT count(*) FROM (SELECT category FROM {v_manifest} GROUP BY category HAVING count(*) <> 50)) AS uneven, (SELECT count(DISTINCT category) FROM {v_manifest} WHERE category NOT IN (" + ", ".join(f"'src{i}'" for i in range(19)) + ")) AS unknown)"
_G2 = f"{_GATE2}, c AS ({_ROW('rows', 'rows = 1000', 'rows', 1000)} UNION ALL {_ROW('unique images', 'rep = 0', 'rep', 0)} UNION ALL {_ROW('rows per category', 'uneven = 0', 'uneven', 0)} UNION ALL {_ROW('known categories', 'unknown = 0', 'unknown', 0)})"
_GATE3 = "b AS (SELECT * FROM {v_page_runs} WHERE NOT starts_with(status, 'fallback')), o AS (SELECT count(*) AS rows, 0 AS fallbacks, (SELECT count(*) FROM (SELECT image FROM b GROUP BY image HAVING count(*) > 1)) AS rep, count(*) FILTER (starts_with(status, 'fail') AND run_id >= 2) AS unapproved, count(*) FILTER (starts_with(status, 'fail') AND NOT contains(status, 'failed: e')) AS other FROM b)"
_G3 = f"{_GATE3}, c AS ({_ROW('rows', 'rows = 100', 'rows', 100)} UNION ALL {_ROW('unique images', 'rep = 0', 'rep', 0)} UNION ALL {_ROW('no fallback', 'fallbacks = 0', 'fallbacks', 0)} UNION ALL {_ROW('approved failures only', 'unapproved = 0', 'unapproved', 0)} UNION ALL {_ROW('known error only', 'other = 0', 'other', 0)})"
_GATE4 = "o AS (SELECT count(*) FILTER (starts_with(status, 'fail')) AS fail, avg(seconds) FILTER (status = 'ok') AS mean, quantile_disc(seconds, 0.95) FILTER (status = 'ok') AS p95 FROM {v_page_runs})"
_G4 = f"{_GATE4}, c AS ({_ROW('failures', 'fail = 0', 'fail', 0)} UNION ALL {_ROW('mean', 'mean <= 13.0', 'round(mean, 6)', '13.0')} UNION ALL {_ROW('p95', 'p95 <= 34.82', 'p95', 34.82)})"
_sub = lambda g, name: f"SELECT '{name}' AS \"check\", passed, observed, \"limit\" FROM (WITH {g} SELECT 'verdict' AS \"check\", bool_and(passed) AS passed, CAST(count(*) FILTER (NOT passed) AS VARCHAR) AS observed, '0' AS \"limit\" FROM c)"

ORACLES = {
    "j7_paired_samples": oracle(f"WITH {_FULL} SELECT {', '.join(_SHOWN)} FROM f"),
    "j7_duplicate_keys": oracle("SELECT component, img_id, gt, count(*) AS n FROM {v_samples_ref} GROUP BY ALL HAVING count(*) > 1"),
    "j8_trace_pairs": oracle(f"WITH {_TRACE} SELECT * FROM j"),
    "j9_positional_pairs": oracle("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY block_index, label) AS pos FROM {v_trace_ref}), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY block_index, label) AS pos FROM {v_trace_cand})
SELECT a.page, a.pos, a.block_index AS ref_block_index, a.label AS ref_label, a.raw_result AS ref_raw_result, b.block_index AS cand_block_index, b.label AS cand_label, b.raw_result AS cand_raw_result FROM a JOIN b ON a.page = b.page AND a.pos = b.pos"""),
    "j9_request_counts": oracle("WITH a AS (SELECT page, count(*) AS n FROM {v_trace_ref} GROUP BY page), b AS (SELECT page, count(*) AS n FROM {v_trace_cand} GROUP BY page) SELECT coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_cand, 'request_count' AS boundary FROM a FULL JOIN b ON a.page = b.page WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"),
    "j10_prediction_pairs": oracle(f"WITH a AS (SELECT stem, sha256({_CLEAN('text')}) AS h FROM {{v_pred_ref}} WHERE stem <> 5), b AS (SELECT stem, sha256({_CLEAN('text')}) AS h FROM {{v_pred_cand}} WHERE stem <> 5) SELECT coalesce(a.stem, b.stem) AS stem, a.h AS ref_sha, b.h AS cand_sha, CASE WHEN b.h IS NULL THEN 'only_ref' WHEN a.h IS NULL THEN 'only_cand' WHEN a.h = b.h THEN 'equal' ELSE 'different' END AS relation FROM a FULL JOIN b ON a.stem = b.stem"),
    "j11_error_cases": oracle("SELECT component, img_id, gt_idx, concat_ws(',', CASE WHEN (img_id + gt_idx) % 7 = 0 THEN 'error' END, CASE WHEN (img_id + gt_idx) % 5 = 0 THEN 'exception' END, CASE WHEN (img_id + gt_idx) % 11 = 0 THEN 'timeout' END) AS error_cases FROM {v_samples_ref}"),
    "j13_page_records": oracle("SELECT m.category, r.image, r.status AS run_status, r.seconds AS run_seconds, CASE WHEN r.status = 'ok' THEN r.seconds END AS base_old FROM (SELECT category, 'p' || regexp_extract(image, '(\\d+)', 1) || '.png' AS image FROM {v_manifest}) m JOIN {v_page_runs} r ON r.image = m.image"),
    "j14_subset": oracle("SELECT stem, text FROM {v_pred_ref} SEMI JOIN {v_pred_cand} USING (stem)"),
    "j14_uncovered": oracle("SELECT stem, 0 AS n, 'missing' AS problem FROM {v_pred_cand} ANTI JOIN {v_pred_ref} USING (stem)"),
    "j15_manifest_differences": oracle("WITH m AS (SELECT CAST(coalesce(a.stem, b.stem) AS VARCHAR) AS path, sha256(a.text) AS want, sha256(b.text) AS have FROM {v_pred_ref} a FULL JOIN {v_pred_cand} b ON a.stem = b.stem) SELECT path, want, have, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' ELSE 'changed' END AS problem FROM m WHERE want IS DISTINCT FROM have"),
    "j16_unexpected_predictions": oracle("SELECT CAST(regexp_extract(image, '(\\d+)', 1) AS BIGINT) AS stem, image FROM {v_page_runs} WHERE starts_with(status, 'fail') AND CAST(regexp_extract(image, '(\\d+)', 1) AS BIGINT) IN (SELECT stem FROM {v_pred_ref})"),
    "a5_macro_mean": oracle(f"SELECT component, round(v, 9) AS macro_mean, pages, samples FROM ({_PAGES(CAND)})"),
    "a6_coverage": oracle(f"SELECT w.component, h.samples = w.samples AS samples_ok, h.pages = w.pages AS pages_ok, abs(h.v - w.v) <= 1e-6 AS value_ok FROM ({_PAGES(REF)}) w JOIN ({_PAGES(CAND)}) h USING (component)"),
    "a7_page_metrics": oracle("SELECT CAST(img_id AS VARCHAR) AS page, round(avg(score) FILTER (component = 'formula'), 9) AS formula, round(avg(score) FILTER (component = 'table'), 9) AS \"table\" FROM {v_samples_ref} GROUP BY img_id"),
    "a8_loss_attribution": oracle(f"WITH {_CATS} SELECT category, count(*) AS count, round(sum(loss), 6) AS loss_sum, round(avg(loss), 6) AS avg_loss, round(CASE WHEN (SELECT sum(loss) FROM k) > 0 THEN sum(loss) / (SELECT sum(loss) FROM k) * 100 ELSE 0 END, 6) AS loss_pct FROM k GROUP BY category"),
    "a9_score_overview": oracle("SELECT count(*) AS count, count(*) FILTER (score < 0.95) AS below, count(*) FILTER (score = 0) AS zeros FROM {v_samples_cand}"),
    "a10_divergence_counts": oracle(f"WITH {_TRACE} SELECT o.boundary, CAST(o.ord AS INT) AS ord, count(v.boundary) AS n FROM (VALUES (0, 'prompt'), (1, 'label'), (2, 'raw_result'), (3, 'final')) o(ord, boundary) LEFT JOIN v ON v.boundary = o.boundary GROUP BY ALL"),
    "a12_overall_score": "SELECT l_orderkey, l_linenumber, round((round((1 - CASE WHEN l_linenumber <> 3 THEN l_discount END) * 100, 3) + round((1 - l_tax) * 100, 3) + round(l_quantity / 50 * 100, 3)) / 3, 6) AS overall FROM lineitem",
    "a13_metric_validity": oracle("WITH t AS (SELECT img_id, count(*) FILTER (score < 0.91) AS t, count(*) FILTER (gt_idx = 7) AS e, max(score) AS v FROM {v_samples_ref} GROUP BY img_id) SELECT img_id, t = 0 AND e = 0 AS valid, CASE WHEN t = 0 AND e = 0 THEN v END AS value FROM t"),
    "a14_projection": oracle(f"SELECT component, round(95 + CASE WHEN component = 'table' THEN 1 ELSE -1 END * sum(score - ref_score) / 100000 * 100, 6) AS projected FROM ({PAIRS}) GROUP BY component"),
    "a19_slice_metrics": "SELECT slice, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT 'ALL' AS slice, n_chars FROM documents UNION ALL SELECT 'lang: ' || lang, n_chars FROM documents UNION ALL SELECT 'source: ' || source, n_chars FROM documents) GROUP BY slice",
    "a20_ascii_edit_scores": """
WITH l AS (SELECT source AS page, unnest(string_split_regex(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '\\n|\\. ')) AS gt FROM documents),
x AS (SELECT page, gt, coalesce(CASE length(gt) % 4 WHEN 0 THEN NULL WHEN 1 THEN gt || 'x' ELSE replace(gt, 'a', '') END, '') AS pred FROM l),
d AS (SELECT page, levenshtein(gt, pred) AS d, greatest(length(gt), length(pred), 1) AS n FROM x),
p AS (SELECT page, sum(d) AS d, sum(n) AS n, sum(d / n) AS s, count(*) AS k FROM d GROUP BY page)
SELECT round(avg(d / n), 9) AS page_avg, round(sum(d) / sum(n), 9) AS whole, round(sum(s) / sum(k), 9) AS sample_avg FROM p""",
    "a21_evidence_digest": oracle(f"{_EVIDENCE}, n AS (SELECT kind, concat_ws('|', kind, page, block_index) AS name, sha256(concat_ws('|', kind, page, block_index, side, boundary)) AS h FROM e) SELECT kind, sha256(string_agg(name || chr(9) || h, chr(10) ORDER BY name)) AS digest FROM n GROUP BY kind"),
    "a21_page_evidence_digest": oracle(f"{_EVIDENCE}, n AS (SELECT page, concat_ws('|', kind, page, block_index) AS name, sha256(concat_ws('|', kind, page, block_index, side, boundary)) AS h FROM e) SELECT page, sha256(string_agg(name || chr(9) || h, chr(10) ORDER BY name)) AS digest FROM n GROUP BY page"),
    "f37_first_divergence": oracle(f"WITH {_TRACE} SELECT * FROM v WHERE boundary IS NOT NULL"),
    "t1_loss_ranking": oracle(f"WITH {_FULL} SELECT {', '.join(_SHOWN)} FROM f WHERE side = 'both' ORDER BY delta DESC, img_id, ref_gt_idx, component, gt_position LIMIT 100"),
    "t2_worst_per_category": oracle(f"WITH {_CATS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY loss DESC, img_id, gt_position, component) AS rank FROM k) WHERE rank <= 5"),
    "t3_lowest_scores": oracle("SELECT component, img_id, gt_position, score FROM {v_samples_cand} ORDER BY score, img_id, gt_position, component LIMIT 50"),
    "t4_bounded_details": oracle(f"WITH {_TRACE}, f AS (SELECT * FROM v WHERE boundary IS NOT NULL) SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 100 AS details_truncated FROM f ORDER BY page, block_index LIMIT 100"),
    "u1_only_left": oracle("SELECT stem FROM {v_pred_ref} ANTI JOIN {v_pred_cand} USING (stem)"),
    "u2_page_sets": oracle(f"SELECT {_SIDE} AS side, count(*) AS n FROM {{v_pred_ref}} a FULL JOIN {{v_pred_cand}} b ON a.stem = b.stem GROUP BY 1"),
    "u3_set_equality": oracle(f"WITH p AS (SELECT {_SIDE} AS side FROM {{v_pred_ref}} a FULL JOIN {{v_pred_cand}} b ON a.stem = b.stem) SELECT count(*) FILTER (side = 'left') AS only_left, count(*) FILTER (side = 'right') AS only_right, count(*) FILTER (side <> 'both') = 0 AS equal FROM p"),
    "u4_evidence_rows": oracle(f"{_EVIDENCE} SELECT * FROM e"),
    "w5_boundary_attribution": """
WITH t AS (SELECT l_orderkey AS case_id, l_linenumber AS ord, CASE WHEN l_orderkey % 6 <> l_linenumber THEN min(l_discount) END AS b, min(l_tax) AS a FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT *, bool_and(b IS NOT NULL) OVER (PARTITION BY case_id ORDER BY ord) AS seen FROM t)
SELECT case_id, coalesce('b' || min(CASE WHEN seen AND a - b > 0 THEN ord END), 'unproven') AS boundary FROM k GROUP BY case_id""",
    "x3_score_replay": """
WITH t AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS ord FROM lineitem),
o AS (SELECT *, 'line ' || ord % 9 AS gt, CASE WHEN case_id % 6 <> ord THEN 'lime ' || ord % 3 END AS b, 'line ' || ord % 4 AS a FROM t),
c AS (SELECT case_id, ord, gt, b, CASE WHEN case_id % 5 = 0 THEN b ELSE a END AS a FROM o),
v AS (SELECT case_id, ord, 1 - levenshtein(gt, b) / greatest(length(gt), length(b)) AS b, 1 - levenshtein(gt, a) / greatest(length(gt), length(a)) AS a FROM c),
k AS (SELECT *, bool_and(b IS NOT NULL AND a IS NOT NULL) OVER (PARTITION BY case_id ORDER BY ord) AS seen FROM v)
SELECT case_id, coalesce('boundary ' || min(CASE WHEN seen AND a - b > 0 THEN ord END), 'unproven') AS boundary FROM k GROUP BY case_id""",
    "w6_page_consistency": oracle("SELECT page, count(DISTINCT label) AS n_values FROM {v_trace_ref} GROUP BY page HAVING count(DISTINCT label) > 1"),
    "g1_schema_gate": oracle("WITH n AS (SELECT count(*) FILTER (category = 'src3') AS n FROM {v_manifest}), c AS (SELECT 'column category' AS \"check\", true AS passed, 'string' AS observed, 'string' AS \"limit\" UNION ALL SELECT 'column image', true, 'string', 'string' UNION ALL SELECT 'column sha256', true, 'string', 'string' UNION ALL SELECT 'no other columns', true, '', '' UNION ALL SELECT 'digest sha256', n = 0, CAST(n AS VARCHAR), '0' FROM n) " + _VERDICT),
    "g2_manifest_gate": oracle(f"WITH {_G2} {_VERDICT}"),
    "g3_run_contract_gate": oracle(f"WITH {_G3} {_VERDICT}"),
    "g4_latency_gate": oracle(f"WITH {_G4} {_VERDICT}"),
    "g5_page_relations": oracle(f"WITH {_REL} SELECT * FROM q"),
    "g5_regressions": oracle(f"WITH m AS (SELECT img_id || '/' || gt_position AS image, component || CASE WHEN component = 'table' THEN '_edit' ELSE '' END AS metric, ref_score AS reference, score AS candidate FROM ({PAIRS})) SELECT * FROM m WHERE CASE WHEN metric = 'table_edit' THEN candidate > reference ELSE candidate < reference END"),
    "g5_quality_gate": oracle(f"WITH {_REL}, pr AS (SELECT round(avg(p), 2) AS overall FROM (SELECT 95 + CASE WHEN component = 'table' THEN 1 ELSE -1 END * sum(score - ref_score) / 100000 * 100 AS p FROM ({PAIRS}) GROUP BY component)), o AS (SELECT (SELECT count(*) FROM q) AS n, overall FROM pr), c AS (SELECT 'every page is classed' AS \"check\", true AS passed, CAST(n AS VARCHAR) AS observed, CAST(n AS VARCHAR) AS \"limit\" FROM o UNION ALL {_ROW('only scored pages have metrics', 'true', '0', 0)} UNION ALL {_ROW('projection', 'overall >= 95', 'overall', '95.0')}) {_VERDICT}"),
    "g6_combined_verdict": oracle(f"WITH c AS ({_sub(_G2, 'manifest')} UNION ALL {_sub(_G3, 'runs')} UNION ALL {_sub(_G4, 'latency')}) {_VERDICT}"),
    "g6_stored_decision": oracle(f"WITH c AS ({_sub(_G3, 'runs')}) SELECT \"check\", true AS stored, passed AS recomputed FROM c WHERE NOT passed"),
    "g7_component_gate": oracle(f"WITH o AS (SELECT count(*) FILTER (CASE WHEN r.component = 'table' THEN c.v > r.v ELSE c.v < r.v END) AS worse, 0 AS missing, round(avg(CASE WHEN r.component = 'table' THEN 1 - c.v ELSE c.v END * 100), 6) AS overall FROM ({_PAGES(REF)}) r JOIN ({_PAGES(CAND)}) c USING (component)), c AS ({_ROW('no component worse', 'worse = 0', 'worse', 0)} UNION ALL {_ROW('all components there', 'missing = 0', 'missing', 0)} UNION ALL {_ROW('overall', 'overall >= 90', 'overall', '90.0')}) {_VERDICT}"),
    "g8_strict_verdict": oracle(f"WITH {_TRACE}, r AS (SELECT CASE WHEN ref_raw_result IS NULL OR cand_raw_result IS NULL THEN 'unobservable' WHEN ref_raw_result = cand_raw_result THEN 'equal' ELSE 'different' END AS x FROM j) SELECT count(*) FILTER (x = 'equal') AS equal, count(*) FILTER (x = 'different') AS different, count(*) FILTER (x = 'unobservable') AS unobservable, count(*) AS total, CASE WHEN count(*) FILTER (x = 'different') > 0 THEN 'FAIL' WHEN count(*) FILTER (x = 'unobservable') > 0 OR count(*) = 0 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM r"),
    "g9_report_agreement": oracle("WITH a AS (SELECT 'ALL' AS metric, avg(score) AS a FROM {v_samples_ref} UNION ALL SELECT 'component: ' || component, avg(score) FROM {v_samples_ref} GROUP BY component), b AS (SELECT 'ALL' AS metric, avg(score) AS b FROM {v_samples_cand} UNION ALL SELECT 'component: ' || component, avg(score) FROM {v_samples_cand} GROUP BY component) SELECT metric, round(a, 4) AS a, round(b, 4) AS b FROM a JOIN b USING (metric) WHERE round(a, 3) <> round(b, 3)"),
    "g10_result_table": "SELECT source, round(avg(n_chars) / 100, 2) AS overall, source = 'src7' AS is_primary FROM documents GROUP BY source",
    "g11_log_gate": """
WITH h AS (SELECT conv_id * 1000 + turn AS pos, role AS command, CAST(turn % 3 AS INT) AS exit_code FROM conversations),
w AS (SELECT pos, command, CASE WHEN pos % 7 = 0 THEN 9 ELSE exit_code END AS exit_code FROM h WHERE pos % 10 <> 4)
SELECT h.pos, h.command AS have_command, h.exit_code AS have_exit, w.command AS want_command, w.exit_code AS want_exit FROM h LEFT JOIN w ON w.pos = h.pos WHERE w.pos IS NULL OR w.exit_code <> h.exit_code""",
}
