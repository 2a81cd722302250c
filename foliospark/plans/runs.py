"""Queries on page runs, latencies, samples, votes and the function runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import runner as U
from foliospark.operators import runs as R
from foliospark.plans.views import oracle, table


def page_runs(s, d):
    return table(s, d, "v_page_runs")


def run_summary(s, d):
    """Counts and latencies of each stage."""
    runs = page_runs(s, d)
    counts = R.run_counts(runs, "stage")
    times = R.latency_summary(runs.where(R.status_class(F.col("status")) == "ok"), "seconds", "stage").withColumnRenamed("count", "timed")
    return counts.join(times, "stage", "left").withColumn("mean", F.round("mean", 6))


_KIND = "CASE WHEN status = 'ok' THEN 'ok' WHEN starts_with(status, 'fail') THEN 'fail' WHEN starts_with(status, 'fallback') THEN 'fallback' END"
_COUNTS = f"count(*) AS count, count(*) FILTER ({_KIND} = 'ok') AS ok, count(*) FILTER ({_KIND} = 'fail') AS fail, count(*) FILTER ({_KIND} = 'fallback') AS fallback, count(*) FILTER ({_KIND} <> 'fail') AS ok_including_fallback"
_STATE = "CASE WHEN fail = 0 THEN 'ok' WHEN ok_including_fallback > 0 THEN 'partial' ELSE 'failed' END AS run_status"
_TIMES = "round(avg(seconds), 6) AS mean, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95, quantile_disc(seconds, 0.99) AS p99, max(seconds) AS max"


def repairs(s, d):
    """A repair run for most of the pages that failed with e3."""
    runs = page_runs(s, d).select("image", "status", "seconds")
    fix = runs.where("status LIKE '%e3' AND seconds > 5").select("image", F.lit("ok").alias("status"), (F.col("seconds") + 1).alias("seconds"))
    return runs, fix


def traced(s, d):
    """Stage seconds as a map, then a row for each stage."""
    rows = page_runs(s, d).where("status = 'ok'").select(F.create_map(F.lit("encode"), F.col("seconds") / 4, F.lit("request"), F.col("seconds")).alias("stages"))
    got = rows.select(F.explode("stages").alias("stage", "seconds"))
    return R.latency_summary(got, "seconds", "stage").withColumn("mean", F.round("mean", 6))


def answers(s, d):
    t = table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("answer"))
    return R.majority(t, "user_id", "answer", "event_id")


def digests(s, d):
    """A digest for each thousand of a category's images."""
    m = table(s, d, "v_manifest").withColumn("h", F.sha2("image", 256)).withColumn("lot", F.floor(F.regexp_extract("image", r"(\d+)", 1).cast("long") / 1000))
    return R.listed_digest(m, "image", "h", "category", "lot")


def whole_digest(s, d):
    return R.listed_digest(table(s, d, "v_manifest").withColumn("h", F.sha2("category", 256)), "image", "h")


def _first_word(text):
    """Stands in for a model: the first word of a text; texts of one word are an error."""
    if text is None or " " not in text:
        raise ValueError("one word")
    return text.split(" ")[0]


def function_runs(s, d):
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.regexp_extract("text", r"^(\S*)", 1)).otherwise(F.col("text")).alias("text"))
    run = U.run_function(docs, "doc_id", "text", _first_word, attempts=2)
    old = docs.where("doc_id % 20 = 0").select("doc_id", F.lit("old").alias("answer"))
    return U.with_fallback(run, old, "doc_id").select("doc_id", "answer", "status", "attempts")


def gate(s, d):
    return U.success_gate(function_runs(s, d))


def lookups(s, d):
    """Requests that repeat: each source and language is asked once or found in the cache."""
    asked = table(s, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("text"), U.request_key("source", "lang").alias("key"))
    cache = asked.where("text LIKE '% en'").select("key", F.lit("cached").alias("answer")).distinct()
    return U.memoised(asked, cache, _first_word, "text").select("doc_id", "answer", "source")


def providers(s, d):
    e = table(s, d, "events").select("event_type", F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 5 == 0, "gpu").when(F.col("event_id") % 7 == 0, "other").otherwise("cpu").alias("provider"))
    return R.provider_shares(e, "provider", ("gpu", "cpu"), F.col("event_type") != "view")


QUERIES = {
    "run_summary": run_summary,
    "p10_status_classes": lambda s, d: page_runs(s, d).groupBy(R.status_class(F.col("status")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "p12_a15_provider_shares": providers,
    "a1_run_counts": lambda s, d: R.run_counts(page_runs(s, d), "run_id"),
    "a2_latency": lambda s, d: R.latency_summary(page_runs(s, d), "seconds", "run_id").withColumn("mean", F.round("mean", 6)),
    "a3_stage_timing": traced,
    "a4_covered_time": lambda s, d: R.covered_time(table(s, d, "v_intervals")),
    "a11_majority_vote": answers,
    "a16_ordered_digest": digests,
    "a16_whole_digest": whole_digest,
    "a18_throughput": lambda s, d: page_runs(s, d).groupBy("run_id").agg(F.round(R.pages_per_minute(F.count(F.lit(1)), F.sum("seconds")), 6).alias("ppm")),
    "a22_scored_tally": lambda s, d: R.scored_tally(table(s, d, "v_samples_cand").withColumn("score", F.when(F.col("img_id") % 13 != 0, F.col("score"))), "score", "component").withColumn("nonzero_mean", F.round("nonzero_mean", 9)),
    "t5_failure_sample": lambda s, d: R.failure_sample(page_runs(s, d), ("image", "run_id", "stage", "status", "seconds"), 20),
    "w4_stratified_sample": lambda s, d: R.stratified_sample(table(s, d, "v_manifest"), 3),
    "j12_repair_upsert": lambda s, d: R.repaired(*repairs(s, d), "e3"),
    "j12_unapplied_repairs": lambda s, d: R.unapplied_repairs(*repairs(s, d), "e3"),
    "x1_function_runner": function_runs,
    "x1_success_gate": gate,
    "j17_memoised_lookup": lookups,
}
_FIX = "r AS (SELECT image, status, seconds FROM {v_page_runs}), f AS (SELECT image, seconds + 1 AS seconds FROM r WHERE status LIKE '%e3' AND seconds > 5)"
_RUN = """
r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN regexp_extract(text, '^(\\S*)', 1) ELSE text END AS text FROM documents),
x AS (SELECT doc_id, CASE WHEN contains(text, ' ') AND split_part(text, ' ', 1) <> '' THEN split_part(text, ' ', 1) END AS a,
  CASE WHEN NOT contains(text, ' ') THEN 'ValueError: one word' WHEN split_part(text, ' ', 1) = '' THEN 'empty answer' END AS e FROM r),
y AS (SELECT doc_id, CASE WHEN a IS NULL AND doc_id % 20 = 0 THEN 'old' ELSE a END AS answer,
  CASE WHEN a IS NOT NULL THEN 'ok' WHEN doc_id % 20 = 0 THEN 'fallback: ' || e ELSE 'failed: ' || e END AS status, CASE WHEN a IS NULL THEN 2 ELSE 1 END AS attempts FROM x)"""
ORACLES = {
    "run_summary": oracle(f"WITH c AS (SELECT stage, {_COUNTS} FROM {{v_page_runs}} GROUP BY stage), t AS (SELECT stage, count(*) AS timed, {_TIMES} FROM {{v_page_runs}} WHERE status = 'ok' GROUP BY stage) SELECT c.*, {_STATE}, timed, mean, p50, p95, p99, max FROM c LEFT JOIN t USING (stage)"),
    "p10_status_classes": oracle(f"SELECT {_KIND} AS kind, count(*) AS n FROM {{v_page_runs}} GROUP BY 1"),
    "p12_a15_provider_shares": """
WITH e AS (SELECT CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'gpu' WHEN event_id % 7 = 0 THEN 'other' ELSE 'cpu' END AS p FROM events WHERE event_type <> 'view'),
c AS (SELECT count(*) AS events, count(*) FILTER (p = 'gpu') AS n_0, count(*) FILTER (p = 'cpu') AS n_1, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (p = 'other') AS other FROM e)
SELECT *, n_0 / (n_0 + n_1) AS share_0, n_1 / (n_0 + n_1) AS share_1 FROM c""",
    "a1_run_counts": oracle(f"WITH c AS (SELECT run_id, {_COUNTS} FROM {{v_page_runs}} GROUP BY run_id) SELECT *, {_STATE} FROM c"),
    "a2_latency": oracle(f"SELECT run_id, count(*) AS count, {_TIMES} FROM {{v_page_runs}} GROUP BY run_id"),
    "a3_stage_timing": oracle(f"SELECT stage, count(*) AS count, {_TIMES} FROM (SELECT 'encode' AS stage, seconds / 4 AS seconds FROM {{v_page_runs}} WHERE status = 'ok' UNION ALL SELECT 'request', seconds FROM {{v_page_runs}} WHERE status = 'ok') GROUP BY stage"),
    "a4_covered_time": oracle("""
WITH b AS (SELECT *, max(finish_s) OVER (PARTITION BY page_id ORDER BY start_s, finish_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {v_intervals}),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_s > before THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY start_s, finish_s ROWS UNBOUNDED PRECEDING) AS island FROM b),
n AS (SELECT page_id, island, max(finish_s) - min(start_s) AS n FROM i GROUP BY ALL)
SELECT page_id, sum(n) AS covered FROM n GROUP BY page_id"""),
    "a11_majority_vote": "WITH v AS (SELECT user_id, event_type AS answer, count(*) AS votes, min(event_id) AS first FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM v) SELECT user_id, answer, votes FROM k WHERE k = 1",
    "a16_ordered_digest": oracle("SELECT category, CAST(regexp_extract(image, '(\\d+)', 1) AS BIGINT) // 1000 AS lot, sha256(string_agg(image || chr(9) || sha256(image), chr(10) ORDER BY image)) AS digest FROM {v_manifest} GROUP BY ALL"),
    "a16_whole_digest": oracle("SELECT sha256(string_agg(image || chr(9) || sha256(category), chr(10) ORDER BY image)) AS digest FROM {v_manifest}"),
    "a18_throughput": oracle("SELECT run_id, round(coalesce(count(*) * 60.0 / nullif(sum(seconds), 0), 0), 6) AS ppm FROM {v_page_runs} GROUP BY run_id"),
    "a22_scored_tally": oracle("WITH x AS (SELECT component, CASE WHEN img_id % 13 <> 0 THEN score END AS s FROM {v_samples_cand}) SELECT component, round(avg(CASE WHEN s > 0 THEN s END), 9) AS nonzero_mean, count(*) FILTER (s = 0) AS zeros, count(*) FILTER (s IS NULL) AS missing FROM x GROUP BY component"),
    "t5_failure_sample": oracle("SELECT substr(image, 1, 200) AS image, run_id, substr(stage, 1, 200) AS stage, substr(status, 1, 200) AS status, seconds FROM {v_page_runs} WHERE status <> 'ok' ORDER BY image, run_id, stage, status, seconds LIMIT 20"),
    "w4_stratified_sample": oracle("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256(image), image) AS rank FROM {v_manifest}) WHERE rank <= 3"),
    "j12_repair_upsert": oracle(f"WITH {_FIX} SELECT r.image, CASE WHEN f.image IS NOT NULL THEN 'ok' ELSE r.status END AS status, coalesce(f.seconds, r.seconds) AS seconds, f.image IS NOT NULL AS repaired FROM r LEFT JOIN f ON f.image = r.image"),
    "j12_unapplied_repairs": oracle(f"WITH {_FIX} SELECT image, 'base' AS side FROM r ANTI JOIN f USING (image) WHERE contains(status, 'e3')"),
    "x1_function_runner": f"WITH {_RUN.strip()} SELECT * FROM y",
    "x1_success_gate": f"WITH {_RUN.strip()} SELECT count(*) AS n, count(*) FILTER (NOT starts_with(status, 'fail')) AS ok, count(*) FILTER (NOT starts_with(status, 'fail')) >= 0.5 * count(*) AS passed FROM y",
    "j17_memoised_lookup": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'cached' ELSE source END AS answer, CASE WHEN lang = 'en' THEN 'cache' ELSE 'computed' END AS source FROM documents",
}
