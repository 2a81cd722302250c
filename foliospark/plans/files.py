"""Queries on files: each writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators.blocks import page_markdown
from foliospark.plans.texts import ORACLES as ORACLES_TEXT
from foliospark.plans.views import oracle, table
from foliospark.sources import files as S


def listing(s, d):
    """Files that a run left, one for each twenty documents with their whole texts; those with an
    extension of either set, in any case, are listed."""
    folder = S.new_folder(s, "pages")
    ends = F.array(*map(F.lit, (".PNG", ".gif", ".tif", ".txt")))
    lots = table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("lot")).agg(_joined("text").alias("value"))
    lots = lots.select(F.concat(F.lit("p"), F.col("lot").cast("string"), F.get(ends, (F.col("lot") % 4).cast("int"))).alias("name"), "value")
    S.write_named_texts(lots, folder, "name", "value").write.format("noop").mode("overwrite").save()
    kinds = {"run": S.IMAGE_EXTENSIONS, "evaluation": S.EVALUATION_EXTENSIONS}
    one, two = (S.file_scan(s, folder, e).select(F.lit(k).alias("kind"), "stem", "bytes") for k, e in kinds.items())
    return one.union(two)


def _joined(text):
    """The texts of a lot of documents, in order of their id, a line feed between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", text))), lambda x: F.coalesce(x[text], F.lit(""))), "\n")


def repeated(s, d):
    names = table(s, d, "pages").select(F.regexp_extract("url", r"([^/?#.]+)(?:[.][a-z]+)?(?:[?#].*)?$", 1).alias("stem"), F.col("url").alias("name"))
    return S.repeated_stems(names)


def predictions(s, d):
    """Page texts, a Markdown file for each twenty documents, read back whole without an excluded
    stem."""
    folder = S.new_folder(s, "predictions")
    lots = table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("lot")).agg(_joined("text").alias("value"))
    lots = lots.withColumn("name", F.concat(F.lit("lot"), F.col("lot").cast("string"), F.lit(".md")))
    S.write_named_texts(lots, folder, "name", "value").write.format("noop").mode("overwrite").save()
    return S.prediction_texts(s, folder, "lot3")


def page_texts(s, d):
    """A folder a page, read back whole: the text is a digest of the page's."""
    folder = S.new_folder(s, "texts")
    texts = table(s, d, "documents").groupBy("source").agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.min(F.sha2("text", 256)), F.max(F.sha2("text", 256))).alias("markdown"))
    S.write_page_texts(texts, folder, "source")
    return S.read_page_texts(s, folder).select("source", F.regexp_replace("value", "\n$", "").alias("text"))


def trace_folder(s, d):
    """Traces of forty events a file: every line of file 5n is blank, of others some are, some are
    no objects and some belong to another page."""
    e = table(s, d, "events").select("event_id", F.concat(F.lit("t"), F.floor(F.col("event_id") / 40).cast("string")).alias("stem"))
    own = F.format_string('{"page":"%s","n":%d}', F.col("stem"), F.col("event_id"))
    line = F.when((F.floor(F.col("event_id") / 40) % 5 == 0) | (F.col("event_id") % 7 == 0), " ").when(F.col("event_id") % 11 == 0, "[1]").when(F.col("event_id") % 13 == 0, '{"page":"t","n":0}').otherwise(own)
    files = e.select("event_id", "stem", line.alias("line")).groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("value"))
    folder = S.new_folder(s, "traces")
    S.write_named_texts(files.withColumn("name", F.concat("stem", F.lit(".jsonl"))), folder, "name", "value").write.format("noop").mode("overwrite").save()
    read = S.trace_events(s, folder).groupBy("page", F.coalesce("problem", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return read.union(S.empty_traces(s, folder).select("page", F.lit("empty").alias("kind"), F.lit(0).cast("long").alias("n")))


def trace_file(s, d):
    """Canonical JSON lines of a trace, read back strictly."""
    folder = S.new_folder(s, "trace")
    S.write_canonical_jsonl(table(s, d, "v_trace_ref"), folder)
    lines = s.read.text(folder)
    got = S.strict_json(lines).where("problem IS NULL")
    return got.select(F.col("value").alias("line"), F.try_variant_get("parsed", "$.page", "long").alias("page"))


def problems(s, d):
    """Lines that strict reading refuses, by reason."""
    bad = F.when(F.col("turn") % 4 == 0, '{"a":1,"a":2}').when(F.col("turn") % 4 == 1, '{"a":NaN}').when(F.col("turn") % 4 == 2, "[1]").otherwise('{"a":1}')
    return S.strict_json(table(s, d, "conversations").select(bad.alias("value"))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def components(s, d):
    """Scorer results, a list of samples a file, written and read as components."""
    folder = S.new_folder(s, "samples")
    rows = table(s, d, "v_samples_ref").select(F.col("component"), F.struct(F.col("img_id").cast("string").alias("img_id"), F.array("gt_idx").alias("gt_idx"), F.col("gt_position").cast("string").alias("gt_position"), "gt", "pred", F.struct(F.col("score").alias("CDM")).alias("metric")).alias("x"))
    rows.select("component", "x.*").write.partitionBy("component").json(folder)
    formula, tables = (S.component_samples(s, f"{folder}/component={c}", "*.json", c, "CDM", multi_line=False) for c in ("formula", "table"))
    got = formula.union(tables)
    return got.select("component", *[F.col(c).cast("long").alias(c) for c in ("img_id", "gt_idx", "gt_position")], "gt", "pred", "score")


def scores(s, d):
    """Score files in three shapes, a page's scores a text."""
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("v"))
    name = F.concat(F.lit("p"), F.col("l_orderkey").cast("string"))
    # page -> list of samples, page_[id] -> number, page -> sample
    listed = F.map_from_arrays(F.array(name), F.array(F.transform("v", lambda x: F.struct(F.struct(x.alias("CDM")).alias("metric")))))
    keyed = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.concat(name, F.lit("_["), i.cast("string"), F.lit("]"))), F.col("v"))
    single = F.map_from_arrays(F.array(name), F.array(F.struct(F.array_max("v").alias("score"))))
    text = F.when(F.col("l_orderkey") % 3 == 0, F.to_json(listed)).when(F.col("l_orderkey") % 3 == 1, F.to_json(keyed)).otherwise(F.to_json(single))
    return S.sample_scores(t.select(text.alias("value"))).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


def cache(s, d):
    """A cache file for each thousand documents of a source, in either shape."""
    t = table(s, d, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("lot")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("lang")))).alias("m"))
    text = F.when(F.substring("source", -1, 1) == "1", F.to_json("m")).otherwise(F.to_json(F.struct(F.col("m").alias("entries"))))
    return S.response_cache(t.select(text.alias("value"))).select(F.col("key").cast("long").alias("doc_id"), "text")


def worst_cases(s, d):
    """A CSV of cases with a fixed order of columns, read back."""
    folder = S.new_folder(s, "cases")
    columns = ["img_id", "gt_position", "score", "gt", "pred"]
    S.write_csv(table(s, d, "v_samples_cand"), folder, columns)
    return S.read_csv(s, folder, "img_id long, gt_position long, score double, gt string, pred string")


def redacted(s, d):
    e = table(s, d, "documents").select("doc_id", F.create_map(F.lit("Token"), F.col("source"), F.lit("lang"), F.col("lang")).alias("payload"))
    got = S.redacted_trace(e)
    return got.select("doc_id", F.col("payload")["Token"].alias("token"), "payload_fingerprint")


def markdown_files(s, d):
    folder = S.new_folder(s, "markdown")
    S.write_json(page_markdown(table(s, d, "v_blocks")), folder)
    return s.read.schema("page_id long, markdown string").json(folder)


QUERIES = {
    "s1_file_scan": listing,
    "s2_repeated_stems": repeated,
    "s3_prediction_texts": predictions,
    "s3_s9_page_texts": page_texts,
    "s4_trace_folder": trace_folder,
    "s4_s9_trace_lines": trace_file,
    "s5_component_samples": components,
    "s6_score_shapes": scores,
    "s7_strict_json": problems,
    "s8_response_cache": cache,
    "s9_csv_sink": worst_cases,
    "s9_redacted_trace": redacted,
    "s9_json_sink": markdown_files,
}
ORACLES = {
    "s1_file_scan": """WITH f AS (SELECT doc_id // 20 AS lot, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id))) AS bytes FROM documents GROUP BY 1)
SELECT kind, 'p' || lot AS stem, CAST(bytes AS BIGINT) AS bytes FROM f JOIN (VALUES ('run', 0), ('run', 2), ('evaluation', 0), ('evaluation', 1)) k(kind, e) ON lot % 4 = e""",
    "s2_repeated_stems": "WITH f AS (SELECT DISTINCT regexp_extract(url, '([^/?#.]+)(?:[.][a-z]+)?(?:[?#].*)?$', 1) AS stem, url AS name FROM pages), n AS (SELECT stem, count(*) AS n FROM f GROUP BY stem HAVING count(*) > 1) SELECT stem, name, n FROM f JOIN n USING (stem)",
    "s3_prediction_texts": "SELECT * FROM (SELECT 'lot' || (doc_id // 20) AS stem, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1) WHERE stem <> 'lot3'",
    "s4_trace_folder": """WITH e AS (SELECT event_id, event_id // 40 AS f FROM events),
l AS (SELECT 't' || f AS page, CASE WHEN f % 5 = 0 OR event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'not a JSON object' WHEN event_id % 13 = 0 THEN 'another page' ELSE 'ok' END AS kind FROM e)
SELECT page, kind, count(*) AS n FROM l WHERE kind IS NOT NULL GROUP BY ALL UNION ALL SELECT page, 'empty', 0 FROM l GROUP BY page HAVING count(kind) = 0""",
    "s3_s9_page_texts": "SELECT source, count(*) || ' ' || min(sha256(text)) || ' ' || max(sha256(text)) AS text FROM documents GROUP BY source",
    "s5_component_samples": oracle("SELECT component, img_id, gt_idx, gt_position, gt, pred, score FROM {v_samples_ref}"),
    "s6_score_shapes": "SELECT 'p' || l_orderkey AS page, CASE WHEN l_orderkey % 3 = 2 THEN 1 ELSE count(*) END AS n, round(CASE WHEN l_orderkey % 3 = 2 THEN max(l_discount) ELSE sum(l_discount) END, 6) AS total FROM lineitem GROUP BY l_orderkey",
    "s7_strict_json": "SELECT CASE turn % 4 WHEN 0 THEN 'not strict JSON' WHEN 1 THEN 'not strict JSON' WHEN 2 THEN 'not an object' END AS problem, count(*) AS n FROM conversations GROUP BY 1",
    "s8_response_cache": "SELECT doc_id, lang AS text FROM documents",
    "s9_csv_sink": oracle("SELECT img_id, gt_position, score, gt, pred FROM {v_samples_cand}"),
    "s9_redacted_trace": """SELECT doc_id, '<redacted>' AS token, sha256('{"Token":"<redacted>","lang":"' || lang || '"}') AS payload_fingerprint FROM documents""",
    "s9_json_sink": ORACLES_TEXT["f6_page_markdown"],
}
