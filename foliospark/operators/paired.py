"""Paired comparison of two runs: samples, traces, predictions, manifests, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.edit import edit_distance
from foliospark.functions.json_values import relation
from foliospark.functions.text import for_comparison


def sample_key() -> list[Column]:
    """A sample is known by component, page, position and the digest of its truth."""
    return [F.col("component"), F.col("img_id"), F.col("gt_position"), F.sha2("gt", 256).alias("gt_sha256")]


def duplicate_keys(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def paired_samples(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Full outer join on the sample key; side says both, ref or cand. delta is the loss."""
    names = ["component", "img_id", "gt_position", "gt_sha256"]
    side = lambda df, p: df.select(*sample_key(), F.col("gt_idx").alias(f"{p}_gt_idx"), F.col("gt").alias(f"{p}_gt"), F.col("pred").alias(f"{p}_pred"), F.col("score").alias(f"{p}_score"), F.lit(True).alias(f"{p}_in"))
    got = side(ref, "ref").join(side(cand, "cand"), names, "full_outer")
    where = F.when(F.col("ref_in") & F.col("cand_in"), "both").when(F.col("ref_in"), "ref").otherwise("cand")
    return got.withColumn("side", where).withColumn("delta", F.col("ref_score") - F.col("cand_score")).drop("ref_in", "cand_in")


def attach_errors(samples: DataFrame, timeouts: DataFrame, errors: DataFrame, exceptions: DataFrame, keys=("component", "img_id", "gt_idx")) -> DataFrame:
    """Adds error_cases: the kinds listed for a sample, in order."""
    kinds = [df.select(*keys, F.lit(k).alias("kind")) for df, k in ((timeouts, "timeout"), (errors, "error"), (exceptions, "exception"))]
    cases = reduce(DataFrame.unionByName, kinds).groupBy(*keys).agg(F.array_sort(F.collect_list("kind")).alias("error_cases"))
    return samples.join(cases, list(keys), "left").withColumn("error_cases", F.coalesce("error_cases", F.array().cast("array<string>")))


def macro_mean(samples: DataFrame, score: str = "score", component: str = "component", page: str = "img_id") -> DataFrame:
    """Per component: mean over pages of the page's mean, so that pages weigh the same."""
    pages = samples.groupBy(component, page).agg(F.avg(score).alias("page_mean"), F.count(F.lit(1)).alias("n"))
    return pages.groupBy(component).agg(F.avg("page_mean").alias("macro_mean"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("samples"))


def coverage(samples: DataFrame, expected: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """expected: component, samples, pages, value. Whether counts are equal and the macro mean
    reconciles to the value."""
    e = expected.select("component", *[F.col(c).alias(f"want_{c}") for c in ("samples", "pages", "value")])
    got = e.join(macro_mean(samples), "component", "left")
    return got.select("component", F.coalesce(F.col("samples") == F.col("want_samples"), F.lit(False)).alias("samples_ok"), F.coalesce(F.col("pages") == F.col("want_pages"), F.lit(False)).alias("pages_ok"), F.coalesce(F.abs(F.col("macro_mean") - F.col("want_value")) <= tolerance, F.lit(False)).alias("value_ok"))


def page_metrics(samples: DataFrame, metrics: list[str], page: str = "page", metric: str = "metric", score: str = "score") -> DataFrame:
    """A row a page, a column a metric: the mean of its samples, null where it has none."""
    return samples.groupBy(page).pivot(metric, metrics).agg(F.avg(score))


def loss_by_category(pairs: DataFrame, category: Column, loss: Column, *order: str) -> DataFrame:
    """count, loss, share of the total loss in percent (0 without one), mean loss of each category."""
    rows = pairs.select(category.alias("category"), loss.alias("loss"))
    got = rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.sum("loss").alias("loss_sum"), F.avg("loss").alias("avg_loss"))
    total = got.agg(F.sum("loss_sum").alias("total"))
    pct = F.when(F.col("total") > 0, F.col("loss_sum") / F.col("total") * 100).otherwise(0.0)
    return got.crossJoin(F.broadcast(total)).withColumn("loss_pct", pct).drop("total")  # one row


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def score_overview(scores: DataFrame, score: str = "score", limit: float = 0.8) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(score) < limit).alias("below"), F.count_if(F.col(score) == 0).alias("zeros"))


def typed_index_order(c: str = "gt_idx") -> list[Column]:
    """Numbers in their order, then texts in theirs."""
    number = F.col(c).cast("string").try_cast("double")
    return [number.isNull(), number, F.col(c).cast("string")]


def loss_ranking(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs with the largest loss; ties by page, typed index and component."""
    return pairs.where("side = 'both'").orderBy(F.col("delta").desc(), "img_id", *typed_index_order("ref_gt_idx"), "component", "gt_position").limit(n)


def page_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right, for every key of either table."""
    got = a.select(key).distinct().withColumn("__a", F.lit(True)).join(b.select(key).distinct().withColumn("__b", F.lit(True)), key, "full_outer")
    return got.select(key, F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "left").otherwise("right").alias("side"))


def sets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal, only_left, only_right; the sets are compared as sets."""
    left, right = a.subtract(b), b.subtract(a)
    counts = left.agg(F.count(F.lit(1)).alias("only_left")).crossJoin(right.agg(F.count(F.lit(1)).alias("only_right")))
    return counts.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def trace_pairs(ref: DataFrame, cand: DataFrame, page: str = "page", index: str = "block_index") -> DataFrame:
    """Blocks of the pages that both traces have: joined on page and block, with side."""
    shared = ref.select(page).distinct().join(cand.select(page).distinct(), page, "left_semi")
    only = lambda df, p: df.where(F.col(index).isNotNull()).join(shared, page, "left_semi").select(page, index, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (page, index)], F.lit(True).alias(f"{p}_in"))
    got = only(ref, "ref").join(only(cand, "cand"), [page, index], "full_outer")
    return got.withColumn("side", F.when(F.col("ref_in") & F.col("cand_in"), "both").when(F.col("ref_in"), "ref").otherwise("cand")).drop("ref_in", "cand_in")


def positional_pairs(ref: DataFrame, cand: DataFrame, group: str, *order: str) -> DataFrame:
    """The k-th row of a group beside the k-th of the other's, up to the shorter."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    side = lambda df, p: df.withColumn("pos", rank).select(group, "pos", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != group])
    return side(ref, "ref").join(side(cand, "cand"), [group, "pos"])


def length_differences(ref: DataFrame, cand: DataFrame, group: str) -> DataFrame:
    """Groups with different numbers of rows."""
    n = lambda df, p: df.groupBy(group).agg(F.count(F.lit(1)).alias(p))
    got = n(ref, "n_ref").join(n(cand, "n_cand"), group, "full_outer").fillna(0, ["n_ref", "n_cand"])
    return got.where("n_ref <> n_cand").withColumn("boundary", F.lit("request_count"))


def divergence_counts(found: DataFrame, boundaries: list[str], column: str = "boundary") -> DataFrame:
    """How often each boundary is the first to differ, zero for those that never are."""
    order = found.sparkSession.createDataFrame(list(enumerate(boundaries)), f"ord int, {column} string")
    counts = found.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return order.join(counts, column, "left").select(column, "ord", F.coalesce("n", F.lit(0)).alias("n"))


def prediction_pairs(ref: DataFrame, cand: DataFrame, excluded: str | None = None, key: str = "stem", text: str = "text") -> DataFrame:
    """(stem, relation, ref_sha, cand_sha): equal, different, only_ref or only_cand by the digest
    of the text as it is compared."""
    side = lambda df, n: df.where(F.col(key).cast("string") != excluded if excluded is not None else F.lit(True)).select(key, F.sha2(for_comparison(F.coalesce(F.col(text), F.lit(""))), 256).alias(n))
    got = side(ref, "ref_sha").join(side(cand, "cand_sha"), key, "full_outer")
    rel = F.when(F.col("cand_sha").isNull(), "only_ref").when(F.col("ref_sha").isNull(), "only_cand").when(F.col("ref_sha") == F.col("cand_sha"), "equal").otherwise("different")
    return got.withColumn("relation", rel)


def classified_pages(ref: DataFrame, cand: DataFrame, key: str = "stem", text: str = "text") -> DataFrame:
    """(stem, relation): exact, normalized or scored, the cheap tests first."""
    got = ref.select(key, F.col(text).alias("a")).join(cand.select(key, F.col(text).alias("b")), key)
    rel = F.when(F.sha2("a", 256) == F.sha2("b", 256), "exact").when(for_comparison(F.col("a")) == for_comparison(F.col("b")), "normalized").otherwise("scored")
    return got.withColumn("relation", rel)


def subset_by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def uncovered_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that no row has (missing) or that several have (duplicate)."""
    n = keys.select(key).distinct().join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna(0, ["n"])
    return n.where("n <> 1").withColumn("problem", F.when(F.col("n") == 0, "missing").otherwise("duplicate"))


def manifest_differences(expected: DataFrame, current: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, problem): missing, extra or changed; equal digests leave no row."""
    e, c = (df.select(path, F.col(digest).alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((expected, "want"), (current, "have")))
    got = e.join(c, path, "full_outer")
    problem = F.when(F.col("in_have").isNull(), "missing").when(F.col("in_want").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "changed")
    return got.withColumn("problem", problem).where("problem IS NOT NULL").select(path, "want", "have", "problem")


def page_records(manifest: DataFrame, runs: DataFrame, baseline: DataFrame, key: str = "image") -> DataFrame:
    """The manifest's rows in order beside the run's and the baseline's of the same image."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
    return manifest.join(side(runs, "run"), key).join(side(baseline, "base"), key, "left")


def unexpected_predictions(failures: DataFrame, predictions: DataFrame, failure_key: str, key: str) -> DataFrame:
    """Approved failures for which a prediction exists all the same."""
    return failures.join(predictions.select(F.col(key).alias(failure_key)), failure_key, "left_semi")


def edit_scores(pairs: DataFrame, gt: str = "gt", pred: str = "pred", page: str = "page") -> DataFrame:
    """Normalised edit distance three ways: mean over pages of their summed distance over summed
    length, the whole sum over the whole length, and the mean over samples. A missing prediction
    is an empty one."""
    p = F.coalesce(F.col(pred), F.lit(""))
    # equal pairs of a page are compared once
    rows = pairs.groupBy(page, F.col(gt).alias("g"), p.alias("p")).agg(F.count(F.lit(1)).alias("k"))
    g, p = F.col("g"), F.col("p")
    d = edit_distance(g, p)
    rows = rows.select(page, "k", d.alias("d"), F.greatest(F.length(g), F.length(p), F.lit(1)).alias("n"))
    k = F.col("k")
    pages = rows.groupBy(page).agg(F.sum(k * F.col("d")).alias("d"), F.sum(k * F.col("n")).alias("n"), F.sum(k * F.col("d") / F.col("n")).alias("s"), F.sum("k").alias("k"))
    return pages.agg(F.avg(F.col("d") / F.col("n")).alias("page_avg"), (F.sum("d") / F.sum("n")).alias("whole"), (F.sum("s") / F.sum("k")).alias("sample_avg"))


def slice_means(rows: DataFrame, value: str, attributes: list[str]) -> DataFrame:
    """(slice, n, mean): `attribute: value` of each attribute, and ALL, in one pass over the rows."""
    names = F.array(F.lit("ALL"), *[F.concat(F.lit(f"{a}: "), F.col(a).cast("string")) for a in attributes])
    return rows.select(F.explode(names).alias("slice"), F.col(value).alias("v")).where("slice IS NOT NULL").groupBy("slice").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def projection(accepted: DataFrame, pages: DataFrame) -> DataFrame:
    """accepted: component, accepted, denominator, sign; pages: component, reference, candidate.
    Accepted score plus the summed change over the whole denominator, in percent points."""
    change = pages.groupBy("component").agg(F.sum(F.col("candidate") - F.col("reference")).alias("change"))
    got = accepted.join(change, "component", "left")
    return got.select("component", (F.col("accepted") + F.col("sign") * F.coalesce("change", F.lit(0.0)) / F.col("denominator") * 100).alias("projected"))


def projected_overall(projected: DataFrame) -> DataFrame:
    return projected.agg(F.round(F.avg("projected"), 2).alias("overall"))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; equal texts, empty ones too, have 1."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def replayed_scores(rows: DataFrame, score=similarity, gt: str = "gt", before: str = "output_before", after: str = "output_after") -> DataFrame:
    """Adds before and after, what `score`, a function of columns, gives for the outputs at each
    boundary as they were and as a change makes them; `boundary_attribution` goes on from there.
    An output that wasn't recorded has no score."""
    return rows.withColumn("before", score(F.col(gt), F.col(before))).withColumn("after", score(F.col(gt), F.col(after)))


def boundary_attribution(rows: DataFrame, case: str = "case_id", order: str = "ord", name: str = "boundary") -> DataFrame:
    """(case_id, boundary): the first boundary with a gain (after - before > 0) such that it and
    all before it were observed; unproven where there is none."""
    seen = F.col("before").isNotNull() & F.col("after").isNotNull()
    w = Window.partitionBy(case).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("__seen", F.min(seen).over(w)).withColumn("__gain", F.col("after") - F.col("before"))
    first = F.min_by(name, F.when(F.col("__seen") & (F.col("__gain") > 0), F.col(order)))
    return known.groupBy(case).agg(F.coalesce(first, F.lit("unproven")).alias(name))


def inconsistent_pages(rows: DataFrame, page: str, value: str) -> DataFrame:
    """Pages whose rows don't all carry the same value (null is a value)."""
    same = F.coalesce(F.min(value) == F.max(value), F.lit(True)) & ((F.count(value) == 0) | (F.count(value) == F.count(F.lit(1))))
    return rows.groupBy(page).agg(same.alias("same"), F.count_distinct(value).alias("n_values")).where("NOT same").drop("same")


def bounded_details(details: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows, each with the exact total and whether rows are left out."""
    total = details.agg(F.count(F.lit(1)).alias("total"))
    return details.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("details_truncated", F.col("total") > n)  # one row


def evidence_rows(**kinds: DataFrame) -> DataFrame:
    """Findings of several kinds in one table; columns that a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()])


def observed_relation(a: Column, b: Column) -> Column:
    return relation(a, b)
