"""Quality gates: rows (check, passed, observed, limit) and a verdict row last.

Thresholds and tables are parameters; a gate fails closed: a missing value is not a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.json_values import lower_is_better
from foliospark.operators.runs import latency_summary, run_counts, status_class


def check_rows(one: DataFrame, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """A row a check from a one-row table: name, passed, observed and limit as text."""
    rows = [F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), o.cast("string").alias("observed"), m.cast("string").alias("limit")) for n, p, o, m in checks]
    return one.select(F.inline(F.array(*rows)))


def with_verdict(checks: DataFrame) -> DataFrame:
    total = checks.agg(F.lit("verdict").alias("check"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count_if(~F.col("passed")).cast("string").alias("observed"), F.lit("0").alias("limit"))
    return checks.unionByName(total)


def schema_gate(df: DataFrame, columns: dict[str, str], digests: tuple[str, ...] = ()) -> DataFrame:
    """Exactly these columns with these types; digest columns are 64 hex digits throughout."""
    have = dict(df.dtypes)
    fixed = [(f"column {c}", have.get(c) == t, str(have.get(c)), t) for c, t in columns.items()] + [("no other columns", set(have) <= set(columns), ",".join(sorted(set(have) - set(columns))), "")]
    rows = df.sparkSession.createDataFrame(fixed, "check string, passed boolean, observed string, limit string")
    good = [c for c in digests if c in have]
    if good:
        bad = df.agg(*[F.count_if(~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))).alias(c) for c in good])
        rows = rows.unionByName(check_rows(bad, [(f"digest {c}", F.col(c) == 0, F.col(c), F.lit(0)) for c in good]))
    return with_verdict(rows)


def manifest_gate(manifest: DataFrame, rows: int, per_category: int, categories: list[str]) -> DataFrame:
    n = manifest.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    one = n.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") != per_category).alias("uneven"), F.count_if(~F.col("category").isin(*categories)).alias("unknown"))
    one = one.crossJoin(manifest.groupBy("image").count().agg(F.count_if(F.col("count") > 1).alias("repeated")))
    return with_verdict(
        check_rows(
            one,
            [
                ("rows", F.col("rows") == rows, F.col("rows"), F.lit(rows)),
                ("unique images", F.col("repeated") == 0, F.col("repeated"), F.lit(0)),
                ("rows per category", F.col("uneven") == 0, F.col("uneven"), F.lit(0)),
                ("known categories", F.col("unknown") == 0, F.col("unknown"), F.lit(0)),
            ],
        )
    )


def run_contract_gate(runs: DataFrame, count: int, approved: DataFrame, signature: str) -> DataFrame:
    """runs: image, status. Row count, unique images, no fallback, and only approved failures."""
    kind = status_class(F.col("status"))
    one = runs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(kind == "fallback").alias("fallbacks"))
    one = one.crossJoin(runs.groupBy("image").count().agg(F.count_if(F.col("count") > 1).alias("repeated")))
    failed = runs.where(kind == "fail")
    wrong = failed.join(approved.select("image"), "image", "left_anti").agg(F.count(F.lit(1)).alias("unapproved"))
    other = failed.agg(F.count_if(~F.col("status").contains(signature)).alias("other_errors"))
    one = one.crossJoin(wrong).crossJoin(other)
    names = [("repeated", "unique images"), ("fallbacks", "no fallback"), ("unapproved", "approved failures only"), ("other_errors", "known error only")]
    return with_verdict(check_rows(one, [("rows", F.col("rows") == count, F.col("rows"), F.lit(count))] + [(t, F.col(c) == 0, F.col(c), F.lit(0)) for c, t in names]))


def latency_gate(runs: DataFrame, seconds: str, mean: float, p95: float) -> DataFrame:
    one = run_counts(runs).crossJoin(latency_summary(runs.where(status_class(F.col("status")) == "ok"), seconds).select("mean", "p95"))
    return with_verdict(
        check_rows(one, [("failures", F.col("fail") == 0, F.col("fail"), F.lit(0)), ("mean", F.col("mean") <= mean, F.round("mean", 6), F.lit(mean)), ("p95", F.col("p95") <= p95, F.col("p95"), F.lit(p95))])
    )


def regressions(metrics: DataFrame) -> DataFrame:
    """metrics: image, metric, reference, candidate. Rows that are worse in the candidate."""
    worse = F.when(lower_is_better(F.col("metric")), F.col("candidate") > F.col("reference")).otherwise(F.col("candidate") < F.col("reference"))
    return metrics.where(worse)


def quality_gate(pages: DataFrame, metrics: DataFrame, projected: DataFrame, accepted: float) -> DataFrame:
    """pages: stem, relation; metrics only of scored pages; projected: overall."""
    one = pages.agg(*[F.count_if(F.col("relation") == k).alias(k) for k in ("exact", "normalized", "scored")], F.count(F.lit(1)).alias("n"))
    stray = metrics.join(pages.where("relation <> 'scored'").select(F.col("stem").alias("image")), "image", "left_semi").agg(F.count(F.lit(1)).alias("stray"))
    one = one.crossJoin(stray).crossJoin(projected)
    total = F.col("exact") + F.col("normalized") + F.col("scored")
    return with_verdict(
        check_rows(
            one,
            [
                ("every page is classed", total == F.col("n"), total, F.col("n")),
                ("only scored pages have metrics", F.col("stray") == 0, F.col("stray"), F.lit(0)),
                ("projection", F.col("overall") >= accepted, F.col("overall"), F.lit(accepted)),
            ],
        )
    )


def combined(**gates: DataFrame) -> DataFrame:
    """A row a gate from its verdict, and the verdict over all."""
    rows = [g.where(F.col("check") == "verdict").withColumn("check", F.lit(k)) for k, g in gates.items()]
    return with_verdict(reduce(DataFrame.unionByName, rows))


def stored_decision_agrees(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Checks whose stored result differs from the recomputed one, or stands on one side only."""
    side = lambda df, n: df.select("check", F.col("passed").alias(n))
    got = side(stored, "stored").join(side(recomputed, "recomputed"), "check", "full_outer")
    return got.where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def metric_validity(metrics: DataFrame) -> DataFrame:
    """metrics: samples, timeouts, errors, value. value becomes null where it isn't valid."""
    good = F.coalesce((F.col("samples") > 0) & (F.col("timeouts") == 0) & (F.col("errors") == 0), F.lit(False))
    return metrics.withColumn("valid", good).withColumn("value", F.when(good, F.col("value")))


def overall_score(text_edit: Column, formula: Column, tables: Column) -> Column:
    """Mean of three components in percent; null if one is missing. Edit distance counts against."""
    return (F.round((1 - text_edit) * 100, 3) + F.round(formula * 100, 3) + F.round(tables * 100, 3)) / 3


def component_gate(pairs: DataFrame, minimum: float) -> DataFrame:
    """pairs: component, reference, candidate, lower_is_better. No component worse, enough overall."""
    worse = F.when(F.col("lower_is_better"), F.col("candidate") > F.col("reference")).otherwise(F.col("candidate") < F.col("reference"))
    percent = F.when(F.col("lower_is_better"), 1 - F.col("candidate")).otherwise(F.col("candidate")) * 100
    one = pairs.agg(F.count_if(worse).alias("worse"), F.count_if(F.col("reference").isNull() | F.col("candidate").isNull()).alias("missing"), F.round(F.avg(percent), 6).alias("overall"))
    return with_verdict(
        check_rows(one, [("no component worse", F.col("worse") == 0, F.col("worse"), F.lit(0)), ("all components there", F.col("missing") == 0, F.col("missing"), F.lit(0)), ("overall", F.col("overall") >= minimum, F.col("overall"), F.lit(minimum))])
    )


def strict_verdict(rows: DataFrame, relation: str = "relation") -> DataFrame:
    """FAIL if a row differs, else UNKNOWN if one can't be observed (or there is none), else PASS."""
    r = F.col(relation)
    level = F.coalesce(F.max(F.when(r == "equal", 0).when(r == "unobservable", 1).otherwise(2)), F.lit(1))
    counts = [F.count_if(r == k).alias(k) for k in ("equal", "different", "unobservable")]
    return rows.agg(*counts, F.count(F.lit(1)).alias("total"), F.element_at(F.array(F.lit("PASS"), F.lit("UNKNOWN"), F.lit("FAIL")), level + 1).alias("verdict"))


def report_agreement(a: DataFrame, b: DataFrame, digits: int = 2) -> DataFrame:
    """a, b: metric, value. Shared metrics that aren't equal after rounding."""
    got = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    return got.where(~F.round("a", digits).eqNullSafe(F.round("b", digits)))


def log_gate(log: DataFrame, expected: DataFrame) -> DataFrame:
    """log, expected: pos, command, exit_code. Rows of the ordered log that aren't as expected."""
    side = lambda df, p: df.select("pos", F.col("command").alias(f"{p}_command"), F.col("exit_code").alias(f"{p}_exit"), F.lit(True).alias(f"{p}_in"))
    got = side(log, "have").join(side(expected, "want"), "pos", "full_outer")
    same = F.col("have_in").eqNullSafe(F.col("want_in")) & F.col("have_command").eqNullSafe(F.col("want_command")) & F.col("have_exit").eqNullSafe(F.col("want_exit"))
    return got.where(~same).drop("have_in", "want_in")


def result_table(results: DataFrame, primary: str, name: str = "name", overall: str = "overall") -> DataFrame:
    """Rows in order of their score, the primary one marked, scores rounded for display."""
    return results.select(name, F.round(overall, 2).alias(overall), (F.col(name) == primary).alias("is_primary")).orderBy(F.col("is_primary").desc(), F.col(overall).desc(), name)
