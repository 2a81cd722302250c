"""Page runs: statuses, counts, latencies, intervals, samples, repairs, votes."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_class(status: Column) -> Column:
    """ok, fail or fallback; any other status is an error."""
    return (
        F.when(status == "ok", "ok")
        .when(status.startswith("fail"), "fail")
        .when(status.startswith("fallback"), "fallback")
        .otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))))
    )


def run_counts(runs: DataFrame, *by: str) -> DataFrame:
    """count, ok, fail and fallback apart, ok with fallback, and the run's status."""
    kind = F.col("kind")
    got = runs.withColumn("kind", status_class(F.col("status"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), *[F.count_if(kind == k).alias(k) for k in ("ok", "fail", "fallback")], F.count_if(kind != "fail").alias("ok_including_fallback")
    )
    state = F.when(F.col("fail") == 0, "ok").when(F.col("ok_including_fallback") > 0, "partial").otherwise("failed")
    return got.withColumn("run_status", state)


#: Equal parts into which the range of a sought value is cut, and how often before values are ranked.
PARTS, ZOOMS = 4096, 2


def latency_summary(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, nearest-rank p50, p95 and p99, and max.

    Equal values are counted first. For each rank the range of a group's values is cut into
    PARTS of equal width, whose totals say in which one the rank stands; that part's own range
    is cut again, and only the values of the last part are ranked. So no window sees more than
    PARTS rows of a group but where a single part of a part still holds more different values;
    nothing is sampled or stored, and the result is exact.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = runs.where(F.col(value).isNotNull())
    keys = [f"__by{i}" for i in range(len(by))]
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("v"), F.col("__n").alias("n"))
    whole = counted.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(k).alias("share"), F.ceil(F.col("all") * F.lit(p)).alias("rank")) for k, p in shares.items()])
    sought = whole.select(*keys, F.explode(wanted).alias("w"), F.lit(0).cast("long").alias("before"), "lo", "hi").select(*keys, "w.*", "before", "lo", "hi")

    def within(sought: DataFrame) -> DataFrame:
        """Counted values in the range in which each rank is sought."""
        named = sought.withColumnsRenamed({k: f"{k}s" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]
        met = counted.join(named, reduce(lambda x, y: x & y, same)) if keys else counted.crossJoin(F.broadcast(named))  # three rows
        return met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop(*[f"{k}s" for k in keys])

    for _ in range(ZOOMS):
        lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
        place = F.floor((F.col("v").cast("double") - lo) / F.nullif(hi - lo, F.lit(0.0)) * PARTS)
        # no number where the range has no width or no end: the values at its end are last
        part = F.when(F.col("v") == F.col("lo"), 0).when(F.isnan(F.col("v").cast("double")) | (F.col("v").cast("double") == float("inf")), PARTS).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(PARTS - 1)))
        totals = within(sought).withColumn("part", part).groupBy(*keys, "share", "rank", "before", "part").agg(F.sum("n").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("m").over(Window.partitionBy(*keys, "share").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        totals = totals.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        sought = totals.select(*keys, "share", "rank", (F.col("upto") - F.col("m")).alias("before"), "lo", "hi")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = within(sought).withColumn("upto", upto).where(F.col("upto") >= F.col("rank"))
    found = reached.groupBy(*keys).agg(*[F.min(F.when(F.col("share") == k, F.col("v"))).alias(k) for k in shares])
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    if not by:
        return sums.crossJoin(found).select("count", "mean", *shares, "max")  # one row each
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)])
    return sums.join(found, same).select(*by, "count", "mean", *shares, "max")


def covered_time(intervals: DataFrame, key: str = "page_id", start: str = "start_s", finish: str = "finish_s") -> DataFrame:
    """(key, covered): length of the union of a key's intervals; touching ones merge."""
    w = Window.partitionBy(key).orderBy(start, finish)
    rows = intervals.withColumn("__before", F.max(finish).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__before").isNull() | (F.col(start) > F.col("__before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = rows.groupBy(key, "__island").agg((F.max(finish) - F.min(start)).alias("n"))
    return lengths.groupBy(key).agg(F.sum("n").alias("covered"))


def pages_per_minute(n: Column, wall_seconds: Column) -> Column:
    return F.coalesce(F.try_divide(n * 60.0, wall_seconds), F.lit(0.0))


def failure_sample(runs: DataFrame, fields: tuple[str, ...], n: int = 20, width: int = 200) -> DataFrame:
    """The first n rows that failed or fell back, texts cut to `width` characters."""
    cut = [F.substring(F.col(c), 1, width).alias(c) if t == "string" else F.col(c) for c, t in runs.select(*fields).dtypes]
    return runs.where(status_class(F.col("status")) != "ok").orderBy(*fields).limit(n).select(*cut)


def stratified_sample(manifest: DataFrame, k: int, category: str = "category", name: str = "image") -> DataFrame:
    """The first k rows of each category by SHA-256 of the name."""
    digest = F.sha2(name, 256)
    rank = F.row_number().over(Window.partitionBy(category).orderBy(digest, name))
    return manifest.withColumn("rank", rank).where(F.col("rank") <= k)


def provider_shares(events: DataFrame, provider: str, known: tuple[str, str], keep: Column | None = None) -> DataFrame:
    """Events by provider, shares of the two known ones among themselves, missing and others."""
    rows = events.where(keep) if keep is not None else events
    p = F.col(provider)
    got = rows.agg(F.count(F.lit(1)).alias("events"), *[F.count_if(p == k).alias(f"n_{i}") for i, k in enumerate(known)], F.count_if(p.isNull()).alias("missing"), F.count_if(p.isNotNull() & ~p.isin(*known)).alias("other"))
    return got.withColumns({f"share_{i}": F.coalesce(F.try_divide(F.col(f"n_{i}"), F.col("n_0") + F.col("n_1")), F.lit(0.0)) for i in (0, 1)})


def repaired(base: DataFrame, repair: DataFrame, signature: str, key: str = "image") -> DataFrame:
    """Rows whose status holds the signature become the repair run's ok row of the same key."""
    fixes = repair.where("status = 'ok'").select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in base.columns if c != key], F.lit(True).alias("__fix"))
    rows = base.join(fixes, key, "left").withColumn("repaired", F.coalesce(F.col("__fix") & F.col("status").contains(signature), F.lit(False)))
    return rows.select(key, *[F.when(F.col("repaired"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c != key], "repaired")


def unapplied_repairs(base: DataFrame, repair: DataFrame, signature: str, key: str = "image") -> DataFrame:
    """Keys of the repair that replace nothing, and of rows with the signature that nothing repairs."""
    broken, fixes = base.where(F.col("status").contains(signature)).select(key), repair.where("status = 'ok'").select(key)
    return fixes.join(broken, key, "left_anti").withColumn("side", F.lit("repair")).union(broken.join(fixes, key, "left_anti").withColumn("side", F.lit("base")))


def majority(answers: DataFrame, key: str, answer: str, repeat: str) -> DataFrame:
    """(key, answer, votes): the most frequent answer, of equals the one given first."""
    votes = answers.groupBy(key, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(repeat).alias("first"))
    return votes.groupBy(key).agg(F.max_by(F.struct(answer, "votes"), F.struct("votes", -F.col("first"))).alias("best")).select(key, "best.*")


#: Lines of a group that are hashed as one row.
PIECE = 1 << 20


def listed_digest(rows: DataFrame, name: str, digest: str, *by: str, separator: str = "\t") -> DataFrame:
    """SHA-256 of the lines `name<separator>digest` in order of name, joined by line feeds, of all
    rows or of each group: the digest of the sorted listing, whatever the size of a group.

    Rows are range-partitioned and sorted by group and name, and those that stand together are
    joined into pieces of about PIECE bytes; a hash goes through a group's pieces in order, in
    the memory of a batch of them. So all but the hash itself, which is one sequence by
    definition, is spread over tasks. Rows without a name or digest have no line; a group of
    such rows, and no rows at all where there are no groups, have the digest of an empty text.
    """
    kinds = "".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    n = len(by)
    lines = rows.select(*by, F.col(name).cast("string").alias("__n"), F.concat(F.col(name).cast("string"), F.lit(separator), F.col(digest).cast("string")).alias("__l"))
    if not by:  # a row without a line, so that there is one to hash
        lines = lines.union(rows.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(None).cast("string")))
    lines = lines.repartitionByRange(*by, "__n").sortWithinPartitions(*by, "__n", "__l")

    def pieces(batches):
        part, place, group, held, size, any_ = TaskContext.get().partitionId(), 0, None, [], 0, False

        def piece():
            arrays = [pa.array([v], t) for v, t in zip(group or (), types)]
            body = "\n".join(held).encode("utf-8", "surrogatepass") if held else None
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([body], pa.binary())], names=[*by, "part", "place", "body"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n)]
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(n)))) if n else [()] * batch.num_rows
            for own, line in zip(groups, batch.column(n + 1).to_pylist()):
                if any_ and (own != group or size >= PIECE):
                    yield piece()
                    place, held, size = place + 1, [], 0
                group, any_ = own, True
                if line is not None:
                    held.append(line)
                    size += len(line)
        if any_:
            yield piece()

    def hashed(batches):
        group, state, begun = None, None, False
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n)]
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(n)))) if n else [()] * batch.num_rows
            for own, body in zip(groups, batch.column(n + 2).to_pylist()):
                if state is None or own != group:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(group, types)], pa.array([state.hexdigest()])], names=[*by, "digest"])
                    group, state, begun = own, hashlib.sha256(), False
                if body is not None:
                    state.update((b"\n" if begun else b"") + body)
                    begun = True
        if state is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(group, types)], pa.array([state.hexdigest()])], names=[*by, "digest"])

    joined = lines.mapInArrow(pieces, f"{kinds}part int, place long, body binary")
    joined = joined.repartition(*by) if by else joined.repartition(1)
    return joined.sortWithinPartitions(*by, "part", "place").mapInArrow(hashed, f"{kinds}digest string")


def scored_tally(scores: DataFrame, score: str, *by: str) -> DataFrame:
    """Mean of the scores above zero, counts of zeros and of missing ones."""
    s = F.col(score)
    return scores.groupBy(*by).agg(F.avg(F.when(s > 0, s)).alias("nonzero_mean"), F.count_if(s == 0).alias("zeros"), F.count_if(s.isNull()).alias("missing"))
