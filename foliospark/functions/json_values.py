"""Column functions on JSON: fingerprints, look-ups, checks, observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """Compact JSON with sorted keys; null where the text isn't strict JSON."""
    return F.to_json(F.try_parse_json(c))


def fingerprint(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def number_at(c: Column, path: str) -> Column:
    """The number at a path, or null where there is none."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def text_at(c: Column, *paths: str) -> Column:
    """The first text over several paths; null where all are missing or aren't strings."""
    v = F.try_parse_json(c)
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string")) for p in paths]
    return F.coalesce(*found)


def response_content(c: Column) -> Column:
    """Text of a chat response's first choice; empty where a level is missing or isn't a string."""
    return F.coalesce(text_at(c, "$.choices[0].message.content"), F.lit(""))


def is_score(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(low, high), F.lit(False))


def lower_is_better(metric: Column) -> Column:
    """Edit distances fall as quality rises; other scores rise with it."""
    return metric.contains("edit") | metric.contains("Edit")


def observation(*digests: Column) -> Column:
    """struct<status, fingerprint> of the first digest that is there; it must be a SHA-256 in hex."""
    value = F.coalesce(*digests)
    good = F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))
    return F.struct(F.when(good, "observable").otherwise("unobservable").alias("status"), F.when(good, value).alias("fingerprint"))


def relation(a: Column, b: Column) -> Column:
    """equal, different, or unobservable if either observation is (or is missing)."""
    seen = F.coalesce((a["status"] == "observable") & (b["status"] == "observable"), F.lit(False))
    return F.when(~seen, "unobservable").when(a["fingerprint"] == b["fingerprint"], "equal").otherwise("different")


def first_divergence(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Name of the first boundary whose two values differ; missing on both sides is equal."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs])
