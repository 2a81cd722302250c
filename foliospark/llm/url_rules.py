"""URL filters (2): given host rules, then association rules mined by FP-growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored, table

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Mined rules: share of labelled pages that a token combination and the label must have together
#: and their least number, share of bad pages among those with the combination, and its ratio to
#: the share among all.
SUPPORT, LEAST, CONFIDENCE, LIFT = 0.001, 5, 0.6, 1.5
#: Fixed value: a host name has no more labels.
LABELS = 127
_BAD = "#bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def host_tokens(url: Column) -> Column:
    """Each suffix of the host, the longest first; each implies those behind it."""
    labels = F.split(host_of(url), r"\.")
    labels = F.slice(labels, F.greatest(F.size(labels) - LABELS, F.lit(0)) + 1, F.lit(LABELS))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.filter(suffixes, lambda x: x != "host:")


def other_tokens(url: Column) -> Column:
    """Distinct: the scheme, segments of the path, parts of the query."""
    url = F.coalesce(url, F.lit(""))
    part = lambda kind, c, by: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    return F.array_distinct(F.concat(scheme, part("path:", path_of(url), "/"), part("query:", F.regexp_extract(url, _SPLIT, 3), "[?&#]")))


def tokens_of(url: Column) -> Column:
    return F.concat(host_tokens(url), other_tokens(url))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, or null. A rule fits its host and
    all subdomains where the path begins with the rule's; of equally long ones the last by name."""
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        good = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fits.append(F.when(good, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def _together(rows: DataFrame, need: int, n: int) -> DataFrame:
    """(items, freq, n_bad) of the combinations that `need` of n baskets have with the label."""
    from pyspark.ml.fpm import FPGrowth

    basket = F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items"))
    found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n, minConfidence=0.0).fit(rows.select(basket.alias("items"))).freqItemsets
    found = stored(found.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_label = found.where(F.array_contains("items", _BAD)).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("n_bad"))
    return found.join(with_label.where(F.size("items") > 0), "items")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> DataFrame:
    """(key, items, confidence, freq): token combinations that point to bad pages.

    A page's label is that of the document of its number; quality 0 or toxic 1 is bad. Spark's
    FP-growth gives the frequent combinations, of any length, with and without the label; those
    with enough confidence and lift stay, without the ones that a part of them implies as well.
    Each rule is posted under its rarest token. Pages without a label teach nothing; repeated
    rows count each; no labels, no rules.

    Tokens that imply each other don't multiply combinations: tokens of path, query and scheme
    that the same labelled pages have go through the mining as one, those of all pages and of
    too few not at all, and a basket has one suffix of the host. A rule names all of them.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    rows = pages.select(F.col("page_id").alias("doc_id"), host_tokens(F.col("url")).alias("hosts"), other_tokens(F.col("url")).alias("others")).join(known, "doc_id")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "hosts", "others", "bad"), "baskets")
    total, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not total or not n_bad:
        return rows.sparkSession.createDataFrame([], "key string, items array<string>, confidence double, freq long")
    need = max(least, -int(-support * total // 1))
    counted = lambda c: rows.select("row", F.explode(c).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("h2")
    ).where(F.col("n") >= need)
    # stored, so that Spark knows their size: total tokens by `need` at most
    hosts, others = stored(counted("hosts").select("token", "n"), "hosts"), stored(counted("others"), "tokens")
    alike = others.where(F.col("n") < total).groupBy("n", "h1", "h2").agg(F.min("token").alias("one"), F.array_sort(F.collect_set("token")).alias("all"))
    alike = stored(alike.select("one", "all"), "alike")
    plain = rows.select("row", F.explode("others").alias("one")).join(alike.select("one"), "one").groupBy("row").agg(F.collect_set("one").alias("items"))
    plain = stored(rows.select("row", "hosts", "bad").join(plain, "row", "left").select("row", "hosts", "bad", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "baskets")
    levels = plain.select("row", "bad", "items", F.explode("hosts").alias("token")).join(hosts.select("token"), "token")
    levels = stored(levels.select("bad", F.concat("items", F.array("token")).alias("items")), "levels")
    n_levels = levels.count()
    found = _together(plain, need, total)
    if n_levels:
        found = found.union(_together(levels, need, n_levels).where(F.exists("items", lambda x: x.startswith("host:"))))
    rules = found.withColumn("confidence", F.col("n_bad") / F.col("freq"))
    rules = rules.where((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * n_bad / total))
    rules = stored(rules.select(F.monotonically_increasing_id().alias("rule"), "items", "confidence", "freq"), "rules")
    # a rule adds nothing if it goes with as much confidence without one token, or with the next
    # shorter suffix of its host
    less = F.transform("items", lambda x: F.array_remove("items", x))
    shorter = F.transform(F.filter("items", lambda x: x.rlike(r"^host:[^.]*\.")), lambda x: F.array_sort(F.concat(F.array_remove("items", x), F.array(F.regexp_replace(x, r"^host:[^.]*\.", "host:")))))
    parts = rules.select("rule", "confidence", F.explode(F.concat(less, shorter)).alias("items"))
    implied = parts.join(rules.select("items", F.col("confidence").alias("c")), "items").where("c >= confidence").select("rule").distinct()
    rules = rules.join(implied, "rule", "left_anti")
    # each token with all that it stands for or implies
    labels = F.split(F.substring("token", 6, 1 << 30), r"\.")
    tail = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, LABELS), ".")))
    wide = rules.select("rule", F.explode("items").alias("token")).join(alike, F.col("token") == F.col("one"), "left")
    wide = wide.select("rule", F.explode(F.when(F.col("token").startswith("host:"), tail).otherwise(F.col("all"))).alias("token"))
    posted = wide.join(hosts.union(others.select("token", "n")), "token").groupBy("rule").agg(F.array_sort(F.collect_set("token")).alias("items"), F.min_by("token", F.struct("n", "token")).alias("key"))
    return posted.join(rules.select("rule", "confidence", "freq"), "rule").select("key", "items", "confidence", "freq")


def judge(pages: DataFrame, mined: DataFrame, rules=RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """Host, path, rule, verdict and mined_rule of each url, with the columns `keep`.

    Where no given rule fits, a url that has all tokens of a mined rule is blocked, others are
    allowed; a null url, or one without ://, has empty host and path. Urls of any length are
    judged whole, repeated rows alike; of several mined rules the surest is named, of equally
    sure ones the last by name. Each distinct url is judged once: its tokens are looked up in the inverted index of mined rules, and a rule
    found by its rarest token must have all its tokens in the url.
    """
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).alias("__url"))
    urls = rows.select("__url").where("__url IS NOT NULL").distinct().withColumn("__tokens", tokens_of(F.col("__url")))
    posted = urls.withColumn("key", F.explode("__tokens")).join(mined.select("key", "items", "confidence"), "key")
    hit = (
        posted.where(F.size(F.array_except("items", "__tokens")) == 0)
        .groupBy("__url")
        .agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("name"))).alias("m"))
        .select("__url", F.col("m.name").alias("mined_rule"))
    )
    best = longest_rule(F.col("host"), F.col("path"), rules)
    got = rows.join(hit, "__url", "left").withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url"))).withColumn("__best", best)
    verdict = F.coalesce("__best.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return got.select(*keep, "host", "path", F.col("__best.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls by the given rules and those mined from all labels."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, stored(mine(pages, table(spark, sf_dir, "labels")), "rules"))


QUERIES = {"op2_url_rules": op2_url_rules}
ORACLES: dict[str, str] = {}
