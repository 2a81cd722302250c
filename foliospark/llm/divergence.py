"""Source divergence audit (13): chunk factorisation of term counts, sources of a language compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import release, stored, table

#: Terms are kept that so many documents of a language have, and so many are listed a group.
SUPPORT, RANKS = 10, 10
#: What is no letter: terms are runs of ASCII letters and of all beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Text that a task counts at once, unless one text is longer.
UNIT = 32_000_000
#: Terms and sources of a block of the comparison, about.
TERMS, SOURCES = 2048, 256
_BLANKS = bytes(0x20 if c < 0x20 else c for c in range(256))


COLUMNS = "key string, lang string, source array<long>, n array<long>, docs array<long>"


def _lists(values: np.ndarray, size: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)), mask=None if null is None else pa.array(null))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def counted(text: pa.Array, lang: pa.Array, source: pa.Array, first: int, support: int) -> pa.RecordBatch | None:
    """(key, lang, source, n, docs) for each chunk and language of some texts: occurrences by source
    and the numbers from `first` of the documents that have it, null for `support` of them or
    more. Chunks are what ASCII blanks and control characters part."""
    text = text.cast(pa.string()).fill_null("")
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2]
    body = held[int(at[0]) : int(at[-1])].to_pybytes().translate(_BLANKS) if held is not None else b""
    plain = pa.StringArray.from_buffers(len(text), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(body))
    split = pc.split_pattern(plain, " ")
    flat = split.flatten().dictionary_encode()
    size = np.diff(split.offsets.to_numpy())
    coded = lang.dictionary_encode()
    langs, of_lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    sources, of_source = np.unique(source.to_numpy(), return_inverse=True)
    docs = len(text)
    chunks, code = flat.dictionary, flat.indices.to_numpy()
    full = code != pc.index(chunks, "").as_py()
    del body, plain, split, flat  # the words of a unit are its largest part
    doc = np.repeat(np.arange(docs, dtype=np.int32), size)[full]
    key = code[full].astype(np.int64)
    del code, full
    if not len(key):
        return None
    for of, n in ((of_lang, len(langs)), (of_source, len(sources)), (np.arange(docs), docs)):
        key *= n
        key += of[doc]
    del doc
    key.sort()
    head = _heads(key)  # a chunk in a document
    n, key = np.diff(np.concatenate([head, [len(key)]])), key[head]
    doc, key = key % docs, key // docs
    by_source = _heads(key)
    own, key = key[by_source] % len(sources), key // len(sources)
    row = _heads(key)  # a chunk in a language
    d, width = np.diff(np.concatenate([row, [len(key)]])), np.diff(np.concatenate([_heads(key[by_source]), [len(by_source)]]))
    many = d >= support
    key = key[row]
    cols = [
        chunks.take(pa.array(key // len(langs))),
        langs.take(pa.array(key % len(langs))),
        _lists(sources[own], width),
        _lists(np.add.reduceat(n, by_source), width),
        _lists(first + doc[np.repeat(~many, d)], np.where(many, 0, d), many),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["key", "lang", "source", "n", "docs"])


def _postings(support: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            unit = -(-int(size.sum()) // max(1, -(-int(size.sum()) // UNIT)))  # equal parts of at most UNIT
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + unit, "right")))
                got = counted(*batch.slice(lo, hi - lo).columns, first, support)
                if got is not None:
                    for k in range(0, got.num_rows, 20_000):
                        yield got.slice(k, 20_000)
                first += hi - lo
                lo = hi

    return run


def summed(t: pa.Table, support: int) -> pa.Table:
    """One row for each (key, lang) of sorted rows: counts added by source, documents united, null
    as soon as there are `support` of them."""
    t = t.combine_chunks()
    key, lang, source, n, docs = (t.column(c).chunk(0) for c in ("key", "lang", "source", "n", "docs"))
    same = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False).astype(bool)
    row = np.concatenate([[True], ~same])
    of, head = np.cumsum(row) - 1, np.flatnonzero(row)
    size = source.value_lengths().to_numpy()
    names, code = np.unique(source.flatten().to_numpy(), return_inverse=True)
    cell, back = np.unique(np.repeat(of, size) * len(names) + code, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, back, n.flatten().to_numpy())
    width = np.bincount(cell // max(1, len(names)), minlength=len(head))
    none = docs.is_null().to_numpy(zero_copy_only=False)
    held, has = docs.flatten().to_numpy(), docs.value_lengths().fill_null(0).to_numpy()
    ids, code = np.unique(held, return_inverse=True)
    pair = np.unique(np.repeat(of, has) * max(1, len(ids)) + code)
    at, ids = pair // max(1, len(ids)), ids[pair % max(1, len(ids))]
    many = (np.bincount(of[none], minlength=len(head)) > 0) | (np.bincount(at, minlength=len(head)) >= support)
    few = np.bincount(at, minlength=len(head)) * ~many
    where = pa.array(head)
    return pa.table([key.take(where), lang.take(where), _lists(names[cell % max(1, len(names))], width), _lists(total, width), _lists(ids[~many[at]], few, many)], names=["key", "lang", "source", "n", "docs"])


def _reduced(support: int, finish):
    """Rows sorted by key and language in batches, added up and finished; of a key that goes on in
    the next batch only the sums are held."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = summed(t if held is None else pa.concat_tables([held, t]), support)
            key = t.column("key").chunk(0)
            cut = pc.index(key, key[-1]).as_py()
            if cut:
                yield from finish(t.slice(0, cut)).combine_chunks().to_batches()
            held = t.slice(cut).combine_chunks()
        if held is not None:
            yield from finish(held).combine_chunks().to_batches()

    return run


def _as_terms(t: pa.Table) -> pa.Table:
    """The rows of chunks as rows of their terms, one as often as it stands in the chunk; each
    different chunk is split once."""
    coded = t.column("key").combine_chunks().dictionary_encode()
    split = pc.split_pattern_regex(pc.ascii_lower(coded.dictionary), BETWEEN)
    size = split.value_lengths().to_numpy()
    at = coded.indices.to_numpy()
    start, n = (np.cumsum(size) - size)[at], size[at]
    term = split.flatten().take(pa.array(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))))
    out = t.take(pa.array(np.repeat(np.arange(len(at)), n))).set_column(0, "key", term)
    return out.filter(pc.not_equal(term, ""))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exact for totals below 9 * 10^15, as the
    division goes on by three digits at a time. Needs count <= total and kinds >= 1."""
    below, rest, out = total + 2 * kinds, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, below)
        rest = (rest * 1000) % below
    return out + 1


def shares(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """`share` of arrays of longs."""
    below, rest, out = total + 2 * kinds, count + 2, 0
    for _ in range(3):
        out = out * 1000 + rest * 1000 // below
        rest = rest * 1000 % below
    return out + 1


def _compared(t: pa.Table) -> pa.Table:
    """(lang, a, b, value) of a block: sums over its terms for each pair of its two source chunks.
    A row is a source with the places and counts of those of the block's terms that it has."""
    t = t.sort_by("source").combine_chunks()
    names = t.column("source").to_pylist()
    chunk, total = (t.column(c).to_numpy() for c in ("chunk", "total"))
    x, y, width, kinds = (t.column(c)[0].as_py() for c in ("x", "y", "width", "kinds"))
    count = np.zeros((len(names), width), np.int64)
    for i, (at, n) in enumerate(zip(t.column("at").to_pylist(), t.column("n").to_pylist())):
        if at:
            count[i, at] = n
    p = shares(count, total[:, None], kinds) if kinds else count
    a, b, value = [], [], []
    for i in range(len(names) - 1):
        other = np.arange(i + 1, len(names))
        other = other if x == y else other[chunk[other] != chunk[i]]
        value.append(((p[other] - p[i]) ** 2 // np.maximum(p[other] + p[i], 1)).sum(1))
        a.append(np.full(len(other), i))
        b.append(other)
    named = lambda at: pa.array(names, pa.string()).take(pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)))
    value = pa.array(np.concatenate([*value, np.zeros(0, np.int64)]).astype(np.int64))
    return pa.table([pa.array([t.column("lang")[0].as_py()] * len(value), pa.string()), named(a), named(b), value], names=["lang", "a", "b", "value"])


def vocabulary(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, term, source, n), arrays of sources and counts, of the terms kept from (text, lang,
    source) with sources as numbers.

    Chunks between blanks are counted a document where the text is read, and added up there by
    language and source. Each different chunk of the corpus goes to one task, which splits it
    into terms once and gives its counts to them; terms are added up in their turn. The numbers
    of the documents go along for as long as there are fewer than `support`, so that a document
    with two chunks of one term counts once.
    """

    def by(df: DataFrame, finish) -> DataFrame:
        return df.repartition("key").sortWithinPartitions("key", "lang").mapInArrow(_reduced(support, finish), COLUMNS)

    chunks = docs.select("text", "lang", "source").mapInArrow(_postings(support), COLUMNS)
    terms = by(by(chunks, _as_terms), lambda t: t.filter(t.column("docs").is_null()))
    return stored(terms.select("lang", F.col("key").alias("term"), "source", "n"), "kept")


#: A table of so few rows, counted before, is broadcast; a larger one is joined by a shuffle.
LOOKUP = 100_000


def _lookup(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(LOOKUP + 1).count() <= LOOKUP else df


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", support: int = SUPPORT, ranks: int = RANKS) -> DataFrame:
    """How the sources of each language differ from each other, and in which terms from the whole.

    Terms are runs of letters (ASCII and all beyond), A-Z lower-cased; a language keeps those of
    at least `support` of its documents, a row being a document. With V of them, and N occurrences of them in a group
    (lang, source), a term of count c has p = 1 + floor(10^9 (c + 2) / (N + 2 V)) there; a
    language counts as the group of all its documents. Two shares differ by
    floor((p - q)^2 / (p + q)).

    Returns (lang, source, part, item, value, rank): in part `pair` every other source of the
    language with the sum over all terms kept (0 where there are none); in part `term` the
    `ranks` terms in which the group is furthest above its language. Ranks count from 1 by
    falling value, ties by the item's UTF-8 bytes. Groups without terms, without texts or with
    null texts take part with counts of 0. Null texts, languages and sources count as empty;
    rows repeated in full are documents of their own; an empty table gives no rows. Other
    columns are not read. Integers are exact for up to 9 * 10^15 occurrences a language.

    The comparison goes through blocks of some TERMS terms and two chunks of some SOURCES
    sources, in which every source stands with the few terms it has.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(text).cast("string").alias("text"), name(lang).alias("lang"), name(source).alias("name"))
    names = stored(rows.select("lang", "name").distinct(), "names")
    seed = 0
    while names.select(F.count_distinct("name") - F.count_distinct(F.xxhash64("name", F.lit(seed)))).first()[0]:
        seed += 1  # no two sources with one number
    number = F.xxhash64("name", F.lit(seed)).alias("source")
    table_ = vocabulary(rows.select("text", "lang", number), support)
    kept = table_.select("lang", "term", F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    own = table_.select("lang", "term", F.explode(F.arrays_zip("source", "n")).alias("e")).select("lang", "term", F.col("e.source").alias("number"), F.col("e.n").alias("n"))
    own = own.join(_lookup(names).select("lang", F.col("name").alias("source"), number.alias("number")), ["lang", "number"]).select("lang", "source", "term", "n")
    sums = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    of_lang = names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sums, "lang", "left").fillna(0, ["kinds", "all"])
    of_lang = stored(of_lang, "languages")
    each_lang = _lookup(of_lang)
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.select("lang", F.col("name").alias("source")).join(totals, ["lang", "source"], "left").join(each_lang, "lang").fillna(0, ["total"])
    groups = stored(groups, "groups")

    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("of_all"), F.col("all"), F.col("kinds"))
    above = own.join(kept.withColumnRenamed("n", "of_all"), ["lang", "term"]).join(_lookup(groups), ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    blocks = F.greatest(F.ceil(F.col("kinds") / TERMS), F.lit(1))
    block = F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    places = kept.join(each_lang, "lang").select("lang", "term", block).withColumn("at", place)
    places = stored(places, "places")
    sparse = own.join(places, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.collect_list(F.struct("at", "n")).alias("e"))
    sparse = sparse.select("lang", "source", "block", F.col("e.at").alias("at"), F.col("e.n").alias("n"))
    widths = places.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    chunks = F.ceil(F.col("sources") / SOURCES).cast("int").alias("chunks")
    every = groups.select("lang", "source", "total", "kinds", chunks, F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("block"))
    every = every.join(sparse, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    dealt = every.withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("x", F.least("chunk", "o")).withColumn("y", F.greatest("chunk", "o"))
    part = dealt.groupBy("lang", "block", "x", "y").applyInArrow(_compared, "lang string, a string, b string, value long")
    half = stored(part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    release(spark, places)
    return both.unionByName(above)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of `documents` against each other and their languages, from all their terms."""
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, k.n AS of_all, coalesce(x.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 2)) // (s.n + 2 * v.v) AS p, 1 + (1000000000 * (c.of_all::HUGEINT + 2)) // (v.n + 2 * v.v) AS q
  FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
items AS (SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums ON sums.lang = pairs.lang AND sums.source = pairs.source AND sums.item = pairs.item
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
}
