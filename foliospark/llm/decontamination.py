"""Benchmark decontamination (4): Aho-Corasick over the benchmark's word windows, spans of the original."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import small, stored, table, words_of

WINDOW = 13
#: An automaton has some so many words at most, and so many bytes of them; every task that scans
#: holds one (a node a word of each window, some 100 bytes each).
MAX_WORDS, MAX_BYTES = 200_000, 8_000_000
#: Items are cut into slices of so many windows, so that an item of any length can be dealt out.
SLICE = 1000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def _letters(codes: np.ndarray) -> str:
    """Word numbers as a string of one character each; -1, an unknown word, is character 0."""
    codes = codes.astype(np.int64) + 1
    codes[codes >= 0xD800] += 0x800  # no surrogates
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def windows_of(words: list, window: int = WINDOW) -> list[tuple]:
    """All runs of `window` words; a shorter list, if it isn't empty, is one run."""
    if len(words) < window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def slices(items, window: int = WINDOW, size: int = SLICE):
    """(item, words): stretches of items that have each window of an item in one of them."""
    for item, text in items:
        words = words_of(text)
        for k in range(0, max(len(words) - window + 1, 1 if words else 0), size):
            yield item, words[k : k + size + window - 1]


class Automaton:
    """Windows of benchmark items as strings of one character a word."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        owners: dict[str, set] = {}
        for item, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for run in windows_of(codes, window):
                owners.setdefault(_letters(np.array(run)), set()).add(item)
        self.owners = [frozenset(x) for x in owners.values()]
        self.lengths = np.array([len(k) for k in owners], np.int64)
        self.tree = ahocorasick.Automaton()
        for i, k in enumerate(owners):
            self.tree.add_word(k, i)
        if owners:
            self.tree.make_automaton()
        self.words = pa.array([w.decode("utf-8", "surrogatepass") for w in self.vocabulary], pa.string())

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[frozenset]]:
        """Words of each text, its ranges (first, last) of hit words, and its items."""
        folded = pa.array([b" ".join(words_of(t.as_py())) for t in texts], pa.binary()).cast(pa.string())
        split = pc.split_pattern(folded, " ")
        sizes = np.where(pc.binary_length(folded).to_numpy(zero_copy_only=False) == 0, 0, np.diff(split.offsets.to_numpy()))
        flat = split.flatten()
        if (sizes == 0).any():
            flat = flat.filter(pc.not_equal(flat, ""))  # an empty text splits into one empty word
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ranges, found = [[] for _ in texts], [frozenset()] * len(texts)
        if not self.owners or not total:
            return sizes, ranges, found
        codes = pc.index_in(flat, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        # one scan over the whole batch; a window that begins in one text and ends in the next is no match
        got = list(self.tree.iter(_letters(codes)))
        if not got:
            return sizes, ranges, found
        last, which = np.array(got, np.int64).T
        first = last - self.lengths[which] + 1
        doc = np.searchsorted(ends, last, "right")
        start = ends - sizes
        inside = first >= start[doc]
        first, last, which, doc = first[inside], last[inside], which[inside], doc[inside]
        for d in np.unique(doc):
            mine = doc == d
            found[d] = frozenset().union(*(self.owners[k] for k in np.unique(which[mine])))
            ranges[d] = joined(list(zip((first[mine] - start[d]).tolist(), (last[mine] - start[d]).tolist())))
        return sizes, ranges, found


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) that overlap or are neighbours as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges of words as character ranges of the original text."""
    first, last = {a for a, _ in ranges}, {b for _, b in ranges}
    out: list[dict] = []
    for k, m in enumerate(WORD.finditer(text.translate(_UPPER))):
        if k in first:
            out.append({"start": m.start(), "end": m.end()})
        if k in last:
            out[-1]["end"] = m.end()
            if len(out) == len(ranges):
                break
    return out


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _scanned(docs: DataFrame, held, n: int, window: int, schema: T.StructType, hits_only: bool):
    """docs, whose last column is __text and whose first n are kept, with n_words, the ranges of
    hit words and the items that the automaton over `held` finds."""

    def run(batches):
        tree = Automaton(held.value, window)
        for batch in small(batches):
            sizes, ranges, found = tree.scan(batch.column(batch.num_columns - 1))
            at = np.flatnonzero([bool(r) for r in ranges]) if hits_only else np.arange(batch.num_rows)
            cols = [
                pa.array(sizes[at], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in ranges[i]] for i in at], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array([sorted(map(str, found[i])) for i in at], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:n]), *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = (),
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Benchmark windows in each document.

    Returns the columns `keep`, n_words, n_hit, n_items, items_sha256, contaminated and
    hit_spans: ranges of hit words as characters of the original text. A null or empty text
    has no words and no hits; items without an id or words match nothing; items of one id are
    one item; rows repeated in full have equal results. Long texts are scanned whole.

    The benchmark is measured, and cut into as many automata of bounded size as it needs. With
    one, texts are scanned once, in place (no shuffle). With more, each scans the texts and
    gives out the rows with hits, which are joined by a 128-bit hash of the whole row.
    """
    spark, row, n = docs.sparkSession, docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")), len(keep)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL")

    def cut(batches):
        for batch in batches:
            rows = list(slices(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), window))
            cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([b" ".join(r[1]).decode("utf-8", "surrogatepass") for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "n"])

    parts = stored(items.mapInArrow(cut, "item string, words string, n long").distinct(), "items")
    words, size = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    k = max(1, -(-words // max(1, max_words)), -(-size // MAX_BYTES))
    dealt = lambda g: spark.sparkContext.broadcast([(r.item, r.words.encode("utf-8", "surrogatepass").split()) for r in parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(k)) == g).collect()])
    hits = [T.StructField("n_words", T.LongType()), T.StructField("__ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), T.StructField("__items", T.ArrayType(T.StringType()))]
    if k == 1:
        held = dealt(0)
    else:
        key = ("__h1", "__h2")
        whole = [F.col(c) for c in row.columns]
        row = row.withColumns({"__h1": F.xxhash64(*whole), "__h2": F.xxhash64(F.lit(1), *whole)})
        schema = T.StructType([T.StructField(c, T.LongType()) for c in key] + hits)
        found = None
        for g in range(k):
            part = _scanned(row.select(*key, "__text"), dealt(g), 2, window, schema, True)
            found = part if found is None else found.union(part)
        # a row's hits: at most what its own words and items make up; rows repeated in full hit once
        found = stored(found.select(*key, "__ranges", "__items").distinct().groupBy(*key).agg(F.flatten(F.collect_list("__ranges")).alias("__ranges"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items")), "hits")
        row = row.join(found, list(key), "left").select(*[F.col(c) for c in keep], "__ranges", "__items", "__text")
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        tree = Automaton(held.value, window) if k == 1 else None
        for batch in small(batches):
            texts = batch.column(batch.num_columns - 1)
            if tree:
                n_words, ranges, found = tree.scan(texts)
            else:
                n_words = np.array([len(words_of(t.as_py())) for t in texts], np.int64)
                ranges = [joined([(r["first"], r["last"]) for r in x or ()]) for x in batch.column(n).to_pylist()]
                found = [x or () for x in batch.column(n + 1).to_pylist()]
            n_hit = np.array([sum(b - a + 1 for a, b in x) for x in ranges], np.int64)
            cols = [
                *batch.columns[:n],
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([_digest(x) for x in found], pa.string()),
                pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                pa.array([_spans(t.as_py(), x) if x else [] for t, x in zip(texts, ranges)], kind),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return row.mapInArrow(run, schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; hit_spans as text, `start-end` by commas."""
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return got.withColumn("hit_spans", F.array_join(F.transform("hit_spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


_APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_FOLD_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_FOLD_SQL} AS w FROM documents),
b AS (SELECT item_id, {_FOLD_SQL} AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, w AS run FROM b WHERE len(w) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item_id, w[i:i+12] FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)),
sizes AS (SELECT DISTINCT len(run) AS n FROM runs),
mine AS (SELECT doc_id, i, n, w[i:i+n-1] AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM mine JOIN runs USING (run)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
raw AS (SELECT doc_id, regexp_extract_all(text, '[^{_APART}]+') AS w, regexp_extract_all(text, '[{_APART}]+') AS s, regexp_matches(text, '^[{_APART}]') AS lead
  FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word, unnest(CASE WHEN lead THEN s[1:len(w)] ELSE list_prepend('', s)[1:len(w)] END) AS sep FROM raw),
placed AS (SELECT doc_id, k, length(word) AS n, sum(length(word) + length(sep)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM each),
isles AS (SELECT doc_id, n, e, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS isle
  FROM placed JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) USING (doc_id, k)),
bounds AS (SELECT doc_id, CAST(min(e - n) AS BIGINT) AS a, CAST(max(e) AS BIGINT) AS b FROM isles GROUP BY doc_id, isle),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS hit_spans FROM bounds GROUP BY doc_id)
SELECT coalesce(hit_spans, '') AS hit_spans, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN spans USING (doc_id)"""
}
