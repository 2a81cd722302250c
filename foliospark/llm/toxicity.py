"""Toxicity (12): gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import ROWS, release, stored, table

#: The classifier is fitted on about so many labelled documents of either label, drawn by a hash of
#: their ids; what they weigh makes up for it.
SAMPLE = 10_000
#: A term is learned for the lexicon where its excess in toxic documents, by the likelihood ratio, is
#: such that so many terms of all would have it by chance.
CHANCE = 1.0
TREES, DEPTH, LEAF = 20, 3, 3
#: With fewer calibration documents of either label, all training documents calibrate.
CALIBRATION = 30
#: Words before and behind a hit in which a second person counts as near.
NEAR = 5
#: Text that is worked on at once, unless one text is longer.
UNIT = 8_000_000

# Insults of four languages, which the lexicon has before it learns any; the second
# person; characters that stand for letters.
INSULTS = (
    "arsehole asshole bastard bitch clown crap creep cretin disgusting dumb dumbass filth fool freak garbage idiot idiotic imbecile jerk loser lowlife moron moronic pathetic "
    "pig scum scumbag shit stupid trash ugly vermin wanker whore worthless arschloch abschaum blödmann depp drecksack dummkopf hurensohn idiotin mistkerl trottel vollidiot wichser widerlich "
    "abruti connard connasse crétin débile enculé imbécile merde ordure pouffiasse salaud salope basura cabrón escoria estúpido estúpida gilipollas idiota imbécil maldito mierda pendejo puta"
).split()
SECOND = "you your yours yourself youre u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

FEATURES = (
    "hits", "hit_density", "hidden_hits", "hidden_density", "second_person", "near_hits", "capitals", "punctuation", "exclamation", "obfuscation", "drawn_out", "words",
)
_LEET = str.maketrans(LEET)
_THRICE = re.compile(r"(.)\1{2,}")
_TWICE = re.compile(r"(.)\1+")


def slices(batch: pa.RecordBatch, column: int):
    """Slices of a batch of at most ROWS rows and about UNIT bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + UNIT, "right"))
        hi = min(max(hi, lo + 1), lo + ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters of each word, lower-cased, and the word of each."""
    split = pc.split_pattern_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+")
    return split.flatten(), np.repeat(np.arange(len(words)), split.value_lengths().to_numpy(zero_copy_only=False))


def _tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct blank-separated words, the word number of each in turn, and where each text's begin."""
    split = pc.utf8_split_whitespace(text.cast(pa.string()).fill_null(""))
    flat = split.flatten().dictionary_encode()
    at = split.offsets.to_numpy().astype(np.int64)
    code, empty = flat.indices.to_numpy().astype(np.int64), pc.index(flat.dictionary, "").as_py()
    full = code != empty
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.dictionary, code[full], before[at - at[0]]


def _disguised(word: str, lexicon: frozenset, by_size: dict) -> bool:
    """A lexicon term in digits and signs, with letters drawn out, parted by signs, or with some of
    its letters as * or #."""
    low = word.lower().strip(".,;:?\"'()[]{}…«»")
    for form in (low, low.rstrip("!")):
        plain = "".join(c for c in form.translate(_LEET) if c.isalpha())
        if plain in lexicon or _THRICE.sub(r"\1", plain) in lexicon or _THRICE.sub(r"\1\1", plain) in lexicon:
            return True
        if _THRICE.search(plain) and _TWICE.sub(r"\1", plain) in lexicon:
            return True
    body = low.rstrip("!*#")
    if any(c in "*#%&" for c in body[1:]) and sum(c.isalpha() for c in low) * 2 >= len(low):
        pattern = re.compile("".join("." if c in "*#%&" else re.escape(c) for c in low.rstrip("!")))
        return any(pattern.fullmatch(t) for t in by_size.get(len(low.rstrip("!")), ()))
    return False


@dataclass
class Lexicon:
    terms: tuple[str, ...]

    def __post_init__(self):
        self.known = frozenset(self.terms)
        self.array = pa.array(self.terms, pa.string())
        self.second = pa.array(SECOND, pa.string())
        self.by_size: dict[int, list[str]] = {}
        for t in self.terms:
            self.by_size.setdefault(len(t), []).append(t)

    def _words(self, words: pa.Array) -> dict[str, np.ndarray]:
        """What is known of each distinct word, whatever text it stands in."""
        number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        flag = lambda a: a.to_numpy(zero_copy_only=False).astype(bool)
        n = len(words)
        piece, owner = _pieces(words)
        among = lambda known: np.bincount(owner[flag(pc.is_in(piece, value_set=known))], minlength=n) > 0
        letters = number(pc.utf8_length(pc.replace_substring_regex(words, r"[^\p{L}\p{M}]+", "")))
        others = pc.replace_substring_regex(words, r"[\p{L}\p{M}\p{N}]+", "")
        hit = among(self.array)
        mixed = flag(pc.match_substring_regex(words, r"\p{L}[0-9@$!*#%&|+._\-]+\p{L}|[0-9@$]\p{L}{2}|\p{L}{2}[0-9@$*#]"))
        drawn = flag(pc.match_substring_regex(pc.utf8_lower(words), "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")))
        hidden = np.zeros(n, bool)
        maybe = np.flatnonzero((mixed | drawn) & ~hit)
        hidden[maybe] = [_disguised(w, self.known, self.by_size) for w in words.take(pa.array(maybe)).to_pylist()]
        same = flag(pc.equal(words, pc.utf8_upper(words))) & ~flag(pc.equal(words, pc.utf8_lower(words)))
        chars = number(pc.utf8_length(words))
        # a term in disguise is a hidden hit and nothing else
        mixed, drawn = mixed & ~hidden & ~hit, drawn & ~hidden
        signs = np.where(hidden, 0, number(pc.utf8_length(others)))
        return {
            "hit": hit, "hidden": hidden, "second": among(self.second) & ~hidden, "capital": same & (letters > 1), "chars": chars, "punct": signs,
            "loud": number(pc.count_substring_regex(words, "[!?]")), "mixed": mixed & (letters > 0), "drawn": drawn, "single": (chars == 1) & (letters == 1),
        }

    def _spelled(self, words: pa.Array, codes: np.ndarray, owner: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Places at which a lexicon term begins that is spelled letter by letter between blanks."""
        at = np.flatnonzero(single[codes])
        if not len(at):
            return at
        cuts = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
        found = []
        for run in np.split(at, cuts):
            if len(run) > 2:
                line = "".join(words.take(pa.array(codes[run])).to_pylist()).lower()
                for size, terms in self.by_size.items():
                    if 2 < size <= len(line):
                        found += [run[m.start()] for t in terms for m in re.finditer(re.escape(t), line)]
        return np.array(found, np.int64)

    def features(self, text: pa.Array) -> np.ndarray:
        """A row of FEATURES for each text; texts without a word are all zeros."""
        words, codes, starts = _tokens(text)
        size = np.diff(starts)
        out = np.zeros((len(size), len(FEATURES)))
        if not len(codes):
            return out
        of = self._words(words)
        owner = np.repeat(np.arange(len(size)), size)
        total = lambda v: np.bincount(owner, v[codes], len(size))
        hidden = of["hidden"][codes].astype(np.int64)
        np.add.at(hidden, self._spelled(words, codes, owner, of["single"]), 1)
        hit = (of["hit"][codes] | (hidden > 0)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(of["second"][codes])])
        place = np.flatnonzero(hit)
        lo, hi = np.maximum(place - NEAR, starts[owner[place]]), np.minimum(place + NEAR + 1, starts[owner[place] + 1])
        near = np.bincount(owner[place], before[hi] > before[lo], len(size))
        n, chars = np.maximum(size, 1), np.maximum(total(of["chars"]), 1)
        hits, veiled = np.bincount(owner, hit, len(size)), np.bincount(owner, hidden, len(size))
        columns = [
            np.log1p(hits), 100 * hits / n, np.log1p(veiled), 100 * veiled / n, 100 * total(of["second"]) / n, np.log1p(near), total(of["capital"]) / n,
            total(of["punct"]) / chars, 100 * total(of["loud"]) / chars, 100 * total(of["mixed"]) / n, 100 * total(of["drawn"]) / n, np.log1p(size),
        ]
        return np.stack(columns, 1)


@dataclass
class Model:
    """The lexicon, the trees and their calibration; no trees where nothing could be learned."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None


def fold(id: str) -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(5))


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and features, an array of doubles, of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # as bounded as the sample it was learned from
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                rows = held.value.features(part.column(part.num_columns - 1))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], names=schema.names)

    return docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def learned_terms(rows: DataFrame) -> list[str]:
    """Terms of (text, toxic) rows that toxic ones have more often than chance allows. What counts is
    a term behind a different term: copies of a document say no more than one of them, and a
    place that a clean document has too is clean."""

    def places(batches):
        for batch in batches:
            for part in slices(batch, 0):
                words, codes, starts = _tokens(part.column(0))
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                piece, owner = _pieces(words)
                coded = piece.dictionary_encode()
                terms, of_piece = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                # the terms of all words in turn, each with its document and the term before it
                size = np.bincount(owner, minlength=len(words))
                at = (np.cumsum(size) - size)[codes]
                n = size[codes]
                at = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc, term = np.repeat(np.repeat(np.arange(len(toxic)), np.diff(starts)), n), of_piece[at]
                full = term != (pc.index(terms, "").as_py() if len(terms) else -1)
                doc, term = doc[full], term[full]
                before = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), -1, np.concatenate([[-1], term[:-1]])) if len(term) else term
                key, back = np.unique(term * (len(terms) + 1) + before + 1, return_inverse=True)
                bad = np.ones(len(key), np.int64)
                np.minimum.at(bad, back, toxic[doc])
                first = pa.concat_arrays([pa.array([""]), terms]).take(pa.array(key % (len(terms) + 1)))
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(key // (len(terms) + 1))), first, pa.array(bad)], names=["term", "before", "bad"])

    seen = rows.select("text", "toxic").mapInArrow(places, "term string, before string, bad long").groupBy("term", "before").agg(F.min("bad").alias("bad"))
    counts = stored(seen.groupBy("term").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("seen")), "terms")
    kinds, bad, all_ = counts.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("seen")).first()
    found = []
    if kinds and 0 < bad < all_:
        rate = bad / all_
        part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("seen") * share))).otherwise(0.0)
        ratio = 2 * (part(F.col("bad"), rate) + part(F.col("seen") - F.col("bad"), 1 - rate))
        sure = (F.col("bad") > F.col("seen") * max(rate, 0.5)) & (ratio > float(2 * np.log(kinds / CHANCE))) & (F.length("term") > 2)
        found = [r.term for r in counts.where(sure).select("term").collect()]
    release(rows.sparkSession, counts)
    return sorted(found)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration from the labelled documents with crc32(id) mod 5 other than 0.

    Those with a remainder of 4 calibrate, the others teach the trees, and all of them the lexicon. About
    `sample` documents of either label are drawn by a hash of their id. Labels of one id that
    differ count as toxic; null labels, ids and texts teach nothing. Where there aren't both
    labels, there are no trees.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.withColumn("fold", fold("id")).where("fold <> 0")
    sizes = dict(known.groupBy("toxic").count().collect())
    seeds = tuple(sorted(INSULTS))
    if not sizes.get(0) or not sizes.get(1):
        return Model(Lexicon(seeds))
    shares = {k: min(1.0, sample / n) for k, n in sizes.items()}
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    drawn = drawn.withColumn("weight", F.when(F.col("toxic") == 1, 1 / shares[1]).otherwise(1 / shares[0]))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = stored(texts.join(F.broadcast(drawn), "id"), "labelled")  # some 2 * sample rows of numbers
    lexicon = Lexicon(tuple(sorted({*seeds, *learned_terms(rows)})))
    table_ = stored(with_features(rows, lexicon, "text", ("id", "toxic", "weight", "fold")).repartition(8, "id").sortWithinPartitions("id"), "features")
    ready = table_.select("fold", F.col("toxic").cast("double").alias("label"), "weight", array_to_vector("features").alias("features"))
    fitting = ready.where("fold <> 4")
    if fitting.select("label").distinct().count() < 2:
        return Model(lexicon)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, stepSize=0.3, seed=1).fit(fitting)
    held = dict(ready.where("fold = 4").groupBy("label").count().collect())
    calibrating = ready.where("fold = 4") if min(held.get(0.0, 0), held.get(1.0, 0)) >= CALIBRATION else ready
    margins = _margin(trees.transform(calibrating)).select("margin", "label", "weight")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(margins)
    release(docs.sparkSession, rows, table_)
    return Model(lexicon, trees, calibration)


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin", vector_to_array("rawPrediction")[1])


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep`, score (0 to 1) and predicted (1 at 0.5 or more) of each whole text.

    Null texts count as empty ones and get the score of a text without words. Texts of any
    length are read whole; equal texts get equal scores. Without trees a text is scored 1
    where it has a term of the lexicon, else 0. Columns that aren't in `keep` are not read,
    and those of `keep` may have any name that isn't score or predicted.
    """
    own = docs.select(F.struct(*[F.col(c) for c in keep]).alias("__row"), F.col(text).alias("__body"))
    rows = with_features(own, model.lexicon, "__body", ("__row",))
    if model.trees is None:
        scored = rows.withColumn("score", (F.col("features")[0] > 0).cast("double"))
    else:
        judged = _margin(model.trees.transform(rows.withColumn("features", array_to_vector("features"))))
        scored = model.calibration.transform(judged.select("__row", "margin"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(*[F.col("__row")[c].alias(c) for c in keep], score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of those whose crc32(doc_id) mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    got = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return got.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
