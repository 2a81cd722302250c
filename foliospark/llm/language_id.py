"""Language ID (6): interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import mix, small, table

ORDER = 5
#: Models are fitted on about so many training documents a language, of about so many characters
#: together, drawn by a hash of the text. With these a language has at most some SAMPLE_CHARS
#: different 5-grams, of 28 bytes each, on the driver.
SAMPLE, SAMPLE_CHARS = 4000, 40_000_000
#: A document is rejected whose cross-entropy is above both so many times the highest of its
#: language's calibration documents, and two thirds of the way from their mean to a guess at random.
MARGIN, WAY = 1.1, 2 / 3
UNKNOWN = "und"
_FACTORS = mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct blank-separated chunks of letters, lower-cased, other characters as blanks; the
    chunk number of each chunk in turn, and where each text's begin. Chunks may be empty."""
    split = pc.split_pattern(texts.fill_null("").cast(pa.string()), " ")
    flat = split.flatten().dictionary_encode()
    starts = split.offsets.to_numpy().astype(np.int64)
    letters = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(flat.dictionary), r"[^\p{L}\p{M}]+", " "), " ")
    letters = pc.if_else(pc.match_substring_regex(letters, r"\p{L}"), letters, "")
    return letters, flat.indices.to_numpy().astype(np.int64), starts - starts[0]


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, ends, sizes): for each letter of each word and the blank behind it the ORDER code
    points that end there, a word standing behind ORDER - 1 blanks."""
    pad = " " * (ORDER - 1)
    text = "".join(f"{pad}{w} " for w in words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes + ORDER - 1)
    at = np.arange(int(sizes.sum())) + np.repeat((ends - sizes) - (np.cumsum(sizes) - sizes), sizes)
    return points, at, sizes


def hashes(points: np.ndarray, at: np.ndarray, k: int, back: int = 0) -> np.ndarray:
    """Hashes of the k code points that end `back` before each place."""
    total = np.full(len(at), k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += (points[at - back - j].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
    return mix(total)


def _find(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    k = np.searchsorted(held, wanted)
    k[k == len(held)] = 0
    return np.where(held[k] == wanted, k, -1) if len(held) else np.full(len(wanted), -1)


@dataclass
class Models:
    """For k = 1..ORDER: sorted hashes of all languages' k-grams, their probabilities by
    language, and the weight that each leaves to shorter contexts when it is a context."""

    langs: list[str]
    keys: list[np.ndarray]
    probability: list[np.ndarray]
    backoff: list[np.ndarray]
    base: np.ndarray  # what an unseen character gets, by language
    letters: np.ndarray  # different characters of each language
    limit: np.ndarray | None = None

    def log_loss(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """-ln p of each place by language, by the longest k-gram that is known."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        weight = np.ones((len(at), len(self.langs)), np.float32)
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            hit = _find(self.keys[k - 1], hashes(points, at[open_], k))
            good = hit >= 0
            out[open_[good]] = weight[open_[good]] * self.probability[k - 1][hit[good]]
            open_ = open_[~good]
            if not len(open_):
                break
            if k > 1:
                ctx = _find(self.keys[k - 2], hashes(points, at[open_], k - 1, 1))
                known = ctx >= 0
                weight[open_[known]] *= self.backoff[k - 2][ctx[known]]
        out[open_] = weight[open_] * self.base
        return -np.log(np.maximum(out, 1e-30))

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by language, letters and word ends counted, best language or -1)."""
        words, codes, starts = chunks(texts)
        points, at, sizes = grams(words)
        sizes = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0, sizes)
        bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        per_word = np.zeros((len(words), len(self.langs)))
        for lo in range(0, len(words), 20_000):  # bounds memory
            hi = min(len(words), lo + 20_000)
            loss = self.log_loss(points, at[bounds[lo] : bounds[hi]])
            per_word[lo:hi] = np.add.reduceat(loss, bounds[lo:hi] - bounds[lo], axis=0)
        per_word[sizes == 0] = 0
        n = np.add.reduceat(sizes[codes], starts[:-1]) if len(codes) else np.zeros(0, np.int64)
        total = np.stack([np.add.reduceat(per_word[codes, j], starts[:-1]) for j in range(len(self.langs))], 1) if len(codes) else np.zeros((0, len(self.langs)))
        entropy = total / np.maximum(n, 1)[:, None]
        return entropy, n, np.where(n > 0, entropy.argmin(1), -1)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's ORDER-grams, as rows of code points, and their counts.

    Interpolated Kneser-Ney: the longest order by counts, shorter ones by the number of
    different characters before them, each less an absolute discount n1 / (n1 + 2 n2).
    """
    langs = sorted(counts)
    levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [counts]
    for _ in range(ORDER - 1):
        levels.insert(0, {g: np.unique(rows[:, 1:], axis=0, return_counts=True) for g, (rows, _) in levels[0].items()})

    def key(rows: np.ndarray) -> np.ndarray:
        k = rows.shape[1]
        return hashes(rows.ravel(), np.arange(len(rows)) * k + k - 1, k)

    # rows and keys of all grams and of all contexts, in the order of the keys: word beginnings
    # are contexts that no gram is
    rows, keys = [], []
    for k, level in enumerate(levels, 1):
        found = np.concatenate([level[g][0] for g in langs] + [levels[k][g][0][:, :-1] for g in langs if k < ORDER])
        at, one = np.unique(key(found), return_index=True)
        keys.append(at)
        rows.append(found[one])
    tables, backs = [], [np.ones((len(k), len(langs)), np.float32) for k in keys]
    alphabet = len(np.unique(np.concatenate([levels[0][g][0].ravel() for g in langs]))) + 1
    base = np.zeros(len(langs), np.float32)
    for k in range(1, ORDER + 1):
        level = levels[k - 1]
        p = np.zeros((len(keys[k - 1]), len(langs)), np.float32)
        ctx = _find(keys[k - 2], key(rows[k - 1][:, :-1])) if k > 1 else None
        tail = _find(keys[k - 2], key(rows[k - 1][:, 1:])) if k > 1 else None
        for j, g in enumerate(langs):
            own, c = level[g]
            c = c.astype(float)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            where = _find(keys[k - 1], key(own))
            if k == 1:
                total = c.sum()
                base[j] = d * len(c) / total / alphabet
                p[:, j] = base[j]
                p[where, j] += (c - d) / total
                continue
            head = _find(keys[k - 2], key(own[:, :-1]))
            known = head >= 0
            total = np.bincount(head[known], c[known], len(keys[k - 2]))
            kinds = np.bincount(head[known], minlength=len(keys[k - 2]))
            seen = total > 0
            backs[k - 2][seen, j] = d * kinds[seen] / total[seen]
            lower = np.where(tail >= 0, tables[-1][np.maximum(tail, 0), j], base[j])
            weight = np.where(ctx >= 0, backs[k - 2][np.maximum(ctx, 0), j], 1)
            p[:, j] = weight * lower
            p[where[known], j] += np.maximum(c[known] - d, 0) / total[head[known]]
        tables.append(p)
    return Models(langs, keys, tables, backs, base, np.array([len(levels[0][g][0]) for g in langs]))


def _fold(id: str):
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models | None:
    """Models of the languages of the documents with crc32(id) mod 4 of 0 or 1, calibrated on
    those with 3; None where there is no such document with a letter. Rows without id, text or
    language teach nothing. About `sample` documents a language, and SAMPLE_CHARS characters of
    them, are drawn by a hash of their text, so the n-grams that come to the driver don't grow
    with the corpus; the limits come from all calibration documents."""
    rows = docs.select(_fold(id).alias("fold"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("fold <> 2 AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for g, n, chars in sizes for x in (g, min(1.0, sample / n, SAMPLE_CHARS / max(1, chars)))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    order = ORDER

    def count(batches):
        for batch in small(batches):
            lang = batch.column(1).to_numpy(zero_copy_only=False)
            for g in set(lang):
                words, codes, _ = chunks(batch.column(0).filter(pa.array(lang == g)))
                points, at, sizes = grams(words)
                often = np.bincount(codes, minlength=len(words))
                often[pc.equal(words, "").to_numpy(zero_copy_only=False)] = 0
                n = np.repeat(often, sizes)
                rows = np.stack([points[at - order + 1 + j] for j in range(order)], 1)[n > 0]
                kinds, back = np.unique(np.ascontiguousarray(rows).view(f"V{4 * order}").ravel(), return_inverse=True)
                total = np.bincount(back, n[n > 0]).astype(np.int64)
                if len(kinds):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(kinds)), pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(total)], names=["lang", "gram", "n"])

    got = drawn.where("fold < 2").select("text", "lang").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    by_lang = got.column("lang").to_numpy()
    grams_ = np.frombuffer(b"".join(got.column("gram").to_pylist()), "<u4").reshape(-1, ORDER)
    n = got.column("n").to_numpy()
    models = fit({g: (grams_[by_lang == g], n[by_lang == g]) for g in sorted(set(by_lang))})
    held = docs.sparkSession.sparkContext.broadcast(models)

    def calibrate(batches):
        for batch in small(batches):
            entropy, letters, best = held.value.judge(batch.column(0))
            mine = np.array([held.value.langs.index(x) if x in held.value.langs else -1 for x in batch.column(1).to_pylist()], int)
            good = (best == mine) & (best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(best[good].astype(np.int32)), pa.array(entropy[good, best[good]])], names=["lang", "h"])

    told = rows.where("fold = 3").select("text", "lang").mapInArrow(calibrate, "lang int, h double").groupBy("lang").agg(F.max("h"), F.avg("h")).collect()
    models.limit = np.full(len(models.langs), np.inf)  # a language without calibration documents rejects nothing
    for j, most, mean in told:
        models.limit[j] = max(MARGIN * most, mean + WAY * (np.log(models.letters[j]) - mean))
    return models


def identify(docs: DataFrame, models: Models | None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: the model of least cross-entropy a character.

    Returns the columns `keep`, lang_pred, score, cross_entropy and rejected. Texts that are
    null or without a letter are `und`, with score 0 and no cross-entropy, and rejected; so is
    everything where there is no model. Other texts get a learned language always; rejected
    says that even that model's cross-entropy is beyond its calibrated limit. score is the
    posterior of the language, damped by the square root of the length. Of languages with one
    cross-entropy the first by name is taken; repeated rows are judged alike, texts of any
    length whole.
    """
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    if models is None:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = held.value
        for batch in small(batches):
            entropy, n, best = m.judge(batch.column(batch.num_columns - 1))
            pick = np.maximum(best, 0)
            row = np.arange(len(best))
            least = entropy[row, pick]
            score = 1 / np.exp(-(entropy - least[:, None]) * np.sqrt(n)[:, None]).sum(1)
            none = best < 0
            cols = [
                pa.array([UNKNOWN if x < 0 else m.langs[x] for x in best], pa.string()),
                pa.array(np.where(none, 0, score)),
                pa.array(least, pa.float64(), mask=none),
                pa.array(none | (least > m.limit[pick])),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those whose crc32(doc_id) mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, train(docs), keep=("doc_id",))
    return got.select("doc_id", F.coalesce(_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
