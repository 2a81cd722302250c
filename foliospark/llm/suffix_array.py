"""Suffix-array dedup (9): repeated byte strings by sorting suffixes of block fingerprints."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import compressed, mix, release, small, stored, table, unpacked

MIN_BYTES = 400
#: Words of a repeated passage that the query tells of beside repeats of MIN_BYTES: "over 50 words".
PASSAGE_WORDS = 51
#: Suffixes of a bucket, which one task sorts in memory (24 bytes each).
BUCKET = 1 << 20
#: Words of an anchor of a window of words, and words that are worked on at once.
BLOCK, STRETCH = 5, 4000
#: Bytes of texts whose words are found at once.
LOT = 1 << 17
#: Bytes that are worked on at once, whatever the length of a text.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 21) - 1)
_WIDE = re.compile(r"[^\S\x00-\x7f]")
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


class Roller:
    """Fingerprints of all blocks of `block` bytes of a buffer."""

    def __init__(self, block: int, longest: int = SEGMENT):
        self.block = block
        self.longest = longest
        n = longest + 2 * block + 2
        inverse = pow(_BASE, -1, 1 << 64)
        self.power, self.inverse = (np.cumprod(np.full(n, b, np.uint64)) * np.uint64(pow(b, -1, 1 << 64)) for b in (_BASE, inverse))
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        k, n = self.block, len(data)
        if n < k:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[data] * self.power[:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * self.inverse[: n - k + 1])


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for every i, in two running minima over stretches of w."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = -len(v) % w
    top = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fore = np.minimum.accumulate(top, axis=1).ravel()
    back = np.minimum.accumulate(top[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def anchored_runs(data: np.ndarray, roll: Roller, size: int):
    """Runs of window starts with one anchor: (key, context, first start, number of starts).

    The anchor of the window at s is the leftmost least fingerprint of the blocks within
    data[s : s + size], so equal windows have equal anchors at equal places in them. key is
    the anchor's fingerprint, context that of everything the run's windows cover.
    """
    v = roll(data)
    w = size - roll.block + 1
    if len(v) < w:
        return None
    place = np.arange(len(v), dtype=np.uint64)
    least = window_minima((v & ~_LOW) | place, w)
    at = (least & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    count = np.diff(np.concatenate([first, [len(at)]]))
    anchor = at[first]
    # the run covers data[first : first + count - 1 + size]: blocks at its start, anchor and end
    # and every block between, by a sum over fingerprints that doesn't depend on the place
    last = first + count - 1 + size - roll.block
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * roll.power[: len(v)])])
        spread = (total[last + 1] - total[first]) * roll.inverse[first]
        context = mix(spread + mix((anchor - first).astype(np.uint64) * np.uint64(0x100000001B3) + count.astype(np.uint64)))
    return v[anchor], context, first, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _find_runs(size: int, block: int):
    """Rows (key, k, c, reps, s, n) of each text's runs of windows. Runs of equal context in
    one segment make one row with reps 2; the places of the others come as rows without k."""

    def run(batches):
        roll = Roller(block)
        for batch in small(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            keys = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                data = _bytes(batch.column(1)[i])
                for lo in range(0, len(data) - size + 1, SEGMENT):
                    k, c, s, n = anchored_runs(data[lo : lo + SEGMENT + size - 1], roll, size)
                    _, one, count = np.unique(c, return_index=True, return_counts=True)
                    one, reps = one[np.argsort(one)], np.minimum(count, 2)[np.argsort(one)]
                    more = np.setdiff1d(np.arange(len(c)), one)
                    if len(more):  # neighbours in one row
                        cut = np.flatnonzero(s[more][1:] != s[more][:-1] + n[more][:-1]) + 1
                        head = np.concatenate([[0], cut])
                        extra = np.add.reduceat(n[more], head)
                        s2, n2 = np.concatenate([s[one], s[more][head]]), np.concatenate([n[one], extra])
                    else:
                        s2, n2, extra = s[one], n[one], n[:0]
                    pad = np.zeros(len(extra), np.uint64)
                    row = [np.full(len(s2), keys[i]), np.concatenate([k[one], pad]), np.concatenate([c[one], pad]), np.concatenate([reps, np.zeros(len(extra), np.int64)]), s2 + lo, n2]
                    for held, v in zip(out, row):
                        held.append(v)
            if out[0]:
                key, k, c, reps, s, n = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(key), _signed(k), _signed(c), pa.array(reps.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "k", "c", "reps", "s", "n"])

    return run


def _emit_suffixes(size: int, block: int):
    """Rows (t1, t2s, key): the tokens of the suffix at each contested start. t1 is the
    fingerprint of its first `block` bytes, t2s half of the last block's over the start."""

    def run(batches):
        roll = Roller(block)
        for batch in small(batches):
            keys = batch.column(0).to_numpy()
            t1, t2s, key = [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(unpacked(batch.column(1)[i]), np.uint8)
                for r in batch.column(2)[i].as_py():
                    v = roll(data[r["s"] : r["s"] + r["n"] + size - 1])
                    n = r["n"]
                    t1.append(v[:n])
                    t2s.append((v[size - block : size - block + n] & ~np.uint64(0xFFFFFFFF)) | np.arange(r["s"], r["s"] + n, dtype=np.uint64))
                    key.append(np.full(n, keys[i]))
            if t1:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(t1)), _signed(np.concatenate(t2s)), pa.array(np.concatenate(key))], names=["t1", "t2s", "key"])

    return run


def multikey_quicksort(tokens: list[np.ndarray], short: int = 2048) -> np.ndarray:
    """The order of suffixes that are given token by token: three-way partitions by one token, and
    those with the pivot's token go on with the next. Short stretches are sorted at once."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, k = todo.pop()
        own = order[lo:hi]
        if hi - lo <= short:
            order[lo:hi] = own[np.lexsort([t[own] for t in tokens[:k:-1]] + [tokens[k][own]])]
            continue
        v = tokens[k][own]
        pivot = np.sort(v[:: len(v) // 31])[15]
        less, more = v < pivot, v > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([own[less], own[same], own[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, k), (b, hi, k)]
        if k + 1 < len(tokens):
            todo.append((a, b, k + 1))
    return order


def _sort_and_compare(batches):
    """A bucket's suffixes, sorted by multikey quicksort: those that equal a neighbour, and the
    first of the first and of the last group with the group's size, for the comparison with
    other buckets. A bucket is of bounded size (`BUCKET`)."""
    held = [[x.to_numpy() for x in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    t1, t2s, key = (np.concatenate(x) for x in zip(*held))
    del held
    t1, t2s = t1.view(np.uint64), t2s.view(np.uint64)
    order = multikey_quicksort([t1, t2s, key])
    t1, t2s, key = t1[order], t2s[order], key[order]
    t2, s = t2s >> np.uint64(32), t2s & np.uint64(0xFFFFFFFF)

    def rows(at, n, edge):
        return pa.RecordBatch.from_arrays(
            [_signed(t1[at]), _signed(t2[at]), pa.array(s[at].astype(np.int32)), pa.array(key[at]), pa.array(np.minimum(n[at], 2).astype(np.int32)), pa.array(np.full(len(t1[at]), edge))],
            names=["t1", "t2", "s", "key", "n", "edge"],
        )

    head = np.flatnonzero(np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
    count = np.diff(np.concatenate([head, [len(t1)]]))
    n = np.repeat(count, count)
    ends = np.unique(head[[0, -1]])
    yield rows(ends, n, True)
    inner = n >= 2
    inner[ends] = False
    yield rows(np.flatnonzero(inner), n, False)


def _marked(text: str) -> tuple[bytes, bytes]:
    """The text's bytes, and the same with any wide white space as blanks."""
    data = text.encode("utf-8", "surrogatepass")
    return data, data if text.isascii() else _WIDE.sub(lambda m: " " * len(m[0].encode()), text).encode("utf-8", "surrogatepass")


def _turns(marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    space = np.concatenate([[True], _SPACE[np.frombuffer(marks, np.uint8)], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def word_places(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes, and where its words begin and end. White space, as Python knows it, stands
    between words."""
    data, marks = _marked(text)
    return data, *_turns(marks)


def lots(keys: list[int], texts, gap: int):
    """Texts of some LOT bytes in one buffer, with `gap` blanks between two: (keys, where each text
    starts, bytes, where words begin and end)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(_marked(text.as_py() or ""))
        size += len(held[-1][0]) + gap
        if size >= LOT or i + 1 == len(keys):
            data, marks = ((b" " * gap).join(x) for x in zip(*held))
            starts = np.cumsum([0] + [len(d) + gap for d, _ in held[:-1]])
            yield np.array(keys[i + 1 - len(held) : i + 1]), starts, data, *_turns(marks)
            held, size = [], 0


def word_runs(data: bytes, s: np.ndarray, e: np.ndarray, words: int, size: int, roll: Roller):
    """Runs of windows of `words` words and under `size` bytes with one anchor, as `anchored_runs`
    has them for bytes: (key, context, first window, number of windows). The anchor is the least
    fingerprint of BLOCK words in the window."""
    n = len(s) - words + 1
    short = e[words - 1 :] - s[: max(0, n)] < size
    if n <= 0 or not short.any():
        return
    # no such window reaches over a word that stands `size` bytes before the next one, and
    # STRETCH words between two of these have at most so many times `size` bytes
    cuts = [0, *(np.flatnonzero(np.diff(s) >= size) + 1).tolist(), len(s)]
    parts: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:]):  # short ones at once; no short window reaches over a cut
        if parts and b - parts[-1][0] <= STRETCH and e[b - 1] - s[parts[-1][0]] <= roll.longest:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    for a, b in parts:
        for lo in range(a, b - words + 1, STRETCH - words + 1):
            hi = min(b, lo + STRETCH)
            at = np.flatnonzero(short[lo : hi - words + 1])
            if not len(at):
                continue
            # (a longer last word is in no such window)
            begin, end = s[lo:hi] - s[lo], np.minimum(e[lo:hi] - s[lo], roll.longest)
            letters = np.frombuffer(data, np.uint8)[s[lo] : s[lo] + end[-1]]
            total = np.zeros(len(letters) + 1, np.uint64)
            np.cumsum(roll.letter[letters] * roll.power[: len(letters)], out=total[1:])
            stretch = lambda x, y: mix((total[y] - total[x]) * roll.inverse[x] + (y - x).astype(np.uint64))
            block = stretch(begin[: 1 - BLOCK], end[BLOCK - 1 :])
            least = window_minima((block & ~_LOW) | np.arange(len(block), dtype=np.uint64), words - BLOCK + 1)
            anchor = (least[at] & _LOW).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) > 1)]))
            count = np.diff(np.concatenate([head, [len(at)]]))
            first, anchor = at[head], anchor[head]
            with np.errstate(over="ignore"):
                place = mix((anchor - first).astype(np.uint64) * np.uint64(0x100000001B3) + count.astype(np.uint64))
                context = mix(stretch(begin[first], end[first + count + words - 2]) + place)
            yield block[anchor], context, first + lo, count


def repeated_words(docs: DataFrame, words: int, size: int) -> DataFrame:
    """(key, span) of the windows of `words` words that occur anywhere else too and are shorter
    than `size` bytes; `repeated_spans` finds the longer ones. As there, a run whose whole context
    occurs again is repeated as it is; only where an anchor has different contexts are windows
    compared, one run of each context, known by 128 bits."""

    def find(batches):
        roll = Roller(1, STRETCH * size)
        for batch in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for keys, starts, data, s, e in lots(batch.column(0).to_pylist(), batch.column(1), size):
                for k, c, first, n in word_runs(data, s, e, words, size, roll):
                    own = np.searchsorted(starts, s[first], "right") - 1
                    row = keys[own], k.view(np.int64), c.view(np.int64), s[first] - starts[own], n, e[first + n + words - 2] - s[first]
                    for held, v in zip(out, row):
                        held.append(v)
            if out[0]:
                cols = [pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "k", "c", "s", "n", "bytes"])

    def windows(batches):
        for batch in small(batches):
            out: list[list] = [[] for _ in range(4)]
            for key, packed, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data, s, e = word_places(unpacked(packed).decode("utf-8", "surrogatepass"))
                for r in asked:
                    i = int(np.searchsorted(s, r["s"]))
                    a, b = s[i : i + r["n"]], e[i + words - 1 : i + r["n"] + words - 1]
                    out[0] += [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist())]
                    out[1] += [key] * len(a)
                    out[2] += a.tolist()
                    out[3] += (b - a).tolist()
            cols = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "key", "s", "n"])

    runs = stored(docs.select("key", "text").mapInArrow(find, "key long, k long, c long, s int, n int, bytes int"), "runs")
    again = runs.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k")
    cand = stored(runs.join(again, "k", "left_semi"), "candidates")
    ctx = stored(cand.groupBy("k", "c").agg(F.count(F.lit(1)).alias("reps"), F.min(F.struct("key", "s", "n")).alias("r")), "contexts")
    wholly = stored(cand.join(ctx.where("reps > 1").select("k", "c"), ["k", "c"], "left_semi").select("key", F.struct("s", F.col("bytes").alias("n")).alias("span")), "spans")
    contested = stored(ctx.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "contested")
    asked = ctx.join(contested, "k", "left_semi").groupBy(F.col("r.key").alias("key")).agg(F.collect_list(F.struct("r.s", "r.n")).alias("asked"))
    texts = docs.select("key", "text").mapInArrow(compressed, "key long, text binary").join(asked.hint("merge"), "key").dropDuplicates(["key"])
    found = stored(texts.mapInArrow(windows, "h binary, key long, s int, n int"), "windows")
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    spans = stored(wholly.union(found.join(twice, "h", "left_semi").select("key", F.struct("s", "n").alias("span"))), "spans")
    release(docs.sparkSession, runs, cand, ctx, wholly, contested, found)
    return spans


def repeated_spans(docs: DataFrame, size: int = MIN_BYTES, words: int = 0) -> DataFrame:
    """(key, spans) of `docs`, which has a long `key` and `text`: array<struct<s, n>> of byte
    ranges that strings of `size` bytes cover which start anywhere else too, and with words
    those of so many words.

    Candidate suffixes are those around an anchor that occurs again (`anchored_runs`). Where
    the whole context of an anchor occurs again, all its suffixes do, known by 128 bits. The
    other suffixes are range-partitioned by their tokens at sampled splitters into buckets of
    some BUCKET suffixes, sorted in each by multikey quicksort and compared with their
    neighbours, the ends of buckets with each other. Tokens are fingerprints of half a window
    (96 bits are compared), so a suffix is 12 bytes instead of `size`. A group of equal
    suffixes of any size may lie in several buckets; nothing is gathered by group.
    """
    spark, block = docs.sparkSession, size // 2
    runs = stored(docs.select("key", "text").mapInArrow(_find_runs(size, block), "key long, k long, c long, reps int, s int, n int"), "runs")
    half = F.shiftright("k", 32).cast("int").alias("half")
    again = runs.where("reps > 0").groupBy(half).agg(F.sum("reps").alias("m")).where("m > 1").select("half")
    cand = stored(runs.where("reps > 0").join(again, half == F.col("half"), "left_semi"), "candidates")
    alone = stored(runs.where("reps = 0").select("key", F.struct("s", (F.col("n") + size - 1).alias("n")).alias("span")), "spans")
    release(spark, runs)
    ctx = stored(cand.groupBy("k", "c").agg(F.sum("reps").alias("reps"), F.min(F.struct("key", "s", "n")).alias("r")), "contexts")
    # stored, so that the join has two plain exchanges and Spark can split the rows of a common k
    contested = stored(ctx.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "contested")
    asked = stored(ctx.join(contested, "k", "left_semi").groupBy(F.col("r.key").alias("key")).agg(F.collect_list(F.struct("r.s", "r.n")).alias("asked")), "asked")
    wholly = stored(cand.join(ctx.where("reps > 1").select("k", "c"), ["k", "c"], "left_semi").select("key", F.struct("s", (F.col("n") + size - 1).alias("n")).alias("span")), "spans")
    # joins of texts are merges: two maps in Python, one of them behind a broadcast join, would run in
    # one task, each in a worker of its own
    # of rows repeated in full, whose contexts all occur again, one is asked
    texts = docs.select("key", "text").mapInArrow(compressed, "key long, text binary").join(asked.hint("merge"), "key").dropDuplicates(["key"])
    suffixes = texts.mapInArrow(_emit_suffixes(size, block), "t1 long, t2s long, key long")
    total = asked.agg(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda n, r: n + r["n"]))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    told = stored(suffixes.repartitionByRange(buckets, "t1", "t2s", "key").mapInArrow(_sort_and_compare, "t1 long, t2 long, s int, key long, n int, edge boolean"), "told")
    release(spark, cand, ctx, contested, asked)
    edges = told.where("edge")
    meets = edges.groupBy("t1", "t2").agg(F.sum("n").alias("m")).where("m > 1").select("t1", "t2")
    across = edges.join(meets, ["t1", "t2"], "left_semi")  # two rows a bucket at most
    found = told.where("NOT edge").select("key", "s").union(across.select("key", "s")).select("key", F.struct("s", F.lit(size).alias("n")).alias("span"))
    if words:
        found = found.union(repeated_words(docs, words, size))
    spans = stored(alone.union(wholly).union(found).groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")
    release(spark, alone, wholly, told)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of ranges that overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["s"] + x["n"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def condensed(packed: np.ndarray) -> list[dict]:
    """Maximal runs of ranges that are given as s << 32 | n, as `merged` takes them."""
    if not len(packed):
        return []
    v = np.sort(packed)
    s, e = v >> 32, np.maximum.accumulate((v >> 32) + (v & 0xFFFFFFFF))
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.concatenate([head[1:], [len(v)]]) - 1
    return [{"s": a, "n": b - a} for a, b in zip(s[head].tolist(), e[last].tolist())]


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(data)]))


def remove_repeats(docs: DataFrame, text: str = "text", size: int = MIN_BYTES, keep: tuple[str, ...] = (), with_text: bool = True, words: int = 0, passages: int = 0) -> DataFrame:
    """Every byte that a repeated string of `size` bytes covers is removed, in all its places;
    with words, so is every repeated passage of so many words, however short they are.

    Returns the columns `keep`, n_bytes, n_removed, n_spans, kept_sha256 and, with with_text,
    kept_text: the bytes that are left as text, without characters of which a byte went.
    With passages, n_passage_bytes follows: the bytes that are in such a string or in a repeated
    passage of so many words. All other columns stay as they are without.
    Every row is a document of its own: rows repeated in full are copies of each other, and
    texts of `size` bytes or more that occur twice are removed wholly. Null and shorter texts
    have no such string and stay whole. Rows are told apart by a 64-bit hash of all kept
    columns and the text; rows with equal hashes are equal and so are their results. The ranges
    of such rows are gathered as a set, where they are found first, so any number of them has
    the ranges of one.
    """
    key = F.xxhash64(*[F.col(c) for c in keep], F.col(text)).alias("__key")
    mine = docs.select(*[F.col(c) for c in keep], key, F.col(text).alias("__text"))
    texts = mine.select(F.col("__key").alias("key"), F.col("__text").alias("text"))
    spans = repeated_spans(texts, size, words).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    if passages:
        # (one long a range, as there may be one for every word)
        place = F.shiftleft(F.col("span.s").cast("long"), 32).bitwiseOR(F.col("span.n").cast("long"))
        short = repeated_words(texts, passages, size).groupBy(F.col("key").alias("__key")).agg(F.collect_set(place).alias("__short"))
        spans = spans.join(short, "__key", "full")
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        + ([T.StructField("kept_text", T.StringType())] if with_text else [])
        + ([T.StructField("n_passage_bytes", T.LongType())] if passages else [])
    )
    places = ["__spans", *["__short"] * bool(passages)]

    def run(batches):
        for batch in small(batches):
            rows: list[list] = [[] for _ in range(6)]
            more = batch.column(len(keep) + 2) if passages else pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            for text, ranges, places_ in zip(batch.column(len(keep)), batch.column(len(keep) + 1), more):
                data = unpacked(text)
                spans = ranges.as_py() or []
                short = condensed(places_.values.to_numpy()) if places_.is_valid else []
                cuts = merged(spans)
                left = without(data, cuts)
                gone = sum(e - s for s, e in merged(spans + short))
                told = len(data), len(data) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), gone
                for held, v in zip(rows, told):
                    held.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            asked = [*range(4), *[4] * with_text, *[5] * bool(passages)]
            cols = [pa.array(rows[i], kinds[i]) for i in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    packed = T.StructType([*mine.schema.fields[:-1], T.StructField("__text", T.BinaryType())])
    joined = mine.mapInArrow(compressed, packed).join(spans.hint("merge"), "__key", "left").select(*[F.col(c) for c in keep], "__text", *places)
    return joined.mapInArrow(run, schema)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes in all documents, with the text that is left of each; beside them, in a
    column of its own, what passages of over 50 words that repeat have, however short they are."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep=("doc_id",), passages=PASSAGE_WORDS)


QUERIES = {"op9_suffix_array": op9_suffix_array}
ORACLES: dict[str, str] = {}
