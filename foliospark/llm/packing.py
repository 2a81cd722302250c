"""Best-fit packing (5): exact complements by hashed sums of lengths, then best fit."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import small, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks: tiktoken gives the same ids for a word in a tenth of the time.
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END = 0
#: Parts that the pieces of one length are numbered in.
PARTS = 64
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(tokenizer), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})


def token_ids(texts: pa.Array, tokenizer: str, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in turn, and where each text's begin.

    The tokenizer always cuts before a blank that follows other than white space, so texts are
    cut there and each distinct word of the batch is encoded once. Texts with a special token's
    string, or with a blank between white space, go through the tokenizer whole.
    """
    whole, quick = _encoders(tokenizer, ranks)
    texts = texts.fill_null("").cast(pa.string())
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    odd = pc.match_substring_regex(texts, f"{_SPACE} {_SPACE}")
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    starts = split.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    words = flat.dictionary.to_pylist()
    first = split.flatten().take(pa.array(starts[:-1]))
    firsts = first.to_pylist()
    encode = quick.encode_ordinary
    ids = [encode(" " + w) for w in words]
    ids += [whole.encode(texts[i].as_py(), add_special_tokens=False).ids if odd[i] else encode(firsts[i]) for i in range(len(texts))]
    codes[starts[:-1]] = len(words) + np.arange(len(texts))
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    pool = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
    at = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(at[codes] - (ends - n), n) + np.arange(total)
    bounds = np.concatenate([[0], ends])
    return pool[place], bounds[starts]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of sequences that use each length as often as counts says.

    Works on the histogram of lengths, whose size the capacity bounds. From the longest down,
    a length takes its exact complement from the index of single lengths, of pair sums or of
    triple sums, as often as all its parts are available; what is left is put, longest first,
    where the least room remains.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out: list[tuple[int, tuple[int, ...]]] = []

    def use(parts: tuple[int, ...]) -> int:
        need = {p: parts.count(p) for p in parts}
        times = min(left.get(p, 0) // m for p, m in need.items())
        if times:
            out.append((times, parts))
            for p, m in need.items():
                left[p] -= m * times
                if not left[p]:
                    del left[p]
        return times

    if n := left.get(capacity):
        use((capacity,))
    for longest in sorted(left, reverse=True):
        gap = capacity - longest
        if longest in left and gap in left:
            use((longest, gap))
        while longest in left:  # pairs, by hash of the second for each first that is available
            pair = next(((a, gap - a) for a in sorted((x for x in left if 2 * x >= gap and x < gap), reverse=True) if gap - a in left and use((longest, a, gap - a))), None)
            if pair is None:
                break
    # triple sums: an index of the pair sums of the lengths that remain, whose pairs are tried
    # while their lengths last
    have = sorted(left)
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, x in enumerate(have):
        for y in have[i : bisect_left(have, capacity - x)]:
            sums.setdefault(x + y, []).append((x, y))
    for longest in reversed(have):
        gap = capacity - longest
        for c in reversed(have[: bisect_left(have, gap)]):
            pairs = sums.get(gap - c)
            while pairs and longest in left and c in left:
                x, y = pairs[-1]
                if x not in left or y not in left:
                    pairs.pop()
                elif not use((longest, x, y, c)):
                    break
            if longest not in left:
                break
    # best fit of the residuals: open sequences of equal content are held together with their number
    room: dict[int, list[list]] = {}  # room left -> [times, lengths]
    rooms: list[int] = []

    def put(space: int, times: int, parts: tuple[int, ...]) -> None:
        if space not in room:
            room[space] = []
            insort(rooms, space)
        room[space].append([times, parts])

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                if todo >= fit:
                    put(capacity - fit * length, todo // fit, (length,) * fit)
                if todo % fit:
                    put(capacity - todo % fit * length, 1, (length,) * (todo % fit))
                break
            space = rooms[k]
            times, parts = room[space].pop()
            if not room[space]:
                del room[space], rooms[k]
            fit = min(space // length, max(1, todo // times))  # of each of `times` sequences
            used = min(times, todo // fit)
            put(space - fit * length, used, (*parts, *(length,) * fit))
            if times > used:
                put(space, times - used, parts)
            todo -= used * fit
    for held in room.values():
        out += [(times, parts) for times, parts in held]
    return out


def slots(sequences: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): the pieces of a length are dealt
    to the slots for it in turn, `times` ranks to each."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    number = 0
    for times, parts in sequences:
        offset = 0
        for p in parts:
            out.setdefault(p, []).append((seen.get(p, 0), number, offset))
            seen[p] = seen.get(p, 0) + times
            offset += p
        number += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Sequences of at most `capacity` tokens of whole documents.

    A document is its ids and an end token; one longer than `capacity` is cut into pieces of
    `capacity`, of which the first may be shorter. Null and empty texts are the end token
    alone; rows repeated in full are documents of their own. Returns, per piece, the columns
    `keep`, piece, start, length, ids_crc32, sequence_id and offset. Only the histogram of
    lengths in each of PARTS parts (at most capacity * PARTS numbers) comes to the driver, and
    the plan over it goes back; texts aren't shuffled.
    """
    spark = docs.sparkSession
    paths = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("__part", T.IntegerType())]
    )

    def cut(batches):
        turn = 0
        for batch in small(batches):
            ids, bounds = token_ids(batch.column(batch.num_columns - 1), *paths)
            doc, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END))
                edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    doc.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].astype("<u4").tobytes()))
            at = np.array(doc, np.int64)
            part = np.arange(turn, turn + len(doc)) % PARTS  # in turn, so that copies don't meet in one part
            turn += len(doc)
            cols = [c.take(pa.array(at)) for c in batch.columns[:-1]]
            cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    pieces = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")).mapInArrow(cut, schema)
    pieces = stored(pieces, "pieces")
    sizes = pieces.groupBy("length", "__part").count().collect()  # at most capacity * PARTS numbers
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(sizes, key=lambda r: (r[0], r[1])):
        base[r[0], r[1]] = counts.get(r[0], 0)
        counts[r[0]] = counts.get(r[0], 0) + r[2]
    counts.pop(capacity, None)
    sequences = plan(counts, capacity)
    number = sum(times for times, _ in sequences)
    held = spark.sparkContext.broadcast((base, slots(sequences)))
    full = pieces.where(F.col("length") == capacity).drop("__part")  # alone in a sequence: numbered where they are
    full = full.withColumn("sequence_id", F.lit(number) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    ranked = pieces.where(F.col("length") < capacity).repartition("length", "__part").sortWithinPartitions("length", "__part", "ids_crc32", "start")
    done = T.StructType([f for f in pieces.schema.fields if f.name != "__part"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        base, where = held.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            n, part = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__part"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero((n[1:] != n[:-1]) | (part[1:] != part[:-1])) + 1, [len(n)]]) if len(n) else [0]
            for a, b in zip(cuts, cuts[1:]):
                key = int(n[a]), int(part[a])
                rank = base[key] + seen.get(key, 0) + np.arange(b - a)
                seen[key] = seen.get(key, 0) + int(b - a)
                slot = where[key[0]]
                k = np.searchsorted(slot[:, 0], rank, "right") - 1
                seq[a:b], off[a:b] = slot[k, 1] + rank - slot[k, 0], slot[k, 2]
            cols = [c for c, f in zip(batch.columns, batch.schema.names) if f != "__part"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=done.names)

    return ranked.mapInArrow(place, done).union(full)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), keep=("doc_id",))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
