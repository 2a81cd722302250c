"""Edit distances: bit-parallel over many pairs at once, in one Arrow pass."""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of characters that make a into b.

    What both begin and end with is left out. A column of the table of prefixes is held as two
    whole numbers, whose bits say where it rises and where it falls along the longer text; each
    character of the shorter one takes a few operations on them, so the cost is the product of
    the lengths over 64 and memory is linear.
    """
    start = len(os.path.commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    places = {c: _bits(v) for c, v in at.items()}
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, out = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal
        out += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        rises, falls = down | (every & ~(diagonal | up)), up & diagonal
    return out


def _bits(places: list[int]) -> int:
    held = bytearray(places[-1] // 8 + 1)
    for i in places:
        held[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(held, "little")


#: Characters of a batch that are laid out at once, and bytes of the table of equal characters.
_AT_ONCE, _TABLE = 1 << 21, 1 << 18
#: Columns of so many words are worked out together; longer texts are taken pair by pair.
_WORDS = (1, 2, 3, 4, 6, 8)


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """`distance` of each pair of two arrays of texts without nulls."""
    sizes = pc.add(pc.utf8_length(a), pc.utf8_length(b)).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // _AT_ONCE)) + 1).tolist(), len(a)]
    parts = [_some_distances(a.slice(lo, hi - lo).to_pylist(), b.slice(lo, hi - lo).to_pylist()) for lo, hi in zip(cuts, cuts[1:])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of texts one behind the other: its text's start, and its place in the text."""
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes), within


def _agreeing(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters from x_at and y_at on, forwards or backwards, are equal, up to `most`."""
    x_from, within = _places(x_at, most)
    differ = np.flatnonzero(x[x_from + step * within] != y[np.repeat(y_at, most) + step * within])
    of = np.repeat(np.arange(len(most)), most)[differ]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    out = most.copy()
    out[of[first]] = within[differ[first]]
    return out


def _some_distances(a: list[str], b: list[str]) -> np.ndarray:
    flat = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = lambda texts: np.fromiter(map(len, texts), np.int64, len(texts))
    x, y, nx, ny = flat(a), flat(b), size(a), size(b)
    # characters by number, so that most tables need a byte a place; 0 is none
    seen = np.zeros(0x110000, bool)
    seen[x] = seen[y] = True
    kind = np.uint8 if seen.sum() < 256 else np.uint16 if seen.sum() < 1 << 16 else np.uint32
    number = np.cumsum(seen, dtype=np.uint32).astype(kind)
    x, y, at_x, at_y = number[x], number[y], np.cumsum(nx) - nx, np.cumsum(ny) - ny
    start = _agreeing(x, y, at_x, at_y, np.minimum(nx, ny), 1)
    end = _agreeing(x, y, at_x + nx - 1, at_y + ny - 1, np.minimum(nx, ny) - start, -1)
    at_x, at_y, nx, ny = at_x + start, at_y + start, nx - start - end, ny - start - end
    out, m = np.maximum(nx, ny), np.minimum(nx, ny)
    words = -(-m // 64)
    for least, most in zip((0, *_WORDS), _WORDS):
        of = np.flatnonzero((words > least) & (words <= most))
        if len(of) < 16 * most:
            continue
        # longest first, so that those not yet at their end stand in front
        of = of[np.argsort(-out[of], kind="stable")]
        for k in range(0, len(of), _TABLE // (64 * most)):
            some = of[k : k + _TABLE // (64 * most)]
            turned = nx[some] > ny[some]
            short = np.zeros((len(some), 64 * most), kind)
            long = np.zeros((int(out[some[0]]), len(some)), kind)
            for codes, at, mine in ((x, at_x, ~turned), (y, at_y, turned)):
                rows, place = _places(np.flatnonzero(mine), m[some][mine])
                short[rows, place] = codes[np.repeat(at[some][mine], m[some][mine]) + place]
            for codes, at, mine in ((y, at_y, ~turned), (x, at_x, turned)):
                rows, place = _places(np.flatnonzero(mine), out[some][mine])
                long[place, rows] = codes[np.repeat(at[some][mine], out[some][mine]) + place]
            out[some] = _together(short, m[some], long, out[some])
        words[of] = 0
    for i in np.flatnonzero(words).tolist():
        out[i] = distance(a[i][start[i] : start[i] + nx[i]], b[i][start[i] : start[i] + ny[i]])
    return out


def _together(short: np.ndarray, m: np.ndarray, long: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs: a row of `short` against a column of `long`, as `distance` does, but the
    bits of a column of the table are words of 64, and each step is taken by all pairs that have
    characters left. Pairs stand by falling n."""
    one, top, words = np.uint64(1), np.uint64(63), short.shape[1] // 64
    rises, falls = np.full((words, len(m)), ~np.uint64(0)), np.zeros((words, len(m)), np.uint64)
    left = np.searchsorted(-n, -np.arange(len(long)), "left")
    for j, k in enumerate(left.tolist()):
        same = np.packbits(short[:k] == long[j, :k, None], axis=1, bitorder="little").view(np.uint64)
        up_in, down_in = one, np.uint64(0)
        for w in range(words):
            up_to, down_to, eq = rises[w, :k], falls[w, :k], same[:, w]
            with_falls = eq | down_to
            eq = eq | down_in
            diagonal = (((eq & up_to) + up_to) ^ up_to) | eq
            up, down = down_to | ~(diagonal | up_to), up_to & diagonal
            up_next, down_next = up >> top, down >> top
            up, down = up << one | up_in, down << one | down_in
            rises[w, :k], falls[w, :k] = down | ~(with_falls | up), up & with_falls
            up_in, down_in = up_next, down_next
    # the last column rises and falls from n down to its last row
    out = n.copy()
    for w in range(words):
        held = np.clip(m - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(held == 64, ~np.uint64(0), (one << (held & top)) - one)
        out += np.bitwise_count(rises[w] & mask).astype(np.int64) - np.bitwise_count(falls[w] & mask).astype(np.int64)
    return out


@F.arrow_udf(T.IntegerType())
def _distances(pairs: pa.Array) -> pa.Array:
    """Distances that are known already, and those of the texts that came along."""
    known, a, b = (pairs.field(i) for i in range(3))
    told = pc.and_(pc.is_valid(a), pc.is_valid(b))
    if not pc.any(told).as_py():
        return known
    return pc.replace_with_mask(known, told, pa.array(distances(a.filter(told), b.filter(told)), pa.int32()))


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts, null where one is. Equal and empty texts are told by built-in
    functions; only others go to Python."""
    known = F.when(a == b, 0).when(a == "", F.length(b)).when(b == "", F.length(a))
    pair = lambda k: F.struct(k.alias("k"), F.when(k.isNull(), a).alias("a"), F.when(k.isNull(), b).alias("b"))
    return _distances(F.transform(F.array(known), pair)[0])
