"""N-gram Jaccard join (7): a MinHash LSH forest and exact verification in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import components, compressed, forest, in_blocks, mix, normal_words, release, small, stored, table, unpacked, whole_groups

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 24, 6
RECALL = 0.99999
#: Members of a block's chunk: of a trie node, and when n-grams are compared.
NODE_CHUNK, BLOCK_CHUNK, BLOCK_SHINGLES = 256, 192, 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows without an id are known by a hash of their text from here on; ids are smaller.
NAMELESS = 1 << 62


def prefix_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Where shortening may end: the longest prefix at which a pair of this similarity meets in
    some tree with the recall wanted."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `words` words and where each text's begin; a text of fewer
    words, but not none, has one run of all of them."""
    import xxhash

    vocabulary, codes, starts = normal_words(texts)
    empty = np.array([w == "" for w in vocabulary.to_pylist()])
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    n = np.diff(starts)
    if empty.any():  # an empty text splits into one empty word
        n = np.where((n == 1) & empty[codes[np.minimum(starts[:-1], len(codes) - 1)]], 0, n)
        codes = codes[~empty[codes]]
    starts = np.concatenate([[0], np.cumsum(n)])
    h = h[codes] if len(codes) else np.zeros(0, np.uint64)
    runs = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    total = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            factor = mix(np.array([k + 1], np.uint64) * _ODD)[0] | np.uint64(1)
            total[: max(0, len(h) - k)] += h[k:] * factor
        for i in np.flatnonzero((n < words) & (n > 0)):
            own = h[starts[i] : starts[i + 1]]
            factor = mix(np.arange(1, len(own) + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
            total[starts[i]] = (own * factor).sum() + np.uint64(len(own))
    ends = np.cumsum(runs)
    at = np.repeat(starts[:-1] - (ends - runs), runs) + np.arange(int(ends[-1]) if len(ends) else 0)
    return mix(total[at]), np.concatenate([[0], ends])


def signatures(values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values of 32 bits for each stretch of values; stretches aren't empty."""
    out = np.empty((len(starts) - 1, k), np.uint32)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts) - 1:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 32768, "right")) - 1)
            part, at = values[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]
            for i, f in enumerate(factors):
                out[lo:hi, i] = np.minimum.reduceat(part * f, at) >> np.uint64(32)
            lo = hi
    return out


def _digests(k: int, words: int):
    def run(batches):
        for batch in small(batches):
            values, starts = shingles(batch.column(1), words)
            full = np.flatnonzero(np.diff(starts))
            if not len(full):
                continue
            sets = [np.unique(values[starts[i] : starts[i + 1]]) for i in full]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            bounds = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate(sets)
            with np.errstate(over="ignore"):
                sums = [np.add.reduceat(mix(flat + np.uint64(c)), bounds[:-1]) for c in (1, 0x5851F42D4C957F2D)]
            sig = signatures(flat, bounds, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), *(pa.array(x.view(np.int64)) for x in sums), pa.array(size.astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["id", "f1", "f2", "n", "sig"],
            )

    return run


def _tries(trees: int, depth: int, d: int):
    """(node, rest, id): of each tree the key of the sorted trie's node at prefix length d, and
    the values behind that prefix, which order the suffixes of the signature below the node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, trees, depth)
            key = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64) * _ODD), (batch.num_rows, trees)).copy()
            for k in range(d):  # (array arithmetic wraps around)
                key = mix(key ^ (sig[:, :, k].astype(np.uint64) + mix(np.array([k + 1], np.uint64))[0]))
            rest = np.ascontiguousarray(sig[:, :, d:].astype(">u4")).reshape(batch.num_rows * trees, -1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array([r.tobytes() for r in rest], pa.binary()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))], names=["node", "rest", "id"])

    return run


def _meet(least: float):
    """Forest edges (a, b) between members of a trie node whose signatures agree enough.

    Rows of a node stand in the trie's order. Members that share the whole signature of the
    tree are compared first, then the matched prefix is shortened value by value up to the
    node's own; two members that longer prefixes have joined already aren't compared again.
    """

    def run(batches):
        for t in whole_groups(batches, ("node", "x", "y")):
            ids = t.column("id").to_numpy()
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
            rest = np.frombuffer(b"".join(t.column("rest").to_pylist()), ">u4").reshape(len(ids), -1)
            key = np.stack([t.column(c).to_numpy() for c in ("node", "x", "y")])
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
            label = np.arange(len(ids))
            for width in range(rest.shape[1], -1, -1):
                group = np.cumsum(new | np.concatenate([[True], (rest[1:, :width] != rest[:-1, :width]).any(1)]))
                for lag in range(1, len(ids)):
                    i = np.flatnonzero(group[lag:] == group[:-lag])
                    if not len(i):
                        break
                    i = i[label[i] != label[i + lag]]
                    i = i[(bits[i] == bits[i + lag]).sum(1) >= least * bits.shape[1]]
                    if len(i):
                        label = forest(len(ids), label[i], label[i + lag])[label]
            b = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[b]]), pa.array(ids[b])], names=["a", "b"])

    return run


def _sets(words: int):
    """(id, grams): the sorted different n-grams of compressed texts, 8 bytes each."""

    def run(batches):
        for batch in small(batches):
            texts = pa.array([unpacked(t).decode("utf-8", "surrogatepass") for t in batch.column(1)], pa.string())
            values, starts = shingles(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(values[a:b]).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["id", "grams"])

    return run


def _verify(similarity: float):
    """Rows (a, b, links): a forest of the links within a block, and each member's links there."""

    def run(batches):
        for t in whole_groups(batches, ("group", "x", "y")):
            key = np.stack([t.column(c).to_numpy() for c in ("group", "x", "y")])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]])
            grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
            ids, copies, chunk = (t.column(c).to_numpy() for c in ("id", "copies", "chunk"))
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                same = np.diff(key[1:, lo], axis=0)[0] == 0
                both = _shared(grams[lo:hi])
                size = both.diagonal()
                like = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= similarity
                np.fill_diagonal(like, False)
                like &= (ids[lo:hi, None] != ids[None, lo:hi])
                if not same:  # pairs of one chunk are counted in its own block
                    like &= chunk[lo:hi, None] != chunk[None, lo:hi]
                links = like @ copies[lo:hi]
                i, j = np.nonzero(np.triu(like))
                label = forest(hi - lo, i, j)
                b = np.flatnonzero(label != np.arange(hi - lo))
                own = np.flatnonzero(links)
                mine = ids[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mine[label[b]], mine[own]])),
                        pa.array(np.concatenate([mine[b], mine[own]])),
                        pa.array(np.concatenate([np.zeros(len(b), np.int64), links[own].astype(np.int64)])),
                    ],
                    names=["a", "b", "links"],
                )

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share, slab by slab."""
    m = len(sets)
    owner = np.repeat(np.arange(m), list(map(len, sets)))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    often = np.bincount(column)[column] > 1 if len(flat) else np.zeros(0, bool)
    column, owner = column[often], owner[often]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    both = np.zeros((m, m))
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + 4096, 4096))
    for a, b in zip(cuts, [*cuts[1:], len(column)]):
        if b > a:
            slab = np.zeros((m, 4096), np.float32)
            slab[owner[a:b], column[a:b] % 4096] = 1
            both += slab @ slab.T
    np.fill_diagonal(both, list(map(len, sets)))
    return both


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of `similarity` or more.

    Returns (doc_id, set_id, n_links, component_id, kept), a row per row of docs: the least id
    with the same set of n-grams, the number of other documents linked directly, the least id
    that links reach, and whether that is the row itself. Texts without words (null, empty)
    link with nothing and are kept. Rows without an id take part and get their group's id, or
    null where no member has one; a null component is kept. Rows of one id are one document;
    ids are below 2^62.

    Copies are folded into one set first, so they cost a row each. In each tree signatures are
    sorted into a trie; matched prefixes are shortened from the tries' depth until the recall
    is reached (`_meet`, `prefix_depth`). Nodes of several trees with the same members are one
    node; members of a crowded node meet in blocks of bounded size, and blocks give out
    spanning forests, never all pairs. Links are exact: every two members of a candidate group
    are compared by their n-grams, which are made once and sent to the blocks in place of texts.
    Texts of any length are whole; other columns are not read.
    """
    spark, k = docs.sparkSession, trees * depth
    d = prefix_depth(similarity, trees, depth, recall)
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / k)
    nameless = F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
    mine = docs.select(F.coalesce(F.col(id).cast("long"), nameless).alias("id"), F.col(text).alias("text"))
    base = stored(mine.mapInArrow(_digests(k, words), "id long, f1 long, f2 long, n int, sig binary"), "signatures")
    sets = stored(base.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    nodes = base.join(sets.select("rep", "copies", "f1", "f2"), (base.id == F.col("rep")) & (base.f1 == sets.f1) & (base.f2 == sets.f2))
    nodes = stored(nodes.select("id", "copies", "n", "sig").dropDuplicates(["id"]), "nodes")
    tries = nodes.select("id", "sig").mapInArrow(_tries(trees, depth, d), "node long, rest binary, id long")
    crowd = tries.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")).where("m > 1")
    crowd = crowd.groupBy("m", "h1", "h2").agg(F.min("node").alias("node")).select("node", "m")
    bits = nodes.select("id", "sig").mapInArrow(_low_bytes, "id long, bits binary")
    dealt = in_blocks(tries.join(crowd, "node"), "node", "id", F.ceil(F.col("m") / NODE_CHUNK))
    met = dealt.select("node", "x", "y", "rest", "id").join(bits, "id").repartition("node", "x", "y").sortWithinPartitions("node", "x", "y", "rest", "id")
    edges = stored(met.mapInArrow(_meet(least), "a long, b long").distinct(), "edges")
    near = stored(components(edges).select(F.col("node").alias("id"), F.col("component").alias("group")), "groups")
    release(spark, edges)
    weighed = near.join(nodes.select("id", "copies", "n"), "id")
    crowd = weighed.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_CHUNK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    members = in_blocks(weighed.join(crowd, "group"), "group", "id", parts).select("group", "x", "y", "chunk", "id", "copies")
    packed = mine.where("text IS NOT NULL").mapInArrow(compressed, "id long, text binary")
    sets_of = packed.join(near.select("id"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(words), "id long, grams binary")
    blocks = members.join(sets_of, "id").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "id")
    told = stored(blocks.mapInArrow(_verify(similarity), "a long, b long, links long"), "links")
    release(spark, near)
    final = components(told.where("a <> b").select("a", "b"))
    links = told.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = sets.join(links, "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", F.col("rep").alias("set_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = base.select("id", "f1", "f2").join(known, ["f1", "f2"]).select("id", "set_id", "n_links", "component_id")
    bare = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")) == 0
    rest = mine.where(bare).select("id", F.col("id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    rows = linked.union(rest).select(named("id"), named("set_id"), "n_links", named("component_id"))
    return rows.select(F.col("id").alias("doc_id"), "set_id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _low_bytes(batches):
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in (sig & np.uint32(0xFF)).astype(np.uint8)], pa.binary())], names=["id", "bits"])


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all documents at five words and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES: dict[str, str] = {}
