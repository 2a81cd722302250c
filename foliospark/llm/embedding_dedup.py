"""Embedding near-dedup (1): Euclidean p-stable hashing in tables, then exact cosines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import components, forest, in_blocks, mix, stored, table, whole_groups

COSINE = 0.98
#: Projections are quantised in steps of WIDTH. Unit vectors at cosine 0.98 are 0.2 apart, which
#: one projection keeps together with probability 0.92; 16 of them with 0.26, and one of 36 tables
#: with 0.99998. MISS bounds the probability that no table has a pair at the threshold.
WIDTH, PROJECTIONS, MISS = 2.0, 16, 2e-5
#: A table has so many projections, PROJECTIONS at least, that no more than CROWD of a label's vectors
#: share a bucket by chance where all are at cosine FAR of each other.
FAR, CROWD = 0.7, 16
#: Vectors and directions are rounded to these steps, so that their products add up exactly in
#: doubles and a vector has the same buckets in whichever batch it stands.
VECTOR_STEP, PLANE_STEP = 2.0**-20, 2.0**-16
#: Quantised projections that are held at once.
CELLS = 1 << 22
#: Vectors of a crowded bucket's chunk; a block compares two chunks.
CHUNK = 512
#: Buckets of more vectors are compared as a matrix, smaller ones pair by pair over many buckets at once.
FEW, PAIRS = 24, 16_384


def meeting(cosine: float) -> float:
    """The probability that one quantised projection keeps two unit vectors of this cosine together."""
    steps = WIDTH / math.sqrt(max(2 - 2 * cosine, 1e-12))
    return math.erf(steps / math.sqrt(2)) - math.sqrt(2 / math.pi) / steps * (1 - math.exp(-steps * steps / 2))


def tables_for(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections a table, and tables, for labels of up to n vectors. Below a threshold of FAR
    more projections would ask for too many tables, so it stays at PROJECTIONS."""
    projections = PROJECTIONS
    if cosine > FAR and n > CROWD:
        projections = max(PROJECTIONS, math.ceil(math.log(n / CROWD) / -math.log(meeting(FAR))))
    return projections, math.ceil(math.log(MISS) / math.log1p(-(meeting(cosine) ** projections)))


@lru_cache(2)
def planes(dim: int, projections: int, tables: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions in steps of PLANE_STEP and the offsets of their quantisation."""
    rng = np.random.default_rng([seed, dim])
    return np.rint(rng.standard_normal((dim, tables * projections)) / PLANE_STEP), rng.uniform(0, WIDTH, tables * projections)


def buckets(unit: np.ndarray, labels: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """The bucket of each unit vector in each table, of its label's hash and dimension alone."""
    a, b = planes(unit.shape[1], projections, tables)
    whole = np.rint(unit / VECTOR_STEP) @ a  # exact: up to 2**39 a product, 2**14 of them
    step = np.floor((whole * (VECTOR_STEP * PLANE_STEP) + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    salt = labels[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 20)
    key = mix(salt)
    for k in range(projections):
        key = mix(key ^ step[:, :, k])
    return key.view(np.int64)


def _hashes(labels: pa.Array) -> np.ndarray:
    """64-bit hashes of label texts."""
    import xxhash

    coded = labels.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(v) for v in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]


def _units(column: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: rows and their unit vectors, scaled first so that no square overflows."""
    out: dict[int, list] = {}
    for i, v in enumerate(column.to_pylist()):
        out.setdefault(len(v) // np.dtype(kind).itemsize, []).append((i, v))
    done = {}
    for dim, rows in out.items():
        m = np.frombuffer(b"".join(v for _, v in rows), kind).reshape(-1, dim).astype(np.float64)
        m = m / np.abs(m).max(1)[:, None]
        done[dim] = np.array([i for i, _ in rows]), m / np.sqrt((m * m).sum(1))[:, None]
    return done


def _digest(kind: str):
    """(id, label, f1, f2, vector) of the vectors that can be compared; f1 and f2 are a 128-bit
    hash of label and vector."""
    import xxhash

    def run(batches):
        for batch in batches:
            keep, raw, f = [], [], []
            for i, (g, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if v and None not in v:
                    x = np.asarray(v, kind) + np.zeros(1, kind)  # -0 becomes 0
                    if np.isfinite(x).all() and x.any():
                        keep.append(i)
                        raw.append(x.tobytes())
                        f.append(xxhash.xxh128_digest(g.encode("utf-8", "surrogatepass") + b"\xff" + raw[-1]))
            if keep:
                at = pa.array(keep)
                both = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)), pa.array(raw, pa.binary())], names=["id", "label", "f1", "f2", "vector"])

    return run


def _tables(kind: str, projections: int, tables: int):
    """(bucket, t, id) of vectors, CELLS projections at a time."""
    lot = max(1, CELLS // (projections * tables))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = _hashes(batch.column(1))
            for rows, unit in _units(batch.column(2), kind).values():
                for k in range(0, len(rows), lot):
                    some = rows[k : k + lot]
                    key = buckets(unit[k : k + lot], labels[some], projections, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), batch.column(0).take(pa.array(np.repeat(some, tables)))], names=["bucket", "t", "id"]
                    )

    return run


def _pairs(unit: np.ndarray, group: np.ndarray, cosine: float):
    """Pairs (i, j) with i < j of one group and a cosine of `cosine` or more, some at a time.
    Rows of a group stand together."""
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([head, [len(group)]]))
    few = np.repeat(size <= FEW, size)
    for lag in range(1, min(FEW, int(size.max()))):
        at = np.flatnonzero(few[lag:] & (group[lag:] == group[:-lag]))
        for k in range(0, len(at), PAIRS):
            i = at[k : k + PAIRS]
            i = i[np.einsum("ij,ij->i", unit[i], unit[i + lag]) >= cosine]
            yield i, i + lag
    for lo, n in zip(head[size > FEW], size[size > FEW]):
        own = unit[lo : lo + n]
        i, j = np.nonzero(np.triu(own @ own.T >= cosine, 1))
        for k in range(0, len(i), PAIRS):
            yield lo + i[k : k + PAIRS], lo + j[k : k + PAIRS]


def _compare(cosine: float, kind: str, projections: int, tables: int):
    """Rows (a, b, links): a forest of the links found in a block, and each member's links. A pair
    that meets in several tables counts in the first of them only, for which the buckets of linked
    vectors are worked out again; labels must be equal."""
    lot = max(1, CELLS // (projections * tables))

    def run(batches):
        for t in whole_groups(batches, ("bucket", "x", "y")):
            t = t.combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")])
            ids, copies, chunk, at = (t.column(c).to_numpy() for c in ("id", "copies", "chunk", "t"))
            text = t.column("label").chunk(0)
            label, hashed = text.dictionary_encode().indices.to_numpy(), _hashes(text)
            group = np.cumsum(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            within = key[1] == key[2]  # a block of one chunk with itself
            links, left, right = np.zeros(len(ids), np.int64), [], []
            for rows, unit in _units(t.column("vector").chunk(0), kind).values():
                codes, known = np.zeros((len(rows), tables), np.int64), np.zeros(len(rows), bool)
                for i, j in _pairs(unit, group[rows], cosine):
                    asked = np.unique(np.concatenate([i, j]))
                    asked = asked[~known[asked]]
                    for k in range(0, len(asked), lot):
                        some = asked[k : k + lot]
                        codes[some] = buckets(unit[some], hashed[rows[some]], projections, tables)
                    known[asked] = True
                    a, b = rows[i], rows[j]
                    good = (label[a] == label[b]) & (ids[a] != ids[b]) & (within[a] | (chunk[a] != chunk[b]))
                    good &= (codes[i] == codes[j]).argmax(1) == at[a]
                    left.append(a[good])
                    right.append(b[good])
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = forest(len(ids), i, j)
                b, own = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
                cols = [np.concatenate([ids[root[b]], ids[own]]), np.concatenate([ids[b], ids[own]]), np.concatenate([np.zeros(len(b), np.int64), links[own]])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Vectors of one label with a cosine of `cosine` or more, in double precision.

    Returns (vec_id, n_links, component_id, kept), a row per row: the number of other vectors
    linked directly, the least id that links reach, and whether that is its own. Vectors that
    are null, empty, zero or hold nulls or non-finite numbers, and those without a label or an
    id, link with nothing: no links, their own id, kept. Vectors of different lengths don't
    link. Labels may be of any type that casts to a text and are compared by that text.
    Numbers stay as they are given: floats as floats, all others as doubles. Rows repeated in
    full, and equal vectors of one label, are links of each other; they are folded into one
    before hashing. Rows of one id must be repeats of one row. Other columns are not read.

    The number of projections and tables follows from the size of the largest label
    (`tables_for`). Buckets of several tables with the same members are one bucket. Crowded buckets are dealt
    into blocks of bounded size, which give out counts and spanning forests, never pairs.
    """
    single = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kind, value = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    group = F.col(label)
    if isinstance(vectors.schema[label].dataType, (T.FloatType, T.DoubleType)):
        group = group + F.lit(0.0)  # -0 becomes 0
    mine = vectors.select(F.col(id).cast("long").alias("id"), group.cast("string").alias("label"), F.col(embedding).cast(value).alias("e"))
    base = stored(mine.where("id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").mapInArrow(_digest(kind), "id long, label string, f1 long, f2 long, vector binary"), "vectors")
    sets = stored(base.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    nodes = base.join(sets.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep", "copies"), (F.col("id") == F.col("rep")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    nodes = stored(nodes.select("id", "label", "copies", "vector").dropDuplicates(["id"]), "nodes")
    size = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    form = tables_for(size, cosine)
    dealt = nodes.select("id", "label", "vector").mapInArrow(_tables(kind, *form), "bucket long, t int, id long")
    crowd = dealt.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.min("t").alias("t"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")
    ).where("m > 1")
    crowd = crowd.groupBy("m", "h1", "h2").agg(F.min_by("bucket", "t").alias("bucket")).select("bucket", "m")
    met = in_blocks(dealt.join(crowd, "bucket"), "bucket", "id", F.ceil(F.col("m") / CHUNK)).join(nodes, "id")
    met = met.select("bucket", "x", "y", "t", "chunk", "id", "label", "copies", "vector").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "id")
    told = stored(met.mapInArrow(_compare(cosine, kind, *form), "a long, b long, links long"), "links")
    final = components(told.where("a <> b").select("a", "b"))
    links = told.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = sets.join(links, "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = base.select("id", "f1", "f2").join(known, ["f1", "f2"]).select("id", "n_links", "component_id")
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    rest = mine.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, vec_id) AS component_id, coalesce(c.m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
}
