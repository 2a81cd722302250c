"""Embedding whitening (11): principal components of distinct vectors on a grid, joined back."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import release, small, stored, table

#: Entries are multiples of 1 / SCALE; COMPONENTS are given.
SCALE, COMPONENTS = 256, 4
#: Components of less than this share of the variance are rounding, not variance.
NOISE = 1e-12
_KINDS = {"a": "<i2", "b": "<i4", "c": "<i8"}


def grid(column: pa.Array, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose vectors have finite entries only, and floor(scale * entry) of each as the
    narrowest of 2, 4 or 8 bytes that hold the vector: equal vectors, equal bytes."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * scale)
        bad = ~(np.abs(x) < 2.0**63)
    good = (size >= 0) & (np.bincount(owner[bad], minlength=len(size)) == 0)
    starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    rows, out = np.flatnonzero(good), []
    for i in rows:
        v = x[starts[i] : starts[i] + size[i]].astype(np.int64)
        most = max(int(v.max()), -int(v.min())) if len(v) else 0
        head = "a" if most < 1 << 15 else "b" if most < 1 << 31 else "c"
        out.append(head.encode() + v.astype(_KINDS[head]).tobytes())
    return rows, out


def matrices(column: pa.Array):
    """(rows, their vectors as a matrix of longs) for each length and width of stored vectors."""
    found: dict[tuple[str, int], list] = {}
    for i, v in enumerate(column.to_pylist()):
        found.setdefault((chr(v[0]), len(v)), []).append((i, v[1:]))
    for (head, size), rows in found.items():
        kind = np.dtype(_KINDS[head])
        m = np.frombuffer(b"".join(v for _, v in rows), kind).reshape(len(rows), (size - 1) // kind.itemsize)
        yield np.array([i for i, _ in rows]), m.astype(np.int64)


def _weighted_sum(m: np.ndarray, w: np.ndarray) -> list[int]:
    """Exact sums of m's columns, rows counted w times."""
    most = int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0
    m = m if most * int(w.sum()) < 1 << 62 else m.astype(object)
    return [int(s) for s in (m * w[:, None]).sum(0)]


def _sums(batches):
    """(dim, k, s, n) of a task's distinct vectors: the exact sum of each dimension, and its weight."""
    total: dict[int, list] = {}
    for batch in small(batches):
        w = batch.column(1).to_numpy()
        for rows, m in matrices(batch.column(0)):
            own = total.setdefault(m.shape[1], [0, [0] * m.shape[1]])
            own[0] += int(w[rows].sum())
            own[1] = [a + b for a, b in zip(own[1], _weighted_sum(m, w[rows]))]
    for dim, (n, s) in total.items():
        ks = np.arange(dim, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(ks), pa.array([Decimal(v) for v in s], pa.decimal128(28, 0)), pa.array(np.full(dim, n))], names=["dim", "k", "s", "n"])


def _products(means: dict[int, np.ndarray]):
    """(dim, k, v) of a task's distinct vectors: the upper triangle of the centred products."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in small(batches):
            w = batch.column(1).to_numpy()
            for rows, m in matrices(batch.column(0)):
                dim = m.shape[1]
                if dim:
                    c = m - means[dim]
                    total[dim] = total.get(dim, 0) + c.T @ (c * w[rows, None])
        for dim, v in total.items():
            v = v[np.triu_indices(dim)]
            for lo in range(0, len(v), 100_000):
                part = v[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, np.int32)), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["dim", "k", "v"])

    return run


def _deviation(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n * x - S)^2 over the dimensions."""
    most = max((abs(int(m.max())), abs(int(m.min()))) if m.size else (0,)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, m.shape[1]) < 1 << 62:
        d = m * n - np.array(sums, np.int64)
    else:
        d = m.astype(object) * n - np.array(sums, object)
    return [int(v) for v in (d * d).sum(1)]


def _whitened(fits: dict[int, tuple]):
    """(x, dim, deviation, w) of each distinct vector."""

    def run(batches):
        for batch in small(batches):
            for rows, m in matrices(batch.column(0)):
                dim = m.shape[1]
                if not dim:
                    continue
                n, sums, mean, axes = fits[dim]
                w = (m - mean) @ axes
                cols = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.full(len(rows), dim, np.int32)),
                    pa.array([Decimal(d) for d in _deviation(m, n, sums)], pa.decimal128(38, 0)),
                    pa.array([[None if v != v else v for v in r] for r in w.tolist()], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "dim", "deviation", "w"])

    return run


def components_of(products: np.ndarray, n: int, dim: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes that whiten (unit eigenvectors over the roots of their eigenvalues, NaN where there is
    no variance) and the eigenvalues' shares of the trace (NaN where that is zero)."""
    v = np.zeros((dim, dim))
    v[np.triu_indices(dim)] = products / n
    v = v + np.triu(v, 1).T
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.maximum(e, 0) / trace
        axes = np.where(share > NOISE, u / np.sqrt(np.where(e > 0, e, np.nan)), np.nan)
    return axes, share


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """Vectors on a grid, projected on the first principal components and scaled to unit variance.

    Each entry c counts as the whole number x = floor(scale * c). Equal x-vectors are folded
    into one with a count; the fit takes each once (`weights="one"`) or as often as it occurs
    (`"counts"`). Covariances have divisor n, the fit's weight, and are centred before they are
    multiplied. Each distinct vector is whitened once and joined back to its rows.

    Returns for each row and component (from 1, by falling eigenvalue): id, component, n,
    deviation (decimal; the exact sum over dimensions of (n * x - S)^2, S the fit's sums),
    whitened, explained (the eigenvalue's share of the trace) and identity_error (the largest
    absolute entry of the covariance of `whitened` less the identity).

    Rows whose vector is null or holds null or non-finite entries, or one whose x is no long,
    are left out; so are empty vectors, which have no component. Vectors of each length are a
    fit of their own; the driver holds a matrix of length by length for it, never vectors.
    Shorter vectors than `components` have as many components as entries. Components without
    variance (one distinct vector, say) have a null `whitened` and don't count for the
    identity; explained is null where the trace is 0. Repeated rows give repeated rows, a null
    id stays null. Eigenvectors of equal eigenvalues are any orthonormal ones, the same for all
    rows. Other columns are not read.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("id", vectors.schema[id].dataType), T.StructField("x", T.BinaryType())])

    def on_grid(batches):
        for batch in small(batches):
            rows, x = grid(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(x, pa.binary())], names=["id", "x"])

    mine = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("e")).where("e IS NOT NULL AND size(e) > 0")
    base = stored(mine.mapInArrow(on_grid, schema), "grid")
    weight = F.count(F.lit(1)) if weights == "counts" else F.max(F.lit(1).cast("long"))
    sets = stored(base.groupBy("x").agg(weight.alias("weight")), "distinct")

    fitted: dict[int, list] = {}
    got = sets.mapInArrow(_sums, "dim int, k int, s decimal(28,0), n long").groupBy("dim", "k").agg(F.sum("s"), F.sum("n"))
    for dim, k, s, n in got.collect():
        own = fitted.setdefault(dim, [n, [0] * dim])
        own[1][k] = int(s)
    means = {dim: np.array([float(Fraction(s, n)) for s in sums]) for dim, (n, sums) in fitted.items()}
    triangles = {dim: np.zeros(dim * (dim + 1) // 2) for dim in fitted}
    for dim, k, v in sets.mapInArrow(_products(means), "dim int, k long, v double").groupBy("dim", "k").agg(F.sum("v")).collect():
        triangles[dim][k] = v
    shares, fits = {}, {}
    for dim, (n, sums) in fitted.items():
        axes, shares[dim] = components_of(triangles[dim], n, dim, components)
        fits[dim] = (n, sums, means[dim], axes)

    done = stored(sets.mapInArrow(_whitened(fits), "x binary, dim int, deviation decimal(38,0), w array<double>"), "whitened")
    # the covariance of what came out, over the fit list again
    weighed = done.join(sets, "x") if weights == "counts" else done.withColumn("weight", F.lit(1).cast("long"))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w, c = (lambda i: F.get("w", F.lit(i))), F.col("weight")
    mean = lambda v: F.sum(v * c) / F.sum(F.when(v.isNotNull(), c))
    entry = lambda i, j: F.abs(mean(w(i) * w(j)) - mean(w(i)) * mean(w(j)) - float(i == j))
    errors = dict(weighed.groupBy("dim").agg(F.greatest(*[entry(i, j) for i, j in pairs], F.lit(None).cast("double")).alias("e")).collect())
    number = lambda v: None if v != v else float(v)
    facts = [(dim, j + 1, fits[dim][0], number(share), errors.get(dim)) for dim, own in shares.items() for j, share in enumerate(own)]
    facts = spark.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double")
    release(spark, sets)
    rows = base.join(done, "x").select("id", "dim", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return rows.join(F.broadcast(facts), ["dim", "component"]).select(F.col("id").alias(id), "component", "n", "deviation", "whitened", "explained", "identity_error")  # a row a component


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings, each distinct vector once in the fit.
    A deviation beyond a long is an error."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLES: dict[str, str] = {}
