"""Helpers that several operators share: tables, the shared folder, words, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that end a word become blanks, A-Z become a-z; bytes from 0x80 stay.
_FOLD = bytes(
    (c if chr(c).isdigit() or c > 0x7F or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20)
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where
    that is unset the context's checkpoint folder; a temporary one only in local mode."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: While a table is written Spark drops the write's shuffle files when it is done, not at some later
#: garbage collection.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here. Shuffle files
    of the write go with its end; the session's setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    got = spark.read.schema(df.schema).parquet(path)
    got._stored_at = path
    return got


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more."""
    for t in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that a task works on at once: an Arrow batch holds up to 10,000 of them.
ROWS = 2000


def small(batches):
    """The batches in slices of ROWS rows, which bounds what a task holds beside the batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def compressed(batches):
    """The last column, a text, as zstd, so that it is shuffled at a third of its size."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in small(batches):
        packed = pa.array([squeeze.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


def unpacked(packed: pa.Scalar) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def words_of(text: str | None) -> list[bytes]:
    """Words of [0-9a-z] and of any non-ASCII letters, after A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def normal_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each word in turn, and where each text starts."""
    folded = pa.array([b" ".join(words_of(t.as_py())) for t in texts], pa.binary()).cast(pa.string())
    split = pc.split_pattern(folded, " ")
    flat = split.flatten().dictionary_encode()
    starts = split.offsets.to_numpy().astype(np.int64)
    codes = flat.indices.to_numpy().astype(np.int64)
    return flat.dictionary, codes, starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that links reach, for every node of edges (a, b).

    Alternates large-star and small-star until an edge table repeats; each round is a few
    shuffles of at most as many rows as there are edges and nothing is gathered on the
    driver but two numbers. A hub's neighbours are never collected: the least neighbour of
    each node is a partial aggregate, joined back to the edges.
    """
    cur = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name
    )
    tally = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    before = tally(cur)
    while before[0]:
        last = cur
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join has two plain exchanges and Spark can split a hub's rows
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        # in small-star every node b takes its smaller neighbours and itself to the least of them
        down = large.distinct()
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            down.join(low, "b")
            .select(F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .where("a < b")
            .distinct()
        )
        cur = stored(small, name)
        after = tally(cur)
        release(edges.sparkSession, last, least)
        if after == before:
            break
        before = after
    return cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(
        cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def whole_groups(batches, key: tuple[str, ...]):
    """Arrow tables of whole groups from batches sorted by key: what may go on in the next
    batch waits for it. Groups must be bounded by the caller."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        same = np.ones(t.num_rows, bool)
        for k in key:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (i, j) reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def in_blocks(df: DataFrame, group: str, member: str, chunks) -> DataFrame:
    """Rows of each group dealt into blocks (x, y) with 0 <= x <= y < chunks: a row of chunk x
    goes to each block that has x, so any two rows of a group meet in exactly one block of
    their two chunks, and in no block stand more rows than in two chunks. The column `chunk`
    tells a row's own; a group of one chunk stays as it is."""
    own = F.pmod(F.xxhash64(member), chunks).cast("int")
    with_own = df.withColumn("chunk", own).withColumn("__n", chunks.cast("int"))
    dealt = with_own.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return dealt.withColumn("x", F.least("chunk", "__o")).withColumn("y", F.greatest("chunk", "__o")).drop("__n", "__o")
