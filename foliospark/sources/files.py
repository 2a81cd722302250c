"""Readers and writers of run artifacts: file listings, predictions, traces, scores, caches."""

from __future__ import annotations

import tempfile
import uuid
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image extensions that runs accept, and those that evaluation accepts.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
EVALUATION_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".gif")
CSV = {"header": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only in local mode."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_name(path: Column | None = None) -> Column:
    """The last part of a path as it is; without one, of the row's file, whose path Spark gives as
    a URI."""
    if path is not None:
        return F.regexp_extract(path, r"([^/]+)$", 1)
    return _decoded(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def _decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, limit: int | None = None) -> DataFrame:
    """(name, stem, path, bytes) of files by extension in any case, in name order; contents are
    not read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes")).withColumn("name", file_name(F.col("path")))
    rows = rows.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*extensions)).withColumn("stem", stem(F.col("name")))
    rows = rows.select("name", "stem", "path", "bytes").orderBy("name")
    return rows if limit is None else rows.limit(limit)


def repeated_stems(files: DataFrame) -> DataFrame:
    """(stem, name, n) of the files whose stem n files have; nothing may be written by stem then."""
    names = files.select("stem", "name").distinct()
    return names.join(names.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "stem").select("stem", "name", "n")


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _entries(glob: str, recursive: bool):
    """(name, folder) of what is in each folder, without hidden names; with `recursive` the files in
    it and below."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                system, base = fs.FileSystem.from_uri(todo.pop())
                scheme = batch.column(0)[0].as_py().partition(":")[0]
                names, folders = [], []
                for info in system.get_file_info(fs.FileSelector(base)):
                    if info.base_name[:1] in "._":
                        continue
                    at = f"{scheme}://{quote(info.path)}"
                    if info.type == fs.FileType.Directory:
                        folders.append(at)
                    elif fnmatchcase(info.base_name, glob):
                        names.append(at)
                if recursive:
                    todo += folders
                    folders = []
                for k in range(0, len(names), 10_000):
                    part = names[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([False] * len(part))], names=["name", "folder"])
                if folders:
                    yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array([True] * len(folders))], names=["name", "folder"])

    return run


def listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(name, stem) of the files in a folder and below. A scan leaves empty files out, so names are
    listed: the folder by one task, what is below each of its sub-folders by tasks of their own,
    and no name comes to the driver. Folders of a store that pyarrow can't open are listed by
    Spark's driver, as it does for any scan."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_uri(folder))
    except (pa.ArrowInvalid, OSError, ValueError):
        paths = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").format("binaryFile").load(folder).inputFiles()
        names = spark.createDataFrame([(p,) for p in paths], "name string")
    else:
        top = spark.range(1).select(F.lit(_uri(folder)).alias("name")).mapInArrow(_entries(glob, False), "name string, folder boolean")
        below = top.where("folder").select("name").repartition("name").mapInArrow(_entries(glob, True), "name string, folder boolean")
        names = top.where("NOT folder").union(below).select("name")
    return names.withColumn("stem", stem(_decoded(file_name(F.col("name")))))


def require_unique_stems(files: DataFrame) -> None:
    """A ValueError with an example where a stem has several files."""
    if found := repeated_stems(files).select("stem", "n").first():
        raise ValueError(f"{found.n} files have the stem {found.stem!r}")


def prediction_texts(spark: SparkSession, folder: str, excluded: str | None = None) -> DataFrame:
    """(stem, text) of the Markdown files in a folder and below, whole, without one excluded stem.
    A stem of several files is an error; for that, and for empty files, names are listed."""
    keep = F.lit(True) if excluded is None else F.col("stem") != excluded
    names = listed(spark, folder, "*.md").where(keep)
    require_unique_stems(names)
    texts = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    texts = texts.select(stem(file_name()).alias("stem"), F.col("value").alias("text")).where(keep)
    full = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").format("binaryFile").load(folder).select(stem(file_name()).alias("stem"))
    return texts.union(names.select("stem").join(full, "stem", "left_anti").select("stem", F.lit("").alias("text")))


def write_named_texts(rows: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """Writes each row's text to the file that `name` says, in `folder` of any file system that
    pyarrow opens; returns (name, bytes). A repeated task writes the same files again. Bytes go
    to the file from the Arrow batch, as they are and a text at a time, so a task holds no more
    than the batch, which Spark bounds (spark.sql.execution.arrow.maxBytesPerBatch)."""
    at = _uri(folder)

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(at)
        system.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = t.as_buffer() if t.is_valid else b""
                with system.open_output_stream(f"{base}/{n}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInArrow(run, "name string, bytes long")


def trace_events(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(page, line, event, problem) of JSON-lines traces, a file a page: blank lines are left
    out; problem says what is wrong with a line: no strict JSON object, or another page's.
    With strict such a line is an error when it is read."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).select(stem(file_name()).alias("page"), F.col("value").alias("line")).where(F.trim("line") != "")
    event = F.try_parse_json("line")
    is_object = F.coalesce(F.schema_of_variant(event).startswith("OBJECT"), F.lit(False))
    own = F.try_variant_get(event, "$.page", "string")
    problem = F.when(~is_object, "not a JSON object").when(~own.eqNullSafe(F.col("page")), "another page")
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("trace of page "), "page", F.lit(": "), problem)).cast("string"))
    return rows.withColumn("event", event).withColumn("problem", problem)


def empty_traces(spark: SparkSession, folder: str) -> DataFrame:
    """(page) of trace files without a line, those without a byte too."""
    files = listed(spark, folder, "*.jsonl").select(F.col("stem").alias("page"))
    return files.join(trace_events(spark, folder).select("page"), "page", "left_anti")


def component_samples(spark: SparkSession, folder: str, glob: str, component: str, metric: str, multi_line: bool = True) -> DataFrame:
    """Scorer samples (component, img_id, gt_idx, gt_position, gt, pred, score) of result files: a
    list of objects a file, or an object a line. Lists of one index become the index."""
    schema = f"img_id string, gt_idx string, gt_position string, gt string, pred string, metric struct<`{metric}`: double>"
    rows = spark.read.schema(schema).option("multiLine", multi_line).option("pathGlobFilter", glob).option("mode", "FAILFAST").json(folder)
    index = F.regexp_replace("gt_idx", r"^\[([^,\]]*)\]$", "$1")
    return rows.select(F.lit(component).alias("component"), "img_id", index.alias("gt_idx"), "gt_position", "gt", "pred", F.col(f"metric.{metric}").alias("score"))


def sample_scores(texts: DataFrame, metric: str = "CDM") -> DataFrame:
    """(page, id, score) of score files, a JSON text a row in column value, in any accepted shape:
    a list of samples, page -> list of samples, page -> sample, or `page_[id]` -> number. Rows
    without a number are left out; true and false are no numbers."""
    each = texts.sparkSession.tvf.variant_explode
    kind = lambda c: F.schema_of_variant(c)
    root = texts.select(F.try_parse_json("value").alias("v")).where(kind("v").rlike("^(OBJECT|ARRAY)"))
    top = root.lateralJoin(each(F.col("v").outer()))
    top = top.select(F.when(kind("v").startswith("ARRAY"), F.try_variant_get("value", "$.img_id", "string")).otherwise(F.col("key")).alias("key"), "value", kind("v").startswith("OBJECT").alias("named"))
    lists = F.col("named") & kind("value").startswith("ARRAY")
    inner = top.where(lists).select("key", F.col("value").alias("list")).lateralJoin(each(F.col("list").outer()).select(F.col("value").alias("item")))
    rows = inner.select("key", F.col("item").alias("value")).union(top.where(F.coalesce(~lists, F.lit(True))).select("key", "value"))
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), v.cast("double"))
    found = F.coalesce(number(F.col("value")), *[number(F.try_variant_get("value", p, "variant")) for p in (f"$.metric.{metric}", f"$.{metric}", "$.score")])
    keyed = F.col("key").rlike(r"(?s)^.*_\[.*\]$")
    page = F.when(keyed, F.regexp_extract("key", r"(?s)^(.*)_\[(.*)\]$", 1)).otherwise(F.col("key"))
    return rows.select(page.alias("page"), F.when(keyed, F.regexp_extract("key", r"(?s)^(.*)_\[(.*)\]$", 2)).otherwise("").alias("id"), found.alias("score")).where("score IS NOT NULL")


def strict_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """Adds parsed (a variant) and problem: NaN, Infinity, repeated keys, broken JSON and roots
    that aren't objects are refused."""
    v = F.try_parse_json(value)
    problem = F.when(v.isNull(), "not strict JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    return texts.withColumn("parsed", v).withColumn("problem", problem)


def response_cache(texts: DataFrame, value: str = "value") -> DataFrame:
    """(key, text) of a cache file's text: {entries: {key: text}} or {key: text}; an entry that
    isn't a text is an error."""
    v = F.try_parse_json(value)
    entries = F.coalesce(F.try_variant_get(v, "$.entries", "variant"), v)
    rows = texts.select(entries.alias("v")).lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()))
    text = F.when(F.schema_of_variant("value") == "STRING", F.col("value").cast("string")).otherwise(F.raise_error(F.lit("cache entries must be texts")))
    return rows.select("key", text.alias("text"))


def write_canonical_jsonl(rows: DataFrame, folder: str) -> None:
    """Compact JSON with sorted keys, a line a row."""
    rows.select(F.to_json(F.parse_json(F.to_json(F.struct(*rows.columns)))).alias("value")).write.text(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.json(folder)


def write_csv(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """CSV with a header and a fixed order of columns; \\N is null, so that empty texts stay."""
    rows.select(*columns).write.options(**CSV).option("quoteAll", True).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.options(**CSV).schema(schema).csv(folder)


def write_page_texts(rows: DataFrame, folder: str, page: str = "page", text: str = "markdown") -> None:
    """A folder page=<page> for each page with its text in it."""
    rows.select(page, F.col(text).alias("value")).write.partitionBy(page).text(folder)


def read_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True)


def redacted_trace(events: DataFrame, payload: str = "payload") -> DataFrame:
    """A trace ready to be written: secrets gone from the payload (a map of texts), its fingerprint
    beside it."""
    from foliospark.functions.json_values import fingerprint
    from foliospark.functions.text import redact_map

    clean = events.withColumn(payload, redact_map(F.col(payload)))
    return clean.withColumn("payload_fingerprint", fingerprint(F.to_json(payload)))
