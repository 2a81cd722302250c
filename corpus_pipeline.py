"""A corpus from the documents table: five stages, each one operator of foliospark.llm.

All stages take tables without rows, null in any column, texts of any length, rows repeated in
full and extra columns of any name; a stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored, table
from foliospark.llm.decontamination import contamination
from foliospark.llm.jaccard import near_duplicates
from foliospark.llm.language_id import identify, train
from foliospark.llm.packing import pack
from foliospark.llm.suffix_array import remove_repeats

#: The suffix stage removes repeats of so many bytes, and of so many words where these are shorter.
#: A choice of this stage: both are what a passage of over 50 words may have, and neither implies
#: the other (51 short words have fewer than 250 bytes, 250 bytes may be one word).
PASSAGE_BYTES = 250
PASSAGE_WORDS = 51


def _whole(docs: DataFrame) -> DataFrame:
    """The other columns as one struct beside the text, so that no extra column clashes with a
    result."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), F.col("text").alias("__body"))


def _again(docs: DataFrame, got: DataFrame, **new) -> DataFrame:
    """The columns of docs from what an operator made of `_whole(docs)`."""
    return got.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; lang becomes the one that was found. Null texts, texts
    without letters and those beyond their language's calibrated cross-entropy go; repeated rows
    stay or go alike. Rows without an id teach the models nothing and are judged as others.
    Where nothing can be learned (no language given) everything goes."""
    got = identify(_whole(docs), train(docs), "__body", keep=("__row", "__body")).where(~F.col("rejected"))
    return _again(docs, got, text=F.col("__body"), lang=F.col("lang_pred"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that Jaccard links make up. Rows without
    an id are known by their text and stand behind all that have one; of rows with one id and
    text one stays."""
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    known = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), by_text))
    kept = near_duplicates(known, "__id").where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return known.join(kept, "__id", "left_semi").dropDuplicates(["__id", "text"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_BYTES bytes or PASSAGE_WORDS words or more that occur
    anywhere else, in all their places (there is no first one that stays, so no ties). A
    document that is all such passages stays with an empty text; null and empty texts come out
    empty. Rows repeated in full count as copies of each other."""
    got = remove_repeats(_whole(docs), "__body", PASSAGE_BYTES, keep=("__row",), words=PASSAGE_WORDS)
    return _again(docs, got, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows; exactly a twentieth
    goes. Null and empty texts have no words and stay; so does all where the benchmark is empty."""
    got = contamination(_whole(docs), table(spark, sf_dir, "benchmark"), "__body", keep=("__row", "__body"))
    return _again(docs, got.where(~F.col("contaminated")), text=F.col("__body"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences: doc_id and the columns of
    `foliospark.llm.packing.pack`. A null or empty text is one piece of the end token; repeated
    rows are documents of their own. Which of equally long pieces stands where is not fixed."""
    return pack(docs, keep=("doc_id",))


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]
#: Language models, MinHash and tokens have no SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
