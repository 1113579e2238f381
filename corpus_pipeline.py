"""From raw documents to packed training sequences, one operator after the other.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read
again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipstack.llm import decontam, minhash, packing, suffixes, toxicity
from slipstack.llm.common import stored, table
from slipstack.session import clear_scratch, noted_scratch


#: Fixed value: a repeated passage of over 50 words is cut out, of usual or short words alike.
PASSAGE_WORDS = 51
#: Fixed value: near duplicates share this part of their shingles of five words, in percent.
SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = toxicity.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without id stay as they are.

    Different texts of one id are documents of their own and go by a number drawn from id and text; of equal rows one stays.
    """
    named, text = docs.where("doc_id is not null"), F.coalesce("text", F.lit(""))
    told = named.select("doc_id", F.xxhash64(text).alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = stored(told.where("low <> high").select("doc_id", F.lit(True).alias("_several")))
    keyed = named.withColumn("_key", F.col("doc_id"))
    if not several.isEmpty():
        own = F.xxhash64("doc_id", text).bitwiseOR(F.lit(-(1 << 63)))  # negative
        keyed = named.join(several, "doc_id", "left").withColumn("_key", F.when(F.col("_several"), own).otherwise(F.col("doc_id")))
    found = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), SIMILAR_PERCENT)
    kept = found.where("kept").select(F.col("doc_id").alias("_key")).distinct()
    single = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return single.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of the bytes of a window, that occur twice are cut out of the texts; n_chars is counted anew."""
    cut = suffixes.removed(docs, as_text=True, words=PASSAGE_WORDS)
    text = F.col("kept")
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. A text of a repeated or missing id is judged for itself."""
    key = F.struct("doc_id", F.xxhash64("text").alias("copy"))
    leaks = decontam.overlaps(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = leaks.select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(gone, "_key", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document and its place in a training sequence."""
    return packing.pack(packing.counted(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned scores, components and packing are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    What a stage has written for itself, and the input it no longer needs, is removed before the next.
    """
    docs, before = table(spark, sf_dir, "documents"), noted_scratch()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        clear_scratch(spark, keep=[*before, noted_scratch()[-1]])
    return docs
