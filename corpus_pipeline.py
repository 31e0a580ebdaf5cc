"""A corpus pipeline of the llm operators: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import ffd, similar, suffix, toxicity
from cohortlake.llm._common import cut, without
from cohortlake.llm.queries import WORDS
from cohortlake.sources.tables import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels of the tables, does not call toxic.

    Null and empty texts stay; very long ones are judged by their worst passage; repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (5-word shingles, similarity 0.8): that of smallest doc_id (null last), the first of equal ones.

    Texts without words, null or empty, are one class. Columns of any other name stay as they are.
    """
    own = "__row"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    found = similar.similar_documents(rows, own, ("doc_id",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", own)).getField(own).alias(own)
    gone = found.join(found.groupBy("component").agg(first), own, "left_anti").select(own)
    return without(rows, own, cut(gone)).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that stand earlier in the corpus, cut at whole characters."""
    removed = suffix.remove_repeats(docs, whole=True)
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    return removed.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null text is empty and still a piece, the end mark alone. Workers that
    other stages use as well keep fewer chunks, and nothing beyond a task; a
    task has one of them.
    """
    return ffd.pack_texts(docs, WORDS, cache=300_000, keep=False)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: SQL has neither the classifier nor XXH64, so tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each is written as Parquet in the shared folder and read again.

    A stage's table is deleted when the next but one is written; the last one
    is read by the result and stays with it.
    """
    folder = shared_folder(spark, "pipeline")
    last = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
