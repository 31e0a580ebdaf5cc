"""Queries of this subpackage over the test tables, and the SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ffd, forest, licenses, onebit, quotes, rendezvous, simhash, suffix, suffix_sql, toxicity
from ._common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.link(table(spark, sf_dir, "conversations")))


def op2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_documents(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ffd.tokenize(table(spark, sf_dir, "documents"), WORDS)
    return ffd.pack(tokens, keep_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode_ids(ids, RANKS).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return onebit.nearest(rows, rows.where("vec_id % 20 = 0"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {q.__name__: q for q in (op1_quotes, op2_forest, op3_suffix, op4_rendezvous, op5_packing, op6_simhash, op7_bpe, op8_onebit, op9_licenses, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_forest": forest.ORACLE,
        "op3_suffix": suffix_sql.ORACLE,
        "op4_rendezvous": rendezvous.oracle(),
        "op8_onebit": onebit.ORACLE,
        "op9_licenses": licenses.oracle(),
    }
