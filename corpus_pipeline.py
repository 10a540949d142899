"""A training-data pipeline over `documents`: language ID, near duplicates, benchmark decontamination, personal data, tokens.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the last adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquarry.llm import bpe, decontaminate, langid, ngram_join, pii
from lumenquarry.llm.common import save, table
from lumenquarry.llm.queries import SURROGATE_KEY, tokenizer

ORACLE_SQL = None  # language posteriors, surrogates and BPE have no SQL form; tests/llm compare the operators and the near-duplicate stage with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or whose language isn't likelier than all others together, go."""
    return langid.keep_identified(docs, table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (nulls last), of equal ids the first. Texts without words stay."""
    rows = save(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline_rows")
    found = save(ngram_join.groups(rows, key="__row").where("n_shingles > 0"), "pipeline_groups")
    named = found.join(rows.select("__row", "doc_id"), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = found.select("__row").join(first, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans leave the texts; documents that are benchmark for the most part go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe.encode_table(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
