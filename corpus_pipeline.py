"""Five stages from raw documents to a mixing plan, each one of the operators in ``duoscreen.llm``.

A stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each result below the shared folder
and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscreen.llm import decontam, language, mixing, simhash, suffix
from duoscreen.llm.common import hidden_names, stage

#: A text is rejected below this share of its language among all corrected n-gram counts.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or without a clear language; a missing ``lang`` becomes the predicted one."""
    names = hidden_names(docs, "lang_pred", "score")
    docs = docs.withColumnsRenamed(names)
    found = language.predict(docs, language.fit(docs.filter(~language.held_out())))
    kept = found.filter((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns).withColumnsRenamed({v: k for k, v in names.items()})


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are taken out of the texts."""
    return suffix.without_repeats(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixing plan: documents of which words are taken, with sizes, targets and the words taken."""
    return mixing.mix(docs, whole=True).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_targets", mixing_to_targets),
]

#: SQL expresses neither the fingerprints nor the learned filters; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
