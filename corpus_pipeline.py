"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files; each stage by an operator of marketloom.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Its result is written as Parquet in the
shared folder and read again. All stages but the last return the columns of documents.

Defined cases: a null or empty text has no words and is rejected by the first stage; rows of one doc_id are documents of their own, of
equal rows one stays; rows without doc_id link with nothing and stay; columns of any further names pass through all
stages but the last; an empty table gives an empty result. A document that the mix takes n times is written n times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import decontaminate, jaccard, mixing, quality, tokens
from marketloom.llm.common import shared_path

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_output", tokens.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The last stage's ids come from a tokenizer, which SQL doesn't have; tests compare the stages with brute-force versions.
ORACLE_SQL = None
