"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritill.llm import bpe, mixing, neardups, quality, secrets, textops

STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", neardups.keep_one),
    ("secrets", secrets.mask_secrets),
    ("mixing", mixing.mixed),
    ("tokens", bpe.tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir; what a stage wrote on the way is deleted once its rows are stored."""
    docs = before = textops.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with textops.scratch():
            docs = textops.stored(stage(spark, docs, sf_dir), lasting=True)
        textops.release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
