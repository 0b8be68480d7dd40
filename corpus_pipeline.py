"""The corpus pipeline: five stages over ``documents``, each stored before the next one reads it.

Quality rules drop rejected documents; of each group of near copies one document stays; strings of 200
bytes that repeat anywhere are taken out of the texts; documents contaminated by the benchmark go; the
rest is encoded. Each stage takes and (but for the last) returns all columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, decontaminate, jaccard_join, quality_rules, queries, suffix_dedup
from pagewright.llm.common import scope, stash, table, unstash


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_rejected(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_component(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, queries.tokenizer_path(), keep_ids=True)


STAGES = [
    ("quality_rules", queries.job(apply_quality_rules)),
    ("jaccard_join", queries.job(drop_near_copies)),
    ("suffix_dedup", queries.job(remove_repeated_strings)),
    ("decontaminate", queries.job(decontaminate_benchmark)),
    ("bpe_encode", queries.job(encode)),
]

#: The stages are not expressible in SQL (shrunk host rates, near copies, byte strings, merges); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents. Once a stage is stored, what it was made from and its own intermediate tables are dropped."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scope(kept):
            kept.append(stash(stage(spark, docs, sf_dir), f"stage-{name}"))
        unstash(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
