"""From raw documents to a training mix: quality, exact copies, near copies, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results: empty documents give no rows; null texts count as empty; rows that repeat both identifier and text leave
one; documents that share an identifier but not their text are told apart by exact dedup and treated as one afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontaminate, exact_dedup, mix, near_dedup, quality
from tallyspark.llm.common import shared_dir, stored

#: The classifier only rejects what it is fairly sure of, so that clean documents stay.
LEAST_TAIL = 0.35
#: A document is dropped when benchmark windows cover more than this share of its words; otherwise they are cut out.
MAX_HIT_SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, ratings, "grade", select_grade=1, least_tail=LEAST_TAIL)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_share=MAX_HIT_SHARE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, n_blocks): how many words the training mix takes of each document."""
    return mix.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", cut_benchmark),
    ("mix", mix_sources),
]

#: The classifier and the signatures can't be expressed in SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
