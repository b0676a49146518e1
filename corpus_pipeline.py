"""The corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark leaks, packing.

``run`` applies ``STAGES`` in order; each stage reads what its predecessor kept, written as Parquet.  All stages but the
last return the columns of ``documents``.  A stage handles null doc_ids and texts, empty tables, repeated rows and extra
columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm.common import stored
from geoweave.llm.decontaminate import decontaminate
from geoweave.llm.minhash import deduplicate
from geoweave.llm.packing import pack
from geoweave.llm.suffixes import remove_repeats
from geoweave.llm.toxicity import reject_toxic
from geoweave.plans.tables import read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return deduplicate(docs, threshold=80)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur more than once in what is left of the corpus."""
    return remove_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents and their places in training sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("repeated_strings", repeated_string_stage),
          ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: No stage but the shingle count has an SQL form; tests/llm checks the run against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
