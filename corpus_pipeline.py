"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Toxic documents go; of near-duplicates (five-word shingles with Jaccard similarity 0.8 or more, and chains of
such pairs) the one with the smallest id stays; bytes of passages that start
earlier go from the texts; documents with benchmark text go; what is left is packed. All stages but the
last return the columns of their input. SQL cannot express the trained model and the tilings, so
there is no SQL; the stages are tested against plain versions.

Defined results: a null text counts as empty, and empty texts are near copies of each other; other columns may be null
and may have any name. Rows without doc_id are judged by their text, but are no near copies of any row. Repeated rows are near
copies: one stays. An id with several texts is several documents; where two of them are in one group the smallest text
stays. An empty table gives no rows; without labels of both classes, or without benchmark items, a stage keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruletrace.llm.common import importable, shared_path, table
from ruletrace.llm.decontamination import drop_contaminated
from ruletrace.llm.near_copies import one_of_near_copies
from ruletrace.llm.packing import packing
from ruletrace.llm.suffix_dedup import without_repeats
from ruletrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return one_of_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return without_repeats(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_text),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
