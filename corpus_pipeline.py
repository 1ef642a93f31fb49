"""Corpus pipeline: toxicity, line dedup, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet to the shared folder and reads it again for the next.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probity.llm.common import materialise
from probity.llm.decontaminate import drop_contaminated
from probity.llm.jaccard_join import drop_near_copies
from probity.llm.line_dedup import drop_repeated_lines
from probity.llm.packing import pack_documents
from probity.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic.

    Null and empty texts, null ids and repeated rows stay; an empty table stays empty.
    Columns besides doc_id and text pass through.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three of them share, except in the largest doc_id.

    Every row stays; null texts stay null, rows without an id keep all lines, repeated rows are cut alike.
    Columns besides doc_id and text pass through.
    """
    return drop_repeated_lines(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies.

    Texts without words, and rows without an id, have no copies and stay; of repeated rows of the doc_id kept, all stay.
    Columns besides doc_id and text pass through.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and null ids stay; benchmark items without words match nothing.
    Columns besides doc_id and text pass through.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece in sequences of 4096.

    Null and empty texts are one end mark; every row, also a repeated one, is packed.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: The toxicity votes and the packing are no SQL; tests/llm/test_pipeline.py runs each stage and all of them on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
