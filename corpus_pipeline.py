"""From raw documents to packed sequences: stages that each apply one operator of graphloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import cotraining, jaccard_join, mixing, packing, risk_rules
from graphloom.llm.common import set_aside, table, written

import public_tokenizers  # isort: skip  (after graphloom.llm, whose absence has to show first)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep, with their own columns.

    Null and empty texts have no words and go. Repeated rows are judged each. Columns of docs that are named like the
    operator's results come back as they were. No rows give no rows.
    """
    docs, own = set_aside(docs, *risk_rules.MEASURES, "base_failed", "kept")
    return own(risk_rules.judged(docs, table(spark, sf_dir, "labels")).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds neither low in quality nor toxic, with their own columns.

    Nulls in any column and empty texts are scored like others; equal rows share one verdict. Clashing columns come
    back as they were. Without labels all stay; no rows give no rows.
    """
    docs, own = set_aside(docs, "p_low_quality", "p_toxic", "quality", "kept")
    return own(cotraining.classified(docs, table(spark, sf_dir, "labels")).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id, with its own columns.

    Null texts and texts without words are like nothing and stay; of rows that agree in doc_id and text one stays, with
    the other columns of any one of them. A null doc_id stays only where its group has no other. No rows give no rows.
    """
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice, with their own columns.

    Documents without words are never taken; a null source is a source. Rows that agree in source, doc_id and size
    share one fate. Clashing columns come back as they were. No rows give no rows.
    """
    docs, own = set_aside(docs, "size", "source_size", "target", "copies")
    return own(mixing.pareto_mix(docs).withColumn("__copy", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END"))))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2,048.

    A null or empty text is its end alone; repeated rows are documents of their own; other columns of docs are not
    looked at. No rows give no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near duplicates", near_duplicates), ("source mix", source_mix), ("packing", packed_sequences)]

#: A trained classifier is beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of the table `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
