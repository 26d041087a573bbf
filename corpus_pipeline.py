"""A training-data pipeline over ``documents``: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; further columns go along, whatever their names, up to
the last stage; an empty table stays empty. ``run`` writes each stage's result to the shared folder and reads it again, so a lost executor costs
one stage's tasks at most; what a stage wrote on its way is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import common, decontaminate, near_dups, pieces, pii, quality, vocab


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A null text is empty; null sources and languages are sites of their own; repeated rows are judged one by one; without labels, all stay.
    """
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): the one with the least id.

    Texts without words (null, empty, blanks) are near nothing: all stay, but for rows that repeat an id and such a text. Rows with null or repeated
    ids are told apart by their texts; of equal rows one stays.
    """
    return near_dups.keep(docs, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none covers 0.8 of an item's words. Texts and items without words match nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text. A null text stays null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the check that they give back its text. A null text has none."""
    return pieces.encode(docs, vocab.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: No SQL: stages fit classifiers and run Python kernels. Tests hold it against plain Python, the quality stage's labels apart (they have tests of their own).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.written() as made:
        for name, stage in STAGES:
            docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            common.drop(spark, made[:-1])
            del made[:-1]
    return docs
