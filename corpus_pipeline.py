"""The corpus pipeline: toxicity, near-duplicates, repeated byte strings, benchmark passages, mixing.

Every stage works on all that the stage before kept. Rows are matched to decisions by doc_id, text and all:
a decision belongs to an id, so rows that repeat an id share it. Rows without an id are never duplicates and
lose no strings; the other stages judge them by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmap.llm import decontaminate, mixing, ngram_jaccard, suffix_dedup, toxicity
from workmap.llm.common import discard, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of these documents.

    Null and empty texts score as texts without words; rows that repeat score alike and go or stay together; rows without an id
    are scored, too, but never learnt from. Without labels of both kinds nothing is rejected. Columns other than the five of
    documents are left out, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest id.

    Null and empty texts, and rows without an id, are no duplicates and stay; rows that repeat an id are one document and stay
    or go together.
    """
    gone = ngram_jaccard.join(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that one with a smaller id has; characters that would go only in part stay.

    Null texts stay null, texts of under 50 bytes whole; rows of one id take nothing from each other, rows without an id neither
    give nor lose. A document may be left without text but is never dropped.
    """
    return suffix_dedup.cut_rows(docs, COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth of the words.

    Each row is judged by itself where it is, so repeated rows and rows without an id are judged alike; null and empty texts are
    clean, and so is everything where the benchmark is empty.
    """
    return decontaminate.judge_rows(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mixture, with the factor and the probability of their cell.

    Null sources and languages are values of their own; null and empty texts have no weight and are drawn by the share alone. A
    draw depends on the id: rows that repeat one go or stay together, and so do all rows without.
    """
    return mixing.mix_rows(docs, COLUMNS).where("kept").drop("kept")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeated_strings),
    ("benchmark passages", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            discard(before)  # what the stage before wrote has been read
    return docs
