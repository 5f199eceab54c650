"""Corpus pipeline: quality rules, line dedup, near-duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage's result is written as Parquet to the shared folder and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.

In every stage a null text is one without words (packed as the end id alone), null doc_ids and
columns of any name pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import linededup, packing, quality, simhash
from lexweave.llm.common import load, stored
from lexweave.llm.queries import byte_ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep, by their posterior alone. Repeated rows
    count as often and are judged alike."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; the least doc_id keeps them, in all of its
    rows. A document may end up empty; a null text stays null."""
    return linededup.clean_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at five-word similarity 0.8: that with the least
    doc_id (nulls last), then the least hash of its words, then the least text; of repeated rows
    one. Texts without words are one group."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in training sequences. Repeated rows are
    packed each."""
    return packing.pack(docs, byte_ids)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Components of near-duplicates, tokenization and packing are not expressible in SQL;
#: tests/llm/test_pipeline.py holds ``run`` against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
