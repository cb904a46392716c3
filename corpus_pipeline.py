"""From raw documents to packed training sequences: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logrung.llm.decision_list import fit, kept_rows
from logrung.llm.language_id import accepted_rows
from logrung.llm.mixing import mixed_rows
from logrung.llm.packing import pack, token_pieces
from logrung.llm.parity_join import one_of_each
from logrung.llm.registry import table
from logrung.session import landed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model accepts; the models learn from the documents given.

    Null texts and texts without a letter go.
    """
    return accepted_rows(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``.

    Texts of fewer than ten words, null ones among them, go.
    """
    return kept_rows(docs, fit(docs, table(spark, sf_dir, "labels")))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the one with the smallest id."""
    return one_of_each(docs, words=5, num=8, den=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets; a document that is taken k times is there k times."""
    return mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 2048."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(docs, path, spaces_kept=False, end_id=0))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the language models nor the learned rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
