"""Balanced corpus sample: counts, quotas, hash-drawn rows, text chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logrung.operators.sampling import (
    LINES_PER_FILE,
    SAMPLE_SEED,
    SAMPLE_TOTAL,
    assign_chunks,
    dataset_budgets,
    level_counts,
    level_quotas,
    stratified_sample,
)
from logrung.session import landed
from logrung.sources.files import scan_parsed
from logrung.sources.sinks import write_chunks

ROW_ID = ("file_path", "block", "pos")


@dataclass(frozen=True)
class CorpusSample:
    quotas: DataFrame
    chunked: DataFrame
    files: list[str]
    sampled: int
    shortfall: int


def balanced_sample(
    rows: DataFrame, ids: tuple[str, ...], total: int = SAMPLE_TOTAL, seed: int = SAMPLE_SEED
) -> tuple[DataFrame, DataFrame]:
    """(quotas, sampled rows) over parsed rows with dataset, raw_line, line_level.

    The parse is written once; counting and drawing read that table.
    """
    parsed = landed(rows.select("dataset", "raw_line", "line_level", *ids), "parsed")
    counts = landed(level_counts(parsed), "level-counts")
    quotas = landed(level_quotas(counts, dataset_budgets(counts, total)), "level-quotas")
    return quotas, stratified_sample(parsed, quotas, ids, seed)


def build_corpus(
    spark: SparkSession,
    root: str,
    stem: str,
    total: int = SAMPLE_TOTAL,
    lines_per_file: int = LINES_PER_FILE,
    seed: int = SAMPLE_SEED,
) -> CorpusSample:
    """Sample the logs below ``root`` and write them as shuffled chunks
    ``<stem>_001.log`` and so on.

    A dataset that cannot fill its budget leaves a shortfall, which is
    reported and not shared out among the others.
    """
    quotas, sample = balanced_sample(scan_parsed(spark, root), ROW_ID, total, seed)
    if quotas.isEmpty():
        raise FileNotFoundError(f"no usable log entries below {root}")
    chunked = landed(assign_chunks(sample, ROW_ID, lines_per_file, seed), "corpus-chunks")
    sampled = chunked.count()
    files = write_chunks(chunked, stem) if sampled else []
    return CorpusSample(quotas, chunked, files, sampled, max(0, total - sampled))
