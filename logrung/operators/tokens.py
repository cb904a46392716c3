"""Placeholder vocabulary and tokenised text."""

from __future__ import annotations

from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.functions.text import placeholders

PLACEHOLDER = r"<[^<>\s]+>"


def token_vocabulary(df: DataFrame, text: str = "text", pattern: str = PLACEHOLDER) -> DataFrame:
    """Distinct placeholder tokens of a text column (any split), sorted."""
    return (
        df.select(F.explode(placeholders(F.col(text), pattern)).alias("token"))
        .distinct()
        .orderBy("token")
    )


def new_tokens(discovered: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens not yet in the vocabulary."""
    return discovered.select("token").distinct().join(vocabulary.select("token"), "token", "left_anti")


def register_tokens(vocabulary: DataFrame, discovered: DataFrame) -> tuple[DataFrame, int]:
    """The grown vocabulary and the number of tokens added."""
    added = new_tokens(discovered, vocabulary)
    return vocabulary.select("token").unionByName(added), added.count()


def tokenizer(text: str = "text", output: str = "words") -> RegexTokenizer:
    """White-space tokenizer; placeholders stay whole and keep their case."""
    return RegexTokenizer(inputCol=text, outputCol=output, pattern=r"\s+", toLowercase=False)


def tokenize(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """Replace the text column by its tokens, all of them or the first ``limit``."""
    words = tokenizer(text, "_words").transform(df)
    kept = F.col("_words") if limit is None else F.slice("_words", 1, limit)
    return words.withColumn("words", kept).drop(text, "_words")
