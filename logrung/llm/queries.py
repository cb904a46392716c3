"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrung.llm import checks
from logrung.llm.bit_sliced import search_table
from logrung.llm.decision_list import quality_table
from logrung.llm.fill_in_middle import fill_in_middle, restored
from logrung.llm.html_template import extract_main_text
from logrung.llm.hyperplane_tree import hard_negatives
from logrung.llm.language_id import language_table
from logrung.llm.license_scan import scan_licences
from logrung.llm.mixing import mixed_sizes
from logrung.llm.parity_join import jaccard_components
from logrung.llm.packing import pack, token_pieces
from logrung.llm.registry import query, table
from logrung.llm.rule_ensemble import quality_scores
from logrung.llm.token_store import read_documents, write_tokens
from logrung.llm.url_filter import build_digests, judge


@query("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_tokens(table(spark, sf_dir, "documents"), path, spaces_kept=True, end_id=2)
    return read_documents(spark, manifest)


@query("op2_bit_sliced_top_k", checks.TOP_K)
def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector, against all rows."""
    return search_table(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 256.0, 5, exact=True)


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op3_url_filter", checks.URL_FILTER)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    shards = build_digests(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), shards)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_html_template")
def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_mixing", checks.MIXING)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixed_sizes(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard", checks.JACCARD)
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles overlap by nine tenths or more."""
    found = jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_rule_ensemble")
def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_decision_list")
def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the learned list on every document."""
    found = quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[F.col(f"_stats.{c}").alias(c) for c in base], "base_failed", "kept", "rule")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_table(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(table(spark, sf_dir, "documents"), path, spaces_kept=False, end_id=0))


@query("op11_fill_in_middle", checks.FILL_IN_MIDDLE)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and reordered, and rebuilt from its output."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or tagged in every document."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "obligation"
    )


@query("op13_hard_negatives", checks.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five best positives."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label")
    )
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, 256.0)
