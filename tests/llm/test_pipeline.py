"""The pipeline: each stage on its input, and the whole."""

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logrung.llm.decision_list import fit, quality_table
from logrung.session import landed

SF = "/root/testdata/sf0.001"


def test_stages_and_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = landed(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= ids
        ids = kept[name]
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["language_id"] for i in clean) > 0.99 * len(clean)
    assert sum(i in kept["quality_rules"] for i in clean) > 0.95 * len(clean)
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in docs.select("text").collect()]
    tokens = sum(len(e.ids) + 1 for e in tokenizer.encode_batch(texts, add_special_tokens=False))
    assert sum(r.length for r in rows) == tokens
    whole = pipeline.run(spark, SF).collect()
    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, whole)) == sorted(map(key, rows))


def test_quality_stage_agrees_with_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert fit(docs, labels)
    want = {r.doc_id for r in quality_table(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in pipeline.quality_stage(spark, docs, SF).collect()} == want


def test_quality_stage_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    kept = pipeline.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()
    assert len(junk & {r.doc_id for r in kept}) <= 0.05 * len(junk)


def test_stages_take_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("c")).withColumn("node", F.lit(3))
    odd = docs.limit(40).unionByName(
        spark.createDataFrame(
            [(None, None, None, None, None, "c", 1), (5, "", "xx", None, 0, "c", 1), (5, "", "xx", None, 0, "c", 1), (7, "w " * 30_000, None, "s", None, "c", 1)],
            docs.schema,
        )
    )
    for table in (odd, docs.limit(0)):
        now = table
        for _, stage in pipeline.STAGES[:-1]:
            now = landed(stage(spark, now, SF), "test-stage")
            assert now.columns == docs.columns
        pipeline.STAGES[-1][1](spark, now, SF).collect()
