"""Each stage of the pipeline on its own input, odd rows, and the whole run."""

import brute
import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ODD = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "!!! 12", "en", "s", 6), (9004, "the of and " * 3000, None, None, 1), (None, "thing of the and", "en", "s", 3)]


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS)
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema))


def test_stages_one_by_one(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing_to_targets"]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, documents, SMALL).cache()
    gone = {r.doc_id for r in documents.collect()} - {r.doc_id for r in one.collect()}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 5 and one.columns == COLUMNS
    assert one.where("lang is null").count() == 0

    two = stages["simhash_near_dedup"](spark, one, SMALL).cache()
    prints = {r.doc_id: brute.simhash(r.text) for r in one.collect() if r.doc_id is not None}
    classes = brute.near_classes(prints)
    assert sorted(r.doc_id for r in two.collect() if r.doc_id is not None) == sorted(set(classes.values())) and two.columns == COLUMNS

    three = stages["suffix_array_dedup"](spark, two, SMALL).cache()
    again = brute.repeats([(r.doc_id, r.text) for r in two.where("doc_id is not null").collect()])
    for r in three.where("doc_id is not null").collect():
        n, removed, _, _ = again[r.doc_id]
        assert n - removed - 6 <= len(r.text.encode()) <= n - removed and (removed or len(r.text.encode()) == n)

    four = stages["benchmark_decontamination"](spark, three, SMALL).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rest = {r.doc_id for r in four.collect()}
    for r in three.collect():
        if len(r.text) < 4000:
            assert (r.doc_id in rest) == (not brute.best_windows(r.text, items)), r.doc_id
    assert four.columns == COLUMNS

    five = stages["mixing_to_targets"](spark, four, SMALL).collect()
    assert {r.doc_id for r in five} <= rest and all(0 < r.taken <= 2 * r["size"] for r in five)


def test_run_and_empty_documents(spark, documents, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents.where(F.lit(False)).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ["__low", "__id", "__digest", "__one", "__two", "__cuts", "__whole", "lang_pred", "score", "component", "fp", "hidden_5"]


def test_stages_keep_columns_with_their_own_names(spark, documents):
    """Clashing columns come back as they went in, a third of the ids being null."""
    rows = documents.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.md5(F.coalesce("text", F.lit("")))).alias(c) for c in CLASHING])
    rows = rows.withColumn("doc_id", F.when(F.xxhash64("text") % 3 != 0, F.col("doc_id")))
    before = {tuple(r) for r in rows.select(*CLASHING).collect()}
    plain = documents.withColumn("doc_id", F.when(F.xxhash64("text") % 3 != 0, F.col("doc_id")))
    for name, function in corpus_pipeline.STAGES[:-1]:
        got, want = function(spark, rows, SMALL), function(spark, plain, SMALL)
        assert got.columns == rows.columns, name
        found = got.collect()
        assert {tuple(r[c] for c in CLASHING) for r in found} <= before, name
        key = lambda r: (str(r.doc_id), str(r.text), str(r.lang), str(r.source), str(r.n_chars))
        assert sorted(map(key, found)) == sorted(map(key, want.collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == corpus_pipeline.STAGES[-1][1](spark, plain, SMALL).count()


def test_language_sample_holds_without_ids(spark):
    from duoscreen.llm import language

    rows = spark.range(6000).select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    chosen = language.sampled(rows, F.create_map(F.lit("en"), F.lit(150 / 6000))).count()
    assert 100 < chosen < 200
