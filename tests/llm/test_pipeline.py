"""The pipeline's stages, one by one and together."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from tests.llm.tables import awkward, empty, tuples
from tests.llm.test_pairs import _fingerprint_roots
from tidings.llm import boosted, mixing, surrogates

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(awkward(spark, clashing=False).withColumn("doc_id", F.col("doc_id") + 1_000_000)).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_the_brief():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert queries()["pipeline"] is not None


def test_each_stage_takes_effect_on_all_it_is_given(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    trees = boosted.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~boosted.held_out()))
    assert tuples(kept) == tuples(boosted.score(docs, trees).where("score >= 0.7").drop("score"))
    assert 0 < kept.count() < docs.count()

    once = corpus_pipeline.near_duplicates(spark, docs, folder)
    prints, roots = _fingerprint_roots([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert once.count() == len({roots[p] for p in prints}) and once.columns == docs.columns

    masked = corpus_pipeline.personal_data(spark, docs, folder)
    key = surrogates.Permutation(corpus_pipeline.SURROGATE_KEY)
    expected = [(*r[:1], r[1] and surrogates.pseudonymised(r[1], key)[0], *r[2:]) for r in map(tuple, docs.collect())]
    assert tuples(masked) == sorted(expected, key=repr)
    assert tuples(masked) != tuples(docs)

    mixed = corpus_pipeline.mixture(spark, docs, folder)
    assert mixed.select(F.sum(mixing.words(F.col("text")))).first()[0] == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixed.columns == docs.columns

    ids = corpus_pipeline.token_ids(spark, docs, folder)
    assert ids.count() == docs.count() and ids.where("not restored").count() == 0


def test_stages_keep_further_columns_and_pass_empty_tables(spark, folder):
    odd = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns, name
        assert stage(spark, empty(spark), folder).count() == 0, name
    assert stage(spark, empty(spark), folder).columns == empty(spark).columns


def test_whole_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert tuples(corpus_pipeline.run(spark, folder)) == tuples(docs)
