"""The pipeline: every stage on odd rows, and the whole of it against plain Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from spanguard.llm import queries
from test_corpus import ROWS, SCHEMA, brute_repeats

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (7000, "word " * 30000, "en", "s", 0)]
    return spark.createDataFrame(ROWS + odd, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_nothing(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert (set(out.columns) >= {"doc_id", "n_tokens"}) if name == "encode" else out.columns == NAMES
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_stages_do_their_work(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs.where("doc_id is null or doc_id < 7000"), SF)
    ids = {r[0] for r in good.select("doc_id").collect()}
    assert not ids & {500, 501, 503, 504, 505, 506, 508, None} and 507 in ids
    left = stages["suffix_dedup"](spark, docs.where("doc_id < 400"), SF)
    want = {(r[0], r[4].decode("utf-8", "ignore")) for r in brute_repeats([r for r in ROWS if r[0] < 400], 50)}
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == want
    assert left.where(F.col("n_chars") != F.char_length("text")).count() == 0
    mixed = stages["mix_sources"](spark, docs, SF).groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert 1 <= mixed <= 4  # two rows of the input are equal


def test_run_applies_all_stages(spark):
    whole = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_a_query_for_every_operator():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries.REGISTRY) == 1
    assert set(queries.SQL) <= set(queries.REGISTRY)
