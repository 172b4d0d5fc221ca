"""Rendezvous sharding against a plain version."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanguard.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, slot string, size string, law int, _row_id string"


def plain(key, weights):
    def draw(s):
        digest = hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()
        return math.log((int(digest[:13], 16) + 0.5) / 2**52) / weights[s]
    return max((s for s in range(len(weights)) if weights[s]), key=lambda s: (draw(s), -s))


def test_query(spark, tmp_path):
    rows = [(i, "text ü" * (i % 5)) for i in range(300)] + [(7, "copy")] * 200 + [(None, "x"), (None, None), (None, "x"), (-2**63, None), (2**63 - 1, "w " * 300_000)]
    spark.createDataFrame([(*r, "a", "b", "c", 1, "d") for r in rows], SCHEMA).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op12_rendezvous_shards(spark, str(tmp_path)).collect()
    assert got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    body = [(i, (t or "").encode()) for i, t in rows]
    want = Counter((i, len(b) + 16, zlib.crc32(b), "key", plain(i, [1.0] * 40), plain(i, [1.0] * 41)) for i, b in body)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    again = sharding.op12_rendezvous_shards(spark, str(tmp_path)).collect()
    assert Counter(got) == Counter(again)


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("https://example.org/"), "id").alias("url"), F.lit("old").alias("shard"))
    weights = [1.0, 2.0, 0.0, 5.0]
    first = sharding.assign(keys, F.col("url"), weights)
    counts = {r["shard"]: r["count"] for r in first.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3}
    assert all(abs(counts[s] - 20_000 * w / 8) < 4 * math.sqrt(20_000 * w / 8) for s, w in enumerate(weights) if w)
    moved = sharding.assign(first.withColumnRenamed("shard", "before"), F.col("url"), [*weights, 2.0]).where("before <> shard")
    assert {r[0] for r in moved.select("shard").distinct().collect()} == {4}
    assert abs(moved.count() - 4000) < 4 * math.sqrt(4000)
    sample = {r["url"]: r["shard"] for r in first.limit(50).collect()}
    assert all(plain(u, weights) == s for u, s in sample.items())


def test_bad_weights_and_empty_table(spark):
    for weights in ([], [0.0], [1.0, -1.0], [float("inf")], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("id"), weights)
    nothing = sharding.with_slots(sharding.assign(spark.range(0), F.col("id"), [1.0]), [F.col("id")])
    assert nothing.collect() == [] and nothing.columns == ["id", "shard", "slot"]
