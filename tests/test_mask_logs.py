"""Masking of logs by the secrets of their key."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanguard.operators.redaction import SecretMask, mask_logs

MARK = "***REDACTED***"


def plain(text, secrets):
    if not text:
        return text
    secrets = sorted({s for s in secrets if s}, key=len, reverse=True)
    out, at = "", 0
    while at < len(text):
        hit = next((s for s in secrets if text.startswith(s, at)), None)
        out += MARK if hit else text[at]
        at += len(hit) if hit else 1
    return out


@pytest.mark.parametrize("key_logs", [50_000, 20])
def test_against_brute_force(spark, key_logs):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    logs = [(rng.choice([1, 1, 1, 1, 2, 3, None]), word(30) or None, i, "x") for i in range(400)] + [(1, "aab", 7, "x")] * 30
    secrets = [(rng.choice([1, 2, 2, 4, None]), word(5) or None) for _ in range(60)]
    by_key = {k: [s for key, s in secrets if key == k] for k in (1, 2, 3, 4)}
    df = mask_logs(spark.createDataFrame(logs, "k int, log string, n int, _text string"), spark.createDataFrame(secrets, "k int, secret string"), ["k"], "log", key_logs)
    assert df.columns == ["k", "log", "n", "_text", "masked_log"]
    want = Counter((k, t, n, x, plain(t, by_key.get(k, []))) for k, t, n, x in logs)
    assert Counter(map(tuple, df.collect())) == want


def test_many_secrets_of_one_key(spark):
    secrets = spark.range(100_000).select(F.lit(1).alias("k"), F.concat(F.lit("key-"), F.md5(F.col("id").cast("string"))).alias("secret"))
    logs = spark.range(5_000).select(F.lit(1).alias("k"), F.concat(F.lit("a key-"), F.md5((F.col("id") * 37).cast("string")), F.lit(" b")).alias("log"))
    got = mask_logs(logs, secrets, ["k"], "log").groupBy("masked_log").count().collect()
    hidden = sum(1 for i in range(5_000) if i * 37 < 100_000)
    assert {r["masked_log"]: r["count"] for r in got if r["masked_log"] == f"a {MARK} b"} == {f"a {MARK} b": hidden}


def test_empty_tables(spark):
    logs, secrets = spark.createDataFrame([(1, "abc")], "k int, log string"), spark.createDataFrame([(1, "b")], "k int, secret string")
    assert [r.masked_log for r in mask_logs(logs, secrets.limit(0), ["k"], "log").collect()] == ["abc"]
    assert mask_logs(logs.limit(0), secrets, ["k"], "log").collect() == []


def test_a_secret_inside_another_does_not_hide_one_that_begins_first():
    mask = SecretMask(["bcd", "abcde", "b"])
    assert mask("xabcdz") == "xa" + MARK + "z" and mask("abcde") == MARK and mask("b") == MARK and mask("") == ""
