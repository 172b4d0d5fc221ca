"""Top-k search and URL lists against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from spanguard.llm.topk import top_k, whole_vectors
from spanguard.llm.url_lists import host_of, list_join, page_of, patterns_of

VECTORS = "vec_id bigint, embedding array<float>, rank string, score int"


def best(rows, k, divisor):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in usable if i % divisor == 0}):
        vector = min(v for i, v in usable if i == q)
        found = sorted(((-sum(x * y for x, y in zip(vector, v)), i) for i, v in usable if i != q and len(v) == len(vector)))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_top_k_is_exact(spark, bins):
    rows = [(i, [((i * 7919 + j * 104729) % 1000) / 500 - 1 for j in range(8)]) for i in range(120)]
    rows += [(i, [0.5] * 8) for i in range(200, 230)]  # ties in number
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(310, [1.0, 2.0]), (320, [2.0, 1.0]), (330, []), (340, []), (0, [0.9] * 8), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    vectors = whole_vectors(df)
    asked = vectors.where(F.col("id") % 10 == 0)
    got = top_k(vectors, asked, 5, block_rows=16, bins=bins, cells=6).collect()
    exact = [(i, None if v is None else [None if x is None else spark_float(x) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got) == sorted(best(exact, 5, 10))


def spark_float(x):
    import numpy as np
    return float(np.float32(x))


def test_top_k_large_values_and_empty(spark):
    df = spark.createDataFrame([(0, [3e6, -1.0], "", 0), (1, [2e6, 5.0], "", 0), (2, [-3e6, 1.0], "", 0)], VECTORS)
    vectors = whole_vectors(df)
    got = {tuple(r) for r in top_k(vectors, vectors.where("id = 0"), 5).collect()}
    assert got == best([(i, [spark_float(x) for x in v]) for i, v in [(0, [3e6, -1.0]), (1, [2e6, 5.0]), (2, [-3e6, 1.0])]], 5, 50)
    nothing = vectors.limit(0)
    assert top_k(nothing, nothing).collect() == []
    assert top_k(nothing, vectors).collect() == []


def test_patterns(values):
    urls = ["https://User@A.b.Example.org:80/x/y/?q#z", "http://example.org", None, "", "no url", "http://example.org/#a", "https://h.org?x=/y"]
    assert values(host_of, urls) == ["a.b.example.org", "example.org", "", "", "", "example.org", "h.org"]
    assert values(page_of, urls) == ["a.b.example.org/x/y", "", "", "", "", "", ""]
    assert values(patterns_of, urls[:1])[0] == ["a.b.example.org", "b.example.org", "example.org", "org", "a.b.example.org/x/y"]


def brute_lists(captures, entries):
    out = []
    for page, url, at in captures:
        on = set()
        if url and at is not None:
            host, _, path = url.partition("//")[2].partition("/")
            labels = host.split(".")
            keys = {".".join(labels[i:]) for i in range(len(labels))} | ({f"{host}/{path}"} if path else set())
            last = {}
            for e, name, pattern, added, since in entries:
                if None not in (e, name, pattern, added, since) and pattern in keys and since <= at:
                    last[(pattern, name)] = max(last.get((pattern, name), (-1, -1, False)), (since, e, added))
            on = {name for (_, name), (_, _, added) in last.items() if added}
        out.append((page, url, at, sorted(on)))
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_lists_as_of_the_capture(spark, partitions):
    entries = [(i, f"l{i % 3}", ["hot.org", "a.hot.org", "hot.org/p", "b.net"][i % 4], i % 5 != 0, (i * 37) % 90) for i in range(200)]
    entries += [(900, None, "hot.org", True, 1), (901, "l1", None, True, 1), (902, "l1", "hot.org", None, 1), (903, "l1", "hot.org", True, None)]
    captures = [(i, ["http://a.hot.org/p", "http://hot.org/p", "http://c.b.net/x", "http://none.io/"][i % 4], (i * 13) % 100) for i in range(120)]
    captures += [(500, None, 5), (501, "", 5), (502, "http://hot.org/p", None), (None, "http://hot.org/p", 50), (7, captures[7][1], captures[7][2])]
    df = spark.createDataFrame(captures, "page_id bigint, url string, fetched bigint").withColumn("lists", F.lit("clash")).withColumn("at", F.lit(0))
    says = spark.createDataFrame(entries, "entry_id bigint, list string, pattern string, added boolean, since bigint").withColumn("id", F.lit("clash"))
    got = list_join(df, says, partitions=partitions)
    assert set(got.columns) == {"page_id", "url", "fetched", "at", "lists"}
    key = lambda r: tuple((x is None, x) for x in r[:3])
    rows = sorted(((r["page_id"], r["url"], r["fetched"], r["lists"]) for r in got.collect()), key=key)
    assert rows == sorted(brute_lists(captures, entries), key=key)
    assert list_join(df.limit(0), says).collect() == []
    assert all(r["lists"] == [] for r in list_join(df, says.limit(0)).collect())
