"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from spanguard.llm import lexical

DOCS = "doc_id bigint, text string, rank string, score int, block string, item_id int"
ITEMS = "item_id bigint, text string, score string"
WORDS = ["alpha", "Beta", "gamma", "δέλτα", "ÄÖ", "x1", "the", "of", "7"]


def terms(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower()) if text else []


def brute(docs, items, k):
    rows = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_found, n_terms = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, held, _ in rows for t in held)
    asked = {}
    for i, t in items:
        if t is not None:
            asked[i] = min(asked.get(i, t), t)
    out = []
    for i, text in asked.items():
        wanted = Counter(terms(text))
        found = []
        for d, held, n in rows:
            m = 25 + (75 * n * n_found) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_found + 2) / (2 * df[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 8 * m))
                        for t, times in wanted.items() if t in held)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


def some_docs(n):
    rows = [(i, " ".join(WORDS[(i * 7 + j * (i % 5 + 1)) % len(WORDS)] + ("-" if j % 3 else " ") for j in range(i % 13))) for i in range(n)]
    rows += [(1000 + i, "alpha beta gamma, alpha") for i in range(30)]  # equal scores in number
    rows += [(5, "alpha alpha"), (5, "alpha alpha"), (None, "alpha beta gamma, alpha"), (None, None), (2000, None), (2001, ""), (2002, "- ! \n")]
    return rows + [(3000, "the " * 50_000 + "alpha" + " of" * 400_000)]


@pytest.mark.parametrize("sizes", [(2 << 20, 2048, 1024, 512, None), (200, 7, 2, 2, 3), (1 << 20, 1000, 1, 1, 1)])
def test_search_is_exact(spark, sizes):
    docs = some_docs(60)
    items = [(1, "alpha beta"), (2, "ALPHA alpha of the δέλτα"), (3, "nothing known"), (4, None), (5, ""), (None, "gamma x1"), (6, "7 äö ÄÖ"), (6, "alpha"), (1, "alpha beta")]
    block_bytes, block_rows, item_rows, width, shares = sizes
    got = lexical.search(spark.createDataFrame([(*r, "x", 1, "b", 2) for r in docs], DOCS).repartition(5), spark.createDataFrame([(*r, "s") for r in items], ITEMS),
                         k=10, block_bytes=block_bytes, block_rows=block_rows, item_rows=item_rows, width=width, shares=shares)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "alpha", "", 1, "", 1)], DOCS), spark.createDataFrame([(1, "alpha", "")], ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("false"), items.where("false")).collect() == []
    assert len(lexical.search(docs, items).collect()) == 1


def test_tiles_end_before_the_bound():
    bounds = np.array([2.0**52, 2.0**52 - 1, 5.0, 2.0**60, 1.0, 1.0, 1.0])
    tiles = list(lexical._tiles(bounds, 2))
    assert tiles == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert all(b - a == 1 or bounds[a:b].sum() < 2.0**53 for a, b in tiles)


def test_long_text_in_pieces(monkeypatch):
    text = "Word1 ".encode() * 300 + b"a" * 50 + " ü-ü,".encode() * 200
    whole = lexical.terms_of(text)
    monkeypatch.setattr(lexical, "_PIECE", 16)
    assert lexical.terms_of(text) == whole == Counter({b"word1": 300, b"a" * 50: 1, "ü".encode(): 400})
