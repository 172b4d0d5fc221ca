"""Validation rules, one sentence at a time."""

import pytest
from pyspark.sql import functions as F

from spanguard.operators import spans as S, validate
from spanguard.sources.tables import load_documents

# text with the value in [brackets], entity, path, keep?
CASES = [
    ("patient full name: [Kim Lee], on file", "PERSON", "exports/a.csv", True),
    ("patient full name: [Kim Lee], on file", "ORGANIZATION", "exports/a.csv", False),
    ("we met [Kim Lee] today", "PERSON", "exports/a.csv", False),
    ("Thanks to [Kim Lee] for the fix", "PERSON", "CHANGES.md", False),
    ("customer [Kim Lee] reported by mail", "PERSON", "a.csv", False),
    ("ping @kim about patient [Kim Lee]", "PERSON", "a.csv", False),
    ("mail kim@x about patient [Kim Lee]", "PERSON", "a.csv", True),
    ("owner = [Kim Lee]", "PERSON", "src/app.py", False),
    ("customer = [Kim Lee]", "PERSON", "src/app.py", True),
    ("use `[Kim Lee]`", "PERSON", "src/app.go", False),
    ("subclass [Kim Lee]", "PERSON", "src/app.py", False),
    ("written for [Kim Lee]", "PERSON", "tests/data.csv", False),
    ("employee [Kim Lee]", "PERSON", "tests/data.csv", True),
    ("billing address of [Oslo]", "LOCATION", "docs/guide.csv", True),
    ("near [Oslo]", "LOCATION", "docs/guide.csv", False),
    ("a patient from [Norway]", "NRP", "a.csv", True),
    ("somebody from [Norway]", "NRP", "a.csv", False),
    ("customer [Docker]", "ORGANIZATION", "a.csv", False),
    ("customer [my_name]", "PERSON", "a.csv", False),
    ("customer [ACME]", "ORGANIZATION", "a.csv", False),
    ("customer [lowerCamel]", "PERSON", "a.csv", False),
    ("customer [PascalCaseName]", "ORGANIZATION", "a.csv", False),
    ("customer [Acme Ltd]", "ORGANIZATION", "a.csv", True),
    ("customer [ ]", "PERSON", "a.csv", False),
    ("customers [Kim Lee]", "PERSON", "a.csv", False),
    ("écustomer [Kim Lee]", "PERSON", "a.csv", False),
    ("CUSTOMER: [Kim Lee]", "PERSON", "a.csv", True),
    ("drivers license [Kim Lee] and driver's license", "PERSON", "a.csv", True),
    ("dob: [1990-01-02]", "DATE_TIME", "a.csv", True),
    ("built on [1990-01-02]", "DATE_TIME", "a.csv", False),
    ("x [http://x.example.org/?token=1]", "URL", "README.md", True),
    ("x [http://u:p@x.example.org/]", "URL", "README.md", True),
    ("customer [http://localhost:80/]", "URL", "a.csv", False),
    ("x [http://hr.corp/a]", "URL", "README.md", True),
    ("customer [https://docs.python.org/3]", "URL", "a.csv", False),
    ("customer [https://notpython.org/3]", "URL", "a.csv", True),
    ("customer [https://x.example.org/3]", "URL", "docs/a.csv", False),
    ("see [https://x.example.org/3]", "URL", "a.csv", False),
    ("customer [www.example.org]", "URL", "a.csv", False),
    ("x [123-45-6789]", "US_SSN", "tests/README.md", True),
    ("x [10.0.0.1]", "IP_ADDRESS", "tests/README.md", True),
    ("x [what]", "SOMETHING_ELSE", "tests/README.md", True),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = []
    for i, (sentence, entity, path, _) in enumerate(CASES):
        start, stop = sentence.index("["), sentence.rindex("]")
        text = sentence[:start] + sentence[start + 1:stop] + sentence[stop + 1:]
        rows.append((str(i), path, text, start, stop - 1, entity))
    df = spark.createDataFrame(rows, "repo string, path string, body string, start int, end int, entity_type string")
    docs = load_documents(df, F.col("repo"), F.lit(0), F.col("path"), F.col("body"))
    spans = df.select("repo", F.lit(0).cast("bigint").alias("scan_id"), F.col("path").alias("relative_path"), "start", "end",
                      "entity_type", F.lit(0.9).alias("score"))
    joined = S.spans_with_docs(spans, docs)
    kept = validate.validate_spans(joined).select("repo").collect()
    return {int(r.repo) for r in kept}


@pytest.mark.parametrize("case", range(len(CASES)), ids=lambda i: f"{CASES[i][1]}:{CASES[i][0][:28]}")
def test_rule(decided, case):
    assert (case in decided) is CASES[case][3]


def test_window_is_120_characters(make_docs, spark):
    texts = {"near.csv": "patient" + " " * 113 + "Kim Lee", "far.csv": "patient" + " " * 114 + "Kim Lee"}
    spans = spark.createDataFrame([("r", 1, p, len(t) - 7, len(t), "PERSON", 0.9) for p, t in texts.items()],
                                  "repo string, scan_id bigint, relative_path string, start int, end int, entity_type string, score double")
    kept = validate.validate_spans(S.spans_with_docs(spans, make_docs(texts))).collect()
    assert [r.relative_path for r in kept] == ["near.csv"]


def test_own_validator(make_docs):
    spans = S.detect_spans(make_docs({"a.csv": "a@example.org 10.0.0.1"}))
    only_mail = validate.validate_spans(spans, lambda ctx: ctx.entity == "EMAIL_ADDRESS")
    assert [r.value for r in only_mail.collect()] == ["a@example.org"]
