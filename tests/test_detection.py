"""Detection: offsets, context, thresholds, seams and overlaps."""

import re
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from spanguard.operators import overlaps, recognizers as R, spans as S
from spanguard.options import ScanOptions


MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def found(df):
    return {(r.entity_type, r.value) for r in df.collect()}


TEXT = """owner: jane.doe@mail.example.com, card 4111 1111 1111 1111
host 10.0.0.255 or 10.0.0.256, call +1 (974) 555-3436
token = "04dbebab91ab85687d33" password: 'hunter22'
iban GB82WEST12345698765432 ssn 123-45-6789 itin 912-70-1234
pan ABCPK1234Z uid 2341 2341 2346 dea AB1234563 born 1990-02-30 and 1990-02-28
wallet 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa see https://intra.corp/x?a=1.
-----BEGIN RSA PRIVATE KEY----- eyJhbGciOi.eyJzdWIi.sig12345
"""


def test_recognizers_and_offsets(make_docs):
    docs = make_docs({"a.txt": TEXT})
    spans = S.detect_spans(docs)
    got = found(spans)
    assert {("EMAIL_ADDRESS", "jane.doe@mail.example.com"), ("CREDIT_CARD", "4111 1111 1111 1111"),
            ("IP_ADDRESS", "10.0.0.255"), ("PHONE_NUMBER", "+1 (974) 555-3436"), ("API_KEY", "04dbebab91ab85687d33"),
            ("PASSWORD", "hunter22"), ("IBAN_CODE", "GB82WEST12345698765432"), ("US_SSN", "123-45-6789"),
            ("US_ITIN", "912-70-1234"), ("IN_PAN", "ABCPK1234Z"), ("IN_AADHAAR", "2341 2341 2346"),
            ("MEDICAL_LICENSE", "AB1234563"), ("DATE_TIME", "1990-02-28"), ("CRYPTO", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
            ("URL", "https://intra.corp/x?a=1"), ("PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----"),
            ("JWT", "eyJhbGciOi.eyJzdWIi.sig12345")} <= got
    assert not {v for e, v in got if v in ("10.0.0.256", "1990-02-30")}
    for r in spans.collect():
        assert TEXT[r.start:r.end] == r.value
        assert r.line_number == TEXT.count("\n", 0, r.start) + 1
        assert r.window == TEXT[max(0, r.start - 120):r.end + 120]
        assert r.line == TEXT.split("\n")[r.line_number - 1]


def test_long_documents_in_blocks(make_docs):
    """Blocks, astral characters and one very long line give the offsets of the whole text."""
    lines = [f"{'𝔘ñ ' * (i % 40)}mail{i}@host{i % 7}.example.com tail {'x' * (i % 300)}" for i in range(400)]
    text = "\n".join(lines) + "\n" + "word " * 6000 + "last@example.org" + "\n\n"
    spans = S.detect_spans(make_docs({"a.txt": text}), ScanOptions(recognizers=("email",))).collect()
    expected = [(m.start(), m.end(), m.group()) for m in re.finditer(MAIL, text)]
    assert sorted((r.start, r.end, r.value) for r in spans) == expected and len(expected) == 401
    for r in spans:
        assert r.line_number == text.count("\n", 0, r.start) + 1
        assert r.window == text[max(0, r.start - 120):r.end + 120]


def test_blocks_join_to_the_text(spark):
    text = ("é" * 5000 + "\n") * 3 + "a\n" * 5000 + "end"
    df = spark.createDataFrame([(text,), ("",), ("short",)], "text string")
    assert df.select(F.array_join(S.block_array(F.col("text")), "") == F.col("text")).distinct().collect()[0][0]


def test_repeated_values_get_their_own_offsets(make_docs):
    text = "1.1.1.1 11.1.1.11 1.1.1.1,1.1.1.1"
    spans = S.detect_spans(make_docs({"a.txt": text}), ScanOptions(recognizers=("ipv4",))).collect()
    assert sorted((r.start, r.value) for r in spans) == [(0, "1.1.1.1"), (8, "11.1.1.11"), (18, "1.1.1.1"), (26, "1.1.1.1")]


def test_weak_pattern_needs_a_cue_near(make_docs):
    docs = make_docs({"a.txt": "passport K12345678", "b.txt": "part K12345678", "c.txt": "passport " + "z " * 100 + "K12345678"})
    spans = S.detect_spans(docs, ScanOptions(recognizers=("us_passport",))).collect()
    assert [(r.relative_path, r.score) for r in spans] == [("a.txt", 0.7)]


def test_threshold_keeps_equal_scores(make_docs):
    docs = make_docs({"a.txt": "see http://x.example.org/y and +1 (974) 555-3436"})
    assert found(S.detect_spans(docs, ScanOptions(min_confidence=0.75))) == {("PHONE_NUMBER", "+1 (974) 555-3436")}
    assert R.active(None, 0.75) != R.active(None, 0.0)


def test_empty_and_null_texts(make_docs):
    docs = make_docs([("r", 1, "a.txt", ""), ("r", 1, "b.txt", None)])
    assert S.detect_spans(docs).count() == 0


def test_own_recognizer(make_docs):
    R.register_recognizer(R.Recognizer("ticket", "TICKET", "TCK-[0-9]+", 0.9))
    try:
        assert found(S.detect_spans(make_docs({"a.txt": "see TCK-42"}))) == {("TICKET", "TCK-42")}
    finally:
        R.unregister_recognizer("ticket")


def test_spans_from_table(spark, make_docs):
    docs = make_docs({"a.txt": "one\ntwo Anna three\nfour"})
    spans = spark.createDataFrame([("r", 1, "a.txt", 8, 12, "PERSON", 0.85), ("r", 1, "zz.txt", 0, 1, "PERSON", 0.9)],
                                  "repo string, scan_id bigint, relative_path string, start int, end int, entity_type string, score double")
    row = S.spans_with_docs(spans, docs).collect()
    assert [(r.value, r.line_number, r.line) for r in row] == [("Anna", 2, "two Anna three")]


def test_spans_meet_a_text_once(spark, make_docs):
    text = "\n".join(f"line {i} " + "é" * (i % 50) for i in range(4000))
    docs = make_docs({"a.txt": text, "b.txt": "x"})
    rows = [("r", 1, "a.txt", i * 53 % len(text), i * 53 % len(text) + i % 200, "PERSON", 0.5) for i in range(2000)] + [("r", 1, "a.txt", len(text) + 5, len(text) + 9, "PERSON", 0.5)]
    spans = spark.createDataFrame(rows, "repo string, scan_id bigint, relative_path string, start int, end int, entity_type string, score double")
    joined = S.spans_with_docs(spans, docs)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("Generate") < plan.index("Join")  # spans are taken apart behind the join
    got = sorted((r.start, r.end, r.value, r.line_number, r.window, r.line) for r in joined.collect())
    want = []
    for _, _, _, a, b, _, _ in rows:
        stop = text.find("\n", b)
        inside = a <= len(text)
        line = text[text.rfind("\n", 0, a) + 1:len(text) if stop < 0 else stop]
        want.append((a, b, text[a:b], text.count("\n", 0, a) + 1 if inside else None, text[max(0, a - 120):b + 120], line))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert [g for g in got if g[0] <= len(text)] == [w for w in sorted(want) if w[0] <= len(text)]


def test_line_number_outside_the_text(values):
    assert values(lambda v: S.line_number(v, F.lit(9)), ["a\nb"]) == [None]
    assert values(lambda v: S.line_number(v, F.lit(3)), ["a\nb"]) == [2]


def test_python_engine_failures_stay_with_their_document(make_docs):
    item = namedtuple("item", "entity_type start end score")

    class Engine:
        def analyze(self, text, language, score_threshold):
            if "boom" in text:
                raise RuntimeError("broken")
            return [item("PERSON", 0, 4, 0.85), item("PERSON", 0, 2, 0.2)]

    docs = make_docs({"a.txt": "Anna here", "b.txt": "boom", "c.txt": ""})
    result = S.spans_from_udf(docs, Engine, name="test")
    assert [(r.relative_path, r.value, r.score) for r in S.udf_spans(result).collect()] == [("a.txt", "Anna", 0.85)]
    assert [(r.relative_path, r.error) for r in S.udf_errors(result).collect()] == [("b.txt", "RuntimeError: broken")]


def brute_force(rows):
    best = {}
    for r in rows:
        best[r[:4]] = max(best.get(r[:4], -1), r[4])
    spans = [k + (v,) for k, v in best.items()]

    def beats(a, b):
        if a[:2] != b[:2] or a[2:4] == b[2:4]:
            return False
        holds, inside = a[2] <= b[2] and b[3] <= a[3], b[2] <= a[2] and a[3] <= b[3]
        return (holds and a[4] >= b[4]) or (inside and a[4] > b[4])

    return sorted(s for s in spans if not any(beats(o, s) for o in spans))


def engine_giving(entity, **odd):
    Item = namedtuple("Item", "entity_type start end score")

    class Engine:
        def analyze(self, text, language, score_threshold):
            good = Item(entity, 0, 2, 0.9)
            return [Item(**{**good._asdict(), **odd}), good] if odd else [good]

    return Engine


def test_two_engines_in_one_session_do_not_mix(make_docs):
    docs = make_docs({"a.txt": "hello"})
    for entity in ("AAA", "BBB"):
        assert {r.entity_type for r in S.udf_spans(S.spans_from_udf(docs, engine_giving(entity))).collect()} == {entity}


@pytest.mark.parametrize("odd", [{"score": None}, {"start": "x"}, {"end": None}])
def test_an_odd_item_stays_alone(make_docs, odd):
    out = S.spans_from_udf(make_docs({"a.txt": "hello"}), engine_giving("AAA", **odd))
    assert [(r.entity_type, r.value) for r in S.udf_spans(out).collect()] == [("AAA", "he")]
    assert S.udf_errors(out).count() == 1


def test_long_addresses_are_found_whole(make_docs):
    mail = "a" * 70 + "@" + "b." * 110 + "example.com"
    assert ("EMAIL_ADDRESS", mail) in found(S.detect_spans(make_docs({"a.txt": f"to {mail} now"})))


def test_all_secrets_of_a_key_go_and_rows_stay(spark):
    from spanguard.operators.redaction import mask_logs
    logs = spark.createDataFrame([(1, "x abc y abcdef z"), (1, "none"), (2, "abc"), (3, None)], "k int, log string")
    secrets = spark.createDataFrame([(1, "abc"), (1, "abcdef"), (1, "abc"), (1, None), (1, ""), (4, "q")], "k int, secret string")
    rows = mask_logs(logs, secrets, ["k"], "log").collect()
    assert len(rows) == 4
    got = {r.log: r.masked_log for r in rows}
    assert "abc" not in got["x abc y abcdef z"] and "def" not in got["x abc y abcdef z"]
    assert got["none"] == "none" and got["abc"] == "abc" and got[None] is None


def test_overlaps_against_brute_force(spark):
    rows = [(f"d{i % 3}", "XY"[i % 2], i * 37 % 900, i * 37 % 900 + 1 + i * 53 % 600, (i % 4) / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "relative_path string, entity_type string, start int, end int, score double").select(
        F.lit("r").alias("repo"), F.lit(1).alias("scan_id"), "*")
    got = overlaps.resolve_overlaps(df).select("relative_path", "entity_type", "start", "end", "score").collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows)


@pytest.mark.parametrize("strip", [1, 64, 700, 1 << 16])
def test_overlaps_in_strips(spark, strip):
    import random
    rng = random.Random(strip)
    rows = [(f"d{rng.randrange(3)}", rng.choice("XY"), s, s + rng.choice([0, 1, 5, 60, 900, 3000]), rng.randrange(5) / 4)
            for s in (rng.randrange(2500) for _ in range(700))]
    df = spark.createDataFrame(rows, "relative_path string, entity_type string, start int, end int, score double").select(
        F.lit("r").alias("repo"), F.lit(1).alias("scan_id"), "*", F.lit("v").alias("value"))
    got = overlaps.resolve_overlaps(df, strip)
    assert got.columns == df.columns
    assert sorted(tuple(r)[2:7] for r in got.collect()) == brute_force(rows)


def test_deeply_nested_spans_are_swept(spark):
    n = 100_000
    nested = spark.range(n).select(
        F.lit("r").alias("repo"), F.lit(1).alias("scan_id"), F.lit("a").alias("relative_path"), F.lit("X").alias("entity_type"),
        F.col("id").cast("int").alias("start"), (2 * n - F.col("id")).cast("int").alias("end"), (F.col("id") % 7 / 8.0).alias("score"))
    best = overlaps.resolve_overlaps(nested).collect()
    assert [(r.start, r.score) for r in best] == [(6, 0.75)]


def test_overlaps_without_place_or_score_stay(spark):
    rows = [("a", "X", None, 5, 0.5), ("a", "X", 1, None, 0.5), ("a", "X", 1, 3, None), ("a", "X", 0, 9, 0.5), (None, "X", 1, 3, 0.5), ("a", "X", 2, 3, 0.5)]
    df = spark.createDataFrame(rows, "relative_path string, entity_type string, start int, end int, score double").select(
        F.lit("r").alias("repo"), F.lit(1).alias("scan_id"), "*")
    got = {tuple(r)[2:] for r in overlaps.resolve_overlaps(df).collect()}
    assert got == set(rows) - {("a", "X", 2, 3, 0.5)}
    assert overlaps.resolve_overlaps(df.limit(0)).collect() == []


@pytest.mark.parametrize("bad", [{"min_confidence": 1.1}, {"warning_threshold": -1}, {"fail_threshold": 10}, {"report_page_size": 0},
                                 {"severity_overrides": {"X": "BAD"}}, {"max_file_size_bytes": -1}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        ScanOptions(**bad)
