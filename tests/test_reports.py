"""Findings to risk, rankings, advice, trends, reports, texts and the gate."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanguard import rules
from spanguard.operators import explain, findings as fi, gate, narrative, position, ranking, reports, risk, trend
from spanguard.options import ScanOptions

SCHEMA = ("repo string, scan_id bigint, file string, line_number int, entity_type string, confidence_score double, "
          "start int, end int")


def build(spark, rows):
    """Findings from (repo, scan, file, entity[, start]) rows."""
    full = [(r, s, f, 1, e, 1.0, (rest or [i])[0], (rest or [i])[0] + 1) for i, (r, s, f, e, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).select(
        "repo", "scan_id", "file", "line_number", "entity_type", "confidence_score",
        rules.severity_of(F.col("entity_type")).alias("severity"), rules.category_of(F.col("entity_type")).alias("category"),
        F.lit("***").alias("matched_value"), F.lit(True).alias("redacted"), "start", "end")


def scans_of(spark, *keys):
    return spark.createDataFrame([(r, s, 5, 1) for r, s in keys],
                                 "repo string, scan_id bigint, files_scanned bigint, files_skipped bigint")


@pytest.fixture(scope="module")
def sample(spark):
    """Scan 1 then scan 2 of `a`; `b` has one scan without findings."""
    rows = [("a", 1, "src/x.py", "EMAIL_ADDRESS"), ("a", 1, "z.py", "JWT"), ("a", 1, "src/x.py", "URL"),
            ("a", 2, "z.py", "CREDIT_CARD"), ("a", 2, "src/x.py", "EMAIL_ADDRESS"), ("a", 2, "src/x.py", "PHONE_NUMBER"),
            ("a", 2, "src/y/q.py", "US_SSN"), ("a", 2, "b.py", "JWT")]
    numbered = fi.number_findings(build(spark, rows)).cache()
    scans = scans_of(spark, ("a", 1), ("a", 2), ("b", 1))
    profile = risk.scan_profile(scans, numbered).cache()
    return scans, numbered, profile


def one(df, **where):
    for key, value in where.items():
        df = df.where(F.col(key) == value)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- numbering -----------------------------------------------------------------------------------

def test_report_order(sample):
    _, numbered, _ = sample
    rows = numbered.where("scan_id = 2").orderBy("finding_index").collect()
    assert [(r.finding_id, r.file) for r in rows] == [
        ("F-000000", "b.py"), ("F-000001", "z.py"), ("F-000002", "src/x.py"), ("F-000003", "src/x.py"), ("F-000004", "src/y/q.py")]


def test_positions_of_a_hot_group(spark):
    """One group holds most rows and spans many partitions; positions are those of a plain sort."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(10 ** 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    placed = position.with_position(df, ["k"], [F.col("v")], partitions=16).collect()
    expected = {}
    for k, v in sorted(rows):
        expected.setdefault(k, []).append(v)
    for k, vs in expected.items():
        assert [r.v for r in sorted((r for r in placed if r.k == k), key=lambda r: r.position)] == vs
        assert sorted(r.position for r in placed if r.k == k) == list(range(len(vs)))


def test_previous_row(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 5, 20), ("a", 7, 30), ("b", 1, 5)], "k string, n int, v int")
    got = position.with_previous(df, ["k"], [F.col("n")], ["v"]).collect()
    assert sorted((r.k, r.n, r.has_previous, r.previous_v) for r in got) == [
        ("a", 1, False, None), ("a", 5, True, 10), ("a", 7, True, 20), ("b", 1, False, None)]


# --- risk ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("entities, score, status", [
    ([], 0, "PASS"), (["URL"] * 19, 19, "PASS"), (["URL"] * 20, 20, "WARNING"), (["EMAIL_ADDRESS"] * 7, 49, "WARNING"),
    (["EMAIL_ADDRESS"] * 7 + ["URL"], 50, "FAIL"), (["CREDIT_CARD"], 15, "FAIL"), (["JWT", "NEW_TYPE"], 6, "PASS"),
])
def test_score_and_status(spark, entities, score, status):
    found = build(spark, [("a", 1, "f", e) for e in entities]) if entities else build(spark, [("z", 9, "f", "URL")])
    row = one(risk.risk_assessment(scans_of(spark, ("a", 1)), found))
    assert (row.risk_score, row.pipeline_status, row.total_findings) == (score, status, len(entities))


def test_own_thresholds_and_severities(spark):
    found = build(spark, [("a", 1, "f", "URL")] * 3)
    row = one(risk.risk_assessment(scans_of(spark, ("a", 1)), found, ScanOptions(warning_threshold=2, fail_threshold=3)))
    assert (row.pipeline_status, row.warning_threshold, row.fail_threshold) == ("FAIL", 2, 3)


def test_counts_add_up(sample):
    _, _, profile = sample
    for r in profile.collect():
        assert r.low + r.medium + r.high + r.critical == r.total_findings == sum(r[c] for c in risk.CATEGORY_COLUMNS)


def test_a_scan_alone_gives_the_same(spark, sample):
    scans, numbered, profile = sample
    alone = risk.scan_profile(scans.where("repo = 'a' AND scan_id = 2"), numbered.where("repo = 'a' AND scan_id = 2"))
    assert one(alone) == one(profile, repo="a", scan_id=2)


def test_accounting(spark):
    rows = [("a", ".py", 10, "x"), ("a", ".PY", 11, "x"), ("a", ".py", 10, None), ("a", ".py", None, None), ("a", ".png", 10, "x"),
            ("a", ".md", 0, "")]
    df = spark.createDataFrame(rows, "repo string, extension string, size_bytes bigint, text string").withColumn("scan_id", F.lit(1))
    row = one(risk.scan_accounting(df, ScanOptions(max_file_size_bytes=10)))
    assert (row.files_scanned, row.files_skipped) == (2, 3)


# --- rankings and advice --------------------------------------------------------------------------

def test_rankings(sample):
    _, numbered, profile = sample
    top = ranking.top_findings(numbered.where("scan_id = 2")).orderBy("rank").collect()
    assert [r.entity_type for r in top] == ["CREDIT_CARD", "US_SSN", "EMAIL_ADDRESS", "PHONE_NUMBER", "JWT"]
    files = ranking.top_files(numbered.where("scan_id = 2")).orderBy("rank").collect()
    assert [(r.file, r.finding_count) for r in files] == [("src/x.py", 2), ("b.py", 1), ("z.py", 1), ("src/y/q.py", 1)]
    categories = ranking.top_categories(profile.where("scan_id = 2")).orderBy("rank").collect()
    assert [r.category for r in categories] == ["Personal Information", "Financial Data", "Government IDs", "Other"]
    assert [r.entity_type for r in ranking.top_critical_findings(numbered).orderBy("rank").collect()] == ["CREDIT_CARD", "US_SSN"]


def test_limits_and_remaining(spark):
    found = fi.number_findings(build(spark, [("a", 1, "f", "URL")] * 40))
    profile = risk.scan_profile(scans_of(spark, ("a", 1)), found)
    key = ranking.key_findings(found, profile).collect()
    assert len(key) == 15 and {r.remaining for r in key} == {25}
    sample = ranking.prompt_sample(found, profile).collect()
    assert len(sample) == 25 and all(r.truncated for r in sample) and "matched_value" not in sample[0].asDict()


def test_unknown_severity_is_last(spark):
    df = spark.createDataFrame([(0, "ODD"), (1, None), (2, "LOW"), (3, "HIGH")], "finding_index bigint, severity string")
    assert [r.finding_index for r in df.orderBy(*ranking.worst_first()).collect()] == [3, 1, 2, 0]


def test_recommendations(spark):
    found = fi.number_findings(build(spark, [("a", 1, "f", e) for e in ("URL", "NEW_TYPE", "US_SSN", "US_SSN", "JWT", "")]))
    rows = explain.recommendations(found).orderBy("rank").collect()
    assert [(r.entity_type, r.severity) for r in rows] == [("US_SSN", "CRITICAL"), ("NEW_TYPE", "MEDIUM"), ("JWT", "MEDIUM"), ("URL", "LOW")]
    assert "NEW_TYPE" in rows[1].recommendation and "social security" in rows[0].recommendation


def test_root_cause_and_remediation(sample):
    _, numbered, _ = sample
    causes = explain.root_cause_analysis(numbered)
    assert causes.count() == numbered.count()
    card = one(explain.remediation_for_findings(numbered), entity_type="CREDIT_CARD")
    assert card.owasp.startswith("OWASP A02:2021") and card.cwe.startswith("CWE-312") and len(card.references) == 2
    jwt = explain.remediation_for_findings(numbered).where("entity_type = 'JWT'").first()
    assert jwt.cwe.startswith("CWE-200") and jwt.references[0] == "https://owasp.org/Top10/"


def test_explain_by_id(spark, sample):
    _, numbered, _ = sample
    ids = ["F-000001", "F-000099", "bad", "F--1"]
    asked = spark.createDataFrame([("a", 2, i) for i in ids], "repo string, scan_id bigint, requested_id string")
    got = {r.requested_id: r for r in explain.explain_findings(asked, numbered).collect()}
    assert got["F-000001"].entity_type == "CREDIT_CARD" and got["F-000001"].explanation
    assert all(got[i].finding_id is None and got[i].root_cause is None for i in ids[1:])


# --- trends --------------------------------------------------------------------------------------

def test_trend(sample):
    _, _, profile = sample
    rows = {(r.repo, r.scan_id): r for r in trend.scan_trend(profile).collect()}
    first, second = rows[("a", 1)], rows[("a", 2)]
    assert not first.trend_available and first.message and first.findings_delta is None and first.category_deltas is None
    assert (second.findings_delta, second.difference, second.findings_trend) == (2, 2, "increased")
    assert second.risk_score_delta == second.current_risk_score - second.previous_risk_score > 0
    assert second.category_deltas["Financial Data"] == 1 and len(second.category_deltas) == 10
    assert second.most_improved_category == "Network Information" and second.worst_category == "Personal Information"
    assert not rows[("b", 1)].trend_available


def test_trend_ties_and_unreadable(spark, sample):
    _, _, profile = sample
    same = profile.where("scan_id = 2").unionByName(profile.where("scan_id = 2").withColumn("scan_id", F.lit(3).cast("bigint")))
    row = one(trend.scan_trend(same), scan_id=3)
    assert (row.findings_trend, row.most_improved_category, row.worst_category) == ("unchanged", None, None)
    broken = profile.withColumn("readable", F.lit(False))
    assert trend.scan_trend(broken).where("trend_available").count() == 0
    assert trend.scan_trend(profile, per_repo=False).where("trend_available").count() == 2


def test_trend_cards(sample):
    _, _, profile = sample
    cards = {(r.repo, r.scan_id): [tuple(c) for c in r.cards] for r in trend.trend_cards(trend.scan_trend(profile)).collect()}
    assert cards[("a", 1)] == [("Trend", "No Change")]
    assert cards[("a", 2)][:4] == [("Previous Findings", "3"), ("Current Findings", "5"), ("Difference", "2"), ("Trend", "Increased")]


# --- reports -------------------------------------------------------------------------------------

def reports_json(sample, **options):
    scans, numbered, profile = sample
    built = reports.build_reports(scans, numbered, profile, ScanOptions(**options))
    return {(r.repo, r.scan_id, r.page): (r.page_count, json.loads(r.j)) for r in built.select(
        "*", reports.report_json(F.col("report")).alias("j")).collect()}


def test_report_shape(sample):
    got = reports_json(sample)
    assert set(got) == {("a", 1, 0), ("a", 2, 0), ("b", 1, 0)}
    report = got[("a", 2, 0)][1]
    assert list(report) == ["schema_version", "scanner_version", "repository", "scan", "summary", "findings"]
    assert report["summary"]["severity_counts"] == {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 2}
    assert report["summary"]["pipeline_status"] == "FAIL" and report["summary"]["risk_thresholds"] == {"warning": 20, "fail": 50}
    assert [f["entity_type"] for f in report["findings"]] == ["JWT", "CREDIT_CARD", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN"]
    assert list(report["findings"][0]) == list(reports.FINDING_FIELDS)
    assert got[("b", 1, 0)][1]["findings"] == [] and report["scan"]["finished_at"] is None


def test_report_pages_lose_nothing(sample):
    whole, paged = reports_json(sample), reports_json(sample, report_page_size=2)
    pages = [paged[("a", 2, p)] for p in range(3)]
    assert {p[0] for p in pages} == {3}
    assert sum((p[1]["findings"] for p in pages), []) == whole[("a", 2, 0)][1]["findings"]


def test_dashboard_and_charts(sample):
    scans, numbered, profile = sample
    row = one(reports.build_dashboard(profile, numbered, trend.scan_trend(profile)), repo="a", scan_id=2)
    assert row.summary.pipeline_status == "FAIL" and row.trend.trend_available and len(row.category_counts) == 10
    assert row.top_files[0].file == "src/x.py" and row.top_findings[0].entity_type == "CREDIT_CARD"
    chart = one(reports.chart_data(profile, numbered), repo="a", scan_id=2)
    assert list(chart.severity) and chart.severity["CRITICAL"] == 2 and len(chart.top_categories) == 4
    cards = one(reports.executive_metrics(profile, scans), repo="a", scan_id=2).metrics
    assert [c.label for c in cards][0] == "Total Findings" and cards[-1].value == "5"


def test_release(sample):
    _, numbered, profile = sample
    rows = {(r.repo, r.scan_id): r for r in reports.release_recommendation(profile, numbered).collect()}
    assert rows[("b", 1)].release_status == "SAFE TO RELEASE" and rows[("a", 2)].release_status == "DO NOT RELEASE"
    assert rows[("a", 2)].reason.startswith("2 Critical") and "CREDIT_CARD, EMAIL_ADDRESS" in rows[("a", 2)].reason
    assert len(rows[("a", 2)].actions) == 3


# --- texts ---------------------------------------------------------------------------------------

def test_summary_text(spark, sample):
    _, numbered, profile = sample
    texts = {(r.repo, r.scan_id): r.summary_markdown for r in narrative.summary_markdown(profile, numbered).collect()}
    text = texts[("a", 2)]
    headings = [line for line in text.split("\n") if line.startswith("## ")]
    assert headings == ["## Executive Summary", "## Overall Risk", "## Key Findings", "## Recommendations",
                        "## Prioritized Actions", "## Compliance Considerations"]
    assert "Severity breakdown: 2 Critical, 2 High, 1 Medium." in text and "1. Deal with **CREDIT_CARD**" in text
    assert narrative.NO_FINDINGS in texts[("b", 1)] and narrative.NO_SEVERITY in texts[("b", 1)]


def test_texts_list_at_most_their_limit(spark):
    found = fi.number_findings(build(spark, [("a", 1, "f", "URL")] * 40))
    profile = risk.scan_profile(scans_of(spark, ("a", 1)), found)
    summary = narrative.summary_markdown(profile, found).first().summary_markdown
    guidance = narrative.guidance_markdown(profile, found).first().guidance_markdown
    assert summary.count("- **[LOW]**") == 15 and "...and 25 more finding(s)" in summary
    assert guidance.count("### F-") == 20 and "...and 20 more finding(s)" in guidance


def test_missing_report_gives_placeholders(spark, sample):
    _, numbered, profile = sample
    empty = profile.withColumn("pipeline_status", F.lit(None).cast("string"))
    assert narrative.NO_REPORT in narrative.summary_markdown(empty, numbered).first().summary_markdown
    assert narrative.NO_REPORT in narrative.guidance_markdown(empty, numbered).first().guidance_markdown


def test_narratives(spark, sample):
    _, _, profile = sample
    given = spark.createDataFrame([("a", 1, " Fine. \n"), ("a", 2, " \t ")], "repo string, scan_id bigint, narrative string")
    got = {(r.repo, r.scan_id): r.executive_summary for r in narrative.apply_narratives(profile, given).collect()}
    assert got[("a", 1)] == "Fine." and got[("a", 2)].startswith("The scan of a gave 5") and got[("b", 1)]


def test_prompts_hold_no_values(sample):
    _, numbered, profile = sample
    prompt = one(narrative.build_prompts(profile, numbered.withColumn("matched_value", F.lit("TOPSECRET"))), repo="a", scan_id=2).prompt
    assert "TOPSECRET" not in prompt and '"findings_sample_is_truncated":false' in prompt


# --- gate ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, status, code, reason", [
    ('{"summary":{"pipeline_status":"PASS"}}', "PASS", 0, "pipeline_status is PASS"),
    (' {"summary":{"pipeline_status":"WARNING"}}\n', "WARNING", 0, "pipeline_status is WARNING"),
    ('{"summary":{"pipeline_status":"FAIL"}}', "FAIL", 1, "pipeline_status is FAIL"),
    (None, None, 1, "no report"), ("", None, 1, "no report"), ("{bad", None, 1, "not valid JSON"),
    ("[]", None, 1, "no summary object"), ("{}", None, 1, "no summary object"), ('{"summary":[]}', None, 1, "no summary object"),
    ('{"summary":{}}', None, 1, "unknown pipeline_status"), ('{"summary":{"pipeline_status":"MAYBE"}}', None, 1, "unknown pipeline_status"),
    ('{"summary":{"pipeline_status":["PASS"]}}', None, 1, "unknown pipeline_status"),
    ('{"summary":{"pipeline_status":"PASS"}} x', None, 1, "not valid JSON"),
    ("{'summary':{'pipeline_status':'PASS'}}", None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}},"mark":"x"', None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}},"x":1', None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}},1', None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}}{"a":1}', None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}},"', None, 1, "not valid JSON"),
    ('{"summary":{"pipeline_status":"PASS"}}],["a"', None, 1, "not valid JSON"),
])
def test_gate(spark, text, status, code, reason):
    row = one(gate.evaluate_gate(spark.createDataFrame([(text,)], "report_json string")))
    assert (row.pipeline_status, row.exit_code, row.reason) == (status, code, reason)
