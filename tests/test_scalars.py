"""Scalar functions: ids, masks, formats and paths."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanguard.functions import ids, paths, redact, sqlfuncs, text


def test_finding_id_round_trip(values):
    assert values(ids.finding_id, [0, 7, 999999, 1234567], "bigint") == ["F-000000", "F-000007", "F-999999", "F-1234567"]
    assert values(ids.finding_index_of, ["F-000007", "F-1234567", "F-", "f-1", "F-1x", "", None]) == [
        7, 1234567, None, None, None, None, None]


def test_negative_index_is_an_error(values):
    with pytest.raises(Exception, match="index must be >= 0"):
        values(ids.finding_id, [-1], "bigint")


@pytest.mark.parametrize("entity, value, mask", [
    ("EMAIL_ADDRESS", "john.doe@example.com", "jo***@example.com"),
    ("EMAIL_ADDRESS", "a@x.org", "a***@x.org"),
    ("EMAIL_ADDRESS", "a@b@c.org", "a***@b@c.org"),
    ("EMAIL_ADDRESS", "no-at-sign", "******sign"),
    ("CREDIT_CARD", "4111111111111111", "************1111"),
    ("PERSON", "Anna", "****"), ("PERSON", "Bo", "**"), ("PERSON", "", ""), ("PERSON", "Zoë Łoś", "***" + " Łoś"),
])
def test_redact_value(values, entity, value, mask):
    assert values(lambda v: redact.redact_value(F.lit(entity), v), [value]) == [mask]


def test_mask_secret_and_credential_block(spark):
    rows = [("clone https://oauth2:tok@h failed tok", "tok"), ("no secret here", None), ("left alone", ""), ("x", "y")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [r[0] for r in df.select(redact.sanitize_text(F.col("t"), F.col("s"))).collect()]
    assert got == ["clone https://oauth2:***REDACTED***@h failed ***REDACTED***", "no secret here", "left alone", "x"]


def test_human_readable_size(values):
    sizes = [0, 512, 1023, 1024, 1280, 1536, 13722, 2 ** 20 * 2 + 104858, 2 ** 30, 2 ** 40, 2 ** 50, 2 ** 60]
    assert values(text.human_readable_size, sizes, "bigint") == [
        "0 B", "512 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "13.4 KB", "2.1 MB", "1.0 GB", "1.0 TB", "1.0 PB", "1024.0 PB"]
    with pytest.raises(Exception, match="non-negative"):
        values(text.human_readable_size, [-1], "bigint")


def test_format_duration(values):
    assert values(text.format_duration, ["3725.9", "3600", "184", "180", "5.99", "0", "x", None]) == [
        "1h 2m", "1h 0m", "3m 4s", "3m", "5s", "0s", "n/a", "n/a"]


def test_report_date(values):
    assert values(text.format_report_date, ["2024-03-05T19:08:09+00:00", "2024-03-05T19:08:09Z", "soon", "", None]) == [
        "05 March 2024 07:08 PM UTC", "05 March 2024 07:08 PM UTC", "soon", "n/a", "n/a"]


def test_other_formats(values, spark):
    assert values(text.format_count, [1234567, 0, -4200], "bigint") == ["1,234,567", "0", "-4,200"]
    assert values(text.status_tone, ["PASS", "FAIL", "odd", None]) == ["pass", "fail", "unknown", "unknown"]
    assert values(text.strip, ["  a b\t\n", " x\x1f", " "]) == ["a b", "x", ""]
    moment = [dt.datetime(2026, 7, 25, 7, 19, 0)]
    assert values(text.timestamp_slug, moment, "timestamp") == ["20260725_071900"]
    df = spark.createDataFrame([(moment[0], dt.datetime(2026, 7, 25, 7, 19, 2, 500000)), (moment[0], None)],
                               "a timestamp, b timestamp")
    assert [r[0] for r in df.select(text.scan_duration(F.col("a"), F.col("b"))).collect()] == [2.5, None]


def test_paths(values):
    names = ["src/a.PY", ".env", "x/.env", "a/b.tar.gz", "Makefile", "a.b/README"]
    assert values(paths.extension, names) == [".py", "", "", ".gz", "", ""]
    assert values(paths.path_stem, names) == ["a", ".env", ".env", "b.tar", "Makefile", "README"]
    assert values(paths.normalise_path, ["a\\b\\c.py"]) == ["a/b/c.py"]
    assert values(lambda p: paths.relative_to(p, F.lit("/r/")), ["/r/a/b", "/rest/a"]) == ["a/b", "/rest/a"]


def test_excluded_directory(values):
    names = ["build/x.py", "src/venv/x.py", "src/build", "rebuild/x.py", "Build/x.py"]
    assert values(lambda p: paths.in_excluded_directory(p, ("build", "venv")), names) == [True, True, False, False, False]


def test_traversal_order(values):
    listed = ["b/z.py", "a.py", "b/c/d.py", "b-x/y.py", "z.py", "b/a.py", "B.py"]
    keys = values(paths.traversal_order_key, listed)
    assert [p for _, p in sorted(zip(keys, listed))] == ["B.py", "a.py", "z.py", "b/a.py", "b/z.py", "b/c/d.py", "b-x/y.py"]


def test_url_host(values):
    urls = ["https://User:pw@Docs.Python.org:443/x?q=a@b", "http://a_b.local", "//h/x", "www.x.org/y", "ftp://[::1]:21/", "x"]
    assert values(paths.url_host, urls) == ["docs.python.org", "a_b.local", "h", "", "::1", ""]


def test_sql_functions_agree(spark):
    sqlfuncs.register(spark)
    row = spark.sql("""SELECT sg_redact_value('EMAIL_ADDRESS', 'john@x.org'), sg_redact_value('X', 'abc'), sg_finding_id(7),
        sg_finding_index_of('F-000009'), sg_format_duration(184.0), sg_human_readable_size(1280), sg_severity_of('US_SSN'),
        sg_category_of('nope'), sg_is_high_signal('JWT'), sg_is_public_host('docs.github.com'), sg_is_public_host('notgithub.com'),
        sg_has_person_cue('the Patient said'), sg_has_date_cue('borne'), sg_trend_direction(-2)""").first()
    assert tuple(row) == ("jo***@x.org", "***", "F-000007", 9, "3m 4s", "1.2 KB", "CRITICAL", "Other", True, True, False, True,
                          False, "decreased")
