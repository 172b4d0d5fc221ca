"""File trees, report history, masked documents, streams."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanguard.operators import findings as fi, redaction, reports, risk, spans as S, validate
from spanguard.options import ScanOptions
from spanguard.sources import files as fs, history, tables
from spanguard.streaming import continuous


@pytest.fixture
def tree(tmp_path):
    def put(path, content):
        target = tmp_path / "node_modules_parent" / "repo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("main.py", "mail a@example.org\r\nline two\rthree")
    put(".github/l.yml", "x: 1")
    put("pkg/__init__.py", "")
    put("pkg/sub/deep.JSON", "{}")
    put("pkg/build", "not a directory, no extension")
    put("notes.txt", b"caf\xe9 \xff")
    put("bom.md", b"\xef\xbb\xbfhi")
    put("big.py", "x" * 2048)
    put("picture.png", b"\x89PNG")
    put("node_modules/m.js", "x")
    put("src/.git/config.py", "x")
    put(".env", "A=1")
    return str(tmp_path / "node_modules_parent" / "repo")


def test_read_tree(spark, tree):
    options = ScanOptions(max_file_size_bytes=1024)
    rows = {r.relative_path: r for r in fs.read_repo_files(spark, [("r", 3, tree)], options).collect()}
    assert set(rows) == {"main.py", ".github/l.yml", "pkg/__init__.py", "pkg/sub/deep.JSON", "notes.txt", "bom.md", "big.py"}
    assert rows["main.py"].text == "mail a@example.org\nline two\nthree"
    assert rows["notes.txt"].text == "café ÿ" and rows["bom.md"].text == "﻿hi"
    assert rows["big.py"].text is None and rows["big.py"].size_bytes == 2048
    assert rows["pkg/sub/deep.JSON"].extension == ".json" and rows["main.py"].scan_id == 3


def test_tree_to_report(spark, tree):
    options = ScanOptions(max_file_size_bytes=1024)
    listed = fs.read_repo_files(spark, [("r", 3, tree)], options)
    scans = risk.scan_accounting(listed, options)
    row = scans.collect()[0]
    assert (row.files_scanned, row.files_skipped) == (6, 1)
    found = fi.find(fs.scan_documents_with_content(listed), options)
    assert [(r.file, r.line_number, r.matched_value) for r in found.collect()] == [("main.py", 1, "a***@example.org")]


def test_unreadable_and_missing(spark, tree, tmp_path):
    os.symlink("/nowhere/at/all", os.path.join(tree, "gone.py"))
    rows = fs.read_repo_files(spark, [("r", 1, tree), ("none", 1, str(tmp_path / "absent"))]).where("text IS NULL").collect()
    assert [(r.repo, r.relative_path, r.size_bytes) for r in rows] == [("r", "gone.py", None)]


def test_tree_is_split_without_loss(tree):
    excluded, extensions = ("node_modules", ".git"), (".py", ".json", ".yml")
    whole = []
    for folder, names, files in os.walk(tree):
        names[:] = [n for n in names if n not in excluded]
        whole += [os.path.join(folder, f) for f in files if os.path.splitext(f)[1].lower() in extensions]
    for share in (1, 2, 3, 100):
        todo, found, run = [None], [], fs.folder_opener(extensions, excluded, share)
        while todo:
            batch = pd.DataFrame({"repo": "r", "scan_id": 1, "root": str(tree), "folder": pd.Series(todo, dtype=object)})
            rows = [r for out in run(iter([batch])) for r in out.itertuples()]
            found += [r.absolute_path for r in rows if not r.is_folder]
            todo = [r.absolute_path for r in rows if r.is_folder]
        assert sorted(found) == sorted(whole)


def test_table_filters(make_docs):
    docs = make_docs({"a.py": "x" * 11, "b.PY": "x", "build/c.py": "x", "d.png": "x", "e/build": "x", "f.md": "x" * 10})
    kept = tables.in_scope(docs, ScanOptions(max_file_size_bytes=10))
    assert sorted(r.relative_path for r in kept.collect()) == ["b.PY", "f.md"]


def test_filters_reach_the_scan(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = tables.load_documents(raw, F.col("source"), F.lit(0), F.lit("a.py"), F.col("text"), F.col("n_chars"))
    plan = tables.with_size_limit(docs, ScanOptions(max_file_size_bytes=10)).select("repo")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(n_chars,10)" in plan and "ReadSchema: struct<source:string,n_chars:bigint>" in plan


def test_detection_does_not_shuffle(make_docs):
    plan = fi.find(make_docs({"a.txt": "x"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- history -------------------------------------------------------------------------------------

def test_folders_left_over_are_opened_in_later_rounds(spark, tmp_path):
    want = set()
    for i in range(12):
        folder = tmp_path / f"a{i % 3}" / f"b{i}" / ".c"
        folder.mkdir(parents=True)
        (folder / f"{i}.py").write_text("x" * i)
        want.add((f"a{i % 3}/b{i}/.c/{i}.py", i))
    (tmp_path / "a0" / "loop").symlink_to(tmp_path)
    roots = spark.createDataFrame([("r", 1, str(tmp_path)), ("n", 1, None), ("m", 1, str(tmp_path / "absent"))], fs.ROOT_SCHEMA)
    for share in (1, 5, 1000):
        rows = fs.list_repo_files(spark, roots, share=share).collect()
        assert {(r.relative_path, r.size_bytes) for r in rows} == want and len(rows) == 12


def report_rows(make_docs, texts, scan_id=1, page_size=10_000):
    docs = make_docs(texts, scan_id=scan_id)
    found = fi.number_findings(fi.find(docs))
    scans = docs.select("repo", "scan_id").distinct()
    options = ScanOptions(report_page_size=page_size)
    return reports.build_reports(scans, found, risk.scan_profile(scans, found), options)


def test_history_numbers_and_repeats(spark, make_docs, tmp_path):
    path = str(tmp_path / "history")
    first = report_rows(make_docs, {"a.py": "a@example.org b@example.org c@example.org"}, 1, page_size=2)
    assert history.read_history(spark, path).count() == 0
    assert sorted((r.scan_no, r.page) for r in history.append_history(first, path).collect()) == [(1, 0), (1, 1)]
    assert history.append_history(first, path).count() == 0
    second = report_rows(make_docs, {"a.py": "4111111111111111"}, 2)
    assert [r.scan_no for r in history.append_history(second, path).collect()] == [2]
    headers = history.history_headers(history.read_history(spark, path))
    index = history.history_index(headers).orderBy("scan_no").collect()
    assert [(r.report_number, r.pipeline_status, r.tone) for r in index] == [("001", "WARNING", "warning"), ("002", "FAIL", "fail")]
    assert history.latest_previous_report(headers).collect()[0].scan_no == 2
    assert history.read_history(spark, path).where("scan_no = 2").first().name.startswith("Report_002_")


def test_two_writers_never_share_a_number(spark, make_docs, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    mine, theirs = (report_rows(make_docs, {"a.py": text}, scan) for scan, text in ((1, "a@example.org"), (2, "4111111111111111")))
    claim, other = history.claim_version, []

    def late(spark, path, version, batch):  # the other writer appends between our batch and our claim
        if not other:
            other.append(None)
            other[0] = [r.scan_no for r in history.append_history(theirs, path).collect()]
        return claim(spark, path, version, batch)

    monkeypatch.setattr(history, "claim_version", late)
    assert [r.scan_no for r in history.append_history(mine, path).collect()] == [2] and other == [[1]]
    stored = history.read_history(spark, path)
    assert sorted((r.scan_no, r.scan_id) for r in stored.collect()) == [(1, 2), (2, 1)]


def test_equal_reports_of_two_writers_are_stored_once(spark, make_docs, tmp_path, monkeypatch):
    path, report = str(tmp_path / "history"), report_rows(make_docs, {"a.py": "a@example.org"}, 1)
    claim, other = history.claim_version, []

    def late(spark, path, version, batch):
        if not other:
            other.append(True)
            history.append_history(report, path)
        return claim(spark, path, version, batch)

    monkeypatch.setattr(history, "claim_version", late)
    assert history.append_history(report, path).count() == 0
    assert history.read_history(spark, path).count() == 1


def test_a_lost_append_leaves_nothing_to_see(spark, make_docs, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    history.append_history(report_rows(make_docs, {"a.py": "x"}, 1), path)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(history, "claim_version", lost)
        with pytest.raises(RuntimeError):
            history.append_history(report_rows(make_docs, {"a.py": "b@example.org"}, 2), path)
    (tmp_path / "history" / "claims" / "_draft").write_text("half")
    half = tmp_path / "history" / "batches" / "batch=half" / "_temporary"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_text("half")
    assert [r.scan_id for r in history.read_history(spark, path).collect()] == [1]
    assert [r.scan_no for r in history.append_history(report_rows(make_docs, {"a.py": "b@example.org"}, 3), path).collect()] == [2]


@pytest.mark.parametrize("move", ["_linked", "_renamed"])
def test_a_version_is_claimed_once(spark, tmp_path, monkeypatch, move):
    monkeypatch.setattr(history, "_linked", getattr(history, move))
    path = str(tmp_path)
    assert [history.claim_version(spark, path, v, b) for v, b in ((1, "a"), (1, "b"), (2, "c"), (2, "a"))] == [True, False, True, False]
    assert sorted(map(tuple, history.read_claims(spark, path).collect())) == [(1, "a"), (2, "c")]


def test_latest_keeps_other_repositories(spark, make_docs, tmp_path):
    path = str(tmp_path / "latest")
    one = report_rows(make_docs, [("one", 1, "a.py", "a@example.org")])
    two = report_rows(make_docs, [("two", 1, "a.py", "x")])
    history.write_latest_reports(one, path)
    history.write_latest_reports(two, path)
    history.write_latest_reports(report_rows(make_docs, [("one", 2, "a.py", "x")]), path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.repo, r.scan_id) for r in rows) == [("one", 2), ("two", 1)]
    assert json.loads(rows[0].report_json)["schema_version"] == "1.0"


def test_report_files_good_and_corrupt(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"summary": {"total_findings": 3, "pipeline_status": "PASS"}, "findings": []}))
    (tmp_path / "bad.json").write_text("{bad")
    (tmp_path / "empty.json").write_text('{"summary": {}, "findings": []}')
    rows = {os.path.basename(r.source_file): r for r in history.read_report_files(spark, str(tmp_path)).withColumn(
        "valid", F.coalesce(F.col("readable") & reports.is_valid_report(F.col("report")), F.lit(False))).collect()}
    assert {k: (r.readable, r.valid) for k, r in rows.items()} == {
        "good.json": (True, True), "bad.json": (False, False), "empty.json": (True, False)}
    assert rows["good.json"].report.summary.total_findings == 3


@pytest.mark.parametrize("text, valid", [
    ('{"summary":{"x":1},"findings":[]}', True), ('{"summary":{"severity_counts":{}},"findings":[1],"files_scanned":"many"}', True),
    ('{"summary":{},"findings":[]}', False), ('{"summary":{"x":1}}', False), ('{"summary":{"x":1},"findings":{}}', False),
    ('{"summary":[1],"findings":[]}', False), ("[]", False), ("", False), (None, False), ("{bad", False),
    ('{"summary":{"x":1},"findings":[]} x', False), ('{"summary":{"x":1},"findings":[]},"y":1', False)])
def test_valid_report_texts(spark, text, valid):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(reports.is_valid_report_text(F.col("t"))).first()[0] is valid


def test_equal_reports_of_one_batch_are_stored_once(spark, make_docs, tmp_path):
    path = str(tmp_path / "history")
    one = report_rows(make_docs, {"a.py": "a@example.org"}, 1)
    both = one.unionByName(one.withColumn("scan_id", F.lit(7).cast("bigint")))
    assert [(r.scan_id, r.scan_no) for r in history.append_history(both, path).collect()] == [(1, 1)]
    assert history.append_history(both, path).count() == 0


# --- masking -------------------------------------------------------------------------------------

def test_redact_documents_agrees_with_join(make_docs):
    text = "\n".join(f"line {i} mail user{i}@example.org card 4111 1111 1111 1111 é𝔘" for i in range(300))
    docs = make_docs({"a.txt": text, "b.txt": "nothing", "c.txt": ""})
    direct = {r.relative_path: r.redacted_text for r in redaction.redact_documents(docs).collect()}
    joined = {r.relative_path: r.redacted_text for r in redaction.redact_text(
        docs, validate.validate_spans(S.detect_spans(docs))).collect()}
    assert direct == joined and direct["b.txt"] == "nothing" and direct["c.txt"] == ""
    assert direct["a.txt"].split("\n")[7] == "line 7 mail us***@example.org card ***************1111 é𝔘"


def test_overlapping_masks(spark):
    df = spark.createDataFrame([("0123456789abcdef",)], "t string")
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(m).alias("mask"))
                      for s, e, m in ((2, 8, "AAAAAA"), (4, 6, "BB"), (6, 10, "CCCC"), (12, 13, "D"))])
    assert df.select(redaction.masked(F.col("t"), spans)).first()[0] == "01AAAAAA**abDdef"


def test_redacted_length_is_kept_but_for_mail(make_docs):
    docs = make_docs({"a.txt": "card 4111 1111 1111 1111 ip 10.0.0.1 tel +1 (974) 555-3436"})
    row = redaction.redact_documents(docs).first()
    assert len(row.redacted_text) == len(row.text) and row.redacted_text != row.text


# --- streams -------------------------------------------------------------------------------------

def test_stream_of_documents(spark, make_docs, tmp_path):
    inbox, found, counts, mark = (str(tmp_path / n) for n in ("inbox", "found", "counts", "mark"))
    for i in range(2):
        make_docs({f"{i}.txt": f"mail u{i}@example.org"}, scan_id=i).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("repo string, scan_id bigint, relative_path string, extension string, size_bytes bigint, "
                                         "text string").parquet(inbox)
        continuous.append_findings(stream, found, counts, mark).awaitTermination(120)
    assert sorted(r.matched_value for r in spark.read.parquet(found).collect()) == ["u0***@example.org", "u1***@example.org"]
    assert spark.read.parquet(counts).agg(F.sum("high")).first()[0] == 2
