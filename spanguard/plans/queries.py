"""The registered queries: name -> function of (session, table directory)."""

from __future__ import annotations

import re
import uuid
from collections import namedtuple
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.functions import ids, paths, sqlfuncs, text
from spanguard.operators import (
    explain, findings as fi, gate, narrative, overlaps, ranking, redaction, reports, risk, spans as sp, trend, validate,
)
from spanguard.operators.position import with_position
from spanguard.options import ScanOptions
from spanguard.plans import fixtures as fx
from spanguard.session import cut, ensure_checkpoint_dir
from spanguard.sources import files as fs, history, tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KEYS = ["repo", "scan_id"]
PLACE = ["repo", "scan_id", "relative_path", "start", "end", "entity_type", "score", "value"]


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _flat(rows: Column, fields: list[str]) -> Column:
    """A short array of structs as one text: fields by `:`, items by `|`."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(
        ":", *[F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields])), "|")


def _scan_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbered findings and the profile made from the same checkpointed rows: one detection pass."""
    numbered = fx.numbered(spark, sf_dir)
    return numbered, risk.scan_profile(fx.scans(spark, sf_dir), numbered)


# --- flagship ------------------------------------------------------------------------------------

@query
def repo_risk(spark, sf_dir):
    return risk.risk_assessment(fx.scans(spark, sf_dir), fx.findings(spark, sf_dir))


# --- detection -----------------------------------------------------------------------------------

def _spans_of(name: str) -> Query:
    def run(spark, sf_dir):
        found = sp.detect_spans(fx.documents(spark, sf_dir), ScanOptions(recognizers=(name,)))
        return found.select(*PLACE, "line_number")
    return run


for _query, _name in (
    ("spans_email", "email"), ("spans_card_luhn", "credit_card"), ("spans_ipv4", "ipv4"),
    ("spans_phone", "phone"), ("spans_secret", "api_key"), ("spans_iban", "iban"),
):
    REGISTRY[_query] = _spans_of(_name)


@query
def spans_url(spark, sf_dir):
    found = sp.detect_spans(fx.url_documents(spark, sf_dir), ScanOptions(recognizers=("url",)))
    return found.select(*PLACE, paths.url_host(F.col("value")).alias("host"))


@query
def spans_in_html(spark, sf_dir):
    pages = tables.load_documents(
        fx.table(spark, sf_dir, "pages"), F.col("page_id"), F.lit(0), F.lit("page.html"), F.col("html"))
    return sp.detect_spans(pages, ScanOptions(recognizers=("email", "phone", "ipv4"))).select(*PLACE)


@query
def spans_in_conversations(spark, sf_dir):
    turns = tables.load_documents(
        fx.table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn"), F.concat(F.col("role"), F.lit(".txt")),
        F.col("text"))
    return sp.detect_spans(turns, ScanOptions(recognizers=("email", "phone", "credit_card"))).select(*PLACE)


SYNTHETIC = ("ssn", "itin", "nhs", "dea", "aadhaar", "pan", "us_passport", "in_passport", "us_bank", "us_driver",
             "date", "jwt", "password", "private_key")


@query
def synthetic_ids(spark, sf_dir):
    found = sp.detect_spans(fx.identifier_documents(spark, sf_dir), ScanOptions(recognizers=SYNTHETIC))
    return found.select(*PLACE, "line_number")


def _made_spans(lines: tuple[str, ...], *names: str) -> Query:
    def run(spark, sf_dir):
        found = sp.detect_spans(fx.made_documents(spark, sf_dir, lines), ScanOptions(recognizers=names), lines=False)
        return found.select(*PLACE, "line_number")
    return run


REGISTRY["spans_secrets_bare"] = _made_spans(fx.SECRET_LINES, "api_key", "password", "secret")
REGISTRY["spans_whole_keys"] = _made_spans(fx.KEY_LINES, "private_key")
REGISTRY["spans_cards_in_groups"] = _made_spans(fx.CARD_LINES, "credit_card")
REGISTRY["spans_ipv6"] = _made_spans(fx.IPV6_LINES, "ipv6")
REGISTRY["spans_iban_valid"] = _made_spans(fx.IBAN_LINES, "iban")


@query
def spans_long_lines(spark, sf_dir):
    options = ScanOptions(recognizers=("email", "phone", "credit_card", "ipv4"))
    found = sp.detect_spans(fx.long_line_documents(spark, sf_dir), options, lines=False)
    return found.select(*PLACE, "line_number", F.md5("window").alias("window_md5"))


@query
def synthetic_wallets(spark, sf_dir):
    return sp.detect_spans(fx.wallet_documents(spark, sf_dir), ScanOptions(recognizers=("crypto",))).select(*PLACE)


@query
def context_columns(spark, sf_dir):
    return sp.detect_spans(fx.documents(spark, sf_dir)).select(*PLACE, "line_number", "window", "line")


@query
def spans_from_table(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    outside = sp.detect_spans(docs).select("repo", "scan_id", "relative_path", "start", "end", "entity_type", "score")
    return sp.spans_with_docs(outside, docs).select(*PLACE, "line_number", "window", "line")


class MailEngine:
    """A stand-in for a caller's Python recognizer."""

    Item = namedtuple("Item", "entity_type start end score")
    pattern = re.compile(r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,190}\.[A-Za-z]{2,24}")

    def analyze(self, text, language, score_threshold):
        return [self.Item("EMAIL_ADDRESS", m.start(), m.end(), 1.0) for m in self.pattern.finditer(text)]


@query
def spans_from_udf(spark, sf_dir):
    result = sp.spans_from_udf(fx.documents(spark, sf_dir), MailEngine, name="mail")
    return sp.udf_spans(result).select(*PLACE, "line_number")


@query
def resolve_overlaps(spark, sf_dir):
    resolved = overlaps.resolve_overlaps(fx.overlapping_spans(spark, sf_dir))
    return resolved.select("repo", "start", "end", "entity_type", "score")


# --- validation ----------------------------------------------------------------------------------

@query
def rule_nlp(spark, sf_dir):
    docs = cut(fx.sentences(spark, sf_dir))
    spans = fx.sentence_spans(docs)
    joined = sp.spans_with_docs(spans, docs.drop("start", "end"))
    ctx = validate.context_of()
    return joined.select(
        "repo", "relative_path", "entity_type", "value", validate.should_keep(ctx).alias("keep"),
        validate.is_documentation_context(ctx).alias("documentation"), validate.is_test_context(ctx).alias("test"),
        validate.is_code_context(ctx).alias("code"), validate.is_public_repository_context(ctx).alias("credit"),
        validate.has_sensitive_context(ctx).alias("sensitive"),
    )


@query
def rule_url(spark, sf_dir):
    found = sp.detect_spans(fx.url_documents(spark, sf_dir), ScanOptions(recognizers=("url",)))
    ctx = validate.context_of()
    return found.select("repo", "relative_path", "value", validate.url_has_secret(ctx.value).alias("secret"),
                        validate.is_public_host(paths.url_host(ctx.value)).alias("public"),
                        validate.should_keep(ctx).alias("keep"))


@query
def rule_date(spark, sf_dir):
    found = sp.detect_spans(fx.date_documents(spark, sf_dir), ScanOptions(recognizers=("date",)))
    return found.select("repo", "value", validate.should_keep(validate.context_of()).alias("keep"))


@query
def validated_spans(spark, sf_dir):
    return validate.validate_spans(sp.detect_spans(fx.documents(spark, sf_dir))).select(*PLACE)


@query
def custom_validator(spark, sf_dir):
    def strict(ctx: validate.Context) -> Column:
        return validate.should_keep(ctx) & ~validate.is_test_context(ctx)

    return validate.validate_spans(sp.detect_spans(fx.documents(spark, sf_dir)), strict).select(*PLACE)


# --- masking -------------------------------------------------------------------------------------

@query
def redacted_findings(spark, sf_dir):
    return fx.findings(spark, sf_dir).select(
        *KEYS, "file", "start", "end", "line_number", "entity_type", "confidence_score", "severity", "category",
        "matched_value", "redacted")


@query
def redacted_documents(spark, sf_dir):
    return redaction.redact_documents(fx.documents(spark, sf_dir)).select(
        "repo", "scan_id", "relative_path", "redacted_text")


@query
def masked_logs(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    secrets = events.select("user_id").distinct().select(
        "user_id", F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 90 + 10).cast("string")).alias("secret"))
    logs = events.select("event_id", "user_id", F.concat(F.lit("https://oauth2:"), "props", F.lit("@host")).alias("message"))
    return redaction.mask_logs(logs, secrets, ["user_id"], "message").select("event_id", "masked_message")


# --- ids and explanations ------------------------------------------------------------------------

@query
def finding_ids(spark, sf_dir):
    numbered = fx.numbered(spark, sf_dir)
    return numbered.select(*KEYS, "finding_index", "finding_id", "file", "entity_type", "start",
                           ids.finding_index_of(F.col("finding_id")).alias("parsed_index"))


def _requests(spark, sf_dir) -> DataFrame:
    wanted = ("F-000000", "F-000003", "F-999999", "F-", "bad", "F-00x001")
    return fx.scans(spark, sf_dir).select(*KEYS, F.explode(F.array(*[F.lit(w) for w in wanted])).alias("requested_id"))


@query
def explain_findings(spark, sf_dir):
    return explain.explain_findings(_requests(spark, sf_dir), fx.numbered(spark, sf_dir))


@query
def finding_by_id(spark, sf_dir):
    found = fi.finding_by_id(_requests(spark, sf_dir), fx.numbered(spark, sf_dir))
    return found.select(*KEYS, "requested_id", "finding_index", "file", "entity_type", "severity")


# --- aggregates ----------------------------------------------------------------------------------

@query
def severity_counts(spark, sf_dir):
    return risk.severity_counts(fx.scans(spark, sf_dir), fx.findings(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return risk.category_counts(fx.scans(spark, sf_dir), fx.findings(spark, sf_dir))


@query
def findings_per_file(spark, sf_dir):
    return fi.findings_per_file(fx.findings(spark, sf_dir))


@query
def max_severity_per_entity(spark, sf_dir):
    return ranking.max_severity_per_entity(fx.numbered(spark, sf_dir))


@query
def distinct_entities_preview(spark, sf_dir):
    seen = ranking.distinct_entities_preview(fx.numbered(spark, sf_dir))
    return seen.select(*KEYS, F.array_join("entities", ",").alias("entities"))


# --- rankings ------------------------------------------------------------------------------------

@query
def top_findings(spark, sf_dir):
    return ranking.top_findings(fx.numbered(spark, sf_dir)).select(
        *KEYS, "rank", "finding_id", "file", "line_number", "entity_type", "severity")


@query
def key_findings(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    return ranking.key_findings(numbered, profile).select(
        *KEYS, "rank", "finding_id", "severity", "entity_type", "file", "line_number", "remaining")


@query
def detailed_findings(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    listed = ranking.detailed_findings(numbered, profile)
    return explain.secure_coding_reference(listed).select(
        *KEYS, "rank", "finding_id", "severity", "entity_type", "owasp", "cwe", "remaining")


@query
def top_critical(spark, sf_dir):
    return ranking.top_critical_findings(fx.numbered(spark, sf_dir)).select(
        *KEYS, "rank", "finding_id", "entity_type", "file", "line_number")


@query
def prompt_sample(spark, sf_dir):
    return ranking.prompt_sample(*_scan_data(spark, sf_dir))


@query
def top_files(spark, sf_dir):
    return ranking.top_files(fx.numbered(spark, sf_dir)).select(*KEYS, "rank", "file", "finding_count")


@query
def top_categories(spark, sf_dir):
    return ranking.top_categories(fx.profile(spark, sf_dir)).select(*KEYS, "rank", "category", "finding_count")


# --- advice --------------------------------------------------------------------------------------

@query
def recommendations(spark, sf_dir):
    return explain.recommendations(fx.numbered(spark, sf_dir))


@query
def secure_coding(spark, sf_dir):
    advised = explain.secure_coding_recommendations(fx.numbered(spark, sf_dir))
    return advised.withColumn("references", F.array_join("references", " "))


@query
def root_cause(spark, sf_dir):
    return explain.root_cause_analysis(fx.numbered(spark, sf_dir))


@query
def remediation(spark, sf_dir):
    advised = explain.remediation_for_findings(fx.numbered(spark, sf_dir))
    return advised.withColumn("references", F.array_join("references", " "))


@query
def critical_with_recommendation(spark, sf_dir):
    return explain.critical_with_recommendation(fx.numbered(spark, sf_dir))


# --- trends --------------------------------------------------------------------------------------

@query
def scan_trend(spark, sf_dir):
    return trend.scan_trend(fx.profile(spark, sf_dir)).drop("category_deltas", "message")


@query
def category_trend(spark, sf_dir):
    rows = trend.scan_trend(fx.profile(spark, sf_dir)).where("trend_available")
    return rows.select(*KEYS, F.explode("category_deltas").alias("category", "delta"))


@query
def category_union(spark, sf_dir):
    rows = risk.category_rows(fx.profile(spark, sf_dir)).where(F.col("finding_count") > 0)
    kept = cut(rows)
    before = kept.withColumn("scan_id", F.col("scan_id") + 1)
    return trend.category_union(before, kept, KEYS)


@query
def trend_cards(spark, sf_dir):
    cards = trend.trend_cards(trend.scan_trend(fx.profile(spark, sf_dir)))
    return cards.select(*KEYS, _flat(F.col("cards"), ["label", "value"]).alias("cards"))


# --- reports -------------------------------------------------------------------------------------

def _reports(spark, sf_dir, options: ScanOptions = ScanOptions()) -> DataFrame:
    numbered, profile = _scan_data(spark, sf_dir)
    return reports.build_reports(fx.scans(spark, sf_dir), numbered, profile, options)


@query
def reports_nested(spark, sf_dir):
    """Pages of two findings, opened again: every finding is there, in order."""
    nested = _reports(spark, sf_dir, ScanOptions(report_page_size=2))
    opened = nested.select(*KEYS, "page", "page_count", "report.summary", F.posexplode_outer("report.findings").alias(
        "position", "finding"))
    return opened.select(
        *KEYS, "page", "page_count", "position", F.col("summary.total_findings").alias("total_findings"),
        F.col("summary.risk_score").alias("risk_score"), F.col("summary.pipeline_status").alias("pipeline_status"),
        F.col("finding.file").alias("file"), F.col("finding.line_number").alias("line_number"),
        F.col("finding.entity_type").alias("entity_type"), F.col("finding.matched_value").alias("matched_value"),
    )


@query
def valid_reports(spark, sf_dir):
    texts = _report_variants(spark, sf_dir)
    return texts.select(*KEYS, "variant", reports.is_valid_report_text(F.col("report_json")).alias("valid"))


@query
def dashboard(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    built = reports.build_dashboard(profile, numbered, trend.scan_trend(profile))
    return built.select(
        *KEYS, F.col("summary.total_findings").alias("total_findings"), F.col("summary.risk_score").alias("risk_score"),
        F.col("summary.pipeline_status").alias("pipeline_status"),
        F.col("category_counts")["Financial Data"].alias("financial"), F.col("category_counts")["Other"].alias("other"),
        F.col("trend.trend_available").alias("trend_available"), F.col("trend.findings_delta").alias("findings_delta"),
        _flat(F.col("top_files"), ["file", "finding_count"]).alias("top_files"),
        _flat(F.col("top_findings"), ["finding_id", "severity"]).alias("top_findings"),
        F.col("severity_distribution")["CRITICAL"].alias("critical"),
    )


@query
def chart_data(spark, sf_dir):
    charts = reports.chart_data(*reversed(_scan_data(spark, sf_dir)))
    return charts.select(
        *KEYS, F.col("severity")["HIGH"].alias("high"), F.col("categories")["Personal Information"].alias("personal"),
        _flat(F.col("top_categories"), ["category", "finding_count"]).alias("top_categories"),
        _flat(F.col("top_files"), ["file", "finding_count"]).alias("top_files"))


@query
def executive_metrics(spark, sf_dir):
    metrics = reports.executive_metrics(fx.profile(spark, sf_dir), fx.scans(spark, sf_dir))
    return metrics.select(*KEYS, F.inline("metrics"))


@query
def release_recommendation(spark, sf_dir):
    advised = reports.release_recommendation(*reversed(_scan_data(spark, sf_dir)))
    return advised.withColumn("actions", F.array_join("actions", " "))


BROKEN_REPORTS = (None, "", "{bad", "[]", "{}", '{"summary":[]}', '{"summary":{}}',
                  '{"summary":{"pipeline_status":"MAYBE"}}', '{"summary":{"pipeline_status":"PASS"}} x',
                  '{"summary":{"pipeline_status":"WARNING"}}')


def _report_variants(spark, sf_dir) -> DataFrame:
    """Each scan's report text and broken texts beside it."""
    texts = _reports(spark, sf_dir).select(*KEYS, reports.report_json(F.col("report")).alias("_j"))
    variants = F.array(F.col("_j"), *[F.lit(b).cast("string") for b in BROKEN_REPORTS])
    return texts.select(*KEYS, F.posexplode(variants).alias("variant", "report_json"))


@query
def release_gate(spark, sf_dir):
    return gate.evaluate_gate(_report_variants(spark, sf_dir)).drop("report_json")


# --- texts ---------------------------------------------------------------------------------------

@query
def summary_markdown(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    return narrative.summary_markdown(profile, numbered)


@query
def guidance_markdown(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    return narrative.guidance_markdown(profile, numbered)


@query
def prompts(spark, sf_dir):
    numbered, profile = _scan_data(spark, sf_dir)
    return narrative.build_prompts(profile, numbered)


@query
def narratives(spark, sf_dir):
    profile = fx.profile(spark, sf_dir)
    given = fx.scans(spark, sf_dir).select(
        *KEYS, F.when(F.col("scan_id") == 1, F.lit(" \t\n")).when(F.col("scan_id") == 2, F.lit(" All good. \n"))
        .alias("narrative"))
    return narrative.apply_narratives(profile, given).select(*KEYS, "executive_summary")


# --- files and formatting ------------------------------------------------------------------------

LIMIT = ScanOptions(max_file_size_bytes=2000)


@query
def scan_accounting(spark, sf_dir):
    listed = fx.files(spark, sf_dir).drop("text")
    excluded = paths.in_excluded_directory(F.col("relative_path"), LIMIT.excluded_directories)
    return risk.scan_accounting(listed.withColumn("excluded", excluded), LIMIT)


@query
def file_filters(spark, sf_dir):
    return tables.in_scope(fx.files(spark, sf_dir), LIMIT).select("repo", "scan_id", "relative_path", "extension", "size_bytes")


@query
def traversal_order(spark, sf_dir):
    """Place of each file in the walk of its repository."""
    listed = fx.files(spark, sf_dir).select("repo", "relative_path")
    order = [paths.traversal_order_key(F.col("relative_path"))]
    return with_position(listed, ["repo"], order)


@query
def path_functions(spark, sf_dir):
    path = F.col("relative_path")
    return fx.files(spark, sf_dir).select(
        "repo", path, paths.path_stem(path).alias("stem"), paths.extension(path).alias("suffix"),
        F.size(paths.path_parts(path)).alias("parts"),
        paths.relative_to(path, F.lit("src")).alias("below_src"))


@query
def decoded_files(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "documents")
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    content = F.encode(F.concat(crlf, F.lit("\rend")), "UTF-8")
    # a lone continuation byte in front makes the bytes invalid UTF-8, so they are read as Latin-1
    latin = F.concat(F.unhex(F.lit("E9")), F.encode(F.lit(" caf"), "UTF-8"), F.unhex(F.lit("E9")))
    return raw.select("doc_id", fs.decode_text(content).alias("text"), fs.decode_text(
        F.concat(latin, F.encode(F.col("source"), "UTF-8"))).alias("latin"))


@query
def formatting(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem")
    size = F.floor(F.pow(F.col("l_quantity"), F.lit(8.0)) + F.col("l_partkey")).cast("bigint")
    seconds = F.floor(F.col("l_extendedprice")) / 2
    return items.select(
        "l_orderkey", "l_linenumber",
        text.human_readable_size(size).alias("size_text"),
        text.format_duration(seconds).alias("duration_text"),
        text.format_count(F.floor("l_extendedprice").cast("bigint")).alias("count_text"),
        text.timestamp_slug(F.col("l_shipdate")).alias("slug"),
        text.format_report_date(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("report_date"),
        text.status_tone(F.when(F.col("l_returnflag") == "A", "PASS").otherwise(F.col("l_returnflag"))).alias("tone"),
    )


@query
def scan_times(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    timed = events.groupBy("user_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(F.lit(1)).alias("files_scanned"))
    duration = text.scan_duration(F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"))
    return timed.select("user_id", "files_scanned", duration.alias("duration_seconds"),
                        text.format_duration(duration).alias("duration_text"))


@query
def sql_functions(spark, sf_dir):
    sqlfuncs.register(spark)
    found = sp.detect_spans(fx.documents(spark, sf_dir)).select(*PLACE)
    return found.selectExpr(
        "repo", "scan_id", "relative_path", "start", "entity_type", "sg_severity_of(entity_type) AS severity",
        "sg_category_of(entity_type) AS category", "sg_redact_value(entity_type, value) AS masked",
        "sg_finding_id(start) AS fid", "sg_human_readable_size(start) AS size_text",
        "sg_is_high_signal(entity_type) AS high_signal")


# --- history -------------------------------------------------------------------------------------

@query
def repo_files(spark, sf_dir):
    """Documents written to trees of files, walked and read again."""
    ensure_checkpoint_dir(spark)
    folder = urlparse(f"{spark.sparkContext.getCheckpointDir()}/tree-{uuid.uuid4().hex}")
    if folder.scheme not in ("", "file"):
        raise ValueError("trees of files need spark.checkpoint.dir on a mounted folder")
    roots = fx.written_tree(spark, sf_dir, folder.path)
    files = fs.scan_documents_with_content(fs.read_repo_files(spark, roots, ScanOptions(max_file_size_bytes=1 << 40)))
    return files.select(*KEYS, "relative_path", "extension", "size_bytes", F.md5("text").alias("text_md5"))


@query
def history_append(spark, sf_dir):
    """Scans 0 and 1 are stored already; storing all again adds only the others. The rows are those read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}"
    began = F.date_format(F.timestamp_seconds(F.col("scan_id") * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")  # so no two reports are equal
    rows = cut(_reports(spark, sf_dir).withColumn("report", F.col("report").withField("scan.started_at", began)))
    history.append_history(rows.where(F.col("scan_id") < 2), path)
    history.append_history(rows, path)
    return history.read_history(spark, path).where(F.col("page") == 0).select("repo", "scan_id", "scan_no")


def _headers(spark, sf_dir) -> DataFrame:
    rows = _reports(spark, sf_dir).select(
        *KEYS, (F.col("scan_id") + 1).alias("scan_no"), "page",
        F.format_string("Report_%03d", F.col("scan_id") + 1).alias("name"),
        F.lit(None).cast("timestamp").alias("stored_at"),
        F.when(F.col("scan_id") != 2, reports.report_json(F.col("report"))).otherwise(F.lit("{bad")).alias("report_json"))
    return history.history_headers(rows)


@query
def history_index(spark, sf_dir):
    return history.history_index(_headers(spark, sf_dir))


@query
def recent_reports(spark, sf_dir):
    return history.recent_reports(_headers(spark, sf_dir)).select("repo", "scan_no", "rank", "pipeline_status")


@query
def latest_previous_report(spark, sf_dir):
    return history.latest_previous_report(_headers(spark, sf_dir)).select("repo", "scan_no", "total_findings")


@query
def trend_with_unreadable(spark, sf_dir):
    """As scan_trend, with the report of scan 1 unreadable: scan 2 has nothing to compare with."""
    profile = fx.profile(spark, sf_dir).withColumn("readable", F.col("scan_id") != 1)
    return trend.scan_trend(profile).select(*KEYS, "trend_available", "findings_delta", "risk_score_trend")


