"""Nested reports, dashboards and the data behind the executive page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules
from spanguard.functions import text
from spanguard.operators import gate, ranking, risk
from spanguard.operators.findings import SCAN_KEYS
from spanguard.options import DEFAULT_OPTIONS, ScanOptions

KEYS = list(SCAN_KEYS)
FINDING_FIELDS = ("file", "line_number", "entity_type", "confidence_score", "severity", "matched_value", "redacted")
REPORT_SCHEMA = (
    "schema_version string, scanner_version string, "
    "repository struct<identifier:string,source_type:string,local_path:string>, "
    "scan struct<started_at:string,finished_at:string,duration_seconds:double,files_scanned:bigint,files_skipped:bigint>, "
    "summary struct<total_findings:bigint,severity_counts:struct<LOW:bigint,MEDIUM:bigint,HIGH:bigint,CRITICAL:bigint>,"
    "risk_score:bigint,pipeline_status:string,risk_thresholds:struct<warning:bigint,fail:bigint>>, "
    "findings array<struct<file:string,line_number:int,entity_type:string,confidence_score:double,severity:string,"
    "matched_value:string,redacted:boolean>>"
)


def iso_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def nest_findings(findings: DataFrame, page_size: int) -> DataFrame:
    """One array per scan and page, in report order. A page bounds what one row and one task hold."""
    paged = findings.withColumn("page", F.floor(F.col("finding_index") / page_size).cast("bigint"))
    nested = paged.groupBy(*KEYS, "page").agg(
        F.array_sort(F.collect_list(F.struct("finding_index", *FINDING_FIELDS))).alias("_rows")
    )
    return nested.select(
        *KEYS, "page",
        F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in FINDING_FIELDS])).alias("findings"),
    )


def report_header(scans: DataFrame, profile: DataFrame) -> DataFrame:
    """The report without its findings, one row per scan.

    `scans` has repo, scan_id and optionally source_type, local_path, started_at, finished_at,
    files_scanned, files_skipped; a missing one is NULL (files: 0).
    """
    def have(name: str, default: Column) -> Column:
        return F.col(name) if name in scans.columns else default

    started = have("started_at", F.lit(None).cast("timestamp"))
    finished = have("finished_at", F.lit(None).cast("timestamp"))
    joined = scans.join(profile, KEYS)
    return joined.select(
        *KEYS,
        F.lit(rules.SCHEMA_VERSION).alias("schema_version"),
        F.lit(rules.SCANNER_VERSION).alias("scanner_version"),
        F.struct(
            F.col("repo").alias("identifier"),
            have("source_type", F.lit("local").cast("string")).alias("source_type"),
            have("local_path", F.col("repo")).alias("local_path"),
        ).alias("repository"),
        F.struct(
            iso_time(started).alias("started_at"),
            iso_time(finished).alias("finished_at"),
            text.scan_duration(started, finished).alias("duration_seconds"),
            have("files_scanned", F.lit(0)).cast("bigint").alias("files_scanned"),
            have("files_skipped", F.lit(0)).cast("bigint").alias("files_skipped"),
        ).alias("scan"),
        F.struct(
            "total_findings",
            F.struct(*[F.col(s.lower()).alias(s) for s in rules.SEVERITIES]).alias("severity_counts"),
            "risk_score",
            "pipeline_status",
            F.struct(F.col("warning_threshold").alias("warning"), F.col("fail_threshold").alias("fail"))
            .alias("risk_thresholds"),
        ).alias("summary"),
    )


def build_reports(
    scans: DataFrame, findings: DataFrame, profile: DataFrame, options: ScanOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Nested report rows: repo, scan_id, page, page_count, report STRUCT.

    A scan with at most `report_page_size` findings has one row, which is its whole report. Larger
    scans continue on further pages under the same header; no finding is left out.
    """
    header = report_header(scans, profile)
    last = F.greatest(F.ceil(F.col("summary.total_findings") / options.report_page_size), F.lit(1))
    pages = header.withColumn("page_count", last.cast("bigint")).withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("page_count") - 1))
    )
    nested = nest_findings(findings, options.report_page_size)
    empty = F.from_json(F.lit("[]"), REPORT_SCHEMA.split("findings ")[-1])
    joined = pages.join(nested, [*KEYS, "page"], "left")
    return joined.select(
        *KEYS, "page", "page_count",
        F.struct(
            "schema_version", "scanner_version", "repository", "scan", "summary",
            F.coalesce("findings", empty).alias("findings"),
        ).alias("report"),
    )


def report_json(report: Column) -> Column:
    return F.to_json(report, {"ignoreNullFields": "false"})


def is_valid_report_text(text: Column) -> Column:
    """The text is one JSON object with a summary that has any member and an array of findings; other fields may be anything."""
    parsed = gate.parsed_report(text)
    summary = F.schema_of_variant(F.try_variant_get(parsed, "$.summary", "variant"))
    listed = F.schema_of_variant(F.try_variant_get(parsed, "$.findings", "variant"))
    shaped = summary.startswith("OBJECT<") & (summary != "OBJECT<>") & listed.startswith("ARRAY<")
    return F.coalesce(shaped, F.lit(False))


def is_valid_report(report: Column) -> Column:
    """The row has a summary with content and an array of findings."""
    summary = report["summary"]
    filled = summary["total_findings"].isNotNull() | summary["risk_score"].isNotNull() | (
        summary["pipeline_status"].isNotNull()
    )
    return report.isNotNull() & summary.isNotNull() & filled & report["findings"].isNotNull()


def _ordered_list(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    """A short ranked list per scan as an array; only ever applied to top-k rows."""
    grouped = df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_rows"))
    return grouped.select(
        *KEYS, F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)
    )


def build_dashboard(profile: DataFrame, findings: DataFrame, trend: DataFrame) -> DataFrame:
    """One row per scan: summary, category counts, trend, top files, top findings, severities."""
    files = _ordered_list(ranking.top_files(findings), ["file", "finding_count"], "top_files")
    top = _ordered_list(
        ranking.top_findings(findings), ["finding_id", "file", "line_number", "entity_type", "severity"],
        "top_findings",
    )
    trends = trend.select(*KEYS, F.struct(*[c for c in trend.columns if c not in KEYS]).alias("trend"))
    joined = profile.join(trends, KEYS, "left").join(files, KEYS, "left").join(top, KEYS, "left")
    return joined.select(
        *KEYS,
        F.current_timestamp().alias("generated_at"),
        F.struct(
            "total_findings", "risk_score",
            F.coalesce("pipeline_status", F.lit("UNKNOWN")).alias("pipeline_status"),
        ).alias("summary"),
        risk.category_map().alias("category_counts"),
        "trend", "top_files", "top_findings",
        risk.severity_map().alias("severity_distribution"),
    )


def chart_data(profile: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scan: severities worst first, all categories, the top categories and the top files."""
    categories = _ordered_list(ranking.top_categories(profile), ["category", "finding_count"], "top_categories")
    files = _ordered_list(ranking.top_files(findings), ["file", "finding_count"], "top_files")
    worst = F.create_map(*[x for s in rules.SEVERITIES_DESC for x in (F.lit(s), F.col(s.lower()))])
    joined = profile.join(categories, KEYS, "left").join(files, KEYS, "left")
    return joined.select(*KEYS, worst.alias("severity"), risk.category_map().alias("categories"),
                         "top_categories", "top_files")


def executive_metrics(profile: DataFrame, scans: DataFrame) -> DataFrame:
    """Seven labelled numbers per scan, in display order."""
    joined = profile.join(scans.select(*KEYS, "files_scanned"), KEYS)
    cards = (
        ("Total Findings", "total_findings"), ("Critical", "critical"), ("High", "high"),
        ("Medium", "medium"), ("Low", "low"), ("Risk Score", "risk_score"), ("Files Scanned", "files_scanned"),
    )
    metrics = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), text.format_count(F.col(c)).alias("value"))
        for i, (label, c) in enumerate(cards)
    ])
    return joined.select(*KEYS, metrics.alias("metrics"))


def release_recommendation(profile: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scan: release status, tone, reason and actions."""
    joined = profile.join(ranking.distinct_entities_preview(findings), KEYS, "left")
    status = F.col("pipeline_status")
    failed = status == "FAIL"
    counted = [F.when(F.col(c) > 0, F.format_string(t, c)) for c, t in rules.RELEASE_COUNTS.items()]
    verdict = F.when(failed, rules.RELEASE_REASON["FAIL"]).otherwise(rules.RELEASE_REASON["WARNING"])
    types = F.when(F.size("entities") > 0, F.format_string(rules.RELEASE_TYPES, F.array_join("entities", ", ")))
    safe = status == "PASS"
    return joined.select(
        *KEYS,
        F.when(safe, rules.RELEASE_STATUS["PASS"]).when(failed, rules.RELEASE_STATUS["FAIL"])
        .otherwise(rules.RELEASE_STATUS["WARNING"]).alias("release_status"),
        F.when(safe, "pass").when(failed, "fail").otherwise("warning").alias("tone"),
        F.when(safe, rules.RELEASE_REASON["PASS"])
        .otherwise(F.concat_ws(" ", *counted, verdict, types)).alias("reason"),
        F.when(safe, rules.lits(rules.SAFE_ACTIONS)).otherwise(rules.lits(rules.BLOCKED_ACTIONS)).alias("actions"),
    )
