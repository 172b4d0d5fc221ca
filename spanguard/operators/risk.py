"""Counts, scores and status per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules
from spanguard.operators.findings import SCAN_KEYS
from spanguard.options import DEFAULT_OPTIONS, ScanOptions


def severity_aggregates() -> list[Column]:
    """low, medium, high, critical and total_findings, for one map-side-combined aggregation."""
    return [
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in rules.SEVERITIES],
        F.count(F.lit(1)).alias("total_findings"),
    ]


def category_column(category: str) -> str:
    return category.lower().replace(" ", "_")


CATEGORY_COLUMNS = tuple(category_column(c) for c in rules.CATEGORIES)


def category_aggregates() -> list[Column]:
    return [
        F.count_if(F.col("category") == c).alias(category_column(c)) for c in rules.CATEGORIES
    ]


def _zero_filled(scans: DataFrame, counts: DataFrame) -> DataFrame:
    """Scans without findings appear with zeros."""
    measures = [c for c in counts.columns if c not in SCAN_KEYS]
    joined = scans.select(*SCAN_KEYS).join(counts, list(SCAN_KEYS), "left")
    return joined.select(*SCAN_KEYS, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in measures])


def severity_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    return _zero_filled(scans, findings.groupBy(*SCAN_KEYS).agg(*severity_aggregates()))


def category_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One column per category, all ten present."""
    return _zero_filled(scans, findings.groupBy(*SCAN_KEYS).agg(*category_aggregates()))


def risk_score() -> Column:
    score = F.lit(0).cast("bigint")
    for severity, weight in rules.SEVERITY_WEIGHTS.items():
        score = score + F.col(severity.lower()) * weight
    return score


def pipeline_status(score: Column, critical: Column, options: ScanOptions = DEFAULT_OPTIONS) -> Column:
    return (
        F.when((critical > 0) | (score >= options.fail_threshold), "FAIL")
        .when(score >= options.warning_threshold, "WARNING")
        .otherwise("PASS")
    )


def assess(counts: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Add score, status and the thresholds used to rows that carry the severity counts."""
    return (
        counts.withColumn("risk_score", risk_score())
        .withColumn("pipeline_status", pipeline_status(F.col("risk_score"), F.col("critical"), options))
        .withColumn("warning_threshold", F.lit(options.warning_threshold).cast("bigint"))
        .withColumn("fail_threshold", F.lit(options.fail_threshold).cast("bigint"))
    )


def risk_assessment(scans: DataFrame, findings: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    return assess(severity_counts(scans, findings), options)


def scan_profile(scans: DataFrame, findings: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Severity counts, category counts, score and status from a single aggregation."""
    counts = findings.groupBy(*SCAN_KEYS).agg(*severity_aggregates(), *category_aggregates())
    return assess(_zero_filled(scans, counts), options)


def severity_map() -> Column:
    """MAP of the four counts, lowest first."""
    pairs = [x for s in rules.SEVERITIES for x in (F.lit(s), F.col(s.lower()))]
    return F.create_map(*pairs)


def category_map() -> Column:
    pairs = [x for c in rules.CATEGORIES for x in (F.lit(c), F.col(category_column(c)))]
    return F.create_map(*pairs)


def category_rows(counts: DataFrame) -> DataFrame:
    """Long form: one row per scan and category."""
    pairs = F.array(*[
        F.struct(F.lit(i + 1).alias("category_rank"), F.lit(c).alias("category"),
                 F.col(category_column(c)).alias("finding_count"))
        for i, c in enumerate(rules.CATEGORIES)
    ])
    return counts.select(*SCAN_KEYS, F.inline(pairs))


def scan_accounting(files: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """files_scanned and files_skipped per scan.

    `files` has extension, size_bytes and optionally text and excluded BOOLEAN. Files of another
    extension or in an excluded directory are out of scope and count as neither. Without a text
    column every file of a fitting size counts as readable, and no text is scanned for the count.
    """
    in_scope = F.lower("extension").isin(*options.supported_extensions)
    if "excluded" in files.columns:
        in_scope = in_scope & ~F.col("excluded")
    size, limit = F.col("size_bytes"), F.lit(options.max_file_size_bytes)
    readable = size.isNotNull() & (size <= limit)
    if "text" in files.columns:
        readable = readable & F.col("text").isNotNull()
    measures = [
        F.count_if(in_scope & readable).alias("files_scanned"),
        F.count_if(in_scope & ~readable).alias("files_skipped"),
    ]
    if "started_at" in files.columns:
        measures += [F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")]
    return files.groupBy(*SCAN_KEYS).agg(*measures)
