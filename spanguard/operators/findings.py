"""Findings: validated spans with severity, category, masked value and position in their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules
from spanguard.functions import ids, paths, redact
from spanguard.operators import validate
from spanguard.operators.position import with_position
from spanguard.operators.spans import detect_spans
from spanguard.options import DEFAULT_OPTIONS, ScanOptions

SCAN_KEYS = ("repo", "scan_id")


def to_findings(spans: DataFrame, options: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Label spans that passed validation. Raw values and texts go no further."""
    severity = rules.severity_of(F.col("entity_type"), options.severity_overrides)
    path = paths.normalise_path(F.col("relative_path"))
    return spans.select(
        *SCAN_KEYS,
        path.alias("file"),
        "line_number",
        "entity_type",
        F.bround("score", 4).alias("confidence_score"),
        severity.alias("severity"),
        rules.category_of(F.col("entity_type")).alias("category"),
        redact.matched_value(F.col("entity_type"), F.col("value"), options.redact).alias("matched_value"),
        F.lit(options.redact).alias("redacted"),
        "start",
        "end",
    )


def find(
    docs: DataFrame, options: ScanOptions = DEFAULT_OPTIONS, validator: validate.Validator = validate.should_keep
) -> DataFrame:
    """Documents to findings in one pass: no shuffle, the text is dropped inside the scan stage."""
    return to_findings(detect_spans(docs, options, lines=False, validator=validator), options)


def order_columns() -> list[Column]:
    """Sort columns of the report order within a scan: walk order, then score, then place."""
    return [
        paths.traversal_order_key(F.col("file")), F.col("confidence_score").desc(), F.col("start"),
        F.col("end"), F.col("entity_type"), F.col("matched_value"),
    ]


def number_findings(findings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add finding_index (zero-based position in the report of the scan) and finding_id."""
    placed = with_position(findings, list(SCAN_KEYS), order_columns(), "finding_index", partitions)
    rest = [c for c in findings.columns if c not in SCAN_KEYS]
    return placed.select(
        *SCAN_KEYS, "finding_index", ids.finding_id(F.col("finding_index")).alias("finding_id"), *rest
    )


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*SCAN_KEYS, "file").agg(F.count(F.lit(1)).alias("finding_count"))


def finding_by_id(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Each (repo, scan_id, requested_id) with its finding; NULLs for an id that names none."""
    wanted = requests.withColumn("finding_index", ids.finding_index_of(F.col("requested_id")))
    return wanted.join(findings.drop("finding_id"), [*SCAN_KEYS, "finding_index"], "left")
