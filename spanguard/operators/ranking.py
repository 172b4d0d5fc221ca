"""Top-k lists per scan.

Every list is `row_number() <= k`, which Spark limits inside each task before the shuffle, so a scan
with very many findings sends k rows per task and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard import rules
from spanguard.operators.findings import SCAN_KEYS
from spanguard.operators.risk import category_rows


def top_per_scan(df: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*SCAN_KEYS).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def worst_first() -> list[Column]:
    return [rules.severity_order(F.col("severity")), F.col("finding_index")]


def top_findings(findings: DataFrame, limit: int = rules.TOP_FINDINGS) -> DataFrame:
    """Worst severity first, then report order."""
    return top_per_scan(findings, worst_first(), limit)


def key_findings(findings: DataFrame, totals: DataFrame) -> DataFrame:
    return _with_remaining(top_findings(findings, rules.KEY_FINDINGS), totals, rules.KEY_FINDINGS)


def detailed_findings(findings: DataFrame, totals: DataFrame) -> DataFrame:
    return _with_remaining(top_findings(findings, rules.DETAILED_FINDINGS), totals, rules.DETAILED_FINDINGS)


def remaining_count(total: Column, limit: int) -> Column:
    return F.greatest(total - limit, F.lit(0)).cast("bigint")


def _with_remaining(listed: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    counts = totals.select(*SCAN_KEYS, remaining_count(F.col("total_findings"), limit).alias("remaining"))
    return listed.join(counts, list(SCAN_KEYS))


def top_critical_findings(findings: DataFrame) -> DataFrame:
    critical = findings.where(F.col("severity") == "CRITICAL")
    return top_per_scan(critical, [F.col("finding_index")], rules.TOP_CRITICAL)


def prompt_sample(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """The first findings in report order, without any matched value."""
    flag = totals.select(*SCAN_KEYS, (F.col("total_findings") > rules.PROMPT_SAMPLE).alias("truncated"))
    sample = findings.where(F.col("finding_index") < rules.PROMPT_SAMPLE)
    return sample.select(*SCAN_KEYS, "finding_index", "entity_type", "severity", "file").join(
        flag, list(SCAN_KEYS)
    )


def file_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*SCAN_KEYS, "file").agg(
        F.count(F.lit(1)).alias("finding_count"), F.min("finding_index").alias("first_index")
    )


def top_files(findings: DataFrame, limit: int = rules.TOP_FILES) -> DataFrame:
    """Most findings first, ties by first appearance."""
    return top_per_scan(file_counts(findings), [F.col("finding_count").desc(), F.col("first_index")], limit)


def top_categories(counts: DataFrame, limit: int = rules.TOP_CATEGORIES) -> DataFrame:
    """Categories with findings, most first, ties in category order."""
    present = category_rows(counts).where(F.col("finding_count") > 0)
    return top_per_scan(present, [F.col("finding_count").desc(), F.col("category_rank")], limit)


def max_severity_per_entity(findings: DataFrame) -> DataFrame:
    """Highest severity seen per entity type; rows without a type or a known severity are left out."""
    usable = findings.where(
        F.col("entity_type").isNotNull() & (F.col("entity_type") != "")
        & F.col("severity").isin(*rules.SEVERITIES)
    )
    return usable.groupBy(*SCAN_KEYS, "entity_type").agg(
        F.max(rules.severity_rank(F.col("severity"))).alias("severity_rank"),
        F.min("finding_index").alias("first_index"),
    )


def recommendations_ranked(findings: DataFrame) -> DataFrame:
    """One row per entity type of a scan, worst first, ties by first appearance."""
    per_entity = max_severity_per_entity(findings)
    window = Window.partitionBy(*SCAN_KEYS).orderBy(F.col("severity_rank").desc(), "first_index", "entity_type")
    return per_entity.select(
        *SCAN_KEYS, "entity_type",
        F.element_at(rules.lits(rules.SEVERITIES), F.col("severity_rank") + 1).alias("severity"),
        F.row_number().over(window).alias("rank"),
    )


def distinct_entities_preview(findings: DataFrame) -> DataFrame:
    """Sorted entity types among the first findings of each scan."""
    first = findings.where(F.col("finding_index") < rules.PREVIEW_FINDINGS)
    return first.groupBy(*SCAN_KEYS).agg(
        F.slice(F.sort_array(F.collect_set(F.coalesce("entity_type", F.lit("UNKNOWN")))), 1,
                rules.PREVIEW_ENTITIES).alias("entities")
    )
