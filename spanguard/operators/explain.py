"""Advice joined to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanguard import advice
from spanguard.operators import ranking
from spanguard.operators.findings import SCAN_KEYS, finding_by_id

CAUSE = ["root_cause", "why_detected", "likely_developer_mistake", "security_impact"]
REFERENCE = ["owasp", "cwe", "best_practice", "references"]


def with_recommendation(findings: DataFrame) -> DataFrame:
    return advice.with_advice(findings, ["recommendation"])


def secure_coding_reference(df: DataFrame) -> DataFrame:
    return advice.with_advice(df, REFERENCE)


def root_cause_analysis(findings: DataFrame) -> DataFrame:
    """Every finding with its category, cause and impact; the confidence is copied."""
    full = advice.with_advice(findings.withColumn("confidence", F.col("confidence_score")), CAUSE)
    return full.select(*SCAN_KEYS, "finding_id", "entity_type", "severity", "category", "file",
                       "line_number", "confidence", *CAUSE)


def remediation_for_findings(findings: DataFrame) -> DataFrame:
    full = advice.with_advice(findings, ["recommendation", *REFERENCE])
    return full.select(*SCAN_KEYS, "finding_id", "entity_type", "severity", "recommendation", *REFERENCE)


def recommendations(findings: DataFrame) -> DataFrame:
    return with_recommendation(ranking.recommendations_ranked(findings))


def secure_coding_recommendations(findings: DataFrame) -> DataFrame:
    return advice.with_advice(ranking.recommendations_ranked(findings), ["recommendation", *REFERENCE])


def explain_findings(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Twelve-field answer per requested id; an id that names no finding gives NULLs."""
    found = finding_by_id(requests, findings)
    full = advice.with_advice(
        found, ["root_cause", "why_detected", "recommendation", "best_practice", "owasp", "cwe"]
    )
    known = F.col("entity_type").isNotNull()

    def answer(field: str, alias: str | None = None):
        return F.when(known, F.col(field)).alias(alias or field)

    return full.select(
        *SCAN_KEYS, "requested_id", answer("requested_id", "finding_id"),
        "entity_type", "severity", "file", "line_number", answer("root_cause"),
        answer("why_detected", "explanation"), answer("recommendation"), answer("best_practice"),
        answer("owasp"), answer("cwe"), F.col("confidence_score").alias("confidence"),
    )


def critical_with_recommendation(findings: DataFrame) -> DataFrame:
    """The first critical findings with the scan's advice for their type, '' if there is none."""
    listed = ranking.top_critical_findings(findings)
    advised = recommendations(findings).select(*SCAN_KEYS, "entity_type", "recommendation")
    joined = listed.join(advised, [*SCAN_KEYS, "entity_type"], "left")
    return joined.select(*SCAN_KEYS, "rank", "finding_id", "entity_type", "file", "line_number", "severity",
                         F.coalesce("recommendation", F.lit("")).alias("recommendation"))


