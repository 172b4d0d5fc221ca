"""Comparison of each scan with the scan before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules
from spanguard.functions import text
from spanguard.operators.findings import SCAN_KEYS
from spanguard.operators.position import with_previous
from spanguard.operators.risk import CATEGORY_COLUMNS

KEYS = list(SCAN_KEYS)
NO_PREVIOUS = "No earlier scan report is available to compare with."
COMPARED = ("total_findings", "risk_score", *CATEGORY_COLUMNS)


def trend_direction(delta: Column) -> Column:
    return F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("unchanged")


def category_deltas(current: str = "", previous: str = "previous_") -> Column:
    """ARRAY<STRUCT<category, delta, rank>> in category order; a missing count is 0."""
    def count(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("bigint")

    return F.array(*[
        F.struct(F.lit(name).alias("category"),
                 (count(current + column) - count(previous + column)).alias("delta"),
                 F.lit(rank).alias("rank"))
        for rank, (name, column) in enumerate(zip(rules.CATEGORIES, CATEGORY_COLUMNS))
    ])


def most_improved(deltas: Column) -> Column:
    """Category with the largest fall, NULL if none fell; ties by category order."""
    best = F.array_min(F.transform(deltas, lambda d: F.struct(
        d["delta"].alias("delta"), d["rank"].alias("rank"), d["category"].alias("category"))))
    return F.when(best["delta"] < 0, best["category"])


def worst(deltas: Column) -> Column:
    """Category with the largest rise, NULL if none rose; ties by category order."""
    top = F.array_max(F.transform(
        deltas, lambda d: F.struct(d["delta"].alias("delta"), (-d["rank"]).alias("rank"), d["category"].alias("category"))
    ))
    return F.when(top["delta"] > 0, top["category"])


def scan_trend(profiles: DataFrame, sequence: str = "scan_id", per_repo: bool = True) -> DataFrame:
    """One row per scan: availability, totals, scores, deltas, directions, category deltas.

    `profiles` has the scan keys, total_findings, risk_score, the ten category columns and
    optionally readable BOOLEAN. The previous scan is the one before in `sequence` order in the same
    repository, or in all of them with `per_repo=False`. An unreadable previous scan gives no trend.
    """
    base = profiles if "readable" in profiles.columns else profiles.withColumn("readable", F.lit(True))
    if per_repo:
        paired = with_previous(base, ["repo"], [F.col(sequence)], [*COMPARED, "readable"])
    else:
        flat = base.withColumn("_all", F.lit(0))
        paired = with_previous(flat, ["_all"], [F.col(sequence), F.col("repo")], [*COMPARED, "readable"])
    available = F.col("has_previous") & F.coalesce("previous_readable", F.lit(False))

    def number(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("bigint")

    findings = number("total_findings") - number("previous_total_findings")
    risk = number("risk_score") - number("previous_risk_score")
    with_deltas = paired.withColumn("_d", category_deltas())
    fields = {
        "previous_total_findings": number("previous_total_findings"),
        "current_total_findings": number("total_findings"),
        "difference": findings,
        "findings_delta": findings,
        "findings_trend": trend_direction(findings),
        "previous_risk_score": number("previous_risk_score"),
        "current_risk_score": number("risk_score"),
        "risk_score_delta": risk,
        "risk_score_trend": trend_direction(risk),
        "category_deltas": F.map_from_entries(
            F.transform("_d", lambda d: F.struct(d["category"], d["delta"]))),
        "most_improved_category": most_improved(F.col("_d")),
        "worst_category": worst(F.col("_d")),
    }
    return with_deltas.select(
        *KEYS,
        available.alias("trend_available"),
        F.when(~available, NO_PREVIOUS).alias("message"),
        *[F.when(available, value).alias(name) for name, value in fields.items()],
    )


def category_union(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Every category either side has, with both counts and the delta; a missing side counts 0."""
    left = previous.select(*keys, "category", F.col("finding_count").alias("previous_count"))
    right = current.select(*keys, "category", F.col("finding_count").alias("current_count"))
    joined = left.join(right, [*keys, "category"], "full_outer")
    before, after = F.coalesce("previous_count", F.lit(0)), F.coalesce("current_count", F.lit(0))
    return joined.select(*keys, "category", before.alias("previous_count"), after.alias("current_count"),
                         (after - before).alias("delta"))


def trend_cards(trend: DataFrame) -> DataFrame:
    """Six label and value pairs per scan; one `Trend: No Change` card when there is no trend."""
    card = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    cards = F.array(
        card("Previous Findings", text.format_count(F.col("previous_total_findings"))),
        card("Current Findings", text.format_count(F.col("current_total_findings"))),
        card("Difference", text.format_count(F.col("findings_delta"))),
        card("Trend", text.title_case(F.col("findings_trend"))),
        card("Previous Risk", text.format_count(F.col("previous_risk_score"))),
        card("Current Risk", text.format_count(F.col("current_risk_score"))),
    )
    none = F.array(card("Trend", F.lit("No Change")))
    return trend.select(*KEYS, F.when(F.col("trend_available"), cards).otherwise(none).alias("cards"))
