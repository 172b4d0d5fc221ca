"""Release gate over report texts. Whatever cannot be read fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules


def parsed_report(text: Column) -> Column:
    """The report as a VARIANT, NULL unless the text is exactly one JSON value.

    The parser stops after the first value, so the text becomes the first of two array elements, the second a mark made from
    the text. Only an array of exactly two elements that ends with the mark is taken: further values change the number,
    further members are no array syntax, and a text that closes the array itself loses the mark.
    """
    mark = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    size = F.size(F.try_variant_get(wrapped, "$", "array<variant>"))
    intact = (size == 2) & (F.try_variant_get(wrapped, "$[1]", "string") == mark)
    return F.when(intact, F.try_variant_get(wrapped, "$[0]", "variant"))


def gate_reason(text: Column, report: Column, status: Column) -> Column:
    summary = F.schema_of_variant(F.try_variant_get(report, "$.summary", "variant"))
    return (
        F.when(text.isNull() | (text == ""), "no report")
        .when(report.isNull(), "not valid JSON")
        .when(~F.coalesce(F.startswith(summary, F.lit("OBJECT")), F.lit(False)), "no summary object")
        .when(status.isNull(), "unknown pipeline_status")
        .otherwise(F.concat(F.lit("pipeline_status is "), status))
    )


def evaluate_gate(reports: DataFrame, column: str = "report_json") -> DataFrame:
    """Add pipeline_status, exit_code (0 or 1), result and reason."""
    parsed = reports.withColumn("_report", parsed_report(F.col(column)))
    status = F.try_variant_get(F.col("_report"), "$.summary.pipeline_status", "string")
    known = parsed.withColumn("pipeline_status", F.when(status.isin(*rules.STATUSES), status))
    passed = F.col("pipeline_status")
    return known.select(
        *reports.columns,
        "pipeline_status",
        F.when(passed.isin("PASS", "WARNING"), 0).otherwise(1).alias("exit_code"),
        F.when(passed == "PASS", "Succeeded").when(passed == "WARNING", "SucceededWithIssues")
        .otherwise("Failed").alias("result"),
        gate_reason(F.col(column), F.col("_report"), passed).alias("reason"),
    )
