"""Explanations and fixes per entity type, in sentences built from the entity dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard import rules

SCHEMA = (
    "entity_type string, root_cause string, why_detected string, likely_developer_mistake string, "
    "security_impact string, recommendation string, owasp string, cwe string, best_practice string, "
    "references array<string>"
)
DEFAULT_OWASP = "A02"
DEFAULT_CWE = 200
TOP10 = "https://owasp.org/Top10/"


def cwe_url(number: int) -> str:
    return f"https://cwe.mitre.org/data/definitions/{number}.html"


def entity_advice(entity: rules.Entity) -> tuple:
    if entity.entity_type in rules.LANGUAGE_ENTITIES:
        how = "A language model marked the text as one and the words around it support that."
    else:
        how = "The text has the format of one and passed the tests that go with that format."
    title, url = rules.OWASP[entity.owasp]
    return (
        entity.entity_type,
        f"A {entity.label} is part of a file that everyone with access to the repository can read.",
        how,
        f"A real {entity.label} was typed or pasted in where {entity.instead} would have done.",
        f"Whoever reads the file can {entity.harm}.",
        f"Take every {entity.label} out of the file and its history, and use {entity.instead}.",
        title,
        rules.CWE[entity.cwe],
        f"Keep every {entity.label} out of code, settings and test data; refer to {entity.instead}.",
        [url, cwe_url(entity.cwe)],
    )


DEFAULTS = {
    "root_cause": "A value that looks sensitive is part of a file that many people can read.",
    "why_detected": "A recognizer marked the value and no rule for false alarms spoke against it.",
    "likely_developer_mistake": "A real value was typed or pasted in where a made-up one would have done.",
    "security_impact": "Whoever reads the file learns the value and can misuse it.",
    "owasp": rules.OWASP[DEFAULT_OWASP][0],
    "cwe": rules.CWE[DEFAULT_CWE],
    "best_practice": "Keep real values out of code, settings and test data; read them from a secret store.",
}
DEFAULT_RECOMMENDATION = (
    "Check each %s value; move those that belong to a real person or system to a secret store."
)
DEFAULT_REFERENCES = (TOP10, cwe_url(DEFAULT_CWE))


def advice_rows() -> list[tuple]:
    return [entity_advice(e) for e in rules.ENTITIES]


def advice_table(spark: SparkSession) -> DataFrame:
    """One row per known entity type: a fixed, small table, safe to broadcast."""
    return spark.createDataFrame(advice_rows(), SCHEMA)


def with_advice(df: DataFrame, fields: list[str]) -> DataFrame:
    """Left-join advice fields by entity_type; unknown types get the defaults."""
    table = advice_table(df.sparkSession).select("entity_type", *[F.col(f).alias(f"_a_{f}") for f in fields])
    joined = df.join(F.broadcast(table), "entity_type", "left")

    def filled(field: str):
        value = F.col(f"_a_{field}")
        if field == "recommendation":
            default = F.format_string(DEFAULT_RECOMMENDATION, F.col("entity_type"))
        elif field == "references":
            default = F.array(*[F.lit(u) for u in DEFAULT_REFERENCES])
        else:
            default = F.lit(DEFAULTS[field])
        return F.coalesce(value, default).alias(field)

    return joined.select(*df.columns, *[filled(f) for f in fields])
