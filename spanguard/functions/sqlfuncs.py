"""SQL names for the scalar functions, as SQL bodies that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanguard import rules

PREFIX = "sg_"


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _names(values) -> str:
    return ", ".join(_quote(v) for v in values)


def _case(key: str, pairs: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in pairs.items())
    return f"CASE {key} {whens} ELSE {_quote(default)} END"


def _cue(cues) -> str:
    return f"rlike(window_text, {_quote(rules.cue_regex(cues))})"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body)."""
    severity = {e.entity_type: e.severity for e in rules.ENTITIES}
    category = {e.entity_type: e.category for e in rules.ENTITIES}
    return {
        "severity_of": ("entity STRING", "STRING", _case("entity", severity, rules.DEFAULT_SEVERITY)),
        "category_of": ("entity STRING", "STRING", _case("entity", category, rules.DEFAULT_CATEGORY)),
        "redact_value": (
            "entity STRING, v STRING", "STRING",
            "CASE WHEN entity = 'EMAIL_ADDRESS' AND instr(v, '@') > 0 THEN "
            "concat(substring(substring_index(v, '@', 1), 1, 2), '***@', substring(v, instr(v, '@') + 1)) "
            "WHEN char_length(v) <= 4 THEN repeat('*', char_length(v)) "
            "ELSE concat(repeat('*', char_length(v) - 4), right(v, 4)) END",
        ),
        "finding_id": ("idx BIGINT", "STRING", "CASE WHEN idx >= 0 THEN format_string('F-%06d', idx) ELSE "
                       "raise_error('index must be >= 0') END"),
        "finding_index_of": ("id STRING", "BIGINT", "try_cast(regexp_extract(id, '^F-([0-9]+)$', 1) AS BIGINT)"),
        "format_duration": (
            "seconds DOUBLE", "STRING",
            "CASE WHEN seconds IS NULL THEN 'n/a' "
            "WHEN seconds >= 3600 THEN format_string('%dh %dm', bigint(seconds) div 3600, bigint(seconds) % 3600 div 60) "
            "WHEN seconds >= 60 AND bigint(seconds) % 60 > 0 THEN "
            "format_string('%dm %ds', bigint(seconds) div 60, bigint(seconds) % 60) "
            "WHEN seconds >= 60 THEN format_string('%dm', bigint(seconds) div 60) "
            "ELSE format_string('%ds', bigint(seconds)) END",
        ),
        "human_readable_size": (
            "size BIGINT", "STRING",
            "CASE WHEN size < 0 THEN raise_error('size must be non-negative') "
            "WHEN size < 1024 THEN format_string('%d B', size) "
            + " ".join(
                f"WHEN size < {1024 ** (p + 1)} THEN format_string('%.1f {u}', bround(size / {float(1024 ** p)}D, 1))"
                for p, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB"))
            )
            + f" ELSE format_string('%.1f PB', bround(size / {float(1024 ** 5)}D, 1)) END",
        ),
        "is_high_signal": ("entity STRING", "BOOLEAN", f"entity IN ({_names(rules.HIGH_SIGNAL_ENTITIES)})"),
        "is_technology_term": ("v STRING", "BOOLEAN", f"lower(v) IN ({_names(rules.TECHNOLOGY_TERMS)})"),
        "is_public_host": (
            "host STRING", "BOOLEAN",
            f"exists(array({_names(rules.PUBLIC_HOSTS)}), h -> host = h OR endswith(host, concat('.', h)))",
        ),
        "has_person_cue": ("window_text STRING", "BOOLEAN", _cue(rules.PERSON_CUES)),
        "has_organization_cue": ("window_text STRING", "BOOLEAN", _cue(rules.ORGANIZATION_CUES)),
        "has_location_cue": ("window_text STRING", "BOOLEAN", _cue(rules.LOCATION_CUES)),
        "has_date_cue": ("window_text STRING", "BOOLEAN", _cue(rules.DATE_CUES)),
        "status_tone": ("status STRING", "STRING",
                        f"CASE WHEN status IN ({_names(rules.STATUSES)}) THEN lower(status) ELSE 'unknown' END"),
        "trend_direction": ("delta BIGINT", "STRING",
                            "CASE WHEN delta > 0 THEN 'increased' WHEN delta < 0 THEN 'decreased' ELSE 'unchanged' END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; gives their names."""
    names = []
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(PREFIX + name)
    return names
