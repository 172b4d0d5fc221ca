"""Validation: which spans are worth a finding, from path, line and surrounding text.

Every rule is a column expression over a `Context`. The first rule that decides wins, so cheap set
tests stand before the text searches in each `CASE WHEN`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from spanguard import rules
from spanguard.functions import paths, text


class Context(NamedTuple):
    entity: Column
    value: Column
    window: Column
    line: Column
    path: Column
    extension: Column


def context_of() -> Context:
    return Context(F.col("entity_type"), F.col("value"), F.col("window"), F.col("line"),
                   F.col("relative_path"), F.col("extension"))


def is_high_signal(ctx: Context) -> Column:
    return ctx.entity.isin(*rules.HIGH_SIGNAL_ENTITIES)


def has_person_cue(ctx: Context) -> Column:
    return ctx.window.rlike(rules.cue_regex(rules.PERSON_CUES))


def has_organization_cue(ctx: Context) -> Column:
    return ctx.window.rlike(rules.cue_regex(rules.ORGANIZATION_CUES))


def has_location_cue(ctx: Context) -> Column:
    return ctx.window.rlike(rules.cue_regex(rules.LOCATION_CUES))


def is_actionable_date(ctx: Context) -> Column:
    return ctx.window.rlike(rules.cue_regex(rules.DATE_CUES))


def has_sensitive_context(ctx: Context) -> Column:
    """Any cue of the four sets; one search over their union."""
    union = sorted({*rules.PERSON_CUES, *rules.ORGANIZATION_CUES, *rules.LOCATION_CUES, *rules.DATE_CUES})
    return ctx.window.rlike(rules.cue_regex(union))


def is_documentation_context(ctx: Context) -> Column:
    return (
        F.lower(ctx.extension).isin(*rules.DOCUMENTATION_EXTENSIONS)
        | F.lower(paths.path_stem(ctx.path)).isin(*rules.DOCUMENTATION_STEMS)
        | F.arrays_overlap(paths.path_parts(F.lower(ctx.path)), rules.lits(rules.DOCUMENTATION_PARTS))
    )


def is_test_context(ctx: Context) -> Column:
    return F.arrays_overlap(paths.path_parts(F.lower(ctx.path)), rules.lits(rules.TEST_PARTS))


#: an assignment, or a word that opens a definition or import (fixed value)
CODE_TEXT = r"(?i)[A-Za-z_][A-Za-z0-9_]*\s*[:=]|(?:def|class|import|from|function|const|let|var)\s"
#: an account mention at the start of a line or after white space (fixed value)
MENTION = r"(?:^|\s)@[-A-Za-z0-9_]"


def is_code_context(ctx: Context) -> Column:
    return F.lower(ctx.extension).isin(*rules.CODE_EXTENSIONS) & (
        F.contains(ctx.path, ctx.value) | F.contains(ctx.line, F.lit("`")) | ctx.line.rlike(CODE_TEXT)
    )


def is_public_repository_context(ctx: Context) -> Column:
    return ctx.window.rlike(rules.cue_regex(rules.CREDIT_CUES)) | ctx.line.rlike(MENTION)


def is_technology_term(value: Column) -> Column:
    return F.lower(value).isin(*rules.TECHNOLOGY_TERMS)


def looks_like_code_identifier(value: Column) -> Column:
    return (
        value.rlike(r"[_./\\{}()\[\]<>:=]")
        | ((F.length(value) > 1) & value.rlike(r"\p{Lu}") & ~value.rlike(r"\p{Ll}"))
        | value.rlike(r"^[a-z]+[A-Z][A-Za-z0-9]*$")
        | value.rlike(r"^[A-Z][A-Za-z0-9]+(?:[A-Z][a-z0-9]+)+$")
    )


def url_has_secret(value: Column) -> Column:
    keys = "|".join(rules.SECRET_QUERY_KEYS)
    return value.rlike(rf"(?i)[?&](?:{keys})=|//[^/\s:@]+:[^/\s@]+@")


def is_public_host(host: Column) -> Column:
    return F.exists(rules.lits(rules.PUBLIC_HOSTS),
                    lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def is_actionable_url(ctx: Context) -> Column:
    value = text.strip(ctx.value)
    host = paths.url_host(value)
    private = F.lit(False)
    for suffix in rules.PRIVATE_SUFFIXES:
        private = private | F.endswith(host, F.lit(suffix))
    return (
        F.when(url_has_secret(value), True)
        .when(host == "", False)
        .when(host.isin(*rules.LOOPBACK_HOSTS), False)
        .when(private, True)
        .when(is_public_host(host), False)
        .when(is_documentation_context(ctx), False)
        .otherwise(has_sensitive_context(ctx))
    )


def is_actionable_language_entity(ctx: Context) -> Column:
    value = text.strip(ctx.value)
    calm = ~has_sensitive_context(ctx)
    return (
        F.when((value == "") | looks_like_code_identifier(value), False)
        .when(is_technology_term(value), False)
        .when(is_documentation_context(ctx) & calm, False)
        .when(is_public_repository_context(ctx), False)
        .when(is_code_context(ctx) & calm, False)
        .when(is_test_context(ctx) & calm, False)
        .when(ctx.entity == "PERSON", has_person_cue(ctx))
        .when(ctx.entity == "ORGANIZATION", has_organization_cue(ctx))
        .when(ctx.entity == "LOCATION", has_location_cue(ctx))
        .otherwise(has_sensitive_context(ctx))
    )


def should_keep(ctx: Context) -> Column:
    return (
        F.when(is_high_signal(ctx), True)
        .when(ctx.entity == "URL", is_actionable_url(ctx))
        .when(ctx.entity == "DATE_TIME", is_actionable_date(ctx))
        .when(ctx.entity.isin(*rules.LANGUAGE_ENTITIES), is_actionable_language_entity(ctx))
        .otherwise(True)
    )


Validator = Callable[[Context], Column]


def validate_spans(spans: DataFrame, validator: Validator = should_keep) -> DataFrame:
    """Keep the spans the validator accepts; pass another function to replace or extend the rules."""
    return spans.where(_rule(validator, id(spans.sparkSession.sparkContext)))


@lru_cache(maxsize=32)
def _rule(validator: Validator, context: int) -> Column:
    """The rule over the span columns, built once per validator (and Spark context)."""
    return validator(context_of())
