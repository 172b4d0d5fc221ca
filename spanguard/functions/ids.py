"""Positional finding ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finding_id(index: Column) -> Column:
    """`F-` and the index, padded to six digits and never cut; a negative index is an error."""
    return F.when(
        index < 0, F.raise_error(F.concat(F.lit("index must be >= 0, got "), index.cast("string"))).cast("string")
    ).otherwise(F.format_string("F-%06d", index))


def finding_index_of(identifier: Column) -> Column:
    """The index in an id; NULL when the id is malformed."""
    return F.regexp_extract(identifier, "^F-([0-9]+)$", 1).try_cast("bigint")
