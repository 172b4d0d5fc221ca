"""Help for expressions that stay inside array lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`.

    Lambdas have no common-subexpression elimination; a one-element array does the job.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
