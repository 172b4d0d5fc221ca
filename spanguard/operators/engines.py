"""Python recognizers inside worker processes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle

_engines: dict[tuple[str, str], object] = {}


def identity_of(factory: Callable[[], object]) -> str:
    """What tells two factories apart: their pickled code and captured values."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def engine_for(name: str, identity: str, factory: Callable[[], object]) -> object:
    """The engine of this worker process; built on first use, since a model is slow to load."""
    if (name, identity) not in _engines:
        _engines[(name, identity)] = factory()
    return _engines[(name, identity)]
