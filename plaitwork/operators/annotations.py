"""What an aggregate is like, for explanations: by its expression, or as the caller says."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column


@dataclass(frozen=True)
class Selection:
    """The result is one of the values (min, max, first, last)."""


@dataclass(frozen=True)
class Aggregation:
    """Values equal to zero, or that the guard refuses, don't change the result."""

    zero: Any = 0
    guard: Column | None = None


@dataclass(frozen=True)
class RemovingDups:
    """Repeated values don't change the result."""


#: Aggregate functions whose nature is plain from their names.
INFERRED = {
    "min": Selection(), "max": Selection(), "first": Selection(), "last": Selection(),
    "sum": Aggregation(0), "product": Aggregation(1),
    "collect_set": RemovingDups(), "count_distinct": RemovingDups(), "approx_count_distinct": RemovingDups(),
}


def infer(functions: list[str]) -> list:
    """Annotations of a combine by one aggregate function; several functions together have none."""
    return [INFERRED[functions[0]]] if len(functions) == 1 and functions[0] in INFERRED else []
