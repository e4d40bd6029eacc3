"""Missing values in the loose sense: null, empty text, zero and empty arrays are all missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(column: Column | str, kind: str = "string") -> Column:
    """Whether a value is there; kind is string, number or array. Never null."""
    c = F.col(column) if isinstance(column, str) else column
    test = {"string": c != "", "number": c != 0, "array": F.size(c) > 0}[kind]
    return F.coalesce(c.isNotNull() & test, F.lit(False))


def first_truthy(*columns: Column | str, kind: str = "string", sentinel: str | None = None) -> Column:
    """The first value that is there, else null; a sentinel such as `N/A` counts as missing."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    tests = [truthy(c, kind) if sentinel is None else truthy(c, kind) & (c != sentinel) for c in values]
    return F.coalesce(*[F.when(t, c) for t, c in zip(tests, values)])


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
