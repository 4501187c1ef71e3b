"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Long rules that mention the same cleaned text a dozen times would otherwise
    repeat its computation in the generated code, up to the size where the JVM
    stops compiling it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
