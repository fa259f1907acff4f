"""Constant maps and arrays as one parsed expression each: building them literal by
literal would cost a call into the JVM for each, far more than running a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).lower()


def array_of(values) -> Column:
    return F.expr(f"array({', '.join(map(_sql, values))})")


def map_of(pairs) -> Column:
    return F.expr(f"map({', '.join(_sql(x) for pair in pairs for x in pair)})")
