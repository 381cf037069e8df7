"""Naming intermediate values of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once.

    Nested CASE expressions otherwise repeat their inputs at every use, which grows
    the generated code beyond what can be compiled.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions see as plain values.

    The columns pass through a one-element ``explode_outer``, which neither projections
    nor filters are merged across; a chain of parsing steps then stays a chain instead
    of being folded into one expression that repeats every step.
    """
    entry = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    rows = df.select("*", F.explode_outer(F.array(entry)).alias("_staged"))
    return rows.select(*kept, *[F.col(f"_staged.{name}").alias(name) for name in columns])
