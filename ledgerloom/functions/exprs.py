"""Small Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once inside one expression.

    A column used twice inside a lambda is evaluated for every element; a lambda variable is
    evaluated once a row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df to be broadcast, once its size is checked: configuration that grows beyond its bound is an error, not a slow plan."""
    n = df.limit(rows + 1).count()
    if n > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return F.broadcast(df)
