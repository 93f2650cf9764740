"""Small frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Send a narrow, materialised frame to every task if it has few rows.

    A larger one is joined as it comes, where adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unnest(df: DataFrame, keep: Sequence[str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` makes the optimizer add a filter on the size of the array,
    which computes the array a second time below. The outer form does not; the row
    it gives for an empty array goes.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
        return rows.where(F.col(position).isNotNull()).withColumn(position, F.col(position).cast("long"))
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())
