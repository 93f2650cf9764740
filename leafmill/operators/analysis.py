"""Free-form analysis and the shaping of its result."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.tables import RESULT, VALUE
from leafmill.session import checkpointed


def as_frame(df: DataFrame, result: Any) -> DataFrame:
    """Any result as a table.

    A DataFrame stays as it is; an aggregate Column is evaluated over ``df``; a
    ``{"type": ..., "value": ...}`` dict gives its value, with ``"index"`` as the name
    of a series' index; a dict or a list of pairs gives ``(index, 值)``, any other list
    one column 值; a scalar gives the one column 结果. Empty results are empty tables.
    """
    spark = df.sparkSession
    if isinstance(result, DataFrame):
        return result
    if isinstance(result, Column):
        return df.agg(result.alias(RESULT))
    if isinstance(result, dict) and "type" in result:
        value, index = result["value"], result.get("index", "index")
        if index != "index" and isinstance(value, dict | list | tuple):
            return as_frame(df, value).withColumnRenamed("index", index)
        return as_frame(df, value)
    if isinstance(result, Row):
        return spark.createDataFrame([result])
    if isinstance(result, dict):
        result = list(result.items())
        if not result:
            return spark.createDataFrame([], f"index string, `{VALUE}` string")
    if isinstance(result, list | tuple):
        if not result:
            return spark.createDataFrame([], f"`{VALUE}` string")
        if all(isinstance(v, tuple | list) and len(v) == 2 for v in result):
            return spark.createDataFrame([tuple(v) for v in result], ["index", VALUE])
        return spark.createDataFrame([(v,) for v in result], [VALUE])
    if result is None:
        return spark.createDataFrame([(None,)], T.StructType([T.StructField(RESULT, T.StringType())]))
    return spark.createDataFrame([(result,)], [RESULT])


def analyze(df: DataFrame, question: str | Callable[[DataFrame], Any], **params) -> DataFrame:
    """Run SQL text over the view ``df``, or a function over the DataFrame.

    Named parameters (``:name``) are bound, never pasted into the text.
    """
    if callable(question):
        return as_frame(df, question(df, **params))
    view = f"analysis_{uuid4().hex}"
    df.createOrReplaceTempView(view)
    own = re.match(r"\s*with\s+(recursive\s+)?", question, re.I)  # the question's own named parts follow ours
    begin = f"with {own[1] or ''}" if own else "with "
    rest = f", {question[own.end() :]}" if own else f" {question}"
    try:
        return df.sparkSession.sql(f"{begin}df as (select * from {view}){rest}", args=params)
    finally:
        df.sparkSession.catalog.dropTempView(view)


def exact(value: Column) -> Column:
    """As decimal, so that sums do not depend on the order of the rows."""
    return value.cast("decimal(18,4)")


def totals_by(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Sums per key. Totals per item can be summed again per group of items, which
    keeps a frequent item out of the join in between."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(name) for name, c in measures.items()))


def with_share(totals: DataFrame, measure: str, name: str) -> DataFrame:
    """Add each row's percentage of the overall total of ``measure``.

    The totals are checkpointed, so that the rows below them are read once, and the
    overall total is a scalar: no task holds all categories.
    """
    totals = checkpointed(totals)
    overall = totals.agg(F.sum(measure).cast("double")).scalar()
    return totals.withColumn(name, F.round(100 * F.col(measure).cast("double") / overall, 6))


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def best_item(totals: DataFrame, measure: str, *keys: str) -> DataFrame:
    """The item with the highest total; the smallest key wins a tie."""
    return top_k(totals, measure, 1, *keys)


def lookup(df: DataFrame, condition: Column, *columns: str) -> DataFrame:
    return df.where(condition).select(*columns)
