"""Metadata filters written as dictionaries, turned into Column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(condition: dict | None) -> Column:
    """``{"lang": "fr", "n": {"$gt": 3}}`` or ``{"$or": [...]}`` as one predicate."""
    if not condition:
        return F.lit(True)
    terms = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            parts = [where(v) for v in value]
            terms.append(reduce(lambda a, b: (a & b) if key == "$and" else (a | b), parts))
        elif isinstance(value, dict):
            terms.extend(_COMPARE[op](F.col(key), operand) for op, operand in value.items())
        else:
            terms.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, terms)
