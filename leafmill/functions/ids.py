"""Stable identifiers for chunk rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metadata that changes when the same file is ingested again.
VOLATILE = ("created_at",)


# The characters JSON writes with a short escape.
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escape(char: Column) -> Column:
    code = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    pair = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.lit("\\u"), F.substring(code, 5, 4))
    out = F.when(char.rlike(r"^[ !#-\[\]-~]?\z"), char)
    for plain, short in SHORT_ESCAPES.items():
        out = out.when(char == F.lit(plain), F.lit(short))
    # beyond the basic plane: a surrogate pair
    return out.when(F.length(code) == 4, F.concat(F.lit("\\u"), code)).otherwise(pair)


def json_string(value: Column) -> Column:
    """Text as an ASCII-only JSON string, or ``null``. Plain text is only quoted."""
    quote = F.lit('"')
    escaped = F.array_join(F.transform(F.split(value, ""), _escape), "")
    return (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"^[ !#-\[\]-~]*\z"), F.concat(quote, value, quote))
        .otherwise(F.concat(quote, escaped, quote))
    )


def _json_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return json_string(value)
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return F.coalesce(value.cast("string"), F.lit("null"))
    bare = F.regexp_extract(F.to_json(F.array(value)), r"^\[(.*)\]$", 1)
    return F.when(value.isNull(), "null").otherwise(bare)


def canonical_json(columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Sorted keys, ``", "`` and ``": "`` separators, ASCII only, numbers bare."""
    parts: list[Column] = []
    for key in sorted(columns):
        head = (", " if parts else "") + f'"{key}": '
        parts.append(F.concat(F.lit(head), _json_value(*columns[key])))
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def chunk_id(text: Column, schema: T.StructType, metadata: list[str], volatile: bool = False) -> Column:
    """md5 of the text, an underscore and the canonical JSON of the metadata columns.

    Volatile keys stay out unless asked for, so a second ingest gives the same id.
    """
    keys = [m for m in metadata if volatile or m not in VOLATILE]
    columns = {k: (F.col(k), schema[k].dataType) for k in keys}
    return F.md5(F.concat(text, F.lit("_"), canonical_json(columns)))
