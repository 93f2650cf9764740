"""Record lists, JSON exchange, processed documents and metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.store import new_rows

# File endings per format.
ENDINGS = {"markdown": ".md", "json": ".json"}


def rows_to_records(rows: DataFrame, header: Sequence[str], cells: str = "cells") -> DataFrame:
    """Rows of cells as JSON objects under the header's names.

    A row shorter than the header lacks the last keys; a longer one loses its tail.
    No rows give no records.
    """
    names = F.array(*(F.lit(h) for h in header))
    n = F.least(F.size(cells), F.lit(len(header)))
    pairs = F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(cells, F.lit(1), n))
    return rows.withColumn("record", F.to_json(pairs))


def export_json(store: DataFrame, path: str, collection: str, now: Column) -> DataFrame:
    """Write the rows as JSON lines, and a one-row envelope beside them."""
    store.write.mode("overwrite").json(f"{path}/documents")
    envelope = store.agg(F.count(F.lit(1)).alias("total_documents")).select(
        now.cast("string").alias("export_time"), "total_documents", F.lit(collection).alias("collection_name")
    )
    envelope.write.mode("overwrite").json(f"{path}/metadata")
    return store.sparkSession.read.json(f"{path}/metadata")


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/documents")


def import_rows(rows: DataFrame, store: DataFrame, key: str = "id", skip_duplicates: bool = True) -> DataFrame:
    """The rows an import adds: each key once and, by default, only unknown keys.

    Without skipping, known keys must be deleted from the store first.
    """
    return new_rows(rows, store if skip_duplicates else None, key)


def write_processed(
    documents: DataFrame, folder: str, name: str, text: str, format_type: str = "markdown"
) -> str:
    """Write each document under ``<stem>_processed<ending>/``.

    Documents that share a name share a folder. A line break inside a document is
    written as it is.
    """
    ending = ENDINGS.get(format_type, ".txt")
    stem = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]+$", "")
    target = F.concat(stem, F.lit(f"_processed{ending}"))
    documents.select(target.alias("file"), F.col(text).alias("value")).write.mode("overwrite").partitionBy(
        "file"
    ).text(folder)
    return folder


def save_metadata(rows: DataFrame, path: str, now: Column) -> None:
    rows.withColumn("saved_time", now).write.mode("append").parquet(path)


def latest_metadata(table: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row per key. A key saved very often is reduced on the map side."""
    others = [c for c in table.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return table.groupBy(key).agg(newest).select(key, *(F.col(f"_row.{c}").alias(c) for c in others))


def load_metadata(table: DataFrame, key: str, value, *order: str) -> DataFrame:
    """The newest row of one key, or no row."""
    return latest_metadata(table.where(F.col(key) == F.lit(value)), key, *order)
