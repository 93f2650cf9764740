"""Changes of a stored chunk table that write only what they change, and compaction.

New rows are a batch, deleted ids and patches are folders in the newest snapshot, numbered among its batches;
``store.read_store`` merges them. One writer at a time is expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.vectors import is_valid
from leafmill.operators import store
from leafmill.operators.id_filters import unstored

# Changes of a snapshot beyond which reading merges too much; ``maintain`` compacts then.
MOST_CHANGES = 64


def _write(rows: DataFrame, root: str, kind: str) -> tuple[int, str]:
    """A change of the newest snapshot: its number and path."""
    spark = rows.sparkSession
    number = store.snapshots(spark, root)[-1]
    change = store.next_change(spark, root, number)
    path = store.change_path(root, number, kind, change)
    rows.write.mode("overwrite").parquet(path)
    return change, path


def add_documents(spark: SparkSession, rows: DataFrame, root: str, metadata: list[str]) -> DataFrame:
    """Add valid, new rows that bring their embedding; returns the ids added."""
    fitting = store.valid_documents(rows, None, store.stored_dimension(spark, root))
    return store.append_batch(spark, unstored(spark, store.with_chunk_id(fitting, metadata), root), root)


def delete_rows(spark: SparkSession, root: str, ids: DataFrame | list, key: str = "id") -> int:
    """Delete by id; returns how many different ids were given.

    Writes these ids and reads no row of the store. Ids that the store lacks do nothing,
    also to rows of that id that come later.
    """
    kind = store.store_schema(spark, root, store.snapshots(spark, root)[-1])[key]
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(i,) for i in ids], f"{key} {kind.dataType.simpleString()}")
    rows = ids.select(F.col(key).cast(kind.dataType)).where(F.col(key).isNotNull()).distinct()
    _, path = _write(rows, root, store.DELETED)
    return spark.read.schema(rows.schema).parquet(path).count()


def delete_matching(spark: SparkSession, root: str, condition: dict | Column, key: str = "id") -> int:
    """Delete the rows that match a condition; returns how many they were.

    The filter reaches the scan; what is written are the ids of the rows found.
    """
    found = store.read_store(spark, root, key=key).where(store.matches(condition)).select(key)
    _, path = _write(found, root, store.DELETED)
    return spark.read.schema(found.schema).parquet(path).count()


def update_rows(spark: SparkSession, root: str, patch: DataFrame, key: str = "id", order: str | None = None, vector: str = "embedding") -> int:
    """Replace the fields a patch gives in the rows of its ids; returns the number of the change.

    A null keeps the old value. Patches of one id merge as in ``store.partial_update``. A
    vector that is not valid or not of the store's dimension keeps the old one. Ids that the
    store lacks do nothing, also to rows that come later.
    """
    schema = store.store_schema(spark, root, store.snapshots(spark, root)[-1])
    fields = [f for f in schema if f.name in patch.columns and f.name != key]
    values = patch.where(F.col(key).isNotNull())
    if vector in patch.columns and vector in schema.names:
        dimension = store.stored_dimension(spark, root, vector)
        fits = is_valid(F.col(vector)) & (F.size(vector) == dimension if dimension else F.lit(True))
        values = values.withColumn(vector, F.when(fits, F.col(vector)))
    rows = store.merged_patch(values, key, [f.name for f in fields], order)
    typed = rows.select(F.col(key).cast(schema[key].dataType), *(F.col(f.name).cast(f.dataType) for f in fields))
    return _write(typed, root, store.PATCH)[0]


def compact(spark: SparkSession, root: str, key: str = "id") -> int:
    """Write what is read as one batch of the next snapshot; returns its number."""
    return store.write_snapshot(store.read_store(spark, root, key=key), root)


def maintain(spark: SparkSession, root: str, most: int = MOST_CHANGES, key: str = "id") -> bool:
    """Compact a store whose newest snapshot has more changes than ``most``; tells whether it did."""
    number = store.snapshots(spark, root)[-1]
    if sum(len(store.changes(spark, root, number, kind)) for kind in (store.BATCH, store.DELETED, store.PATCH)) <= most:
        return False
    compact(spark, root, key)
    return True
