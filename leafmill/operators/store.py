"""The chunk table: a folder of numbered Parquet snapshots.

A snapshot is a file with its schema and numbered folders: batches of rows, deleted ids
and patches. Each change writes a folder of its own in proportion to what it changes,
numbered after all before it, and readers see it when it is finished. Reading merges: a
row goes if its id was deleted after the row came, and takes the fields patched after it
came, the last one of each field. ``store_changes`` has the changes and the compaction that
writes what is read as the next snapshot. A job never overwrites what it reads and a
failed job leaves the last finished state in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.filters import where
from leafmill.functions.ids import chunk_id
from leafmill.functions.vectors import is_valid

# Names reported by the statistics.
COLLECTION = "document_chunks"
METRIC = "cosine"

SCHEMA = "schema.json"
DIMENSION = "dimension-"
BATCH, DELETED, PATCH = "batch", "deleted", "patch"  # kinds of changes, as folders are called
CHANGE = "_change"  # column with the number of a row's batch
MEGABYTE = 1024 * 1024


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_names(spark: SparkSession, root: str) -> list[str]:
    fs, path = _folder(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    fs, target = _folder(spark, path)
    _, beside = _folder(spark, f"{target.getParent()}/_{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished snapshots, oldest first."""
    found = [n for n in folder_names(spark, root) if n.startswith("snapshot-")]  # one entry per snapshot
    return sorted(int(n.split("-")[1]) for n in found if exists(spark, f"{root}/{n}/{SCHEMA}"))


def snapshot_path(root: str, number: int) -> str:
    return f"{root}/snapshot-{number:08d}"


def changes(spark: SparkSession, root: str, number: int, kind: str = BATCH) -> list[int]:
    """Numbers of a snapshot's finished folders of a kind, oldest first."""
    at = snapshot_path(root, number)
    found = [n for n in folder_names(spark, at) if n.startswith(f"{kind}-")]  # one entry per change
    return sorted(int(n.split("-")[1]) for n in found if exists(spark, f"{at}/{n}/_SUCCESS"))


def batches(spark: SparkSession, root: str, number: int) -> list[int]:
    """Numbers of the finished batches of a snapshot, oldest first."""
    return changes(spark, root, number, BATCH)


def next_change(spark: SparkSession, root: str, number: int) -> int:
    """The number after those of all changes, finished or not."""
    kinds = tuple(f"{kind}-" for kind in (BATCH, DELETED, PATCH))
    return max((int(n.split("-")[1]) for n in folder_names(spark, snapshot_path(root, number)) if n.startswith(kinds)), default=0) + 1


def change_path(root: str, number: int, kind: str, change: int) -> str:
    return f"{snapshot_path(root, number)}/{kind}-{change:08d}"


def _batch(root: str, number: int, batch: int) -> str:
    return change_path(root, number, BATCH, batch)


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write the next snapshot as one batch and return its number."""
    spark = df.sparkSession
    number = max(snapshots(spark, root), default=0) + 1
    df.write.mode("overwrite").parquet(_batch(root, number, 1))
    _write_text(spark, f"{snapshot_path(root, number)}/{SCHEMA}", df.schema.json())
    return number


def store_schema(spark: SparkSession, root: str, number: int) -> T.StructType:
    fs, path = _folder(spark, f"{snapshot_path(root, number)}/{SCHEMA}")
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return T.StructType.fromJson(json.loads(text))


def read_store(spark: SparkSession, root: str, number: int | None = None, batch: int | list[int] | None = None, key: str = "id") -> DataFrame:
    """The newest snapshot, or the one asked for; optionally only some of its batches.

    The schema lies with the snapshot, so one without rows is read like any other.
    Deleted rows are left out and patches are merged in.
    """
    return read_numbered(spark, root, number, batch, key).drop(CHANGE)


def read_numbered(spark: SparkSession, root: str, number: int | None = None, batch: int | list[int] | None = None, key: str = "id") -> DataFrame:
    """The rows of ``read_store`` with the number of the batch that brought them, where there is more than that."""
    if number is None:
        number = max(snapshots(spark, root))
    schema = store_schema(spark, root, number)
    found = batches(spark, root, number) if batch is None else [batch] if isinstance(batch, int) else batch
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(_batch(root, number, b) for b in found))
    gone, patched = (changes(spark, root, number, kind) for kind in (DELETED, PATCH))
    if not (gone or patched):
        return rows
    rows = rows.withColumn(CHANGE, change_number(BATCH))
    if gone:
        ids = spark.read.schema(T.StructType([schema[key]])).parquet(*(change_path(root, number, DELETED, c) for c in gone))
        last = ids.select(F.col(key).alias("_gone"), change_number(DELETED).alias("_when")).groupBy("_gone").agg(F.max("_when").alias("_when"))
        rows = rows.join(last, (F.col(key) == F.col("_gone")) & (F.col(CHANGE) < F.col("_when")), "left_anti")
    if patched:
        patches = spark.read.schema(schema).parquet(*(change_path(root, number, PATCH, c) for c in patched))
        rows = _patched(rows, patches.withColumn("_when", change_number(PATCH)), key)
    return rows


def change_number(kind: str) -> Column:
    """The number of the folder that a row of a change is read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}-(\d+)/[^/]*$", 1).cast("long")


def _patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Each field from the last patch of it that came after the row."""
    fields = [c for c in patches.columns if c not in (key, "_when")]
    last = {c: F.max_by(F.struct(F.col("_when").alias("w"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col("_when"))) for c in fields}
    merged = patches.groupBy(F.col(key).alias("_patched")).agg(*(v.alias(f"_new_{c}") for c, v in last.items()))

    def now(c: str) -> Column:
        return F.when(F.col(f"_new_{c}.w") > F.col(CHANGE), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c)

    joined = rows.join(merged, F.col(key) == F.col("_patched"), "left")
    return joined.select(*(now(c) if c in fields else F.col(c) for c in rows.columns))


def append_rows(df: DataFrame, root: str) -> tuple[int, int]:
    """Add rows to the newest snapshot as a batch of their own: its snapshot and number.

    Readers see the batch when it is finished. Columns that the store lacks are
    dropped and missing ones are null, so all batches have one schema.
    """
    spark = df.sparkSession
    known = snapshots(spark, root)
    if not known:
        return write_snapshot(df, root), 1
    schema = store_schema(spark, root, known[-1])
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    batch = next_change(spark, root, known[-1])
    rows.write.mode("overwrite").parquet(_batch(root, known[-1], batch))
    return known[-1], batch


def stored_dimension(spark: SparkSession, root: str, vector: str = "embedding") -> int | None:
    """The dimension of the store's vectors, kept beside the newest snapshot.

    It is written when it is first asked for and vectors are there; a store takes
    vectors of one dimension only, so any of them tells.
    """
    known = snapshots(spark, root)
    if not known:
        return None
    at = snapshot_path(root, known[-1])
    kept = [n for n in folder_names(spark, at) if n.startswith(DIMENSION)]
    if kept:
        return int(kept[0].removeprefix(DIMENSION))
    rows = read_store(spark, root)
    if vector not in rows.columns:
        return None
    one = rows.where(is_valid(F.col(vector))).select(F.size(vector).alias("n")).limit(1).collect()
    if not one:
        return None
    _write_text(spark, f"{at}/{DIMENSION}{one[0]['n']}", "")
    return one[0]["n"]


def restore_snapshot(spark: SparkSession, root: str, number: int) -> int:
    """Make an older snapshot the newest again."""
    return write_snapshot(read_store(spark, root, number), root)


def copy_store(spark: SparkSession, root: str, target: str) -> int:
    """Back the newest snapshot up into another folder."""
    return write_snapshot(read_store(spark, root), target)


def reset_store(spark: SparkSession, root: str) -> int:
    """An empty store of the same schema."""
    schema = read_store(spark, root).schema
    return write_snapshot(spark.createDataFrame([], schema), root)


def with_chunk_id(df: DataFrame, metadata: list[str], text: str = "text", volatile: bool = False) -> DataFrame:
    return df.withColumn("id", chunk_id(F.col(text), df.schema, metadata, volatile))


def new_rows(batch: DataFrame, store: DataFrame | None, key: str = "id") -> DataFrame:
    """Each key once, and none that the store holds.

    Of rows with one key that differ otherwise, the one with the least hash of all
    columns stays, whatever the order they come in. Copies merge on the map side before
    the join, so its keys are unique on both sides; of the store only the key is read.
    """
    rest = [c for c in batch.columns if c != key]
    if not rest:
        fresh = batch.distinct()
    else:
        whole = F.struct(*(F.col(c) for c in rest))
        one = batch.groupBy(key).agg(F.min_by(whole, F.xxhash64(*rest)).alias("_row"))
        fresh = one.select(*(F.col(c) if c == key else F.col("_row")[c].alias(c) for c in batch.columns))
    if store is None:
        return fresh
    return fresh.join(store.select(key), key, "left_anti")


def common_dimension(rows: DataFrame, vector: str = "embedding") -> int | None:
    """The dimension that most valid vectors have, the smallest on ties."""
    counts = rows.where(is_valid(F.col(vector))).groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    first = counts.orderBy(F.desc("c"), "n").limit(1).collect()
    return first[0]["n"] if first else None


def guard_dimension(rows: DataFrame, store: DataFrame | None, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """Mark rows whose vector fits the store: ``accepted`` and a ``reason``.

    ``dimension`` spares the look into the store. An empty store takes the dimension
    that most vectors of the batch have.
    """
    if dimension is None and store is not None:
        dimension = store.agg(F.max(F.size(vector))).first()[0]
    if dimension is None:
        dimension = common_dimension(rows, vector)
    bad, wrong = ~is_valid(F.col(vector)), F.size(vector) != dimension
    reason = F.when(bad, "invalid vector").when(wrong, "dimension mismatch")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def valid_documents(rows: DataFrame, store: DataFrame | None = None, dimension: int | None = None) -> DataFrame:
    """Rows that have a text and a usable vector of the store's dimension."""
    whole = rows.where(F.col("text").isNotNull() & is_valid(F.col("embedding")))
    return guard_dimension(whole, store, dimension=dimension).where("accepted").drop("accepted", "reason")


def known_store(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest snapshot, or nothing where there is none yet."""
    return read_store(spark, root) if snapshots(spark, root) else None


def append_batch(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Append rows as a batch of their own and return their ids.

    The ids come from reading that batch back, so nothing is computed twice.
    """
    number, batch = append_rows(rows, root)
    return read_store(spark, root, number, batch).select("id")


def get_by_ids(store: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    """Rows of the given ids; a list becomes a pushed-down filter, a frame a semi join."""
    if isinstance(ids, DataFrame):
        return store.join(ids.select(key), key, "left_semi")
    return store.where(F.col(key).isin(list(ids)))


def partial_update(
    store: DataFrame, patch: DataFrame, key: str = "id", order: str | None = None, vector: str = "embedding"
) -> DataFrame:
    """Replace the fields a patch gives; a null in the patch keeps the old value.

    Patches of one id merge field by field: the value with the greatest ``order`` wins,
    without an order the one with the greatest hash. A new vector must be valid and of
    the old one's dimension, otherwise the old one stays.
    """
    fields = [c for c in patch.columns if c not in (key, order)]
    merged = merged_patch(patch, key, fields, order)
    merged = merged.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    joined = store.join(merged, key, "left")

    def new(c: str) -> Column:
        value = F.col(f"_new_{c}")
        if c != vector:
            return value
        fits = is_valid(value) & (F.col(c).isNull() | (F.size(value) == F.size(c)))
        return F.when(fits, value)

    out = [F.coalesce(new(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in store.columns]
    return joined.select(*out, F.coalesce("_hit", F.lit(False)).alias("updated"))


def merged_patch(patch: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """One row per id, field by field the value with the greatest ``order``, or hash."""
    by = F.col(order) if order else None
    merged = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.xxhash64(c) if by is None else by)) for c in fields}
    return patch.groupBy(F.col(key)).agg(F.lit(True).alias("_given"), *(v.alias(c) for c, v in merged.items())).select(key, *fields)


def unknown_ids(store: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Patch keys the store does not hold."""
    return patch.select(key).join(store.select(key), key, "left_anti")


def delete_ids(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def matches(condition: dict | Column) -> Column:
    """Whether a row matches; one that the filter can't decide does not."""
    predicate = where(condition) if isinstance(condition, dict) else condition
    return F.coalesce(predicate, F.lit(False))


def delete_where(store: DataFrame, condition: dict | Column) -> DataFrame:
    """Rows that do not match; a row the filter cannot decide is kept."""
    return store.where(~matches(condition))


def count_where(store: DataFrame, condition: dict | Column) -> int:
    """How many rows ``delete_where`` removes."""
    return store.where(matches(condition)).count()


def store_stats(store: DataFrame, name: str = COLLECTION, metric: str = METRIC) -> DataFrame:
    return store.agg(
        F.count(F.lit(1)).alias("total_documents"), F.max(F.size("embedding")).cast("long").alias("vector_dimension")
    ).select(
        "total_documents",
        "vector_dimension",
        F.lit(name).alias("collection_name"),
        F.lit(metric).alias("distance_metric"),
    )


def storage_stats(spark: SparkSession, root: str, name: str = COLLECTION, metric: str = METRIC) -> DataFrame:
    """``store_stats`` of the newest snapshot, and its size in bytes and megabytes on disk."""
    number = max(snapshots(spark, root))
    fs, path = _folder(spark, snapshot_path(root, number))
    size = fs.getContentSummary(path).getLength()
    return store_stats(read_store(spark, root, number), name, metric).withColumns(
        {"storage_bytes": F.lit(size).cast("long"), "storage_mb": F.round(F.lit(size / MEGABYTE), 2)}
    )
