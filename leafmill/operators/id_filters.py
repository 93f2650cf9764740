"""Bloom filters of the ids of each stored batch, and deduplication that reads by them.

A filter is rows (word, bits): an id picks one word of 64 bits by its hash and sets four
bits of it by another, so a filter is one aggregate of the ids and a look into it is one
equality join. There are ``BITS`` bits per id at least, in a power of two of words. Filters
lie beside their batches, under ``filter-<batch>-<power>``, and are written when a batch is
first asked for; a batch never changes, so neither does its filter.

New ids meet the filters, an eighth of the size of the ids or less, and only batches whose
filter may hold one of them are read, for these ids only.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import store
from leafmill.operators.frames import broadcast_if_small
from leafmill.session import checkpointed

BITS = 16  # per id, at least; about one of 200 other ids seems to be held
SET = 4  # bits of an id
FILTER = "filter"
SCHEMA = "word long, bits long"


def word(key: str, power: int | Column) -> Column:
    """Which of 2^power words an id picks."""
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(power).cast("int")) - 1
    return F.xxhash64(key).bitwiseAND(last)


def mask(key: str) -> Column:
    """The bits of an id in its word."""
    other = F.xxhash64(F.col(key), F.lit(1))
    places = (F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(SET))
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places))


def power_of(ids: int) -> int:
    return max(0, ceil(log2(max(1, ids * BITS / 64))))


def filters(spark: SparkSession, root: str, number: int, key: str = "id") -> dict[int, tuple[int, str]]:
    """Batch to (power, path) of the filters of a snapshot; missing ones are written."""
    at = store.snapshot_path(root, number)
    names = [n.split("-") for n in store.folder_names(spark, at) if n.startswith(f"{FILTER}-")]
    found = {int(batch): (int(power), f"{at}/{FILTER}-{batch}-{power}") for _, batch, power in names}
    found = {batch: v for batch, v in found.items() if store.exists(spark, f"{v[1]}/_SUCCESS")}
    kind = store.store_schema(spark, root, number)[key].dataType.simpleString()
    for batch in store.batches(spark, root, number):
        if batch not in found:
            ids = spark.read.schema(f"`{key}` {kind}").parquet(store.change_path(root, number, store.BATCH, batch))
            power = power_of(ids.count())  # from the files' footers
            path = f"{at}/{FILTER}-{batch:08d}-{power:02d}"
            rows = ids.groupBy(word(key, power).alias("word")).agg(F.bit_or(mask(key)).alias("bits"))
            rows.write.mode("overwrite").parquet(path)
            found[batch] = (power, path)
    return found


def may_hold(ids: DataFrame, known: dict[int, tuple[int, str]], key: str = "id") -> DataFrame:
    """(id, batch): which batches may hold which of the ids, by their filters.

    Few ids (a checked number) travel to the filters, which then stay in place.
    """
    spark = ids.sparkSession
    rows = spark.read.schema(SCHEMA).parquet(*(path for _, path in known.values()))
    name = F.col("_metadata.file_path")
    rows = rows.select(
        "word",
        "bits",
        F.regexp_extract(name, rf"/{FILTER}-(\d+)-\d+/[^/]*$", 1).cast("long").alias("batch"),
        F.regexp_extract(name, rf"/{FILTER}-\d+-(\d+)/[^/]*$", 1).cast("int").alias("power"),
    )
    powers = F.explode(F.lit(sorted({power for power, _ in known.values()})))
    asked = ids.select(F.col(key), mask(key).alias("mask"), powers.alias("power"))
    asked = broadcast_if_small(asked.withColumn("word", word(key, F.col("power"))))
    return rows.join(asked, ["power", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(key, "batch")


def held_ids(spark: SparkSession, root: str, ids: DataFrame, key: str = "id") -> DataFrame | None:
    """Which of the ids the newest snapshot holds; nothing where no filter may hold any.

    ``ids`` is materialised. Of the store only the batches that a filter points to are read.
    """
    number = store.snapshots(spark, root)[-1]
    known = filters(spark, root, number, key)
    if not known:
        return None
    maybe = checkpointed(may_hold(ids, known, key))
    batches = [r["batch"] for r in maybe.select("batch").distinct().collect()]  # one per batch at most
    if not batches:
        return None
    stored = store.read_store(spark, root, number, sorted(batches), key).select(key)
    return stored.join(broadcast_if_small(maybe.select(key)), key, "left_semi")


def unstored(spark: SparkSession, rows: DataFrame, root: str, key: str = "id") -> DataFrame:
    """``store.new_rows`` against the newest snapshot of a store, by its filters."""
    fresh = store.new_rows(rows, None, key)
    known = store.snapshots(spark, root)
    if not known or not store.batches(spark, root, known[-1]):
        return fresh
    fresh = checkpointed(fresh)
    held = held_ids(spark, root, fresh.select(key), key)
    return fresh if held is None else fresh.join(held, key, "left_anti")
