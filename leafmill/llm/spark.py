"""Helpers for Arrow batches, id ranges, groups of any size and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import bounded_batches as bounded_batches
from leafmill.session import scratch

LEAST_ID = -(1 << 63)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ids that cut the table into about equal ranges; reads this column only."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    row = df.agg(F.percentile_approx(column, shares, 100 * buckets).alias("at")).first()
    return sorted(set(row["at"] or []))


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every = F.lit(bounds)
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step]), lambda b: b <= value)) * step
    return (coarse + F.size(F.filter(F.slice(every, coarse + 1, step), lambda b: b <= value))).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a frame of bounded size, brought to the driver by Arrow whatever the session's settings."""
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of a column, from batches that are sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        keys = table.column(key).to_numpy()
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        at = 0
        for cut in cuts:
            yield table.slice(at, cut - at)
            at = cut
        rest = table.slice(at)
    if rest is not None:
        yield rest


def tiles(group: Column, size: Column, member: Column, most: int) -> Column:
    """Which tiles of a group a member is in: array of struct(tile, block, diagonal).

    A group of at most ``most`` members is one tile. A larger one is dealt into blocks
    by a hash of the member, and each pair of blocks is a tile, so that every pair of
    members meets in exactly one tile that counts it, whatever the group's size.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / most)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.xxhash64(group, F.least(own, other), F.greatest(own, other)).alias("tile"),
            own.alias("block"),
            (own == other).alias("diagonal"),
        ),
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component.

    ``edges`` has columns a and b. Large-star and small-star steps alternate until the
    edges stay as they are; edges are rows all the way, a node's neighbours are never
    gathered. Nodes without an edge to another node are not in the result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state["n"], state["x"]) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (state["n"], state["x"])
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "edges")
