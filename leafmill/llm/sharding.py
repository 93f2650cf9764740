"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by the hash of their text, so equal texts are neighbours and stay in
one shard. Splitters are found without sorting: the exact bytes below some candidate
keys are counted over all partitions, the candidates around each goal are refined, and
so on until every splitter is within the tolerance; then the rows are exchanged once.

A group of equal texts that is larger than the tolerance could push a splitter off, so
these groups, whose number the tolerance bounds, are first dealt to the least filled
shards, and the splitters fill up what is left. A group larger than a whole shard can't
stay together: its rows take their places one by one.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.spark import shuffle_parts, stored
from leafmill.operators.frames import broadcast_if_small

SHARDS = 16
TOLERANCE = 0.005  # of a shard's bytes, for each splitter
LEAST, MOST = -(1 << 63), 1 << 63
LAST_ID = (1 << 63) - 1


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key."""

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(zero_copy_only=False), "right"), pa.int32())

    return place(key)


def splitters(units: DataFrame, goals: list[float], total: int, tolerance: float) -> list[int]:
    """Keys with about ``goals`` bytes below them, by counting and refining.

    ``units`` has columns u and bytes. Each round is one pass that returns the bytes
    between neighbouring candidates, a few per goal.
    """
    below = {LEAST: 0, MOST: total}

    def bracket(goal: float) -> tuple[int, int]:
        keys = sorted(below)
        at = bisect_right([below[k] for k in keys], goal)
        return keys[at - 1], keys[min(at, len(keys) - 1)]

    def settled(goal: float) -> int | None:
        low, high = bracket(goal)
        nearest = min((low, high), key=lambda k: abs(below[k] - goal))
        return nearest if abs(below[nearest] - goal) <= tolerance or high - low <= 1 else None

    while open_goals := [g for g in goals if settled(g) is None]:
        probes = set()
        for goal in open_goals:
            low, high = bracket(goal)
            width = high - low
            guess = low + int(width * (goal - below[low]) / max(1, below[high] - below[low]))
            near = [low + width * i // 8 for i in range(1, 8)] + [guess - width // 64, guess, guess + width // 64]
            probes |= {k for k in near if low < k < high} or {low + 1}
        bounds = sorted(probes)
        counted = units.groupBy(_place(F.col("u"), bounds).alias("place")).agg(F.sum("bytes").alias("bytes"))
        found = {r["place"]: r["bytes"] for r in counted.collect()}  # one row per candidate
        so_far = 0
        for i, key in enumerate(bounds):
            so_far += found.get(i, 0)
            below[key] = so_far
    return [min(settled(g), MOST - 1) for g in goals]


def _levels(loads: list[float], rest: float) -> list[float]:
    """How much of the rest goes to each shard so that all are filled alike, as far as possible."""
    order = sorted(loads)
    for i in range(len(order), 0, -1):
        level = (rest + sum(order[:i])) / i
        if i == 1 or level >= order[i - 1]:
            break
    return [max(0.0, level - x) for x in loads]


def _told_apart(rows: DataFrame, keys: DataFrame, giants: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows and keys in which those of a giant group that share an id, or have none, have numbers.

    Such rows are written with their number, so that it stays the same; all others are left
    as they are, since their ids scatter them.
    """
    marks = F.broadcast(keys.sparkSession.createDataFrame([(h,) for h in giants], "g_h long"))
    shared = keys.join(marks, F.col("h") == F.col("g_h")).groupBy("h", "at").agg(F.count("*").alias("n")).where("n > 1").select("h", "at")
    shared = broadcast_if_small(stored(shared, "shared-ids"))
    alike = stored(rows.join(shared, ["h", "at"], "left_semi").withColumn("nth", F.monotonically_increasing_id()), "rows-alike")
    others, other_keys = (x.join(shared, ["h", "at"], "left_anti").select(*x.columns) for x in (rows, keys))
    return others.unionByName(alike), other_keys.unionByName(alike.select(*keys.columns))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """All rows with all columns and size, shard and slot.

    ``size`` is the text's UTF-8 bytes plus 1 (1 for null), ``shard`` 0 to shards - 1,
    ``slot`` counts each shard's rows from 0 without gaps. Shards differ in bytes by
    about the tolerance. Equal texts share a shard unless they exceed one by themselves;
    null texts count as empty ones, repeated rows as equal texts. Few or no rows leave
    shards empty. Input columns named like the three added ones are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    keys = stored(docs.select(at.alias("at"), F.xxhash64(text).alias("h"), size_of(F.col(text_col)).alias("size")), "shard-keys")
    groups = stored(keys.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    share = total / shards
    large = groups.where(F.col("bytes") > tolerance * share).collect()  # shards / tolerance groups at most
    giants = [g["h"] for g in large if g["bytes"] > share and g["n"] > 1]
    loads, dealt = [(0, s) for s in range(shards)], []
    for g in sorted((g for g in large if g["h"] not in set(giants)), key=lambda g: (-g["bytes"], g["h"])):
        filled, shard = heapq.heappop(loads)
        heapq.heappush(loads, (filled + g["bytes"], shard))
        dealt.append((g["h"], shard))
    filled = [x for x, _ in sorted(loads, key=lambda x: x[1])]
    hot = F.broadcast(spark.createDataFrame([(h, s) for h, s in dealt] + [(h, None) for h in giants], "hot long, hot_shard int"))

    def with_unit(rows: DataFrame) -> DataFrame:
        """Adds u, the row's key, and hot_shard, the shard of a dealt group."""
        joined = rows.join(hot, F.col("h") == F.col("hot"), "left")
        scattered = F.col("hot").isNotNull()
        return joined.withColumn("u", F.when(scattered, F.xxhash64("h", "at", "nth")).otherwise(F.col("h"))).drop("hot")

    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    rows = docs.select(
        *(F.col(c).alias(f"row_{i}") for i, c in enumerate(names)),
        at.alias("at"),
        F.xxhash64(text).alias("h"),
        size_of(F.col(text_col)).alias("size"),
        F.lit(0).cast("long").alias("nth"),
    )
    keys = keys.withColumn("nth", F.lit(0).cast("long"))
    if giants:
        rows, keys = _told_apart(rows, keys, giants)
    placed = with_unit(keys)
    units = stored(placed.where("hot_shard is null").groupBy("u").agg(F.sum("size").alias("bytes")), "shard-units")
    parts = max(1, -(-shuffle_parts(spark) // shards))  # ranges per shard, so that a shard may have many tasks
    wanted = _levels(filled, total - sum(filled))
    goals, so_far = [], 0.0
    for w in wanted:
        goals += [so_far + w * i / parts for i in range(1, parts + 1)]
        so_far += w
    bounds = splitters(units, goals[:-1], total - sum(filled), tolerance * share / 2)

    def with_part(rows: DataFrame) -> DataFrame:
        own = _place(F.col("u"), bounds)
        return rows.withColumn(
            "part", F.when(F.col("hot_shard").isNull(), own).otherwise(F.col("hot_shard") * parts + F.pmod("u", F.lit(parts)).cast("int"))
        )

    counts = {r["part"]: r["n"] for r in with_part(placed).groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per range
    offsets, before = [], 0
    for part in range(shards * parts):
        before = 0 if part % parts == 0 else before
        offsets.append((part, before))
        before += counts.get(part, 0)
    starts = F.broadcast(spark.createDataFrame(offsets, "start_part int, start long"))
    rows = with_part(with_unit(rows)).repartition(shards * parts, "part")
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy("h", "at")))
    rows = rows.join(starts, F.col("part") == F.col("start_part"), "left")
    return rows.select(
        *(F.col(f"row_{i}").alias(c) for i, c in enumerate(names)),
        "size",
        F.floor(F.col("part") / parts).cast("int").alias("shard"),
        (F.col("start") + F.col("number") - 1).cast("long").alias("slot"),
    )
