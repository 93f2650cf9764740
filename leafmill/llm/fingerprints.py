"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct 63-bit hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and the number of distinct shingles.
With k or fewer shingles all estimates are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.spark import LEAST_ID, bounded_batches, id_bounds, range_bucket, shuffle_parts
from leafmill.llm.words import segments, shingle_hashes, slices

SKETCH = 256
_SPAN = float(1 << 63)


def sketch(text: Column, k: int = SKETCH) -> Column:
    """The bottom-k sketch of a text column; null and empty texts give an empty array."""

    @F.arrow_udf("array<bigint>")
    def smallest(texts: pa.Array) -> pa.Array:
        return _listed(_sketches(texts.to_pylist(), k))

    return smallest(text)


def _sketches(texts: list[str], k: int) -> list[np.ndarray]:
    found = []
    for part in slices(texts):
        hashes, counts = shingle_hashes(part)
        hashes = (hashes >> np.uint64(1)).astype(np.int64)
        found += [np.unique(hashes[a:b])[:k] for a, b in segments(counts)]
    return found


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate([np.empty(0, np.int64), *found])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def edited_text(text: str, following: str) -> str:
    """The text with its second half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sketches_in_order(text: Column, following: Column, k: int) -> Column:
    """Sketches of a text, its edited text and the following text.

    Rows come in order, so the following text is mostly the next row's and its sketch is
    there already.
    """

    @F.arrow_udf("struct<sketch: array<bigint>, edited: array<bigint>, following: array<bigint>>")
    def three(texts: pa.Array, followings: pa.Array) -> pa.Array:
        own, after = texts.to_pylist(), [t or "" for t in followings.to_pylist()]
        edited = _sketches([edited_text(a, b) for a, b in zip(own, after, strict=True)], k)
        found = _sketches(own, k)
        known = [i + 1 < len(own) and after[i] == own[i + 1] for i in range(len(own))]
        more = iter(_sketches([t for t, there in zip(after, known, strict=True) if not there], k))
        nexts = [found[i + 1] if there else next(more) for i, there in enumerate(known)]
        return pa.StructArray.from_arrays([_listed(found), _listed(edited), _listed(nexts)], ["sketch", "edited", "following"])

    return three(text, following)


def _united(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 if both are empty."""
    both = _united(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * _SPAN) / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(_united(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge(df: DataFrame, by: str, column: str, k: int = SKETCH, salts: int = 32) -> DataFrame:
    """Merge the sketches of each group: (by, column). Hot groups merge in two steps.

    Groups are merged salt by salt first, so no task holds more than a 1/salts share
    of a group's sketches; each of those leaves k values at most.
    """
    rows = df.select(F.col(by), F.col(column), F.pmod(F.xxhash64(column), F.lit(salts)).alias("salt"))

    def step(rows: DataFrame, *keys: str) -> DataFrame:
        values = rows.select(*keys, F.explode_outer(column).alias("value")).distinct()
        at = Window.partitionBy(*keys).orderBy("value")
        least = values.withColumn("at", F.row_number().over(at)).where(F.col("at") <= k)
        return least.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias(column))

    return step(step(rows, by, "salt"), by)


def encoded(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a value."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_factor: int = 4) -> DataFrame:
    """(doc_id, text, next_text, tail): each text beside that of the next greater id.

    After the last id comes the first again. The texts move once, into ranges of ids;
    the first row of each range is copied to the end of the range before it. Null ids
    come first, rows of one id in the order of their texts' hashes; null texts are
    empty. A table of one row is its own successor. Rows with ``tail`` are the copies.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("at"))
    parts = shuffle_parts(spark)
    bounds = id_bounds(ids, "at", bucket_factor * parts)
    where = range_bucket(F.col("at"), bounds)
    heads = ids.groupBy(where.alias("bucket")).agg(F.min("at").alias("at")).orderBy("bucket").collect()  # one per range
    if not heads:
        heads_df = spark.createDataFrame([], "at long, before int")
    else:
        heads_df = spark.createDataFrame(
            [(h["at"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)], "at long, before int"
        )
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("at"),
    ).withColumn("bucket", where)
    places = F.when(
        F.col("before").isNotNull(),
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("tail")),
            F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")),
        ),
    ).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("tail"))))
    at_end = Window.partitionBy("bucket").orderBy("tail", "at", F.xxhash64("text"))
    placed = (
        rows.join(F.broadcast(heads_df), "at", "left")
        .select("doc_id", "at", "text", F.explode(places).alias("place"))
        .select("doc_id", "at", "text", F.col("place.bucket").alias("bucket"), F.col("place.tail").alias("tail"))
        .repartition(parts, "bucket")
    )
    return placed.withColumn("next_text", F.lead("text").over(at_end))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """Sketches of every text and of the text whose second half is the next one's start.

    Returns doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited and
    near_next. The last floor(n_chars / 2) code points give way to as many (or all) of
    the next text's. Nulls count as empty texts, repeated rows each give a row, an
    empty table gives none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), length - half),
        F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half),
    )
    rows = with_next(docs, id_col, text_col).where(~F.col("tail"))
    rows = rows.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        _sketches_in_order(F.col("text"), F.col("next_text"), k).alias("s"),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("s.sketch").alias("sketch"),
        F.col("s.edited").alias("edited_sketch"),
        F.col("s.following").alias("next_sketch"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
