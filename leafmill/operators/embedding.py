"""Embedding texts through a cache table.

A cache is a table ``(text_hash, embedding, cached_at)`` keyed by the md5 of the
whole text. Each distinct text is embedded once, however many rows repeat it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.vectors import hash_embedding
from leafmill.operators.store import append_rows
from leafmill.session import checkpointed

# Fixed value: days until a cache entry expires.
EXPIRE_DAYS = 30

# A text with at least this many copies gets its vector by broadcast. There is at most
# one such text per this many rows; beyond HOT_TEXTS of them the plain join is used.
HOT_COPIES = 1_000_000
HOT_TEXTS = 10_000


def text_hash(text: str | Column) -> Column:
    return F.md5(F.col(text) if isinstance(text, str) else text)


def fresh_entries(cache: DataFrame, now: Column, expire_days: int = EXPIRE_DAYS) -> DataFrame:
    """The newest entry per text that has not expired."""
    live = cache.where(F.col("cached_at") >= now - F.make_dt_interval(F.lit(expire_days)))
    return live.groupBy("text_hash").agg(
        F.max_by("embedding", "cached_at").alias("embedding"), F.max("cached_at").alias("cached_at")
    )


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text once. Copies are merged on the map side, so a text that fills a
    third of the table reaches the shuffle once per task."""
    return df.groupBy(text_hash(text).alias("text_hash")).agg(
        F.min(text).alias("text"), F.count(F.lit(1)).alias("copies")
    )


def cache_lookup(
    df: DataFrame, cache: DataFrame, now: Column, text: str = "text", expire_days: int = EXPIRE_DAYS
) -> DataFrame:
    """Distinct texts with their cached embedding, null on a miss."""
    return distinct_texts(df, text).join(
        fresh_entries(cache, now, expire_days).drop("cached_at"), "text_hash", "left"
    )


def embed_with_cache(
    df: DataFrame,
    cache: DataFrame,
    now: Column,
    embedder: Callable[[Column], Column] = hash_embedding,
    text: str = "text",
    expire_days: int = EXPIRE_DAYS,
) -> DataFrame:
    """One row per distinct text ``(text_hash, embedding, cached, copies)``.

    The embedder gets a null in the place of a cached text and must answer it with
    null, so hits cost it nothing and the texts are read once. Rows with ``cached``
    false are what a caller appends to the cache.
    """
    found = cache_lookup(df, cache, now, text, expire_days)
    miss = F.col("embedding").isNull()
    return found.select(
        "text_hash",
        F.coalesce("embedding", embedder(F.when(miss, F.col("text")))).alias("embedding"),
        (~miss).alias("cached"),
        "copies",
    )


def attach_embeddings(df: DataFrame, embedded: DataFrame, text: str = "text") -> DataFrame:
    """Bring the embedding of each text back to the rows that hold it.

    The embeddings are checkpointed, so none is computed twice. Rows of a text with
    very many copies stay where they are and get its vector by broadcast; all other
    rows meet theirs in a join on the hash.
    """
    embedded = checkpointed(embedded)
    if "copies" not in embedded.columns:
        embedded = embedded.withColumn("copies", F.lit(1))
    vectors = embedded.drop("copies")
    rows = df.withColumn("text_hash", text_hash(text))
    hot = embedded.where(F.col("copies") >= HOT_COPIES).drop("copies")
    if not 0 < hot.limit(HOT_TEXTS + 1).count() <= HOT_TEXTS:
        return rows.join(vectors, "text_hash", "left").drop("text_hash")
    often = rows.join(F.broadcast(hot), "text_hash")
    seldom = rows.join(F.broadcast(hot.select("text_hash")), "text_hash", "left_anti")
    return often.unionByName(seldom.join(vectors, "text_hash", "left")).drop("text_hash")


def embed_rows(
    df: DataFrame, text: str = "text", embedder: Callable[[Column], Column] = hash_embedding
) -> DataFrame:
    """Embed every row in place, without a cache and without a shuffle."""
    return df.withColumn("embedding", embedder(F.col(text)))


def new_cache_entries(embedded: DataFrame, now: Column) -> DataFrame:
    return embedded.where("not cached").select("text_hash", "embedding", now.alias("cached_at"))


def save_cache(embedded: DataFrame, root: str, now: Column) -> None:
    """Append what an embedding run added to the cache; ``store.reset_store`` clears it."""
    append_rows(new_cache_entries(embedded, now), root)


def prune_cache(cache: DataFrame, now: Column, expire_days: int = EXPIRE_DAYS) -> DataFrame:
    """The cache without expired and superseded entries."""
    return fresh_entries(cache, now, expire_days)


def cache_info(cache: DataFrame, expire_days: int = EXPIRE_DAYS) -> DataFrame:
    """Entry count and size of the stored vectors (four bytes per number)."""
    size = F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0))
    return cache.agg(F.count(F.lit(1)).alias("entries"), size.cast("long").alias("total_bytes")).select(
        "entries",
        "total_bytes",
        F.round(F.col("total_bytes") / (1024 * 1024), 6).alias("total_mb"),
        F.lit(expire_days).alias("expire_days"),
    )
