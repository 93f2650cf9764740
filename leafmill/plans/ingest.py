"""The batch ingest job: documents to a store of embedded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from leafmill.functions.vectors import hash_embedding, truncate_to_budget
from leafmill.operators.chunking import chunk_table, enrich_chunks
from leafmill.operators.embedding import embed_rows
from leafmill.operators.id_filters import unstored
from leafmill.operators.store import append_batch, stored_dimension, valid_documents, with_chunk_id
from leafmill.session import checkpointed, spread

STAGE = "text_to_chunks"


def prepare_chunks(
    documents: DataFrame,
    metadata: list[str],
    text: str = "text",
    method: str = "basic",
    content_type: str = "markdown",
    stage: str = STAGE,
    **options,
) -> DataFrame:
    """Chunk, enrich and identify in one narrow pass."""
    chunks = chunk_table(spread(documents), text, method, **options)
    return with_chunk_id(enrich_chunks(chunks, content_type, stage), metadata)


def ingest(
    spark: SparkSession,
    documents: DataFrame,
    root: str,
    metadata: list[str],
    embedder: Callable[[Column], Column] = hash_embedding,
    budget: int | None = None,
    **options,
) -> DataFrame:
    """Add the chunks of the documents to the store; returns the ids added."""
    return ingest_chunks(spark, prepare_chunks(documents, metadata, **options), root, embedder, budget)


def ingest_chunks(
    spark: SparkSession,
    chunks: DataFrame,
    root: str,
    embedder: Callable[[Column], Column] = hash_embedding,
    budget: int | None = None,
) -> DataFrame:
    """Add identified chunks to the store; returns the ids added.

    Copies and known chunks leave before the embedder, the dearest step, sees them. An
    embedder with a token limit gets it as ``budget``, and longer texts are cut for it;
    the default one has no limit and reads whole texts.
    """
    fresh = unstored(spark, chunks, root)

    def embed(text: Column) -> Column:
        return embedder(text if budget is None else truncate_to_budget(text, budget))

    embedded = embed_rows(fresh, embedder=embed)
    dimension = stored_dimension(spark, root)
    if dimension is None:  # the first rows: look at their vectors once, then store them
        embedded = checkpointed(embedded)
    return append_batch(spark, valid_documents(embedded, None, dimension), root)
