"""Ingest of a folder of files: every file ends in the ledger, good or bad."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.vectors import hash_embedding
from leafmill.plans.ingest import ingest_chunks, prepare_chunks
from leafmill.session import checkpointed
from leafmill.sources import csvfiles, files

# A reader turns files of one extension, given by their paths, into rows ``(path, text,
# ...)``; a row with an ``error`` and no text tells why a file could not be read.
Reader = Callable[[SparkSession, list[str]], DataFrame]

READERS: dict[str, Reader] = {".csv": csvfiles.describe_files}
BASE = ["source", "file_name", "file_type", "file_size", "file_hash"]
CHUNK = ["chunk_id", "chunk_index", "chunk_size", "content_type", "processing_stage"]


def same_path(path: Column) -> Column:
    """Listings and scans write the scheme of local paths differently."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def ingest_directory(
    spark: SparkSession,
    folder: str,
    root: str,
    readers: dict[str, Reader] | None = None,
    embedder: Callable[[Column], Column] = hash_embedding,
    max_mb: float = files.MAX_SIZE_MB,
    **options,
) -> DataFrame:
    """Describe, chunk, embed and store the supported files directly in a folder.

    Returns the ledger, one row per file. A format without a reader, an oversized or
    an empty file is a failure of its own. ``readers`` adds formats, for example PDF
    through a ``mapInPandas`` over ``files.list_files``.
    """
    readers = READERS | (readers or {})
    listed = files.list_files(spark, folder).withColumn("path", same_path(F.col("path")))
    checked = files.check_files(
        files.file_facts(listed).select("path", F.col("extension").alias("file_type"), "size"),
        F.col("file_type"),
        F.col("size"),
        max_mb,
        list(readers),
    )
    # only accepted files are read, by their paths; the listing itself is of this size
    checked = checkpointed(checked)
    accepted: dict[str, list[str]] = {}
    for row in checked.where("accepted and size > 0").select("path", "file_type").collect():
        accepted.setdefault(row["file_type"], []).append(files.plain_path(row["path"]))
    small = files.file_facts(listed.where(F.col("length") <= int(max_mb * files.MEGABYTE)), with_hash=True)
    base = small.select(
        "path",
        F.col("path").alias("source"),
        F.col("name").alias("file_name"),
        F.col("extension").alias("file_type"),
        F.col("size").alias("file_size"),
        F.col("hash").alias("file_hash"),
    )
    if not accepted:
        return files.ingest_ledger(checked, spark.createDataFrame([], "path string"), "path")
    texts = [readers[s](spark, paths).withColumn("path", same_path(F.col("path"))) for s, paths in accepted.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts).join(base, "path")
    if "error" in rows.columns:
        rows = checkpointed(rows)  # a row per file
        failed = rows.where("text is null").select("path", F.col("error").alias("_error"))
        checked = checked.join(failed, "path", "left").withColumn("reason", F.coalesce("reason", "_error")).drop("_error")
        rows = rows.where("text is not null").drop("error")
    extra = [c for c in rows.columns if c not in ("path", "text", *BASE)]
    chunks = prepare_chunks(
        rows, [*BASE, *CHUNK, *extra], content_type="table_description", stage="table_to_text", **options
    )
    chunks = checkpointed(chunks)  # stored and counted
    ingest_chunks(spark, chunks.drop("path"), root, embedder)
    return files.ingest_ledger(checked, chunks, "path")
