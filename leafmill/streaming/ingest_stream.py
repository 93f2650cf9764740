"""Incremental ingest: new document files to the chunk store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leafmill.plans.ingest import ingest

ARRIVED = "_arrived"


def document_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Documents that arrive as files; ``path`` is a folder or a glob.

    ``max_files`` bounds the files of a micro-batch, so that a backlog comes in steps.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def first_arrivals(documents: DataFrame, keys: Sequence[str], within: str = "1 day") -> DataFrame:
    """Each key once per stretch of arrivals.

    The state holds the keys that arrived ``within`` that time and no others. The time is
    that of the arrival, not one that a row brings, so no row is ever late and dropped for
    it; a key that comes again after that time passes, and the store's filters meet it.
    """
    timed = documents.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, within)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop(ARRIVED)


def start_ingest(
    documents: DataFrame, root: str, checkpoint: str, metadata: list[str], **options
) -> StreamingQuery:
    """Ingest what has arrived since the last run, then stop.

    Progress lies in the checkpoint. The store has the last word: a batch that is played
    again adds nothing, and of the store only the batches are read whose id filters may hold
    a new id.
    """

    def add(batch: DataFrame, _: int) -> None:
        ingest(batch.sparkSession, batch, root, metadata, **options)

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
