"""File listings, limits, retention and the ingest ledger."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions taken in, their size limit in MB, days files are kept.
PDF_EXTENSIONS = (".pdf",)
TABLE_EXTENSIONS = (".csv", ".xlsx", ".xls")
MAX_SIZE_MB = 100
KEEP_DAYS = 30
MEGABYTE = 1024 * 1024


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files of a folder as ``path, modificationTime, length`` and ``content``.

    A caller that does not select ``content`` never reads it. The reader passes over
    files of no bytes, so these are listed through the file system and added.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    empty = empty_files(spark, folder, pattern, recursive)
    if not empty:
        return found
    return found.unionByName(spark.createDataFrame(empty, "path string, modificationTime timestamp, length long, content binary"))


def empty_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> list[tuple]:
    """The files of no bytes in a folder or glob; hidden ones are left out, as by the readers."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    accepts = hadoop.GlobFilter(pattern)
    found, waiting = [], list(fs.globStatus(root) or [])
    top = len(waiting)
    while waiting:
        status = waiting.pop(0)
        name = status.getPath().getName()
        inside = top <= 0
        top -= 1
        if status.isDirectory():
            if not inside or recursive and not name.startswith(("_", ".")):
                waiting += list(fs.listStatus(status.getPath()))
        elif not status.getLen() and not name.startswith(("_", ".")) and accepts.accept(status.getPath()):
            time = datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.timezone.utc)
            found.append((status.getPath().toString(), time, 0, bytearray()))
    return found


def plain_path(path: str) -> str:
    """A path for a reader that takes globs, which finds this one file only."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def scan_directory(
    spark: SparkSession, folder: str, extensions: Sequence[str] = PDF_EXTENSIONS + TABLE_EXTENSIONS
) -> DataFrame:
    """The supported files directly in a folder."""
    return list_files(spark, folder, "*{" + ",".join(extensions) + "}")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def size_mb(length: Column, digits: int = 2) -> Column:
    return F.round(length / MEGABYTE, digits)


def file_facts(files: DataFrame, with_hash: bool = False) -> DataFrame:
    """Name, path, size, extension and time of each file; the md5 only on request."""
    path = F.col("path")
    facts = [
        base_name(path).alias("name"),
        path,
        F.col("length").alias("size"),
        size_mb(F.col("length")).alias("size_mb"),
        extension(path).alias("extension"),
        F.col("modificationTime").alias("modified_time"),
    ]
    if with_hash:
        facts.append(F.md5("content").alias("hash"))
    return files.select(*facts)


def check_files(
    files: DataFrame,
    ext: Column,
    size: Column,
    max_mb: float = MAX_SIZE_MB,
    extensions: Sequence[str] = PDF_EXTENSIONS + TABLE_EXTENSIONS,
) -> DataFrame:
    """Mark each file ``accepted`` or give the ``reason``: format first, then size."""
    reason = F.when(~ext.isin(*extensions), "unsupported format").when(
        size / MEGABYTE > max_mb, "file too large"
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def ingest_ledger(inputs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One outcome per input row: ``chunks_count``, ``success`` and ``error_message``.

    ``inputs`` carries the ``reason`` of ``check_files`` or of a reader that failed. A
    file without chunks is a failure of its own and never stops the others.
    """
    made = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_made"))
    count = F.when(F.col("reason").isNull(), F.coalesce("_made", F.lit(0))).otherwise(0)
    error = F.coalesce("reason", F.when(F.col("chunks_count") == 0, "empty result"))
    return (
        inputs.join(made, key, "left")
        .withColumn("chunks_count", count)
        .withColumn("error_message", error)
        .withColumn("success", F.col("error_message").isNull())
        .drop("_made", "reason")
    )


def retain(rows: DataFrame, time: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows not older than ``days`` before ``now``."""
    return rows.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def count_expired(rows: DataFrame, time: str, now: Column, days: int = KEEP_DAYS) -> int:
    return rows.where(F.col(time) < now - F.make_dt_interval(F.lit(days))).count()


def storage_usage(files: DataFrame, folder: str, size: str, names: DataFrame) -> DataFrame:
    """Megabytes per named folder, 0.0 where it holds nothing."""
    used = files.groupBy(F.col(folder).alias("name")).agg(F.sum(size).alias("_bytes"))
    return names.join(used, "name", "left").select(
        "name", F.coalesce(size_mb(F.col("_bytes")), F.lit(0.0)).alias("size_mb")
    )
