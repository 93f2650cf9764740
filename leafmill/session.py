"""Session set-up, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20

_LOCAL_ROOTS: dict[str, str] = {}
_SCRATCH: list[str] = []


def get_session(cores: int | str = "*", app: str = "leafmill") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small input over all cores before CPU-heavy row work.

    A table of at least as many partitions as there are cores is returned as it
    is, so a large input never pays for the extra shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Exchange|Join|Aggregate|Window|Sort", plan):  # its exchanges deal the rows out; asking would run them
        return df
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str((1 << 31) - 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` decides. Where it is unset a temporary folder is
    used, in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="leafmill-")
    return _LOCAL_ROOTS[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_root(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to its scratch paths; how many there were.

    Frames that read them can't be used any more.
    """
    paths = list(_SCRATCH)
    _SCRATCH.clear()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/leafmill/checkpoints")
    return df.checkpoint(eager=True)
