"""Session helpers: a local session for tests and benches, and lineage cuts
that go to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidewise") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session;
    nothing in the library depends on these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset (a test session)
    is a fresh scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder shared by the cluster; a "
                "machine-local scratch folder would not survive losing an executor")
        configured = tempfile.mkdtemp(prefix="tidewise-ckpt-")  # local test sessions only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Reliable checkpoints survive the loss of the executor that computed them,
    unlike ``localCheckpoint``, which this library never uses.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tidewise-{name}-{uuid.uuid4().hex[:12]}"


# Folders that a task writes to at once, and the bytes that each holds back.
OPEN_FOLDERS = 16
ROW_GROUP_BYTES = 16 << 20


@contextmanager
def open_folders(spark: SparkSession):
    """Within it a task that writes to a few folders keeps a file open in each, in place of sorting its
    rows by folder: its memory does not grow with its rows. More folders than ``OPEN_FOLDERS`` are sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FOLDERS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_folders(df: DataFrame, path: str, partition_by: list[str], mode: str = "overwrite") -> None:
    """Parquet in a folder for each value of ``partition_by``, written without a sort if they are few."""
    with open_folders(df.sparkSession):
        df.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*partition_by).parquet(path)


def write_scratch(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and return a
    scan of it. With ``partition_by``, later filters on those columns read
    only the matching folders. The scan has the schema of ``df``, so folder names
    are never taken for numbers; use ``folder_key`` for free text."""
    path = scratch_path(df.sparkSession, name)
    if partition_by:
        write_folders(df, path, partition_by, "error")
    else:
        df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def folder_key(column: Column | str) -> Column:
    """A text as a folder name that no two texts share, null and empty included."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.concat(F.lit("k"), F.coalesce(F.hex(text), F.lit("none")))
