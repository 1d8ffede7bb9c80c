"""Session construction and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import arborlake

# Functions of this package travel to the executors by value, so that no copy need be installed there.
cloudpickle.register_pickle_by_value(arborlake)


def session(app: str = "arborlake", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one spark-submit gives."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local master gets a folder of its own; a cluster gets none, as its executors would each write to another disk."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_arborlake_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="arborlake-")
        sc._arborlake_dir = own
        atexit.register(shutil.rmtree, own, True)
    return "file://" + own


def _clean_up(spark: SparkSession, at: str) -> None:
    try:
        _delete(spark, at)
    except Exception:  # noqa: BLE001  the session may be gone already, and its folder with it
        pass


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of tables for each partition of a shuffle, and the most of a shuffle that are merged for a task.
PARTITION_BYTES = 16 << 20


def size_of(spark: SparkSession, at: str) -> int:
    """Bytes of a folder's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def sized(spark: SparkSession, size: int) -> SparkSession:
    """A session for tables of so many bytes: its shuffles have partitions in number with them and merge no more than PARTITION_BYTES
    for a task, and a task reads no more than twice that of a table, so that its memory doesn't grow with the input. It has the context and all settings of the given one, which stays
    as it is, and which is returned itself where its cores have not even one such partition each."""
    n = -(-size // PARTITION_BYTES)
    if n <= spark.sparkContext.defaultParallelism:
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        had = spark.conf.get(key, None)
        if had is not None:
            own.conf.set(key, str(max(int(had), n)))
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES), ("spark.sql.files.maxPartitionBytes", 2 * PARTITION_BYTES)):
        own.conf.set(key, f"{min(to_bytes(spark.conf.get(key)), most)}b")
    return own


#: Removes the files of a query's shuffles when the query ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: lineage ends there, and a lost executor loses none of them. So the shuffles that made a table go with its writing.

    A result may read them until the session ends, and then they go. What is needed no longer is dropped before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_clean_up, spark, self.at)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.at}/{table}"
        conf = df.sparkSession.conf
        had = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(CLEAN_UP, had)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str = "") -> None:
        _delete(self.spark, f"{self.at}/{table}" if table else self.at)
