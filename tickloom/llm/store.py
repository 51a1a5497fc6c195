"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids up to this many go to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes that a task hands to Python at once where small_batches() holds; a longer row goes alone.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """Tables that several steps of one job read, kept on the executors' disks; a lost part is computed again.

    What outlives the job must rest on written tables, because release() frees the others.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def release(self) -> None:
        for df in self.tables:
            df.unpersist()
        self.tables = []


def sized(ids: DataFrame) -> DataFrame:
    """ids (a few numbers a row) with a hint to broadcast them if they were counted and are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint to be joined by a shuffle, for joins in loops: small sides would else be gathered on the driver again and again."""
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES, unless it has a setting of its own.

    Spark's default is 10,000 rows or 64 MB, for which every task grows buffers of tens of MB outside the JVM's heap and in its Python
    worker; both processes keep most of what is freed. Which rows meet in a batch never moves a result. The setting stays, as what a
    stage returns is computed after it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str = "_row") -> str:
    """`name` behind as many underscores as it takes that no column of df starts like it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str = "row", columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those named) with a long that no other row has and that stays the same whenever it is read: the file's number and the place in it.

    A table that is read from files is taken as it is, anything else is written first. Files are numbered by path.
    """
    columns = docs.columns if columns is None else columns
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not docs.inputFiles() or "_metadata" in docs.columns:
        docs = written(docs.select(*columns), "rows")
    at, file = F.col("_metadata.row_index").alias(f"{name}_at"), F.col("_metadata.file_path").alias(f"{name}_file")
    x = docs.select(*columns, file, at)
    files = x.select(f"{name}_file").distinct().select(f"{name}_file", (F.row_number().over(Window.orderBy(f"{name}_file")) - 1).cast("long").alias(f"{name}_n"))
    x = x.join(F.broadcast(written(files, "files")), f"{name}_file")  # a row for each file
    return x.select(*columns, (F.shiftleft(f"{name}_n", 40) + F.col(f"{name}_at")).alias(name))
