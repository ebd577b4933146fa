"""Session-level helpers shared by every operator: reading tables and cutting lineage durably."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Where a ``local`` session without a shared folder keeps its tables; removed when the process ends.
OWN_FOLDER = "palimpsest.local.folder"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only a single-process ``local`` session (tests) may fall back to a temporary folder; a cluster without the
    setting is an error, because a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set(OWN_FOLDER, folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared one: all its tables can be removed at once."""
    return f"palimpsest-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete every table this session has materialized. Call it when no result that was built from them is needed any more; files on
    any file system that Spark can reach are removed."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{run_folder(spark)}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: durable, columnar, lineage cut.

    The result survives the loss of executors, later reads prune columns, and its size is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` gave, when nothing more will be read from it."""
    context = written.sparkSession.sparkContext
    own = f"/{run_folder(written.sparkSession)}/"
    for path in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if own in f"{path}/":
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle width set for this session, never under ``at_least``."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
