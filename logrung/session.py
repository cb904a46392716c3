"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "logrung", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only on one machine (master ``local[...]``, as in tests) an absent setting
    is replaced by a temporary folder, remembered in the session. On a cluster
    the executors would write such a folder to disks of their own, so there it
    is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.logrung.shared.dir", None
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    fresh = tempfile.mkdtemp(prefix="logrung-")
    spark.conf.set("spark.logrung.shared.dir", fresh)
    return fresh


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/logrung/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Used where several passes read one expensive result: the parse is paid
    once, row ids stay fixed, and a lost executor costs a re-read only. File
    sizes are known afterwards, so Spark decides on real numbers whether a
    join may broadcast the table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) handles for listing, renaming and deleting."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified_path(spark: SparkSession, path: str) -> str:
    """The absolute path that the file system gives a file name of, without scheme."""
    fs, where = hadoop_path(spark, path)
    return fs.makeQualified(where).toUri().getPath()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables landed by this application; call it after the last job."""
    fs, where = hadoop_path(spark, scratch_root(spark))
    fs.delete(where, True)
