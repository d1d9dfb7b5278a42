"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf overrides single settings."""
    builder = (
        SparkSession.builder.appName("oriel")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_default: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset on a local master (tests), a folder of this process.

    On a cluster no machine sees another's folders, so there the setting must be given.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _local_default:
        _local_default.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local_default[0]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/oriel-{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only the tasks that run, and a second
    reader of the table doesn't compute it again. The files go when the driver's JVM ends, or
    by release().
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables as stage() gave them, once nothing that will still run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
