"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
adds the SQL settings this library relies on (AQE, UTC, ANSI-safe casts are
used explicitly in the code). ``checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only invents one when it is
unset on a local master (tests); on a cluster an unset folder is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL settings that are safe to set on any session."""
    for key, value in SQL_DEFAULTS.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static or locked conf on a managed cluster
            pass
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "retentio") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when none is configured."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder would not survive executor loss on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="retentio-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    This is a reliable lineage cut (lost executors re-read files, they never
    recompute upstream), and unlike ``checkpoint(eager=True)`` on an uncached
    frame it computes the input once: one write job, not a count plus a
    second recomputation for the checkpoint files.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def storage_memory(spark: SparkSession) -> int:
    """Bytes that the executors of now can hold cached; on a cluster the driver keeps no partitions."""
    driver = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId()
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator()
    held = {}
    while found.hasNext():
        at = found.next()
        held[at._1()] = at._2()._1()
    if len(held) > 1:
        held.pop(f"{driver.host()}:{driver.port()}", None)
    return sum(held.values())


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark can reach."""
    fs, at = _path(spark, path)
    return fs.exists(at)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    fs, at = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another name, in place of what had it."""
    fs, at = _path(spark, target)
    fs.delete(at, True)
    if not fs.rename(_path(spark, source)[1], at):
        raise OSError(f"{source} could not be renamed to {target}")
