"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of one Arrow batch of whole texts; Spark's own 10,000 rows of long texts are much of a worker's memory.
BATCH_ROWS = 1_000


def local_session(cpus: int | str = "*", app_name: str = "lettermill", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """All instants are rendered in UTC, whatever zone the session started with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh local one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="lettermill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared work folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches and is costly to compute twice. Unlike a cache it survives
    the loss of executors, and unlike ``checkpoint`` the reader can still prune columns and push filters.
    ``folder`` groups what a job drops together in the end, see :func:`drop_folder`. Texts repeat across columns and copies, which
    zstd makes less of than the default.
    """
    path = f"{folder}/{name}" if folder else fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a job's own intermediate tables once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches from now on, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
