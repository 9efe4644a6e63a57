"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "limnoscope", memory: str = "12g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Local data is small; without this, one task would take most shuffles.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return use_utc(spark)


def use_utc(spark: SparkSession) -> SparkSession:
    """Scene and sensor times are UTC; date keys only agree when the session is too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="limnoscope-"))
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, reachable by every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/limnoscope/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small result that several later jobs read.

    The result survives the loss of executors, and the pixel scan behind it runs once.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
