"""Where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is chosen once per session,
    which is only possible when driver and tasks share one machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.conf.get("tickloom.fallback.dir", None)
    if not current:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("tickloom.fallback.dir", current)
    return current


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once to reliable storage and read it from there on.

    With ``drop_shuffles`` the shuffle files of this write go as soon as it ends. Otherwise they stay on the disks until
    the driver's garbage collector finds them, which on a driver with memory to spare is after the query.
    """
    spark = df.sparkSession
    path = new_path(spark, "stored")
    before = spark.conf.get(DROP_SHUFFLES, "false")
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
