"""Session, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "quaystone") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = cpus or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if sc.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaystone-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table to the shared folder; survives lost executors.

    The tables lie under <shared>/quaystone-<application id>, for whoever owns the folder to remove.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/quaystone-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
