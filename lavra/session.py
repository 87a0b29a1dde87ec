"""Session settings, table reading and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lavra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only where the session names none, as in tests on one
    machine, a temporary folder is made and set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lavra-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system when the driver ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and read it back: later reads survive lost executors and
    the plan before it isn't run again. The table goes when the driver ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "lavra", f"{name}-{uuid.uuid4().hex}")
    remove_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

