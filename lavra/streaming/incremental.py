"""Continuous and resumable runs: new files once, the state of a log, and the heartbeat of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds after which a run without a heartbeat counts as broken off.
STALE = 30


def process_new(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every file of `source` that no run before has seen to `handle`, then stop. The checkpoint makes the
    run resumable: a batch that broke off comes again with the same number."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key in a stream of changes, for the update mode."""
    rest = [c for c in stream.columns if c not in key]
    return stream.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("atual")).select(*key, "atual.*")


def event_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind in windows of `width`; rows later than `late` no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("janela"), kind).agg(F.count("*").alias("n"))


def run_state(progress: DataFrame) -> DataFrame:
    """Runs (execucao, batimento, terminado) with their state: concluída, em andamento, interrompida."""
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("batimento")
    return progress.withColumn("estado", F.when(F.col("terminado"), "concluída").when(age > STALE, "interrompida").otherwise("em andamento"))
