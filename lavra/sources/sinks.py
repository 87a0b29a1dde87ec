"""Where results go. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a table in place of the one before."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions that `df` has rows of: the upsert of a document's vectors or pages."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add events to an append-only JSONL log, with the time of writing."""
    df.withColumn("em", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_texts(df: DataFrame, path: str, target: str = "alvo", text: str = "texto") -> None:
    """One folder per target with its text, for tools that read plain files."""
    df.select(target, text).write.mode("overwrite").partitionBy(target).option("lineSep", "\f").text(path)


def markdown(df: DataFrame, title: str, most: int) -> str:
    """A table of at most `most` rows as Markdown, for a report's section."""
    rows = df.limit(most).collect()
    clean = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join(clean(v) for v in r) + " |" for r in rows), ""])
