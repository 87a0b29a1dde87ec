"""Search by vector, and its fusion with search by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constant of reciprocal rank fusion, and places of each list that count.
RRF, LISTED = 60, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector, a null element or vectors of different length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def top_k(vectors: DataFrame, key: str, vector: str, question: list[float], k: int = LISTED) -> DataFrame:
    """The `k` vectors most similar to one: key, similaridade, posicao. The question is a literal of the plan, so
    there is no join, and only `k` rows of each partition leave it."""
    asked = F.array(*(F.lit(float(x)) for x in question))
    scored = vectors.select(key, cosine(F.col(vector), asked).alias("similaridade")).where("similaridade is not null")
    best = scored.orderBy(F.desc("similaridade"), key).limit(k)
    return best.withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("similaridade"), key)))


def fuse(by_words: DataFrame, by_vectors: DataFrame, key: list[str], limit: int = 20, documents: DataFrame | None = None, document: str = "documento_id") -> DataFrame:
    """Reciprocal rank fusion of two lists (key, posicao): key, pontos, origens. A key that a list holds several
    times counts by its best place. Either list may be empty. Where `documents` are given, keys of others fall out before
    the limit, and the documents' columns come along."""
    lists = [d.where(F.col("posicao") <= LISTED).groupBy(*key).agg(F.min("posicao").alias("posicao")).withColumn("origem", F.lit(o)) for d, o in ((by_words, "palavra"), (by_vectors, "significado"))]
    both = lists[0].unionByName(lists[1])
    fused = both.groupBy(*key).agg(F.sum(1.0 / (RRF + F.col("posicao"))).alias("pontos"), F.array_sort(F.collect_set("origem")).alias("origens"))
    if documents is not None:
        fused = fused.join(documents, document)
    return fused.orderBy(F.desc("pontos"), *key).limit(limit)


def first_passages(found: DataFrame, passages: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    """The passages that an answer is made from: those of the `most` best hits (key, pontos), with their texts."""
    best = found.orderBy(F.desc("pontos"), *key).limit(most)
    return best.join(passages, key).withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("pontos"), *key)))


def pending(passages: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """Passages whose vector is missing or was made from another text or model: left for the provider."""
    return passages.join(stored.select(key, version), [key, version], "left_anti")


def stale(stored: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """Stored vectors of documents that no longer exist."""
    return stored.join(documents.select(document).distinct(), document, "left_anti")


def status(stored: DataFrame, document: str) -> DataFrame:
    """One row: documentos, passagens."""
    return stored.agg(F.countDistinct(document).alias("documentos"), F.count("*").alias("passagens"))
