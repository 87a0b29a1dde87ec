"""Texts in windows of words and in chunks of whole pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a passage and from one to the next, and words of a chunk.
WORDS, STEP, CHUNK_WORDS = 250, 210, 1200


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def passages(pages: DataFrame, key: list[str], text: str, words: int = WORDS, step: int = STEP) -> DataFrame:
    """Windows of `words` words, `step` apart, none over the end of a page: key, n (from 1), palavras, texto."""
    rows = pages.select(*key, _words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("_w") - words) / step), F.lit(0)).cast("int"))
    return rows.select(*key, "_w", F.explode(starts).alias("_k")).select(
        *key, (F.col("_k") + 1).alias("n"), F.size(F.slice("_w", F.col("_k") * step + 1, words)).alias("palavras"), F.array_join(F.slice("_w", F.col("_k") * step + 1, words), " ").alias("texto")
    )


def passage_offsets(pages: DataFrame, key: list[str], text: str, words: int = WORDS, step: int = STEP) -> DataFrame:
    """As `passages`, with where each begins and ends in the page, from the lengths of words and gaps before it."""
    rows = pages.select(*key, F.col(text).alias("_t"), F.regexp_extract_all(F.col(text), F.lit(r"(\s*)(\S+)"), F.lit(0)).alias("_p")).where(F.size("_p") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("_p") - words) / step), F.lit(0)).cast("int"))
    cut = rows.withColumn("_k", F.explode(starts))
    first, last = F.col("_k") * step + 1, F.least(F.col("_k") * step + words, F.size("_p"))
    length = lambda n: F.aggregate(F.slice("_p", F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    begin = length(first) - F.length(F.ltrim(F.regexp_replace(F.element_at("_p", first), r"^\s+", "")))
    return cut.select(*key, (F.col("_k") + 1).alias("n"), begin.alias("inicio"), length(last).alias("fim"), "_t").withColumn("texto", F.substring(F.col("_t"), F.col("inicio") + 1, F.col("fim") - F.col("inicio"))).drop("_t")


def _packed(most: int):
    """The number (from 1) of the chunk that each part falls into, given the sizes of a document's parts in order."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pack(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            chunk, filled, numbers = 1, 0, []
            for w in row:
                if filled and filled + w > most:
                    chunk, filled = chunk + 1, 0
                filled += w
                numbers.append(chunk)
            out.append(numbers)
        return pd.Series(out, dtype=object)

    return pack


def chunks(pages: DataFrame, document: str, n: str, text: str, most: int = CHUNK_WORDS) -> DataFrame:
    """Whole pages packed in order into chunks of at most `most` words: document, trecho (from 1), paginas, palavras,
    texto. A page beyond that goes by its paragraphs, a paragraph beyond that by its words; empty ones are left out."""
    parts = pages.where(F.trim(text) != "").select(document, n, F.posexplode(F.when(F.size(_words(F.col(text))) > most, F.split(text, r"\n\s*\n")).otherwise(F.array(text))).alias("_i", "_p"))
    size = F.size(_words(F.col("_p")))
    sliced = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int")), lambda k: F.array_join(F.slice(_words(F.col("_p")), k * most + 1, most), " "))
    fine = parts.where(F.trim("_p") != "").select(document, n, "_i", F.posexplode(F.when(size > most, sliced).otherwise(F.array("_p"))).alias("_j", "_q"))
    place = ["n", "_i", "_j"]
    fine = fine.select(document, F.col(n).cast("int").alias("n"), "_i", "_j", F.size(_words(F.col("_q"))).alias("w"), F.col("_q").alias("t"))
    # Packing goes in order, so a document's parts come together: their sizes alone, not their texts.
    items = fine.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(*place, "w"))).alias("_l"))
    numbers = _packed(most)(F.transform("_l", lambda x: x["w"]))
    placed = items.select(document, F.explode(F.arrays_zip("_l", numbers.alias("c"))).alias("x")).select(document, *(F.col("x._l")[k].alias(k) for k in place), F.col("x.c").alias("c"))
    marked = F.concat(F.lit("<pagina "), F.col("n").cast("string"), F.lit(">\n"), F.col("t"))
    joined = fine.join(placed, [document, *place])
    out = joined.groupBy(document, F.col("c").alias("trecho")).agg(
        F.array_sort(F.collect_set("n")).alias("paginas"), F.sum("w").alias("palavras"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, marked.alias("m")))), lambda s: s["m"]), "\n\n").alias("texto"),
    )
    return out.withColumn("hash", F.substring(F.sha2(F.col("texto").cast("binary"), 256), 1, 12))
