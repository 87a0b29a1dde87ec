"""What an OCR engine's word boxes say, as text, confidence and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a TSV of word boxes, by place.
COLUMNS = ["nivel", "pagina", "bloco", "paragrafo", "linha", "palavra", "esquerda", "topo", "largura", "altura", "confianca", "texto"]


def boxes(pages: DataFrame, key: str, tsv: str) -> DataFrame:
    """The boxes with text of each page's TSV: key, ordem and the columns above."""
    rows = pages.select(key, F.posexplode(F.split(F.col(tsv), "\n")).alias("ordem", "_l")).withColumn("_c", F.split("_l", "\t")).where((F.size("_c") >= 12) & F.element_at("_c", 1).rlike(r"^\d+$"))
    number = {c: F.element_at("_c", i + 1).try_cast("double" if c == "confianca" else "int").alias(c) for i, c in enumerate(COLUMNS[:-1])}
    return rows.select(key, "ordem", *number.values(), F.trim(F.element_at("_c", 12)).alias("texto")).where("texto <> ''")


def page_text(words: DataFrame, key: str) -> DataFrame:
    """Of each page: key, texto (a line break for a new line, a blank line for a new paragraph or block), confianca
    (mean of the words that have one, to one place), palavras."""
    line = words.groupBy(key, "bloco", "paragrafo", "linha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordem", "texto"))), lambda x: x["texto"]), " ").alias("_t"), F.min("ordem").alias("_o"))
    par = line.groupBy(key, "bloco", "paragrafo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n").alias("_t"), F.min("_o").alias("_o"))
    text = par.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n\n").alias("texto"))
    facts = words.groupBy(key).agg(F.round(F.avg(F.when(F.col("confianca") >= 0, F.col("confianca"))), 1).alias("confianca"), F.count("*").alias("palavras"))
    return text.join(facts, key)


def export_text(words: DataFrame, key: str) -> DataFrame:
    """As `page_text` for the export: lines only, by page of the TSV too, words without confidence left out."""
    kept = words.where("confianca >= 0")
    line = kept.groupBy(key, "pagina", "bloco", "paragrafo", "linha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordem", "texto"))), lambda x: x["texto"]), " ").alias("_t"), F.min("ordem").alias("_o"))
    return line.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n").alias("texto"))
