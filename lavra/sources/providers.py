"""Tools outside the engine as callables: PDF reader, OCR, embedding and language model.

A provider gets a pandas frame and returns one of the declared schema. A row that fails is kept with its error,
so one page never fails the job, and a later run tries it again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.identifiers import effective_dpi, image_coverage, ocr_reason
from lavra.session import materialize
from lavra.sources import ocr

Provider = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Capability:
    """What a provider is, for keys of stored answers and for the method section."""

    name: str
    version: str
    digest: str = ""
    local: bool = True


def run_provider(rows: DataFrame, provider: Provider, schema: str, batch: int = 16, allow_remote: bool = False, capability: Capability | None = None) -> DataFrame:
    """`provider` over `rows` in batches; the result has the columns of `schema` and erro. A provider that isn't
    local is refused unless allowed."""
    if capability is not None and not capability.local and not allow_remote:
        raise ValueError(f"{capability.name} is not local")
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", schema)]

    def call(part: pd.DataFrame) -> pd.DataFrame:
        try:
            return provider(part).assign(erro=None)
        except Exception as error:
            if len(part) == 1:
                kept = {n: part[n].tolist() if n in part else [None] for n in names}
                return pd.DataFrame(kept | {"erro": [f"{type(error).__name__}: {error}"[:300]]})
            return pd.concat([call(part.iloc[[i]]) for i in range(len(part))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield call(frame.iloc[at : at + batch])[[*names, "erro"]]

    return rows.mapInPandas(run, f"{schema}, erro string")


#: What a PDF reader gives for each page: its digital text, size in points and the boxes of its images.
PDF_PAGE = "documento_id string, n int, texto string, largura double, altura double, imagens array<struct<x0:double,y0:double,x1:double,y1:double>>"
#: What an OCR engine gives for each page: the word boxes as it writes them (TSV).
OCR_PAGE = "documento_id string, n int, tsv string"


def plan_pdf(contents: DataFrame, reader: Provider, dpi: int = 300, forced: bool = False) -> DataFrame:
    """The pages of PDF files (documento_id, content) as a reader finds them, each with what is to be done: texto,
    caracteres, cobertura_imagem, motivo_ocr, dpi_efetivo, metodo (texto_digital, pendente_ocr, erro), erro. A file that
    can't be read is one row with its error."""
    read = run_provider(contents, reader, PDF_PAGE, batch=1)
    sized = read.withColumns({"caracteres": F.length(F.trim(F.coalesce("texto", F.lit("")))), "cobertura_imagem": image_coverage(F.col("imagens"), F.col("largura"), F.col("altura")), "dpi_efetivo": F.when(F.col("largura").isNotNull() & F.col("altura").isNotNull(), effective_dpi(F.col("largura"), F.col("altura"), F.lit(dpi)))})
    reason = F.when(F.col("erro").isNull(), ocr_reason(F.col("caracteres"), F.col("cobertura_imagem"), F.lit(forced)))
    method = F.when(F.col("erro").isNotNull(), "erro").when(F.col("motivo_ocr").isNotNull(), "pendente_ocr").otherwise("texto_digital")
    planned = sized.withColumn("motivo_ocr", reason).withColumn("metodo", method)
    return planned.select("documento_id", F.coalesce("n", F.lit(1)).alias("n"), "texto", "caracteres", "cobertura_imagem", "motivo_ocr", "dpi_efetivo", "metodo", "erro")


def read_by_ocr(pages: DataFrame, engine: Provider, batch: int = 4) -> DataFrame:
    """Pending pages (documento_id, n and what the engine needs) read by OCR: documento_id, n, texto, confianca_media,
    ocr_palavras, tsv_sha256, metodo, erro. A page that fails keeps its error and is tried again by a later run."""
    # written, so that no page is read twice
    made = materialize(run_provider(pages, engine, OCR_PAGE, batch=batch).withColumn("_k", F.concat_ws("|", "documento_id", "n")), "ocr")
    texts = ocr.page_text(ocr.boxes(made.where("erro is null"), "_k", "tsv"), "_k")
    state = F.when(F.col("erro").isNull(), "ocr").otherwise("erro")
    return made.join(texts, "_k", "left").select("documento_id", "n", "texto", F.col("confianca").alias("confianca_media"), F.col("palavras").alias("ocr_palavras"), F.sha2(F.col("tsv").cast("binary"), 256).alias("tsv_sha256"), state.alias("metodo"), "erro")


def status(present: DataFrame, needed: DataFrame) -> DataFrame:
    """What a run needs (nome, resumo or null for any) against what there is: nome, estado (pronto, ausente, outra versão)."""
    joined = needed.select("nome", F.col("resumo").alias("_r")).join(present.select("nome", "resumo", "versao"), "nome", "left")
    state = F.when(F.col("versao").isNull(), "ausente").when(F.col("_r").isNotNull() & ~F.col("_r").eqNullSafe(F.col("resumo")), "outra versão").otherwise("pronto")
    return joined.select("nome", "versao", state.alias("estado"))


def capabilities(spark, *all_: Capability) -> DataFrame:
    """The providers of a run as rows, for the manifest."""
    return spark.createDataFrame([(c.name, c.version, c.digest, c.local) for c in all_], "nome string, versao string, resumo string, local boolean")
