"""Integrity of the chain from originals to extractions, and what a next run has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_content(files: DataFrame, path: str = "caminho", digest: str = "sha256") -> DataFrame:
    """Files with the same content as one: sha256, documento_id (its first 16 digits), caminho (the first by order),
    copias. Only the least path and a number are kept of each group, however many files share a content."""
    grouped = files.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("sha256")).agg(F.min(path).alias("caminho"), F.count("*").alias("copias"))
    return grouped.select("sha256", F.substring("sha256", 1, 16).alias("documento_id"), "caminho", "copias")


def pending(current: DataFrame, done: DataFrame, version: str, params: str = "{}") -> DataFrame:
    """Contents that need extraction: not done, failed, or done by another version or with other parameters."""
    finished = done.where(F.col("versao").eqNullSafe(F.lit(version)) & F.col("parametros").eqNullSafe(F.lit(params)) & (F.coalesce("situacao", F.lit("")) != "erro"))
    return current.join(finished.select("sha256").distinct(), "sha256", "left_anti")


def orphans(done: DataFrame, current: DataFrame) -> DataFrame:
    """Extractions whose original is no longer there: to be archived."""
    return done.join(current.select("sha256").distinct(), "sha256", "left_anti")


def moved(done: DataFrame, current: DataFrame) -> DataFrame:
    """Contents already extracted whose paths changed: only their metadata is renewed."""
    return done.select("sha256", F.array_sort("caminhos").alias("antes")).join(current.select("sha256", F.array_sort("caminhos").alias("agora")), "sha256").where("antes <> agora")


def manifest(documents: DataFrame, extraction: list[str]) -> DataFrame:
    """One row per document: sha256_original, caminhos, extracao_sha256 (of the named columns), situacao."""
    return documents.select(F.col("sha256").alias("sha256_original"), "caminhos", F.sha2(F.to_json(F.struct(*extraction), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("extracao_sha256"), "situacao")


def manifest_hash(rows: DataFrame) -> DataFrame:
    """One row: documentos, hash of the whole manifest: the SHA-256 of the sums, over all rows, of the eight words of
    each row's SHA-256, and of their number. No task sees all rows, their order doesn't matter, and equal rows count
    each time."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("documentos"), *(F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"_{k}") for k in range(8)))
    return sums.select("documentos", F.sha2(F.concat_ws(",", F.col("documentos").cast("string"), *(f"_{k}" for k in range(8))).cast("binary"), 256).alias("hash"))


def annex(manifested: DataFrame, ignored: DataFrame, tools: DataFrame) -> DataFrame:
    """All that a custody annex lists, as rows of one form (parte, nome, resumo, nota): documents of a manifest, files
    that were passed over (caminho, motivo), and tools (nome, versao, resumo)."""
    a = manifested.select(F.lit("documento").alias("parte"), F.array_join("caminhos", "; ").alias("nome"), F.col("sha256_original").alias("resumo"), F.col("extracao_sha256").alias("nota"))
    b = ignored.select(F.lit("ignorado").alias("parte"), F.col("caminho").alias("nome"), F.lit(None).cast("string").alias("resumo"), F.col("motivo").alias("nota"))
    c = tools.select(F.lit("ferramenta").alias("parte"), "nome", "resumo", F.col("versao").alias("nota"))
    return a.unionByName(b).unionByName(c)


def tombstone(manifested: DataFrame, case: str, who: str, reason: str) -> DataFrame:
    """The row that stays of a deleted case, for the log: caso, documentos, hash of its manifest, quem, motivo."""
    return manifest_hash(manifested).select(F.lit(case).alias("caso"), "documentos", F.col("hash").alias("manifesto"), F.lit(who).alias("quem"), F.lit(reason).alias("motivo"))


def unchanged(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks (caminho, sha256 when planned) with sha256_agora and erro where the file changed or went meanwhile."""
    now = files.select("caminho", F.col("sha256").alias("sha256_agora"))
    error = F.when(F.col("sha256_agora").isNull(), "arquivo ausente").when(F.col("sha256_agora") != F.col("sha256"), "arquivo mudou")
    return tasks.join(now, "caminho", "left").withColumn("erro", error)


def verify(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Problems of a manifest (caminho, sha256, extracao_sha256) against live files: caminho, problema (original
    ausente, original alterado, extração alterada, arquivo novo). No problem, no row."""
    e = expected.select("caminho", F.col("sha256").alias("_e"), F.col("extracao_sha256").alias("_x"), F.lit(1).alias("_m"))
    n = live.select("caminho", F.col("sha256").alias("_n"), F.col("extracao_sha256").alias("_y"), F.lit(1).alias("_v"))
    problem = F.when(F.col("_v").isNull(), "original ausente").when(F.col("_m").isNull(), "arquivo novo").when(~F.col("_e").eqNullSafe(F.col("_n")), "original alterado").when(~F.col("_x").eqNullSafe(F.col("_y")), "extração alterada")
    return e.join(n, "caminho", "full_outer").select("caminho", problem.alias("problema")).where("problema is not null")


def import_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """What an import does with each file of a tree (caminho, sha256): ignorar (office and system leftovers),
    identico, copiar, renomear (same path, other content: a number is added, nothing is overwritten)."""
    name = F.lower(F.element_at(F.split("caminho", "/"), -1))
    leftover = name.startswith("~$") | name.startswith(".") | name.isin("thumbs.db", "desktop.ini")
    joined = source.join(target.select("caminho", F.col("sha256").alias("_t")), "caminho", "left")
    action = F.when(leftover, "ignorar").when(F.col("_t").isNull(), "copiar").when(F.col("_t") == F.col("sha256"), "identico").otherwise("renomear")
    renamed = F.concat(F.regexp_replace("caminho", r"\.[^./]*$", ""), F.lit(" (2)"), F.regexp_extract("caminho", r"(\.[^./]*)$", 1))
    return joined.select("caminho", "sha256", action.alias("acao"), F.when(action == "renomear", renamed).when(action == "copiar", F.col("caminho")).alias("destino"))


def safe_to_import(source: str, target: str) -> bool:
    """Whether neither folder holds the other."""
    a, b = source.rstrip("/") + "/", target.rstrip("/") + "/"
    return not a.startswith(b) and not b.startswith(a)


def page_alerts(pages: DataFrame) -> DataFrame:
    """Alerts of each document by its pages: documento_id, paginas, paginas_ocr, confianca_minima, vazias, alertas,
    situacao (ok, parcial where a page failed, erro where all did). A page delivered twice counts once."""
    rows = pages.where("documento_id is not null").dropDuplicates(["pagina_id"])
    ocr = F.col("metodo") == "ocr"
    grouped = rows.groupBy("documento_id").agg(
        F.count("*").alias("paginas"), F.count_if(ocr).alias("paginas_ocr"), F.min(F.when(ocr, F.col("confianca_media"))).alias("confianca_minima"),
        F.count_if(ocr & (F.col("confianca_media") < 70)).alias("_baixa"), F.count_if(ocr & (F.coalesce("caracteres", F.lit(0)) < 20)).alias("_vazia"), F.count_if(F.col("metodo") == "erro").alias("_erro"),
    )
    says = lambda c, t: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t)))
    alerts = F.array_compact(F.array(says("_baixa", " páginas com confiança baixa"), says("_vazia", " páginas de OCR quase vazias"), says("_erro", " páginas com erro")))
    state = F.when(F.col("_erro") == F.col("paginas"), "erro").when(F.col("_erro") > 0, "parcial").otherwise("ok")
    return grouped.select("documento_id", "paginas", "paginas_ocr", "confianca_minima", F.col("_vazia").alias("vazias"), alerts.alias("alertas"), state.alias("situacao"))


def run_summary(documents: DataFrame) -> DataFrame:
    """Documents by their state, for the log of a run."""
    return documents.groupBy(F.coalesce("situacao", F.lit("desconhecida")).alias("situacao")).agg(F.count("*").alias("documentos"))
