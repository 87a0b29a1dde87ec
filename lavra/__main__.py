"""Command line over a case folder: `python -m lavra COMMAND CASE`. Originals lie in CASE/originais, tables in CASE/dados.

Readers of PDF files, OCR and models are callables, named as `module:function`; each takes a pandas frame (see
`sources.providers`). Without one, what needs it is reported and left for a later run.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import identifiers, people
from lavra.operators import cases, citations, custody, lexicon, passages, reports, search, vectors
from lavra.session import build_session, shared_dir
from lavra.sources import files, providers, sinks

VERSION = "1"


def _provider(name: str | None) -> providers.Provider | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _table(spark: SparkSession, case: cases.Case, name: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(case.table(name) + "/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(case.table(name)) if there else None


def diagnose(spark: SparkSession, args: argparse.Namespace) -> int:
    """What this installation can do."""
    for need in ("pyarrow", "pandas", "numpy", "regex"):
        print(need, getattr(importlib.import_module(need), "__version__", "?"))
    print("spark", spark.version, "pasta partilhada", shared_dir(spark))
    return 0


def measure(spark: SparkSession, args: argparse.Namespace) -> int:
    """Texts a second of a provider, over one batch of sixteen of about 250 words."""
    provider = _provider(args.modelo)
    if provider is None:
        print("nenhum modelo indicado")
        return 1
    rows = spark.createDataFrame([(i, "palavra " * 250) for i in range(16)], "id long, texto string")
    print(f"{speed(rows, provider, args.esquema):.1f} textos por segundo")
    return 0


def speed(rows: DataFrame, provider: providers.Provider, schema: str) -> float:
    """Rows that a provider does in a second."""
    began = time.time()
    n = providers.run_provider(rows, provider, schema).where("erro is null").count()
    return n / max(time.time() - began, 1e-6)


def process(spark: SparkSession, args: argparse.Namespace) -> int:
    """Read what is new or changed, with one row per content; then write the index and the order of reading."""
    case = cases.Case(args.caso)
    found = files.with_digest(files.scan(spark, case.originals)).where("tipo is not null")
    listed = found.groupBy("sha256", "documento_id").agg(F.array_sort(F.collect_list("caminho")).alias("caminhos"), F.min("tipo").alias("tipo"), F.min("nome").alias("nome"), F.min("tamanho").alias("tamanho_bytes"))
    sinks.replace_table(listed, case.table("arquivos"))
    current, done = _table(spark, case, "arquivos"), _table(spark, case, "feitos")
    todo = current.select("sha256") if done is None else custody.pending(current.select("sha256"), done, VERSION)
    news = found.join(todo, "sha256", "left_semi").dropDuplicates(["sha256"])
    html = files.html_pages(news.where("tipo = 'html'"), "documento_id", "content").select("documento_id", "n", "texto", F.lit("html").alias("metodo"), F.lit(None).cast("string").alias("erro"))
    text = files.text_pages(files.decoded(news.where("tipo = 'txt'"), "documento_id", "content"), "documento_id", "texto").select("documento_id", "n", "texto", F.lit("texto").alias("metodo"), F.lit(None).cast("string").alias("erro"))
    reader = _provider(args.leitor_pdf)
    pdf = news.where("tipo = 'pdf'").select("documento_id", "content")
    if reader is None:
        read = pdf.select("documento_id", F.lit(1).alias("n"), F.lit(None).cast("string").alias("texto"), F.lit("erro").alias("metodo"), F.lit("sem leitor de PDF").alias("erro"))
    else:
        read = providers.run_provider(pdf, reader, "documento_id string, n int, texto string, metodo string").select("documento_id", "n", "texto", "metodo", "erro")
    pages = html.unionByName(text).unionByName(read).withColumn("lote", F.lit(int(time.time() * 1000)))
    pages.write.mode("append").partitionBy("lote").parquet(case.table("paginas"))
    kept = latest_pages(spark, case)
    state = custody.page_alerts(kept.withColumns({"pagina_id": F.xxhash64("documento_id", "n"), "confianca_media": F.lit(None).cast("double"), "caracteres": F.length("texto")}))
    finished = current.join(state.select("documento_id", "situacao"), "documento_id").select("sha256", "documento_id", F.lit(VERSION).alias("versao"), F.lit("{}").alias("parametros"), "situacao", "caminhos")
    sinks.replace_table(custody.manifest(finished.join(extracted(kept), "documento_id", "left"), ["extracao"]), case.table("manifesto"))
    sinks.replace_table(finished, case.table("feitos"))
    search.write_index(kept.withColumn("pagina_id", F.xxhash64("documento_id", "n")), "pagina_id", "texto", case.table("indice"))
    whole = kept.groupBy("documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("texto", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("texto"))
    scores = lexicon.triage(whole, "documento_id", "texto").select("documento_id", "pontos", "palavras", "categoria")
    sinks.replace_table(cases.reading_order(scores, lexicon.priorities(whole, "documento_id", "texto", first_names=people.learn_first_names(_names(whole), "nome")), "documento_id"), case.table("triagem"))
    summary = {r["situacao"]: r["documentos"] for r in custody.run_summary(_table(spark, case, "feitos")).collect()}
    print("documentos:", summary)
    return 1 if summary.get("erro") else 0


def _names(texts: DataFrame) -> DataFrame:
    """Runs of capitals in the texts, from which first names are learned."""
    return texts.select(F.explode(F.regexp_extract_all("texto", F.lit(r"(?U)\b(\p{Lu}\p{Ll}+(?: (?:d[aeo]s? )?\p{Lu}\p{Ll}+)+)"), F.lit(1))).alias("nome"))


def latest_pages(spark: SparkSession, case: cases.Case) -> DataFrame:
    """The pages of each document from the last run that read it."""
    rows = spark.read.parquet(case.table("paginas"))
    last = rows.groupBy("documento_id").agg(F.max("lote").alias("lote"))
    return rows.join(last, ["documento_id", "lote"]).select("documento_id", "n", "texto", "metodo", "erro")


def extracted(pages: DataFrame) -> DataFrame:
    """A digest of what was read of each document: of its pages' digests, in order."""
    one = F.struct("n", F.sha2(F.coalesce("texto", F.lit("")).cast("binary"), 256).alias("d"))
    return pages.groupBy("documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]), ",").alias("extracao"))


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Hold originals and extractions against the manifest."""
    case = cases.Case(args.caso)
    expected = _table(spark, case, "manifesto").select(F.explode("caminhos").alias("caminho"), F.col("sha256_original").alias("sha256"), "extracao_sha256")
    live = files.with_digest(files.scan(spark, case.originals)).where("tipo is not null").select("caminho", "sha256", "documento_id")
    now = extracted(latest_pages(spark, case)).select("documento_id", F.sha2(F.to_json(F.struct("extracao"), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("extracao_sha256"))
    problems = custody.verify(expected, live.join(now, "documento_id", "left").select("caminho", "sha256", "extracao_sha256")).orderBy("caminho").collect()
    print("Integridade OK" if not problems else "Problemas:")
    for r in problems:
        print(" -", r["caminho"], "-", r["problema"])
    return 1 if problems else 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    """The report's tables as Markdown."""
    case = cases.Case(args.caso)
    order, pages = _table(spark, case, "triagem"), latest_pages(spark, case)
    found = identifiers.emails(F.coalesce("texto", F.lit("")))
    mails = pages.select("documento_id", F.explode(found).alias("valor")).groupBy("valor").agg(F.countDistinct("documento_id").alias("documentos")).orderBy(F.desc("documentos"), "valor")
    print(sinks.markdown(order.orderBy("posicao").select("posicao", "documento_id", "pontos", "prioridade", F.array_join("motivos", "; ").alias("motivos")), "Por onde começar", reports.PRIORITIES))
    print(sinks.markdown(pages.groupBy("metodo").agg(F.count("*").alias("paginas")).orderBy("metodo"), "Páginas", reports.VALUES_SHOWN))
    print(sinks.markdown(mails, "Endereços", reports.VALUES_SHOWN))
    print(sinks.markdown(custody.manifest_hash(_table(spark, case, "manifesto")), "Custódia", 1))
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    """The texts under their export names."""
    case = cases.Case(args.caso)
    path = F.try_element_at("caminhos", F.lit(1))
    rows = _table(spark, case, "arquivos").withColumn("identidade", identifiers.file_identity(path, F.regexp_extract(path, r"(\.[^./]+)$", 1), F.lit("")))
    targets = cases.export_names(rows)
    pages = latest_pages(spark, case).withColumn("pagina_id", F.xxhash64("documento_id", "n"))
    sinks.write_texts(reports.export_texts(pages, targets).select("alvo", "texto"), case.path("exportado"))
    print(case.path("exportado"))
    return 0


def import_tree(spark: SparkSession, args: argparse.Namespace) -> int:
    """What an import of a folder would do, and, with --copiar, its copies."""
    case = cases.Case(args.caso)
    if not custody.safe_to_import(args.origem, case.originals):
        print("uma pasta contém a outra")
        return 1
    tree = lambda root: files.with_digest(files.scan(spark, root)).select("caminho", "sha256")
    plan = custody.import_plan(tree(args.origem), tree(case.originals))
    for r in plan.groupBy("acao").count().orderBy("acao").collect():
        print(r["acao"], r["count"])
    if args.copiar:
        copy_files(spark, plan.where("destino is not null").select("caminho", "destino"), args.origem, case.originals)
    return 0


def copy_files(spark: SparkSession, plan: DataFrame, source: str, target: str) -> None:
    """Copy files (caminho, destino) between folders of Hadoop file systems; the list streams through the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    for r in plan.toLocalIterator():
        a, b = make(f"{source}/{r['caminho']}"), make(f"{target}/{r['destino']}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def index_vectors(spark: SparkSession, args: argparse.Namespace) -> int:
    """Vectors of the passages that have none of this model yet; those of documents that are gone fall out."""
    case, provider = cases.Case(args.caso), _provider(args.modelo)
    if provider is None:
        print("nenhum modelo indicado")
        return 1
    rows = passages.passages(latest_pages(spark, case).withColumnRenamed("n", "pagina"), ["documento_id", "pagina"], "texto")
    rows = rows.withColumns({"passagem_id": F.sha2(F.concat_ws("|", "documento_id", "pagina", "n", "texto"), 256), "modelo": F.lit(args.modelo)})
    stored = _table(spark, case, "vetores")
    todo = rows if stored is None else vectors.pending(rows, stored, "passagem_id", "modelo")
    made = providers.run_provider(todo.select("passagem_id", "documento_id", "pagina", "modelo", "texto"), provider, "passagem_id string, documento_id string, pagina int, modelo string, vetor array<float>").where("erro is null").drop("erro")
    made.write.mode("append").parquet(case.table("vetores"))
    print(vectors.status(_table(spark, case, "vetores"), "documento_id").first().asDict())
    return 0


def analyse(spark: SparkSession, args: argparse.Namespace) -> int:
    """Ask a model about the chunks of the documents in the order of reading; answers of an earlier run stay."""
    case, provider = cases.Case(args.caso), _provider(args.modelo)
    if provider is None:
        print("nenhum modelo indicado")
        return 1
    order = _table(spark, case, "triagem")
    only = spark.createDataFrame([(d,) for d in args.documentos.split(",")], "documento_id string") if args.documentos else None
    chosen = cases.to_analyse(order.select("documento_id"), order, "documento_id", only, args.primeiros)
    pages = latest_pages(spark, case).join(chosen.select("documento_id"), "documento_id", "left_semi")
    chunks = passages.chunks(pages, "documento_id", "n", "texto", most=args.palavras).withColumn("modelo", F.lit(args.modelo))
    done = _table(spark, case, "respostas")
    key = ["documento_id", "trecho", "hash", "modelo"]
    todo = chunks if done is None else citations.pending_chunks(chunks, done, key)
    answers = providers.run_provider(todo.select(*key, "texto"), provider, "documento_id string, trecho int, hash string, modelo string, resposta string")
    answers.write.mode("append").parquet(case.table("respostas"))
    counts = _table(spark, case, "respostas").agg(F.count_if(F.col("erro").isNull()).alias("ok"), F.count("erro").alias("erros")).first()
    print(counts.asDict())
    return 1 if counts["erros"] else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lavra", description=__doc__)
    commands = parser.add_subparsers(dest="comando", required=True)
    plain = {"processar": process, "verificar": verify, "relatorio": report, "exportar": export, "importar": import_tree, "indexar-vetores": index_vectors, "analisar-ia": analyse}
    made = {name: commands.add_parser(name, help=f.__doc__) for name, f in plain.items()}
    for sub in made.values():
        sub.add_argument("caso")
    made["processar"].add_argument("--leitor-pdf")
    made["importar"].add_argument("origem")
    made["importar"].add_argument("--copiar", action="store_true")
    for name in ("indexar-vetores", "analisar-ia"):
        made[name].add_argument("--modelo")
    made["analisar-ia"].add_argument("--documentos")
    made["analisar-ia"].add_argument("--primeiros", type=int)
    made["analisar-ia"].add_argument("--palavras", type=int, default=passages.CHUNK_WORDS)
    commands.add_parser("diagnostico", help=diagnose.__doc__)
    ia = commands.add_parser("ia", help=measure.__doc__)
    ia.add_argument("--modelo")
    ia.add_argument("--esquema", default="id long, vetor array<float>")
    args = parser.parse_args(argv)
    run = plain | {"diagnostico": diagnose, "ia": measure}
    return run[args.comando](spark or build_session(), args)


if __name__ == "__main__":
    sys.exit(main())
