"""All queries of the core, each over the whole tables of a folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import dates, identifiers, people, text
from lavra.operators import cases, citations, custody, findings, headers, lexicon, network, passages, reports, search, timestamps, vectors
from lavra.session import materialize, remove_at_exit, shared_dir, table
from lavra.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: What the search queries ask for.
WORDS, BOOLEAN, QUESTION = "fianca OU vistoria OU cronograma", '"carta de fianca" atestad* OU "tabela de descontos"', "Quem recebeu a carta de fiança do fornecedor?"
PAGE_WORDS = "almoxarifado OU vistoria"
#: The vector that the vector queries ask for, of the dimension of the table embeddings.
ASKED = [1.0 if i % 3 else -0.5 for i in range(64)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    path = os.path.join(shared_dir(spark), "lavra", f"datas-{uuid.uuid4().hex}")
    remove_at_exit(spark, path)
    return timestamps.message_and_entity_dates(table(spark, sf, "mensagens"), table(spark, sf, "entidades"), table(spark, sf, "arquivos"), path)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "paginas").where("pagina_id is not null").dropDuplicates(["pagina_id"])


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """One row per file, of its last delivery."""
    return findings.latest(table(spark, sf, "arquivos").where("documento_id is not null"), ["documento_id"], ["extraido_em"])


# --- triage


@query
def triage_lexicon_rank(spark: SparkSession, sf: str) -> DataFrame:
    scored = lexicon.scored(table(spark, sf, "documents"), "doc_id", "text")
    return lexicon.rank(scored.select("doc_id", F.col("termos").alias("pontos")), F.desc("pontos"), F.asc("doc_id"))


@query
def triage_full(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.triage(table(spark, sf, "documents"), "doc_id", "text")


@query
def triage_density(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    points = F.aggregate(lexicon.category_points(F.col("dobrado")), F.lit(0).cast("long"), lambda acc, x: acc + x["pontos"])
    counted = docs.select("doc_id", words.alias("palavras"), text.fold(F.col("text")).alias("dobrado")).select("doc_id", "palavras", points.alias("p"))
    return counted.select("doc_id", "palavras", F.round(F.col("p") * 1000.0 / F.greatest("palavras", F.lit(1)), 1).alias("densidade"))


@query
def triage_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.category_totals(table(spark, sf, "documents"), "doc_id", "text")


@query
def triage_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.snippets(table(spark, sf, "documents"), "doc_id", "text")


@query
def triage_spaced_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    found = lexicon.snippets(table(spark, sf, "documents"), "doc_id", "text", most=20).withColumn("pagina", F.lit(1))
    return reports.spaced_excerpts(found, "doc_id", "pagina")


@query
def reading_priorities(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "achados").where("tipo = 'pessoas'")
    return lexicon.priorities(table(spark, sf, "documents"), "doc_id", "text", first_names=people.learn_first_names(names, "nome"))


@query
def communication_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Chats count on all pages, signs of contracts on the first ten, closing formulas on six, message headers on three,
    titles and wording on two, which is what these kinds mean."""
    rows = _pages(spark, sf).where("documento_id is not null and n is not null")
    ordered = F.array_sort(F.collect_list(F.struct("n", F.coalesce("texto", F.lit("")).alias("t"))))
    until = lambda k: F.array_join(F.transform(F.filter("_p", lambda x: x["n"] <= k), lambda x: x["t"]), "\n")
    first = rows.where(F.col("n") <= lexicon.SIGNS_PAGES).groupBy("documento_id").agg(ordered.alias("_p"))
    spans = {"inicio": lexicon.TITLE_PAGES, "cabeca": lexicon.HEADER_PAGES, "carta": lexicon.CLOSING_PAGES, "texto": lexicon.SIGNS_PAGES}
    pages = first.select("documento_id", *(until(k).alias(c) for c, k in spans.items()))
    blocks = headers.headers(pages, "documento_id", "cabeca").groupBy("documento_id").agg(F.count("*").alias("cabecalhos"))
    chats = headers.chat_pairs(headers.chat_lines(rows, "documento_id", "n", "texto"), "documento_id", "n").groupBy("documento_id").agg(F.count("*").alias("trocas"))
    joined = rows.select("documento_id").distinct().join(pages, "documento_id", "left").join(blocks, "documento_id", "left").join(chats, "documento_id", "left").na.fill(0, ["cabecalhos", "trocas"]).na.fill("", list(spans))
    kind = lexicon.communication_kind(F.col("carta"), F.col("cabecalhos"), F.col("trocas"), beginning=F.col("inicio"))
    return joined.select("documento_id", kind.alias("tipo"), lexicon.is_contract(F.col("inicio"), F.col("texto")).alias("contrato"))


@query
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to be read first, then by points, then by id."""
    scores = lexicon.triage(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "pontos")
    names = people.learn_first_names(table(spark, sf, "achados").where("tipo = 'pessoas'"), "nome")
    first = lexicon.priorities(table(spark, sf, "documents"), "doc_id", "text", first_names=names)
    return cases.reading_order(scores, first, "doc_id").select("doc_id", "prioridade", F.array_join("motivos", "; ").alias("motivos"), "pontos", "posicao")


@query
def lexicon_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.lexicon_hash(lexicon.terms(spark))


# --- text


@query
def text_fold(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    folded = text.fold(F.col("text"))
    return docs.select("doc_id", F.length(folded).cast("long").alias("tamanho"), F.md5(folded.cast("binary")).alias("resumo"))


@query
def text_clean_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("pagina_id", F.md5(text.clean_breaks(F.col("texto")).cast("binary")).alias("resumo"))


@query
def text_unhyphenate(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("pagina_id", F.md5(text.unhyphenate(F.col("texto")).cast("binary")).alias("resumo"))


@query
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("termo"))
    return words.groupBy("termo").agg(F.count("*").alias("n"))


@query
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "achados").where("nome is not null").select("nome").distinct()
    return names.select("nome", text.name_key(F.col("nome")).alias("chave"))


@query
def locators(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).where("documento_id is not null").groupBy("documento_id").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    rows = _files(spark, sf).join(pages, "documento_id")
    none = F.lit(None).cast("string")
    where = text.locator(none, F.col("nome"), none.cast("int"), none, F.col("ns"))
    return rows.select("documento_id", where.alias("localizador"), text.locator_document(where).alias("documento"), text.safe_name(F.col("nome")).alias("nome_seguro"))


@query
def links_and_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = _files(spark, sf).select("documento_id", F.try_element_at("caminhos", F.lit(1)).alias("caminho"))
    return rows.select("documento_id", text.safe_path(F.col("caminho")).alias("seguro"), text.link(F.col("caminho")).alias("ligacao"))


@query
def question_keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "mensagens").where("assunto is not null").select("assunto").distinct()
    return rows.select("assunto", text.question_terms(F.col("assunto")).alias("consulta"))


# --- identifiers and entities


@query
def entity_emails(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(identifiers.emails(F.col("text"))).alias("email"))
    return found.groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query
def entity_amounts(spark: SparkSession, sf: str) -> DataFrame:
    found = _pages(spark, sf).select("pagina_id", F.explode(identifiers.amounts(F.col("texto"))).alias("v"))
    return found.groupBy("pagina_id").agg(F.count("*").alias("n"), F.sum("v.valor").cast("double").alias("total"))


@query
def entity_ids_validated(spark: SparkSession, sf: str) -> DataFrame:
    values = reports.entity_values(table(spark, sf, "entidades"))
    kinds = values.where("tipo in ('cpfs', 'cnpjs')").select("tipo", "valor").distinct()
    return kinds.select("tipo", "valor", F.when(F.col("tipo") == "cpfs", identifiers.cpf_ok(F.col("valor"))).otherwise(identifiers.cnpj_ok(F.col("valor"))).alias("valido"))


@query
def entity_ids_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers found again in sentences that are made of the extracted ones, each once with and once without its signs."""
    rows = table(spark, sf, "entidades").where("entidade_id is not null").dropDuplicates(["entidade_id"])
    said = lambda c, form: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<valor:string,paginas:array<int>>>")), lambda x: F.concat(F.lit("nº "), form(x["valor"]), F.lit(", "))), "")
    bare = lambda v: F.regexp_replace(v, r"\D", "")
    made = F.concat(F.lit("Sócio "), said("cpfs", lambda v: v), said("cpfs", bare), F.lit("firma "), said("cnpjs", lambda v: v), said("cnpjs", bare), F.lit("chave 11222333000181123."))
    found = rows.select("entidade_id", identifiers.cpfs(made).alias("a"), identifiers.cnpjs(made).alias("b")).where("size(a) > 0 or size(b) > 0")
    return found.select("entidade_id", F.array_join(F.array_sort("a"), ",").alias("cpfs"), F.array_join(F.array_sort("b"), ",").alias("cnpjs"))


@query
def entity_values(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entity_values(table(spark, sf, "entidades")).select("documento_id", "tipo", "valor", F.array_join("paginas", ",").alias("paginas"))


@query
def entity_directory(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entity_directory(reports.entity_values(table(spark, sf, "entidades")))


@query
def dates_positional(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(dates.dates(F.col("text"))).alias("d")).select("doc_id", "d.*")


@query
def dates_near_terms(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dates_near_terms(table(spark, sf, "documents"), ["doc_id"], "text")


@query
def firms_and_people(spark: SparkSession, sf: str) -> DataFrame:
    names = people.learn_first_names(table(spark, sf, "achados").where("tipo = 'pessoas'"), "nome")
    return table(spark, sf, "documents").select("doc_id", people.firms(F.col("text")).alias("empresas"), people.people(F.col("text"), names).alias("pessoas"))


@query
def file_identities(spark: SparkSession, sf: str) -> DataFrame:
    """The number of each file by its first path and its first two pages."""
    ordered = F.array_sort(F.collect_list(F.struct("n", F.coalesce("texto", F.lit("")).alias("t"))))
    first = _pages(spark, sf).where("n <= 2 and documento_id is not null").groupBy("documento_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("inicio"))
    path = F.try_element_at("caminhos", F.lit(1))
    rows = _files(spark, sf).join(first, "documento_id", "left").select("documento_id", path.alias("caminho"), F.coalesce("inicio", F.lit("")).alias("inicio"))
    found = identifiers.file_identity(F.col("caminho"), F.regexp_extract("caminho", r"(\.[^./]+)$", 1), F.col("inicio"))
    return rows.select("documento_id", "caminho", found.alias("i")).where("i is not null").select("documento_id", "caminho", "i.*")


@query
def pair_messages(spark: SparkSession, sf: str) -> DataFrame:
    messages, known = _network(spark, sf)
    return network.pair_messages(network.edges(known), messages)


@query
def cast_sources(spark: SparkSession, sf: str) -> DataFrame:
    return findings.sources_of(findings.first_seen(table(spark, sf, "achados")), "pessoas")


@query
def mail_domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "comunicacoes").where("endereco is not null").dropDuplicates(["pessoa_id"])
    return rows.groupBy(identifiers.domain(F.col("endereco")).alias("organizacao")).agg(F.count("*").alias("pessoas"))


# --- pages


@query
def ocr_policy(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("pagina_id", identifiers.ocr_reason(F.col("caracteres"), F.col("cobertura_imagem"), F.lit(False)).alias("motivo"))


@query
def page_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return custody.page_alerts(table(spark, sf, "paginas")).select("documento_id", "paginas", "paginas_ocr", "confianca_minima", "vazias", F.array_join("alertas", "; ").alias("alertas"), "situacao")


@query
def export_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.export_coverage(table(spark, sf, "paginas"))


@query
def export_doubtful(spark: SparkSession, sf: str) -> DataFrame:
    return reports.doubtful_pages(table(spark, sf, "paginas"))


@query
def export_texts(spark: SparkSession, sf: str) -> DataFrame:
    targets = _files(spark, sf).select("documento_id", F.regexp_replace("nome", r"\.[^.]*$", "").alias("alvo"))
    return reports.export_texts(table(spark, sf, "paginas"), targets).select("alvo", "documentos", F.md5(F.col("texto").cast("binary")).alias("resumo"))


@query
def text_file_pages(spark: SparkSession, sf: str) -> DataFrame:
    return files.text_pages(table(spark, sf, "documents"), "doc_id", "text", lines=10).select("doc_id", "n", "primeira", "ultima")


@query
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).where("metodo = 'html' and texto is not null")
    body = F.concat(F.lit("<html><head><title>Página</title><script>x()</script></head><body><p>"), F.replace(F.replace("texto", F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>")), F.lit("</p></body></html>"))
    return files.html_pages(pages.select("pagina_id", body.alias("html")), "pagina_id", "html")


@query
def passages_windows(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passages(table(spark, sf, "documents"), ["doc_id"], "text", words=50, step=42).select("doc_id", "n", "palavras")


@query
def passages_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passage_offsets(_pages(spark, sf).where("texto is not null"), ["pagina_id"], "texto", words=50, step=42)


@query
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return passages.chunks(_pages(spark, sf).where("documento_id is not null and n is not null"), "documento_id", "n", "texto", most=200)


# --- search


#: Indexes written in this session, by application and files.
_INDEXES: dict[tuple, search.Index] = {}


def _index(spark: SparkSession, sf: str, name: str, key: str, text: str, rows: DataFrame | None = None) -> search.Index:
    """The written index of a table, which a session writes once; its files are taken as unchanging meanwhile."""
    files_ = tuple(sorted(table(spark, sf, name).inputFiles()))
    at = (spark.sparkContext.applicationId, files_, key)
    if at not in _INDEXES:
        path = os.path.join(shared_dir(spark), "lavra", f"indice-{name}-{uuid.uuid4().hex}")
        remove_at_exit(spark, path)
        _INDEXES[at] = search.ensure_index(table(spark, sf, name) if rows is None else rows, key, text, path)
    return _INDEXES[at]


@query
def bm25_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_index(_index(spark, sf, "documents", "doc_id", "text"), WORDS, ranked=False).select("doc_id", F.round("pontos", 6).alias("pontos"))


@query
def boolean_phrase_prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_index(_index(spark, sf, "documents", "doc_id", "text"), BOOLEAN, limit=None, ranked=False).select("doc_id")


@query
def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = search.search_index(_index(spark, sf, "documents", "doc_id", "text"), WORDS)
    return search.snippet_of(docs.join(found, "doc_id"), "text", WORDS).select("doc_id", "posicao", "trecho", text.highlight(F.col("trecho")).alias("html"))


@query
def search_index_check(spark: SparkSession, sf: str) -> DataFrame:
    return search.check_index(_index(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "documents"), "text")


@query
def search_pages_located(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf)
    found = search.search_index(_index(spark, sf, "paginas", "pagina_id", "texto", pages), PAGE_WORDS)
    return search.located(found, pages, _files(spark, sf), PAGE_WORDS).select("pagina_id", "documento_id", "n", "localizador", F.round("pontos", 6).alias("pontos"), "trecho")


@query
def search_pages_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The hits on pages with their documents; pages of unknown documents fall out."""
    found = search.search_index(_index(spark, sf, "paginas", "pagina_id", "texto", _pages(spark, sf)), PAGE_WORDS)
    rows = _pages(spark, sf).select("pagina_id", "documento_id", "n").join(found, "pagina_id").join(_files(spark, sf).select("documento_id", "nome"), "documento_id")
    return rows.select("pagina_id", "documento_id", "nome", "n", F.round("pontos", 6).alias("pontos"))


@query
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.contains_search(table(spark, sf, "documents"), "doc_id", "text", "carta de fiança")


@query
def search_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return search.corpus_statistics(table(spark, sf, "documents"), "text").select("textos", F.round("media", 6).alias("media"))


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", ASKED).select("vec_id", F.round("similaridade", 6).alias("similaridade"))


@query
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Search by words over pages and by vectors over passages, fused by document and page; only known documents count."""
    pages = _pages(spark, sf).select("pagina_id", "documento_id", F.col("n").alias("pagina"))
    words = search.search_index(_index(spark, sf, "paginas", "pagina_id", "texto", _pages(spark, sf)), PAGE_WORDS, limit=vectors.LISTED).join(pages, "pagina_id").select("documento_id", "pagina", "posicao")
    stored = table(spark, sf, "passagens").where("passagem_id is not null and documento_id is not null and pagina is not null").dropDuplicates(["passagem_id"])
    near = vectors.top_k(stored, "passagem_id", "vetor", ASKED).join(stored.select("passagem_id", "documento_id", "pagina"), "passagem_id").select("documento_id", "pagina", "posicao")
    fused = vectors.fuse(words, near, ["documento_id", "pagina"], documents=_files(spark, sf).select("documento_id", "nome"))
    return fused.select("documento_id", "pagina", "nome", F.round("pontos", 9).alias("pontos"), F.array_join("origens", "+").alias("origens"))


@query
def question_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.window_around(F.col("text"), F.lit(QUESTION), 40).alias("janela"))


@query
def vector_status(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.status(table(spark, sf, "passagens").where("vetor is not null").dropDuplicates(["passagem_id"]), "documento_id")


@query
def vector_stale(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "passagens").dropDuplicates(["passagem_id"])
    return vectors.stale(stored, table(spark, sf, "entidades"), "documento_id").select("passagem_id")


@query
def vector_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "passagens").dropDuplicates(["passagem_id"]).select("passagem_id", "modelo", "vetor")
    return vectors.pending(rows.withColumn("modelo", F.lit("vetor-b")).select("passagem_id", "modelo"), rows.where("vetor is not null"), "passagem_id", "modelo").select("passagem_id")


# --- network


def _network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The messages, each once, and who is in them; both are read several times in one plan, so they are written."""
    messages = materialize(network.once(table(spark, sf, "mensagens")), "mensagens")
    return messages, materialize(network.identities(network.mentions(messages, delivered_once=True)), "identidades")


@query
def network_people(spark: SparkSession, sf: str) -> DataFrame:
    _, known = _network(spark, sf)
    return network.people(known).select("pessoa", "rotulo", "organizacao", "enviadas", "recebidas", F.size("nomes").alias("nomes"))


@query
def network_pairs(spark: SparkSession, sf: str) -> DataFrame:
    messages, known = _network(spark, sf)
    return network.pairs(network.edges(known), messages, network.people(known)).select("a", "b", "total", "copias", "primeira", "ultima", "documentos", "cruzada")


@query
def network_organisations(spark: SparkSession, sf: str) -> DataFrame:
    messages, known = _network(spark, sf)
    return network.organisations(network.pairs(network.edges(known), messages, network.people(known)))


@query
def network_dot(spark: SparkSession, sf: str) -> DataFrame:
    messages, known = _network(spark, sf)
    persons = network.people(known)
    return network.dot_graph(network.pairs(network.edges(known), messages, persons), persons)


@query
def mail_headers(spark: SparkSession, sf: str) -> DataFrame:
    return headers.headers(_pages(spark, sf), "pagina_id", "texto").drop("data_iso")


@query
def mail_messages(spark: SparkSession, sf: str) -> DataFrame:
    return headers.mail_messages(headers.headers(_pages(spark, sf), "pagina_id", "texto"), "pagina_id")


@query
def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return headers.chat_lines(_pages(spark, sf), "documento_id", "n", "texto").select("documento_id", "n", "linha", "autor", "data")


@query
def chat_adjacency_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return headers.chat_pairs(headers.chat_lines(_pages(spark, sf), "documento_id", "n", "texto"), "documento_id", "n")


def _page_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of e-mail headers and chats on the pages."""
    pages = _pages(spark, sf).where("documento_id is not null and n is not null")
    blocks = headers.headers(pages, "pagina_id", "texto")
    mails = headers.mail_messages(blocks, "pagina_id").join(pages.select("pagina_id", "documento_id", F.col("n").alias("pagina")), "pagina_id")
    chats = headers.chat_pairs(headers.chat_lines(pages, "documento_id", "n", "texto"), "documento_id", "n").withColumnRenamed("n", "pagina")
    return cases.all_messages(mails, chats)


@query
def messages_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _page_messages(spark, sf).groupBy("meio").agg(F.count("*").alias("mensagens"), F.countDistinct("documento_id").alias("documentos"), F.min("data").alias("primeira"), F.max("data").alias("ultima"))


@query
def network_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    messages = materialize(network.once(_page_messages(spark, sf)), "mensagens")
    known = materialize(network.identities(network.mentions(messages, delivered_once=True)), "identidades")
    return network.pairs(network.edges(known), messages, network.people(known)).select("a", "b", "total", "copias", "primeira", "ultima", "documentos", "cruzada")


@query
def people_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """People by number, by message header and by name in the text."""
    rows = _pages(spark, sf)
    names = people.learn_first_names(table(spark, sf, "achados").where("tipo = 'pessoas'"), "nome")
    fields = headers.headers(rows, "pagina_id", "texto").groupBy("pagina_id").agg(F.array_join(F.collect_list(F.concat_ws(";", "de", "para", "cc")), ";").alias("campos"))
    joined = rows.join(fields, "pagina_id", "left")
    return joined.select("pagina_id", F.array_join(people.people_keys(F.coalesce("texto", F.lit("")), names, F.col("campos")), "; ").alias("pessoas"))


@query
def report_mails_by_date(spark: SparkSession, sf: str) -> DataFrame:
    path = os.path.join(shared_dir(spark), "lavra", f"datas-{uuid.uuid4().hex}")
    remove_at_exit(spark, path)
    when = timestamps.message_and_entity_dates(table(spark, sf, "mensagens"), table(spark, sf, "entidades").limit(0), table(spark, sf, "arquivos"), path)
    messages = network.once(table(spark, sf, "mensagens")).drop("data").join(when.select(F.col("registro_id").alias("mensagem_id"), F.col("normal").alias("data")), "mensagem_id", "left")
    return reports.mails_by_date(messages).select("mensagem_id", "data", "assunto")


@query
def report_pairs(spark: SparkSession, sf: str) -> DataFrame:
    messages, known = _network(spark, sf)
    return reports.strongest_pairs(network.pairs(network.edges(known), messages, network.people(known)), crossing=True).select("a", "b", "total")


@query
def report_entities(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entities_shown(reports.entity_values(table(spark, sf, "entidades"))).select("tipo", "valor", "documentos", "lugares", "outros")


@query
def review_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of pending findings on people, as a reviewer sees them."""
    rows = cases.filtered(findings.first_seen(table(spark, sf, "achados")), ["pendente"], ["pessoas"])
    return cases.page_of(rows, [F.col("criado_em"), F.col("achado_id")], 2, cases.REVIEW_ROWS).select("achado_id", "nome", "documento_id")


@query
def display_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = cases.display_rows(findings.first_seen(table(spark, sf, "achados")), network.once(table(spark, sf, "mensagens")))
    return rows.groupBy("origem", "situacao").agg(F.count("*").alias("n"), F.count("data").alias("com_data"))


@query
def export_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.try_element_at("caminhos", F.lit(1))
    rows = _files(spark, sf).where("size(caminhos) > 0").withColumn("identidade", identifiers.file_identity(path, F.regexp_extract(path, r"(\.[^./]+)$", 1), F.lit("")))
    return cases.export_names(rows)


# --- findings


@query
def quote_verification(spark: SparkSession, sf: str) -> DataFrame:
    quotes = findings.first_seen(table(spark, sf, "achados")).where("trecho_fonte is not null").select("achado_id", "documento_id", "trecho_fonte")
    found = citations.locate(quotes, _pages(spark, sf).where("documento_id is not null"))
    return found.select("achado_id", F.col("lugar.pagina").alias("pagina"), F.col("lugar.similaridade").alias("similaridade"), F.col("lugar.literal").alias("literal"))


@query
def quote_literal(spark: SparkSession, sf: str) -> DataFrame:
    """The findings whose quote stands word for word on a page of their document, and the first such page."""
    quotes = findings.first_seen(table(spark, sf, "achados")).where("trecho_fonte is not null").select("achado_id", "documento_id", "trecho_fonte")
    found = citations.locate(quotes, _pages(spark, sf).where("documento_id is not null"))
    return found.where("lugar.literal").select("achado_id", F.col("lugar.pagina").alias("pagina"))


@query
def event_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a date, participants and a category that a model may have made up, held against their page."""
    rows = findings.first_seen(table(spark, sf, "achados")).where("tipo = 'eventos'").select("achado_id", "documento_id", "pagina", "tipo", "nome", "cargo", "empresa", "trecho_fonte", F.date_format("criado_em", "yyyy-MM-dd").alias("data"))
    pages = _pages(spark, sf).where("documento_id is not null and n is not null and texto <> ''").groupBy("documento_id", F.col("n").alias("pagina")).agg(F.min_by("texto", "pagina_id").alias("trecho"))
    held = rows.join(pages, ["documento_id", "pagina"], "left").withColumns({"participantes": F.array(F.lit("fornecedor"), F.lit("ninguém de nome Zoroastro")), "categoria": F.lit("festa")})
    return citations.verify_proposals(held).select("achado_id", "aceito", "motivo", "data", "categoria", F.array_join("participantes", "; ").alias("participantes"), F.array_join("alertas", "; ").alias("alertas"))


@query
def proposal_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Each finding held against the text of the page that it names, or of all its document where it names none."""
    rows = findings.first_seen(table(spark, sf, "achados")).where("tipo = 'pessoas'").select("achado_id", "documento_id", "pagina", "nome", "cargo", "empresa", "trecho_fonte")
    pages = _pages(spark, sf).where("documento_id is not null and n is not null and texto <> ''").select("documento_id", F.col("n").alias("pagina"), "pagina_id", "texto")
    single = pages.groupBy("documento_id", "pagina").agg(F.min_by("texto", "pagina_id").alias("trecho"))
    loose = rows.where("pagina is null and documento_id is not null").select("documento_id").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("pagina", "trecho")))
    whole = single.join(loose, "documento_id").groupBy("documento_id").agg(F.array_join(F.transform(ordered, lambda x: x["trecho"]), "\n").alias("trecho"))
    chunks = single.unionByName(whole.withColumn("pagina", F.lit(None).cast("int")).select("documento_id", "pagina", "trecho"))
    held = rows.alias("r").join(chunks.alias("c"), (F.col("r.documento_id") == F.col("c.documento_id")) & F.col("r.pagina").eqNullSafe(F.col("c.pagina")), "left")
    rows = held.select("achado_id", "nome", "cargo", "empresa", "trecho_fonte", "trecho")
    return citations.verify_proposals(rows).select("achado_id", "id", "aceito", "motivo", F.array_join("alertas", "; ").alias("alertas"))


@query
def findings_first(spark: SparkSession, sf: str) -> DataFrame:
    return findings.first_seen(table(spark, sf, "achados")).select("achado_id", "caso_id", "nome", "criado_em")


@query
def findings_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "achados")
    reviews = rows.select("achado_id", F.col("situacao").alias("estado"), F.lit(None).cast("string").alias("nota"), F.col("criado_em").alias("em"))
    return findings.with_review(findings.first_seen(rows), reviews).groupBy("tipo", "revisao").agg(F.count("*").alias("n"))


@query
def corrections_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings.first_seen(table(spark, sf, "achados")).select("achado_id", "nome", "cargo", "empresa")
    log = table(spark, sf, "achados").select(F.col("achado_id").alias("alvo"), F.lit("cargo").alias("campo"), F.when(F.col("literal"), F.upper("cargo")).otherwise("").alias("valor"), F.col("criado_em").alias("ordem"))
    return findings.overlay(rows, log, "achado_id", ["nome", "cargo", "empresa"]).select("achado_id", "nome", "cargo", "empresa")


@query
def corrections_checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings.first_seen(table(spark, sf, "achados")).select("achado_id", "documento_id", F.col("pagina"), F.lit("nome").alias("campo"), F.col("nome").alias("valor"))
    return citations.check_correction(rows, _pages(spark, sf)).select("achado_id", "conferencia")


@query
def dramatis_personae(spark: SparkSession, sf: str) -> DataFrame:
    return findings.cast_of_characters(findings.first_seen(table(spark, sf, "achados")), "pessoas").select("chave", "nome", F.size("grafias").alias("grafias"), "achados", "documentos")


@query
def firms_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """Firms of findings with the number that their document holds, where it holds a single one."""
    numbers = reports.entity_values(table(spark, sf, "entidades")).where("tipo = 'cnpjs'").groupBy("documento_id").agg(F.min("valor").alias("cnpj"), F.max("valor").alias("_b")).where("cnpj = _b").drop("_b")
    rows = findings.first_seen(table(spark, sf, "achados")).where("tipo = 'empresas' and trim(nome) <> ''").select("nome", "documento_id").join(numbers, "documento_id", "left").select("nome", "cnpj")
    return findings.firms_by_number(rows.distinct()).select("chave", "cnpj", F.size("nomes").alias("grafias"))


@query
def findings_timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings.first_seen(table(spark, sf, "achados")).where("tipo = 'eventos'").select("achado_id", F.date_format("criado_em", "yyyy-MM-dd").alias("data"), "localizador")
    return findings.timeline(rows, "data", "localizador")


@query
def person_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet for every person of the findings: addresses and counterparts of the network, and the events of the
    documents that name the person."""
    messages, known = _network(spark, sf)
    persons = network.people(known)
    linked = network.pairs(network.edges(known), messages, persons)
    first = findings.first_seen(table(spark, sf, "achados"))
    named = first.where("tipo = 'pessoas' and trim(nome) <> ''")
    events = first.where("tipo = 'eventos'").select("documento_id", "localizador", F.date_format("criado_em", "yyyy-MM-dd").alias("data")).join(named.select("documento_id", "nome").distinct(), "documento_id")
    asked = named.select(text.name_key(F.col("nome")).alias("ficha"), "nome").distinct()
    return findings.person_sheet(asked, persons, linked, events.select(F.array("nome").alias("participantes"), "localizador", "data"))


@query
def status_rollups(spark: SparkSession, sf: str) -> DataFrame:
    return findings.tallies(table(spark, sf, "achados").select("tipo", F.coalesce("situacao", F.lit("pendente")).alias("situacao")), "tipo", "situacao")


@query
def latest_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return findings.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


# --- custody and report


@query
def dedup_by_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("caminho"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return custody.by_content(docs).select("sha256", "documento_id", "caminho", "copias")


@query
def incremental_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "arquivos").where("sha256 is not null")
    done = rows.select("sha256", F.col("versao_extrator").alias("versao"), F.lit("{}").alias("parametros"), "situacao")
    return custody.pending(rows.select("sha256").distinct(), done, "1.2")


@query
def orphan_archive(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "arquivos").select("documento_id").distinct().select(F.col("documento_id").alias("sha256"))
    return custody.orphans(done, table(spark, sf, "entidades").select(F.col("documento_id").alias("sha256"))).withColumnRenamed("sha256", "documento_id")


@query
def manifest_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of all but text files against a later state: files in error are gone, and pages were extracted anew by
    a reader that tidies line breaks."""
    rows = _files(spark, sf).select("documento_id", "sha256", "tipo", "situacao")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "pagina_id", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "\f")
    digest = lambda c: F.sha2(ordered(c).cast("binary"), 256)
    read = _pages(spark, sf).where("documento_id is not null").groupBy("documento_id").agg(digest(F.col("texto")).alias("a"), digest(text.clean_breaks(F.col("texto"))).alias("b"))
    both = materialize(rows.join(read, "documento_id", "left"), "manifesto")
    before = both.where("tipo is null or tipo <> 'txt'").select(F.col("documento_id").alias("caminho"), "sha256", F.col("a").alias("extracao_sha256"))
    after = both.where("situacao is null or situacao <> 'erro'").select(F.col("documento_id").alias("caminho"), "sha256", F.col("b").alias("extracao_sha256"))
    return custody.verify(before, after)


@query
def custody_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return custody.manifest_hash(custody.manifest(_files(spark, sf), ["nome", "tipo", "tamanho_bytes", "alertas"]))


@query
def files_moved(spark: SparkSession, sf: str) -> DataFrame:
    """What a move of all PDF files to another folder renews."""
    rows = table(spark, sf, "arquivos").where("sha256 is not null").groupBy("sha256").agg(F.min("tipo").alias("tipo"), F.min("caminhos").alias("caminhos"))
    moved = F.transform("caminhos", lambda c: F.regexp_replace(c, "^originais/", "arquivo/"))
    return custody.moved(rows, rows.select("sha256", F.when(F.col("tipo") == "pdf", moved).otherwise(F.col("caminhos")).alias("caminhos"))).select("sha256")


@query
def import_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _files(spark, sf).where("sha256 is not null")
    source = rows.select(F.col("nome").alias("caminho"), "sha256").groupBy("caminho").agg(F.min("sha256").alias("sha256"))
    target = rows.where("tipo = 'pdf'").select(F.col("nome").alias("caminho"), "sha256").groupBy("caminho").agg(F.max("sha256").alias("sha256"))
    return custody.import_plan(source, target)


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return custody.run_summary(_files(spark, sf))


@query
def report_overview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.overview(table(spark, sf, "arquivos"), table(spark, sf, "paginas"), table(spark, sf, "mensagens"))


@query
def report_priorities(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_to_read(table(spark, sf, "documents"), "doc_id", "text")


@query
def report_quality(spark: SparkSession, sf: str) -> DataFrame:
    return reports.quality(_files(spark, sf), custody.page_alerts(table(spark, sf, "paginas")))


@query
def model_duration(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return reports.duration_estimate(table(spark, sf, "documents").select(words.alias("palavras")), 50.0, 5.0)
