"""A case as a whole: its folders, the order in which it is read, its messages of every kind, and rows for display."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.people import participants
from lavra.functions.text import stable_id
from lavra.operators.findings import latest
from lavra.operators.lexicon import rank

#: Rows of a page of a list, and of findings under review.
PAGE_ROWS, REVIEW_ROWS = 25, 15
_PERSON = "struct<nome:string,endereco:string>"


@dataclass(frozen=True)
class Case:
    """The folders of a case; any file system that Spark reads will do."""

    root: str
    user: str = ""

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def originals(self) -> str:
        return self.path("originais")

    def table(self, name: str) -> str:
        return self.path("dados", name)

    def log(self, name: str) -> str:
        return self.path("registros", name)


def export_names(documents: DataFrame) -> DataFrame:
    """The names under which a document's text is exported: documento_id, alvo. Of documents (documento_id, caminhos,
    identidade as `file_identity` gives it): an attachment goes under the number of its folder, others under their
    number, and under that of their header too; without any, the file's name without its extension."""
    i, first = F.col("identidade"), F.try_element_at("caminhos", F.lit(1))
    bare = lambda c: F.regexp_replace(c, r"\.[^./\\]*$", "")
    attached = i["fonte"] == "pasta de anexo"
    inner = F.regexp_replace(bare(i["anexo"]), r"[\\/]+", " - ")
    own = F.when(attached, F.concat_ws("/", i["numero"], inner)).otherwise(i["numero"])
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(own, i["numero_no_cabecalho"]))))
    stem = bare(F.element_at(F.split(first, "/"), -1))
    return documents.select("documento_id", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array_compact(F.array(stem)))).alias("alvo"))


def reading_order(scores: DataFrame, priorities: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Every document of `scores` (key, pontos) with prioridade, motivos and posicao: documents to be read first, then
    by points, then by `name` (the key where there is none)."""
    joined = scores.join(priorities.select(key, "prioridade", "motivos"), key, "left").withColumn("prioridade", F.coalesce("prioridade", F.lit(False)))
    by_name = [F.lower(F.col(name)), F.asc(key)] if name else [F.asc(key)]
    return rank(joined, F.desc("prioridade"), F.desc("pontos"), *by_name)


def to_analyse(documents: DataFrame, order: DataFrame | None, key: str, only: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """The documents in the order of reading, those that it lacks at the end; `only` (key) keeps the ones named, and
    `first` the first so many of what is left, as asked for."""
    rows = documents if only is None else documents.join(only.select(key).distinct(), key, "left_semi")
    placed = rows.join(order.select(key, "posicao"), key, "left") if order is not None else rows.withColumn("posicao", F.lit(None).cast("int"))
    return placed if first is None else placed.orderBy(F.asc_nulls_last("posicao"), key).limit(first)


def all_messages(mails: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages of e-mails (documento_id, pagina, de, para, cc, data, assunto) and chats (documento_id, pagina, de, para:
    names, data) in one form: mensagem_id (of what they hold), documento_id, pagina, meio, de, para, cc, data, assunto."""
    none = F.array().cast(f"array<{_PERSON}>")
    named = lambda c: F.struct(F.col(c).alias("nome"), F.lit(None).cast("string").alias("endereco"))
    a = mails.select("documento_id", "pagina", F.lit("e-mail").alias("meio"), F.col("de").cast(_PERSON).alias("de"), F.coalesce("para", none).alias("para"), F.coalesce("cc", none).alias("cc"), "data", "assunto")
    b = chats.select("documento_id", "pagina", F.lit("conversa").alias("meio"), named("de").alias("de"), F.array(named("para")).alias("para"), none.alias("cc"), "data", F.lit("").alias("assunto"))
    both = a.unionByName(b)
    return both.withColumn("mensagem_id", stable_id(F.col("documento_id"), F.col("pagina"), F.col("data"), F.to_json(F.struct("de", "para", "cc")), F.col("assunto")))


def corrected_messages(messages: DataFrame, corrections: DataFrame) -> DataFrame:
    """Messages with the last correction (alvo, campo, valor, ordem) of each field over them: data and assunto as they
    are; de and para as names and addresses in one field, where para takes the place of all recipients. A correction
    of de that names nobody changes nothing. `correcoes` holds what was changed."""
    last = latest(corrections.where(F.col("campo").isin("de", "para", "data", "assunto")), ["alvo", "campo"], ["ordem"])
    changes = last.groupBy(F.col("alvo").alias("mensagem_id")).agg(F.map_from_entries(F.collect_list(F.struct("campo", F.coalesce("valor", F.lit("")).alias("valor")))).alias("correcoes"))
    joined = messages.join(changes, "mensagem_id", "left")
    has = lambda f: F.coalesce(F.map_contains_key("correcoes", F.lit(f)), F.lit(False))
    new = lambda f: F.element_at("correcoes", F.lit(f))
    none = F.array().cast(f"array<{_PERSON}>")
    sender = F.try_element_at(participants(F.coalesce(new("de"), F.lit(""))), F.lit(1))
    return joined.withColumns({
        "de": F.when(has("de") & sender.isNotNull(), sender).otherwise(F.col("de")), "para": F.when(has("para"), participants(F.coalesce(new("para"), F.lit("")))).otherwise(F.col("para")),
        "cc": F.when(has("para"), none).otherwise(F.col("cc")), "data": F.when(has("data"), new("data")).otherwise(F.col("data")), "assunto": F.when(has("assunto"), new("assunto")).otherwise(F.col("assunto")),
    })


def people_line(people: Column) -> Column:
    """Participants as one field of a header."""
    one = lambda p: F.when((p["nome"] != "") & (p["endereco"] != ""), F.concat(p["nome"], F.lit(" <"), p["endereco"], F.lit(">"))).otherwise(F.coalesce(p["nome"], p["endereco"], F.lit("")))
    return F.array_join(F.transform(people, one), "; ")


def display_rows(findings: DataFrame, messages: DataFrame) -> DataFrame:
    """Findings and messages in one form for lists and time lines: origem, id, documento_id, pagina, data, descricao,
    trecho, situacao."""
    a = findings.select(F.lit("achado").alias("origem"), F.col("achado_id").cast("string").alias("id"), "documento_id", F.col("pagina").cast("int").alias("pagina"), F.date_format("criado_em", "yyyy-MM-dd").alias("data"), F.concat_ws(": ", "tipo", "nome").alias("descricao"), F.col("trecho_fonte").alias("trecho"), F.coalesce("situacao", F.lit("pendente")).alias("situacao"))
    subject = F.when(F.col("assunto") != "", F.concat(F.lit(" · «"), F.col("assunto"), F.lit("»"))).otherwise("")
    said = F.concat(F.col("meio"), F.lit(": "), F.coalesce("de.nome", "de.endereco", F.lit("")), F.lit(" → "), people_line(F.col("para")), subject)
    b = messages.select(F.lit("mensagem").alias("origem"), F.col("mensagem_id").cast("string").alias("id"), "documento_id", F.col("pagina").cast("int").alias("pagina"), "data", said.alias("descricao"), F.lit("").alias("trecho"), F.lit("máquina").alias("situacao"))
    return a.unionByName(b)


def filtered(findings: DataFrame, states: list[str] | None = None, kinds: list[str] | None = None, document: str | None = None) -> DataFrame:
    """Findings of these states (null ones are pending), kinds and document; None leaves a filter out."""
    rows = findings if states is None else findings.where(F.coalesce("situacao", F.lit("pendente")).isin(*states))
    rows = rows if kinds is None else rows.where(F.col("tipo").isin(*kinds))
    return rows if document is None else rows.where(F.col("documento_id") == document)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page (from 1) of a list in an order. Only the rows up to its end leave their partitions."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
