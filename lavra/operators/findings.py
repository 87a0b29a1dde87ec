"""Findings under review: decisions, corrections as an overlay, people and firms put together, and a time line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import name_key, tokens

ACCEPTED = ["validado"]
#: What a status may be; a finding without one is pending.
STATES = ["validado", "rejeitado", "pendente"]


def first_seen(findings: DataFrame, key: str = "achado_id", order: list[str] | None = None) -> DataFrame:
    """One row per finding: the first in the order of its files. Aggregated, so that copies of one finding, however
    many, meet as partial results."""
    order = order or ["criado_em", "documento_id"]
    rest = [c for c in findings.columns if c != key]
    first = findings.where(f"{key} is not null").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(key, "_r.*")


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def with_review(findings: DataFrame, reviews: DataFrame, key: str = "achado_id") -> DataFrame:
    """`findings` with the last decision on each: revisao (pendente where there is none), nota, revisto_em."""
    last = latest(reviews.where(F.col("estado").isin(*STATES)), [key], ["em"]).select(key, F.col("estado").alias("revisao"), "nota", F.col("em").alias("revisto_em"))
    return findings.join(last, key, "left").withColumn("revisao", F.coalesce("revisao", F.lit("pendente")))


def overlay(rows: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`rows` with the last correction (alvo, campo, valor, ordem) of each field put over it; an empty value takes
    the field's away. The column correcoes holds what was changed; the rows themselves stay as they are."""
    last = latest(corrections.where(F.col("campo").isin(*fields)), ["alvo", "campo"], ["ordem"])
    per_row = last.groupBy("alvo").agg(F.map_from_entries(F.collect_list(F.struct("campo", F.coalesce("valor", F.lit(""))))).alias("correcoes"))
    joined = rows.join(per_row, rows[key] == per_row["alvo"], "left").drop("alvo")
    change = {f: F.when(F.map_contains_key("correcoes", F.lit(f)), F.nullif(F.trim(F.element_at("correcoes", F.lit(f))), F.lit(""))).otherwise(F.col(f).cast("string")) for f in fields}
    return joined.withColumns(change)


def cast_of_characters(findings: DataFrame, kind: str, states: list[str] | None = ACCEPTED, state: str = "situacao") -> DataFrame:
    """Names of one kind put together by their key: chave, nome (most frequent spelling), grafias, cargos, empresas,
    documentos, achados; by documents, then name. Null and blank names are left out, null states pending."""
    rows = findings.where((F.col("tipo") == kind) & (F.trim("nome") != ""))
    if states is not None:
        rows = rows.where(F.coalesce(F.col(state), F.lit("pendente")).isin(*states))
    keyed = rows.withColumn("chave", name_key(F.col("nome"))).where("chave <> ''")
    # by spelling first: a name that a third of all rows bear becomes one row for each of its spellings
    spelled = keyed.groupBy("chave", "nome").agg(F.count("*").alias("n"), F.collect_set("cargo").alias("cargos"), F.collect_set("empresa").alias("empresas"))
    docs = keyed.groupBy("chave").agg(F.countDistinct("documento_id").alias("documentos"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    grouped = spelled.groupBy("chave").agg(
        F.min_by("nome", F.struct((-F.col("n")).alias("a"), F.col("nome").alias("b"))).alias("nome"), F.array_sort(F.collect_set("nome")).alias("grafias"),
        flat("cargos").alias("cargos"), flat("empresas").alias("empresas"), F.sum("n").alias("achados"),
    )
    return grouped.join(docs, "chave")


def sources_of(findings: DataFrame, kind: str) -> DataFrame:
    """Where the names of one kind stand: chave, documento_id, localizador, achados. A row for each place."""
    rows = findings.where((F.col("tipo") == kind) & (F.trim("nome") != "")).withColumn("chave", name_key(F.col("nome"))).where("chave <> ''")
    return rows.groupBy("chave", "documento_id", "localizador").agg(F.count("*").alias("achados"))


def firms_by_number(firms: DataFrame) -> DataFrame:
    """Firms (nome, cnpj or null) put together: those without a number join the one with the same name key, if it
    is a single one. chave, cnpj, nomes."""
    keyed = firms.withColumns({"_k": name_key(F.col("nome")), "_n": F.nullif(F.regexp_replace(F.upper(F.coalesce("cnpj", F.lit(""))), "[^0-9A-Z]", ""), F.lit(""))})
    known = keyed.where("_n is not null and _k <> ''").groupBy("_k").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b")).where("_a = _b").select("_k", F.col("_a").alias("_achado"))
    joined = keyed.join(known, "_k", "left").withColumn("chave", F.coalesce("_n", "_achado", "_k"))
    return joined.where("chave <> ''").groupBy("chave").agg(F.max("_n").alias("cnpj"), F.array_sort(F.collect_set("nome")).alias("nomes"))


def timeline(events: DataFrame, date: str, place: str) -> DataFrame:
    """Events by date, those without one last, then by place."""
    return events.orderBy(F.col(date).asc_nulls_last(), F.col(place))


def person_sheet(spellings: DataFrame, persons: DataFrame, linked: DataFrame, events: DataFrame) -> DataFrame:
    """What is known of chosen people (ficha, nome): one row per ficha and fact: tipo (pessoa, par, evento), alvo, data.
    People meet the network by name key; pairs by either end, as two equi-joins; events by participant,
    and where events have a trecho, by a spelling in it."""
    asked = spellings.select("ficha", name_key(F.col("nome")).alias("_k")).where("_k <> ''").distinct()
    known = persons.select("pessoa", F.explode("nomes").alias("_nome")).select("pessoa", name_key(F.col("_nome")).alias("_k")).distinct()
    found = asked.join(known, "_k").select("ficha", "pessoa").distinct()
    a = found.join(linked.withColumnRenamed("a", "pessoa"), "pessoa").select("ficha", F.lit("par").alias("tipo"), F.col("b").alias("alvo"), F.col("ultima").alias("data"))
    b = found.join(linked.withColumnRenamed("b", "pessoa"), "pessoa").select("ficha", F.lit("par").alias("tipo"), F.col("a").alias("alvo"), F.col("ultima").alias("data"))
    e = asked.join(events.withColumn("_k", F.explode(F.transform("participantes", name_key))), "_k").select("ficha", F.lit("evento").alias("tipo"), F.col("localizador").alias("alvo"), "data")
    if "trecho" in events.columns:  # or where the excerpt holds the name: its first word leads to the excerpts to look at
        words = events.select("localizador", "data", tokens(F.col("trecho")).alias("_w")).withColumn("_p", F.explode(F.array_distinct("_w")))
        first = asked.withColumn("_p", F.split("_k", " ")[0])
        held = first.join(words, "_p").where(F.contains(F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("_k"), F.lit(" "))))
        e = e.unionByName(held.select("ficha", F.lit("evento").alias("tipo"), F.col("localizador").alias("alvo"), "data"))
    p = found.select("ficha", F.lit("pessoa").alias("tipo"), F.col("pessoa").alias("alvo"), F.lit(None).cast("string").alias("data"))
    return p.unionByName(a).unionByName(b).unionByName(e).distinct()


def tallies(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of each combination of values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
