"""Tables of the report and of the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.dates import dates
from lavra.operators.lexicon import TERMS, snippets, term_counts, triage

# The report's limits, signs around a date in which a strong term counts, and the weight of one.
PRIORITIES, DATES_SHOWN, VALUES_SHOWN, PLACES_SHOWN, PAIRS_SHOWN, ORGANISATIONS_SHOWN, NEAR, STRONG = 25, 300, 200, 8, 40, 30, 300, 2
LOW_CONFIDENCE, FEW_WORDS = 70, 20


def overview(files: DataFrame, pages: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: documentos, paginas, paginas_ocr, mensagens, sem_data. Rows delivered twice count once."""
    d = files.agg(F.countDistinct("documento_id").alias("documentos"))
    p = pages.dropDuplicates(["pagina_id"]).agg(F.count("*").alias("paginas"), F.count_if(F.col("metodo") == "ocr").alias("paginas_ocr"))
    m = messages.dropDuplicates(["mensagem_id"]).agg(F.count("*").alias("mensagens"), F.count_if(F.coalesce(F.trim("data"), F.lit("")) == "").alias("sem_data"))
    return d.crossJoin(p).crossJoin(m)


def mails_by_date(messages: DataFrame, most: int = DATES_SHOWN) -> DataFrame:
    """The report's list of messages (mensagem_id, data as an ISO text or null): the first `most` by date, undated last."""
    return messages.withColumn("data", F.nullif(F.trim("data"), F.lit(""))).orderBy(F.asc_nulls_last("data"), "mensagem_id").limit(most)


def mail_period(messages: DataFrame) -> DataFrame:
    """One row: mensagens, com_data, primeira, ultima of messages with an ISO `data`."""
    dated = F.when(F.trim("data") != "", F.col("data"))
    return messages.agg(F.count("*").alias("mensagens"), F.count(dated).alias("com_data"), F.min(dated).alias("primeira"), F.max(dated).alias("ultima"))


def strongest_pairs(pairs: DataFrame, most: int = PAIRS_SHOWN, crossing: bool = False) -> DataFrame:
    """The report's pairs: most messages first; `crossing` keeps those between organisations."""
    return (pairs.where("cruzada") if crossing else pairs).orderBy(F.desc("total"), "a", "b").limit(most)


def strongest_organisations(organisations: DataFrame, most: int = ORGANISATIONS_SHOWN) -> DataFrame:
    """The report's pairs of organisations: most messages first."""
    return organisations.orderBy(F.desc("mensagens"), "org_a", "org_b").limit(most)


def entities_shown(values: DataFrame, most: int = VALUES_SHOWN) -> DataFrame:
    """The report's values of each type: the `most` in most documents, their places, and how many more documents."""
    listed = entity_directory(values)
    place = F.row_number().over(Window.partitionBy("tipo").orderBy(F.desc("documentos"), "valor"))
    more = F.greatest(F.col("documentos") - PLACES_SHOWN, F.lit(0))
    return listed.withColumn("lugar", place).where(F.col("lugar") <= most).withColumn("outros", more)


def first_to_read(texts: DataFrame, key: str, text: str, most: int = PRIORITIES) -> DataFrame:
    return triage(texts, key, text).where("pontos > 0").orderBy("posicao").limit(most)


def spaced_excerpts(found: DataFrame, key: str, page: str, most: int = 3, apart: int = 240) -> DataFrame:
    """The excerpts of each document that don't crowd: at most `most`, those on one page at least `apart` signs from
    every one kept before. Only places are folded, one short list per document and page order."""
    kind = dict(found.dtypes)[page]
    state = f"array<struct<p:{kind},i:int>>"
    items = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(page).alias("p"), F.col("posicao").cast("int").alias("i")))).alias("_l"))
    zero = F.array().cast(state)

    def step(acc, x):
        crowded = F.exists(acc, lambda y: (y["p"] == x["p"]) & (F.abs(y["i"] - x["i"]) < apart))
        return F.when(crowded | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(F.struct(x["p"].alias("p"), x["i"].alias("i")))))

    kept = items.select(key, F.explode(F.aggregate("_l", zero, step)).alias("x"))
    return kept.select(key, F.col("x.p").alias(page), F.col("x.i").alias("posicao"))


def entity_values(entities: DataFrame) -> DataFrame:
    """Every identifier with its pages: documento_id, tipo, valor, paginas (sorted). Rows delivered twice count once."""
    rows = entities.where("documento_id is not null").dropDuplicates(["entidade_id"])
    kinds = ["cnpjs", "cpfs", "emails", "valores"]
    none = F.array().cast("array<struct<valor:string,paginas:array<int>>>")

    def typed(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), none), lambda x: F.struct(F.lit(kind).alias("tipo"), x["valor"].alias("valor"), x["paginas"].alias("paginas")))

    all_ = F.concat(*(typed(k) for k in kinds))
    flat = rows.select("documento_id", F.explode(all_).alias("x")).select("documento_id", "x.*").where("valor is not null")
    return flat.groupBy("documento_id", "tipo", "valor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("paginas", F.array().cast("array<int>")))))).alias("paginas"))


def entity_directory(values: DataFrame, most: int | None = None) -> DataFrame:
    """Each value with the number of documents it is in and the first eight of them; by type, number, value."""
    counts = values.groupBy("tipo", "valor").agg(F.countDistinct("documento_id").alias("documentos"))
    # the lowest ids by partial groups, so that a value in very many documents gathers eight of each part only
    part = values.groupBy("tipo", "valor", F.pmod(F.xxhash64("documento_id"), F.lit(32)).alias("_p")).agg(F.slice(F.array_sort(F.collect_set("documento_id")), 1, PLACES_SHOWN).alias("_d"))
    firsts = part.groupBy("tipo", "valor").agg(F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, PLACES_SHOWN), ", ").alias("lugares"))
    out = counts.join(firsts, ["tipo", "valor"])
    return out.orderBy("tipo", F.desc("documentos"), "valor").limit(most) if most else out


def dates_near_terms(pages: DataFrame, key: list[str], text: str, weight: int = STRONG, near: int = NEAR) -> DataFrame:
    """Dates within `near` signs of a term of at least `weight` on the same page: key, data, precisao, inicio, termos.
    A join on the page with the distance as a rest, so it stays a hash join."""
    strong = {c: [(p, w) for p, w in all_ if w >= weight] for c, all_ in TERMS.items()}
    strong = {c: v for c, v in strong.items() if v}
    one = pages.withColumn("_k", F.to_json(F.struct(*key)))
    hits = snippets(one, "_k", text, most=None, lexicon=strong).select("_k", "padrao", F.col("posicao").alias("_t"))
    found = one.select("_k", *key, F.explode(dates(F.col(text))).alias("d")).select("_k", *key, "d.*")
    near_ = found.join(hits, "_k").where(F.abs(F.col("inicio") - F.col("_t")) <= near)
    return near_.groupBy(*key, "data", "precisao", "inicio").agg(F.countDistinct("padrao").alias("termos"))


def category_totals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Points of each category over the corpus: categoria, textos, pontos."""
    return term_counts(texts, key, text).groupBy("categoria").agg(F.countDistinct(key).alias("textos"), F.sum("pontos").alias("pontos"))


def export_coverage(pages: DataFrame) -> DataFrame:
    """Of each document how much of it has text: documento_id, paginas, digitais, ocr, cobertura, invisiveis; least
    covered first. A page delivered twice counts once."""
    rows = pages.where("documento_id is not null").dropDuplicates(["pagina_id"])
    ocr = F.count_if(F.col("metodo") == "ocr")
    digital = F.count_if(F.col("metodo").isin("texto_digital", "html", "texto"))
    out = rows.groupBy("documento_id").agg(F.count("*").alias("paginas"), digital.alias("digitais"), ocr.alias("ocr"))
    covered = F.col("digitais") + F.col("ocr")
    return out.withColumn("cobertura", F.round(covered / F.greatest("paginas", F.lit(1)), 4)).withColumn("invisiveis", F.col("paginas") - covered)


def doubtful_pages(pages: DataFrame) -> DataFrame:
    """Pages of OCR that can't be relied on: pagina_id, documento_id, n, confianca_media, ocr_palavras."""
    rows = pages.dropDuplicates(["pagina_id"]).where("metodo = 'ocr'")
    return rows.where((F.col("confianca_media") < LOW_CONFIDENCE) | (F.col("ocr_palavras") < FEW_WORDS)).select("pagina_id", "documento_id", "n", "confianca_media", "ocr_palavras")


def export_texts(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """The text of each export target (documento_id, alvo): pages in order between form feeds, documents of one
    target after one another. One target is one file, so its pages come together."""
    rows = pages.dropDuplicates(["pagina_id"]).join(targets, "documento_id")
    by_doc = rows.groupBy("alvo", "documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("texto", F.lit("")).alias("t")))), lambda x: x["t"]), "\f").alias("_t"))
    return by_doc.groupBy("alvo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("documento_id", "_t"))), lambda x: x["_t"]), "\f").alias("texto"), F.count("*").alias("documentos"))


def quality(files: DataFrame, alerts: DataFrame) -> DataFrame:
    """What may be wrong with each document: documento_id, problema. Alerts, copies, unsupported types, documents
    numbered within a file that has no number."""
    rows = files.where("documento_id is not null").dropDuplicates(["documento_id"])
    by_page = alerts.select("documento_id", F.explode("alertas").alias("problema"))
    own = rows.select("documento_id", F.explode("alertas").alias("problema"))
    copies = rows.where("size(caminhos) > 1").select("documento_id", F.concat(F.size("caminhos").cast("string"), F.lit(" cópias")).alias("problema"))
    kinds = rows.where("tipo is null or tipo not in ('pdf', 'html', 'txt')").select("documento_id", F.lit("tipo não reconhecido").alias("problema"))
    loose = rows.where(F.col("nome").rlike(r"(?i)^\s*doc(?:umento)?\.?\s*\d+") & ~F.coalesce(F.try_element_at("caminhos", F.lit(1)), F.lit("")).rlike(r"(?<!\d)\d{6,7}(?!\d)")).select("documento_id", F.lit("documento numerado sem processo").alias("problema"))
    return by_page.unionByName(own).unionByName(copies).unionByName(kinds).unionByName(loose).distinct()


def duration_estimate(chunks: DataFrame, read: float, write: float, tokens_per_word: float = 1.9, answer: int = 400) -> DataFrame:
    """One row: trechos, segundos that a model at `read` and `write` tokens a second needs for chunks (palavras)."""
    n, words = F.count("*"), F.coalesce(F.sum("palavras"), F.lit(0))
    return chunks.agg(n.alias("trechos"), F.round(words * tokens_per_word / read + n * answer / write, 1).alias("segundos"))
