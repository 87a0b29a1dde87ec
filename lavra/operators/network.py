"""Who communicates with whom: people, pairs and organisations from messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.identifiers import domain
from lavra.functions.text import name_key

#: Colours of organisations in the graph, by turns.
PALETTE = ["#4e79a7", "#f28e2b", "#59a14f", "#b07aa1", "#76b7b2", "#edc948", "#ff9da7", "#9c755f"]


def once(messages: DataFrame) -> DataFrame:
    """Each message once; of rows delivered twice any will do, for all their fields are equal."""
    return messages.where("mensagem_id is not null").dropDuplicates(["mensagem_id"])


def mentions(messages: DataFrame, delivered_once: bool = False) -> DataFrame:
    """One row per person and message: mensagem_id, papel (de, para, cc), nome, endereco, chave. Messages hold
    mensagem_id, de (struct), para and cc (arrays of struct<nome, endereco>); nulls are left out, and so are
    participants with neither name nor address. A message delivered twice counts once."""
    rows = messages if delivered_once else once(messages)
    none = F.array().cast("array<struct<nome:string,endereco:string>>")
    role = lambda c, r: F.transform(F.coalesce(c, none), lambda p: F.struct(F.lit(r).alias("papel"), p["nome"].alias("nome"), F.lower(p["endereco"]).alias("endereco")))
    all_ = F.concat(role(F.array("de"), "de"), role(F.col("para"), "para"), role(F.col("cc"), "cc"))
    out = rows.select("mensagem_id", F.explode(all_).alias("p")).select("mensagem_id", "p.*")
    return out.withColumn("chave", name_key(F.coalesce("nome", F.lit("")))).where("chave <> '' or endereco <> ''")


def identities(mentioned: DataFrame) -> DataFrame:
    """`mentioned` with pessoa: the address, or for a bare name the first address (by message) seen with that
    name, or the name's key."""
    seen = mentioned.where("endereco <> '' and chave <> ''").groupBy("chave").agg(F.min_by("endereco", F.struct("mensagem_id", "endereco")).alias("_achado"))
    joined = mentioned.join(seen, "chave", "left")
    own = F.when(F.col("endereco") != "", F.col("endereco"))
    return joined.withColumn("pessoa", F.coalesce(own, F.col("_achado"), F.col("chave"))).drop("_achado")


def people(identified: DataFrame) -> DataFrame:
    """pessoa, rotulo (the longest name, then the first by order), nomes, organizacao, enviadas (messages),
    recebidas (messages received from others)."""
    sent = identified.where("papel = 'de'").select("mensagem_id", F.col("pessoa").alias("_de")).distinct()
    got = identified.where("papel <> 'de'").select("mensagem_id", "pessoa").distinct().join(sent, "mensagem_id", "left").where("_de is null or _de <> pessoa")
    counts = sent.groupBy(F.col("_de").alias("pessoa")).agg(F.count("*").alias("enviadas")).join(got.groupBy("pessoa").agg(F.countDistinct("mensagem_id").alias("recebidas")), "pessoa", "full_outer")
    named = identified.groupBy("pessoa").agg(F.array_sort(F.collect_set(F.when(F.trim("nome") != "", F.col("nome")))).alias("nomes"), F.max(domain(F.col("endereco"))).alias("organizacao"))
    longest = F.try_element_at(F.sort_array(F.transform("nomes", lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), F.lit(1))["n"]
    out = named.join(counts, "pessoa", "left").withColumn("rotulo", F.coalesce(longest, F.col("pessoa")))
    return out.select("pessoa", "rotulo", "nomes", "organizacao", F.coalesce("enviadas", F.lit(0)).alias("enviadas"), F.coalesce("recebidas", F.lit(0)).alias("recebidas"))


def edges(identified: DataFrame) -> DataFrame:
    """One row per message and pair of its sender and another person: mensagem_id, a < b, copia."""
    sent = identified.where("papel = 'de'").select("mensagem_id", F.col("pessoa").alias("_de")).distinct()
    to = identified.where("papel <> 'de'").groupBy("mensagem_id", "pessoa").agg((F.min(F.when(F.col("papel") == "cc", 1).otherwise(0)) == 1).alias("copia"))
    both = to.join(sent, "mensagem_id").where("_de <> pessoa")
    return both.select("mensagem_id", F.least("_de", "pessoa").alias("a"), F.greatest("_de", "pessoa").alias("b"), "copia")


def pairs(linked: DataFrame, messages: DataFrame, persons: DataFrame, when: str = "data") -> DataFrame:
    """Pairs of people: a, b, total (messages), copias, primeira, ultima, documentos, cruzada (two organisations)."""
    facts = messages.where("mensagem_id is not null").dropDuplicates(["mensagem_id"]).select("mensagem_id", F.when(F.col(when) != "", F.col(when)).alias("_d"), "documento_id")
    org = persons.select(F.col("pessoa"), F.col("organizacao"))
    grouped = linked.join(facts, "mensagem_id").groupBy("a", "b").agg(F.count("*").alias("total"), F.count_if("copia").alias("copias"), F.min("_d").alias("primeira"), F.max("_d").alias("ultima"), F.countDistinct("documento_id").alias("documentos"))
    out = grouped.join(org.withColumnsRenamed({"pessoa": "a", "organizacao": "org_a"}), "a", "left").join(org.withColumnsRenamed({"pessoa": "b", "organizacao": "org_b"}), "b", "left")
    return out.withColumn("cruzada", F.coalesce(F.col("org_a") != F.col("org_b"), F.lit(False)))


def pair_messages(linked: DataFrame, messages: DataFrame, when: str = "data") -> DataFrame:
    """The messages of each pair in order: a, b, ordem (from 1), mensagem_id, data, undated ones last. A row for each, so
    that no pair is gathered."""
    facts = messages.select("mensagem_id", F.nullif(F.col(when), F.lit("")).alias("data"))
    order = Window.partitionBy("a", "b").orderBy(F.asc_nulls_last("data"), "mensagem_id")
    return linked.join(facts, "mensagem_id").withColumn("ordem", F.row_number().over(order)).select("a", "b", "ordem", "mensagem_id", "data")


def organisations(of_pairs: DataFrame) -> DataFrame:
    """Pairs of organisations: org_a < org_b, mensagens, pares."""
    crossed = of_pairs.where("cruzada").select(F.least("org_a", "org_b").alias("org_a"), F.greatest("org_a", "org_b").alias("org_b"), "total")
    return crossed.groupBy("org_a", "org_b").agg(F.sum("total").alias("mensagens"), F.count("*").alias("pares"))


def counterparts(of_pairs: DataFrame, person: str) -> DataFrame:
    """With whom one person communicates: contraparte, total. Two equi-filters in place of an OR join."""
    a = of_pairs.where(F.col("a") == person).select(F.col("b").alias("contraparte"), "total")
    b = of_pairs.where(F.col("b") == person).select(F.col("a").alias("contraparte"), "total")
    return a.unionByName(b).groupBy("contraparte").agg(F.sum("total").alias("total"))


def dot_graph(of_pairs: DataFrame, persons: DataFrame, most: int = 40) -> DataFrame:
    """One row with the DOT text of the `most` strongest pairs: pen width 1 to 5 by messages, crossing pairs red."""
    top = of_pairs.orderBy(F.desc("total"), "a", "b").limit(most)
    top = top.crossJoin(F.broadcast(top.agg(F.max("total").alias("_m"))))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    line = F.concat(F.lit("  "), quote(F.col("a")), F.lit(" -- "), quote(F.col("b")), F.lit(" [penwidth="), F.format_number(1 + 4 * F.col("total") / F.col("_m"), 1), F.lit(', label="'), F.col("total").cast("string"), F.lit('"'), F.when(F.col("cruzada"), ", color=red").otherwise(""), F.lit("];"))
    used = top.select(F.col("a").alias("pessoa")).union(top.select("b")).distinct().join(persons, "pessoa")
    colours = F.array(*map(F.lit, PALETTE))
    node = F.concat(F.lit("  "), quote(F.col("pessoa")), F.lit(" [label="), quote(F.col("rotulo")), F.lit(', style=filled, fillcolor="'), F.element_at(colours, (F.pmod(F.xxhash64(F.coalesce("organizacao", F.lit(""))), F.lit(len(PALETTE))) + 1).cast("int")), F.lit('"];'))
    nodes = used.agg(F.array_join(F.array_sort(F.collect_list(node)), "\n").alias("n"))
    return top.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("l")).crossJoin(nodes).select(F.concat(F.lit("graph teia {\n"), "n", F.lit("\n"), "l", F.lit("\n}")).alias("dot"))
