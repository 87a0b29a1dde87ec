"""Full-text search: an index of postings, Boolean queries with phrases and prefixes, ranking by BM25."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions.text import fold, fold_word, locator, tokens, unhyphenate
from lavra.operators.lexicon import rank

# BM25's parameters and its least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The index: termo, key, lugar (from 0), tamanho (words of the text). Words cut at line ends count whole."""
    words = texts.where(F.col(text).isNotNull()).select(key, tokens(unhyphenate(F.col(text))).alias("_w"))
    return words.select(key, F.size("_w").alias("tamanho"), F.posexplode("_w").alias("lugar", "termo"))


def term_frequencies(index: DataFrame, key: str) -> DataFrame:
    """How often each term occurs in each text: termo, key, tf, tamanho; pre-aggregated before the shuffle."""
    return index.groupBy("termo", key).agg(F.count("*").alias("tf"), F.first("tamanho").alias("tamanho"))


def corpus_statistics(texts: DataFrame, text: str) -> DataFrame:
    """One row: textos, media (words of a text on average). Null texts don't count."""
    size = F.size(tokens(unhyphenate(F.col(text))))
    return texts.where(F.col(text).isNotNull()).agg(F.count("*").alias("textos"), F.avg(size).alias("media"))


def folded_word(word: str) -> str:
    """A word of a query as the index has it."""
    return fold_word(word.rstrip("*"))


def parse_query(query: str) -> list[list[list[str]]]:
    """A query as alternatives of parts that must all match; a part is a phrase of words, its last one ending in
    `*` for a prefix. `OU` and `OR` part alternatives, everything else is a must; signs mean nothing, and
    operators at the ends or beside each other are dropped."""
    found: list[list[list[str]]] = [[]]
    for match in re.finditer(r'"([^"]*)"|(\S+)', query or ""):
        if match[2] in ("OU", "OR"):
            found.append([])
            continue
        raw = match[1] if match[1] is not None else match[2]
        words = re.findall(r"[^\W_]+\*?", raw)
        plain = [w if k == len(words) - 1 else w.rstrip("*") for k, w in enumerate(words)]
        if match[1] is None:
            found[-1].extend([w] for w in plain)
        elif plain:
            found[-1].append(plain)
    return [part for part in found if part]


#: Parts of a written index, by term, and a version that a change of what it holds raises.
PARTS, VERSION = 32, 1


@dataclass(frozen=True)
class Index:
    """termos (parte, termo, key, lugares, tamanho) and estado (one row: versao, textos, media). The empty term stands
    for a text as such, so that texts without words are in it too."""

    termos: DataFrame
    estado: DataFrame
    key: str

    @property
    def textos(self) -> DataFrame:
        """key and tamanho of every text."""
        return self.termos.where((F.col("parte") == _part(F.lit(""))) & (F.col("termo") == "")).select(self.key, "tamanho")


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _state(texts: DataFrame) -> DataFrame:
    return texts.agg(F.lit(VERSION).alias("versao"), F.count("*").alias("textos"), F.avg("tamanho").alias("media"))


def build_index(texts: DataFrame, key: str, text: str) -> Index:
    """The index as frames: one row per term and text, with the places of the term in the text; null texts aren't in it.
    Every text is read once, and its words are shuffled once, to the part of their term and a share of its texts."""
    words = texts.where(F.col(text).isNotNull()).select(key, tokens(unhyphenate(F.col(text))).alias("_w"))
    each = words.select(key, F.size("_w").alias("tamanho"), F.posexplode(F.concat(F.array(F.lit("")), F.col("_w"))).alias("lugar", "termo"))
    share = F.pmod(F.xxhash64(key), F.lit(max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS)))
    dealt = each.withColumns({"parte": _part(F.col("termo")), "_s": share}).repartition("parte", "_s")
    places = F.transform(F.sort_array(F.collect_list(F.when(F.col("termo") != "", F.col("lugar")))), lambda x: x - 1)
    terms = dealt.groupBy("parte", "_s", "termo", key).agg(places.alias("lugares"), F.first("tamanho").alias("tamanho")).drop("_s")
    return Index(terms, _state(words.select(F.size("_w").alias("tamanho"))), key)


def write_index(texts: DataFrame, key: str, text: str, path: str) -> Index:
    """Write the index: terms in parts by their hash, sorted, so that a query reads the row groups of its words alone.
    The state comes last; an index without one, or of another version, doesn't count as written."""
    build_index(texts, key, text).termos.sortWithinPartitions("parte", "termo").write.mode("overwrite").partitionBy("parte").parquet(f"{path}/termos")
    spark = texts.sparkSession
    _state(Index(spark.read.parquet(f"{path}/termos"), None, key).textos).write.mode("overwrite").parquet(f"{path}/estado")
    return open_index(spark, key, path)


def open_index(spark: SparkSession, key: str, path: str) -> Index | None:
    """The index at `path`, or None where there is none of this version."""
    try:
        state = spark.read.parquet(f"{path}/estado")
        if [r["versao"] for r in state.select("versao").limit(2).collect()] != [VERSION]:
            return None
        return Index(spark.read.parquet(f"{path}/termos"), state, key)
    except AnalysisException:
        return None


def ensure_index(texts: DataFrame, key: str, text: str, path: str) -> Index:
    """The index at `path`, written anew where it is missing or of another version."""
    return open_index(texts.sparkSession, key, path) or write_index(texts, key, text, path)


def check_index(index: Index, texts: DataFrame, text: str) -> DataFrame:
    """One row: indexados, faltam (texts without entry), sobram (entries without text), palavras (all places), and
    confere, whether nothing is missing or left over and the words add up."""
    held = texts.where(F.col(text).isNotNull()).select(index.key).distinct()
    gaps = held.withColumn("_t", F.lit(1)).join(index.textos.withColumn("_i", F.lit(1)), index.key, "full_outer")
    counts = gaps.agg(F.count("_i").alias("indexados"), F.count_if(F.col("_i").isNull()).alias("faltam"), F.count_if(F.col("_t").isNull()).alias("sobram"), F.coalesce(F.sum("tamanho"), F.lit(0)).alias("_s"))
    places = index.termos.agg(F.coalesce(F.sum(F.size("lugares")), F.lit(0)).alias("palavras"))
    fine = (F.col("faltam") == 0) & (F.col("sobram") == 0) & (F.col("palavras") == F.col("_s"))
    return counts.crossJoin(F.broadcast(places)).select("indexados", "faltam", "sobram", "palavras", fine.alias("confere"))


def _matches(index: Index, phrase: list[str]) -> DataFrame:
    """How often a phrase occurs in each text: key, tf, tamanho. Each word is a filter that reaches the scan; the words
    of a phrase meet on the text and on where the phrase would begin."""
    key = index.key

    def rows(word: str) -> DataFrame:
        bare = folded_word(word)
        if word.endswith("*"):
            return index.termos.where(F.col("termo").startswith(bare) & (F.col("termo") != ""))
        return index.termos.where((F.col("parte") == _part(F.lit(bare))) & (F.col("termo") == bare))

    if len(phrase) == 1:
        return rows(phrase[0]).groupBy(key).agg(F.sum(F.size("lugares")).alias("tf"), F.first("tamanho").alias("tamanho"))
    begin = lambda k: F.explode(F.transform("lugares", lambda x: x - k)).alias("_inicio")
    steps = [rows(w).select(key, begin(k), *(["tamanho"] if k == 0 else [])) for k, w in enumerate(phrase)]
    return reduce(lambda a, b: a.join(b, [key, "_inicio"]), steps).groupBy(key).agg(F.count("*").alias("tf"), F.first("tamanho").alias("tamanho"))


def search_index(index: Index, query: str, limit: int | None = 200, ranked: bool = True) -> DataFrame:
    """The `limit` best texts for a query, all without one: key, pontos, posicao (key and pontos alone where not
    `ranked`). Ties go to the lower key. Each phrase counts as one term; a text scores by every part of the query that
    it holds. A query without words finds nothing."""
    key, alternatives = index.key, parse_query(query)
    if not alternatives:
        return index.textos.sparkSession.createDataFrame([], f"{key} {dict(index.textos.dtypes)[key]}, pontos double" + (", posicao int" if ranked else ""))
    phrases = list(dict.fromkeys(tuple(p) for part in alternatives for p in part))
    hits = reduce(DataFrame.unionByName, (_matches(index, list(p)).withColumn("parte", F.lit(i)) for i, p in enumerate(phrases)))
    # one row per text, with at most as many entries as the query has parts
    held = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("parte", "tf"))).alias("_tf"), F.first("tamanho").alias("tamanho"))
    has = lambda i: F.map_contains_key("_tf", F.lit(i))
    fits = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (has(phrases.index(tuple(p))) for p in part)) for part in alternatives))
    idf = lambda df: F.greatest(F.log((F.col("textos") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    weights = held.agg(*(F.count_if(has(i)).alias(f"_{i}") for i in range(len(phrases)))).crossJoin(F.broadcast(index.estado.select("textos", "media")))
    weights = weights.select("media", *(idf(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(phrases))))
    part = lambda i: F.coalesce(F.col(f"_{i}") * (tf := F.element_at("_tf", F.lit(i))) * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("tamanho") / F.col("media"))), F.lit(0.0))
    scored = held.where(fits).crossJoin(F.broadcast(weights)).select(key, reduce(lambda a, b: a + b, (part(i) for i in range(len(phrases)))).alias("pontos"))
    if not ranked:
        return scored if limit is None else scored.orderBy(F.desc("pontos"), key).limit(limit)
    if limit is None:
        return rank(scored, F.desc("pontos"), F.asc(key))
    top = scored.orderBy(F.desc("pontos"), key).limit(limit)
    return top.withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("pontos"), key)))


def search(texts: DataFrame, key: str, text: str, query: str, limit: int | None = 200) -> DataFrame:
    """`search_index` over texts without a written index: their words are found anew."""
    return search_index(build_index(texts, key, text), query, limit)


def located(hits: DataFrame, pages: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """Hits on pages (pagina_id, pontos, posicao) with where they stand: documento_id, nome, localizador, n and trecho.
    Pages (pagina_id, documento_id, n, texto) of documents that are not in `documents` (documento_id, nome) fall out."""
    joined = hits.join(pages.select("pagina_id", "documento_id", "n", "texto"), "pagina_id").join(documents.select("documento_id", "nome"), "documento_id")
    none = F.lit(None).cast("string")
    place = locator(none, F.col("nome"), none.cast("int"), none, F.array("n"))
    shown = joined.withColumns({"texto": unhyphenate(F.col("texto")), "localizador": place})
    return snippet_of(shown, "texto", query).select("pagina_id", "documento_id", "nome", "n", "localizador", "pontos", "posicao", "trecho")


def contains_search(texts: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """The way without an index: texts that hold `needle` as it is, unranked."""
    return texts.where(F.contains(F.col(text), F.lit(needle))).select(key)


def snippet_of(texts: DataFrame, text: str, query: str, words: int = 30) -> DataFrame:
    """`texts` with the column trecho: `words` words around the first hit of the query, the hits between « and »."""
    asked = [w for part in parse_query(query) for p in part for w in p]
    folded = [(folded_word(w), w.endswith("*")) for w in dict.fromkeys(asked)]
    all_words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    core = lambda w: F.regexp_replace(fold(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    hit = lambda w: reduce(lambda a, b: a | b, (core(w).startswith(f) if prefix else core(w) == f for f, prefix in folded), F.lit(False))
    first = F.array_position(F.transform("_w", hit), True)
    start = F.greatest(first - words // 3, F.lit(1)).cast("int")
    part = F.transform(F.slice("_w", start, words), lambda w: F.when(hit(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    cut = F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(part, " "), F.when(F.size("_w") >= start + words, " …").otherwise(""))
    return texts.withColumn("_w", all_words).withColumn("trecho", cut).drop("_w")
