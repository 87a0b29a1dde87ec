"""The weighted terms, triage by them, and the kinds of document."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions import identifiers, people
from lavra.functions.text import fold, snippet
from lavra.session import materialize

# Categories, patterns for folded text, weights (1 weak to 4 strong).
TERMS = {
    "Licitação: cobertura, rodízio, supressão": [
        (r"\bpropostas? de cobertura\b", 4), (r"\bpropostas? (ficticias?|de fachada|figurativas?|pro forma)\b", 4), (r"\brodizio\b", 3),
        (r"\brevezamento\b", 3), (r"\b(agora e a sua vez|sua vez|nossa vez|vez de voces|vez deles)\b", 2),
        (r"\bdeixa(r|mos)? (voces |eles |a gente |o outro )?ganhar\b", 4), (r"\bnao (vamos |iremos |vou )?(participar|disputar|concorrer|cotar)\b", 3),
        (r"\bdesist(ir|imos|encia|iu)\b", 2), (r"\bcobertura\b", 1), (r"\b(compensac\w+|subcontrat\w+)\b", 1),
        (r"\b(licitac\w+|pregao|pregoes|certame|edital|concorrencia publica)\b", 1),
    ],
    "Fixação de preços e condições": [
        (r"\bfix(ar|amos|acao|ado|ados) (o |os |de )?precos?\b", 4), (r"\btabela (de precos?|unica|comum)\b", 3),
        (r"\bpreco (minimo|combinado|acertado|de referencia do grupo)\b", 3),
        (r"\b(manter|segurar|nao baixar|nao reduzir) (o |os |nosso |nossos )?precos?\b", 3),
        (r"\b(reajuste|aumento) (conjunto|combinado|de todos|linear)\b", 3), (r"\bdesconto maximo\b", 2), (r"\bmargem\b", 1), (r"\breajuste\b", 1),
    ],
    "Divisão de mercado, clientes ou lotes": [
        (r"\bdivisao (de |do |dos |das )?(mercado|clientes|regioes|territorios?|lotes|contratos|obras)\b", 4),
        (r"\bdividir (o |os |as )?(mercado|clientes|lotes|regioes|contratos|obras)\b", 4),
        (r"\bnao (atender|atacar|entrar|prospectar) (no|na|nos|nas|o|a|os|as) (cliente|regiao|territorio|area)\w*\b", 3),
        (r"\b(cliente|regiao|area|lote) (de voces|deles|da outra|do outro|dele)\b", 2), (r"\bterritori\w+\b", 1),
    ],
    "Troca de informação sensível": [
        (r"\bnossa proposta (sera|vai ser|fica|ficara)\b", 3), (r"\bvamos (entrar|cotar|ofertar|dar lance) com\b", 3),
        (r"\bqual (vai ser |sera )?(o |a )?(seu |sua |teu |tua )?(preco|proposta|lance|desconto)\b", 3),
        (r"\b(planilha|estrutura|composicao) de custos?\b", 2), (r"\b(capacidade|volume|carteira) (de|dos) clientes?\b", 1),
    ],
    "Coordenação entre concorrentes": [
        (r"\bconforme (combinado|acertado|conversado|alinhado)\b", 3), (r"\b(conluio|cartel|clube)\b", 3), (r"\b(combinad|acertad)[oa]s?\b", 2),
        (r"\b(alinhad[oa]s?|alinhamento|alinhar)\b", 1), (r"\b(acordo|ajuste|entendimento) entre\b", 2), (r"\bconcorrentes?\b", 1),
    ],
    "Sigilo e ocultação": [
        (r"\b(apague|apagar|delete|deletar|destrua|destruir) (este|esse|essa|esta|a|o)\b", 4),
        (r"\bnao (comente|comentar|repasse|repassar|encaminhe|encaminhar|divulgue)\b", 2), (r"\bnao (por|pelo) e-?mail\b", 3),
        (r"\b(por|pelo) (telefone|celular|whats\w*|zap|signal|telegram)\b", 2), (r"\b(e-?mail|celular|telefone|numero) (pessoal|particular)\b", 2),
        (r"\b(pessoalmente|ao vivo|fora do escritorio)\b", 1), (r"\b(confidencial|sigiloso|reservado)\b", 1),
    ],
    "Encontros e contatos": [
        (r"\breuni(ao|oes|r|mos|ram)\b", 1), (r"\b(cafe|almoco|jantar|happy hour|encontro)\b", 1), (r"\b(associacao|sindicato|entidade de classe)\b", 1),
    ],
}
# Most occurrences of a term that count, and bonuses for two firms' numbers and two firms' domains.
MOST_PER_TERM, BONUS_FIRMS, BONUS_DOMAINS = 5, 3, 2


def terms(spark: SparkSession, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """The lexicon as rows: termo_id, categoria, padrao, peso."""
    rows = [(i, c, p, w) for i, (c, p, w) in enumerate((c, p, w) for c, all_ in (lexicon or TERMS).items() for p, w in all_)]
    return spark.createDataFrame(rows, "termo_id int, categoria string, padrao string, peso int")


def lexicon_hash(lexicon: DataFrame) -> DataFrame:
    """One row: a hash of the lexicon's rows, kept with every triage made by it."""
    one = F.concat_ws("\x1f", "categoria", "padrao", F.col("peso").cast("string"))
    return lexicon.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n").cast("binary"), 256), 1, 16).alias("hash"))


def term_counts(texts: DataFrame, key: str, text: str, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """How often each term occurs in each text: key, categoria, padrao, peso, ocorrencias, pontos. The patterns
    are literals of one projection, so every text is folded and read once, without a join and without Python."""
    flat = [(c, p, w) for c, all_ in (lexicon or TERMS).items() for p, w in all_]
    folded = texts.where(F.col(text).isNotNull()).select(key, fold(F.col(text)).alias("_dobrado"))
    counts = F.array(*(F.struct(F.lit(c).alias("categoria"), F.lit(p).alias("padrao"), F.lit(w).alias("peso"), _count(F.col("_dobrado"), p).alias("ocorrencias")) for c, p, w in flat))
    hits = folded.select(key, F.explode(F.filter(counts, lambda x: x["ocorrencias"] > 0)).alias("t")).select(key, "t.*")
    return hits.withColumn("pontos", F.least("ocorrencias", F.lit(MOST_PER_TERM)) * F.col("peso"))


@lru_cache(maxsize=1000)
def needles(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of a pattern holds one: the most telling ones, so the longest. () for none."""

    def of(tokens) -> list[str] | None:
        found: list[list[str]] = []
        run = ""
        for op, value in [*tokens, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append([run])
                run = ""
            if op is _parser.BRANCH:
                branches = [of(b) for b in value[1]]
                if all(branches):
                    found.append([x for b in branches for x in b])
            elif op is _parser.SUBPATTERN and (inner := of(value[3])):
                found.append(inner)
            elif op is _parser.MAX_REPEAT and value[0] >= 1 and (inner := of(value[2])):
                found.append(inner)
        return max(found, key=lambda x: min(map(len, x)), default=None)

    return tuple(dict.fromkeys(of(_parser.parse(pattern)) or ()))


def _count(folded: Column, pattern: str) -> Column:
    """How often a pattern occurs. Where a text lacks the literals that it needs, a plain search tells so at once."""
    all_ = F.regexp_count(folded, F.lit(pattern))
    wanted = needles(pattern)
    return F.when(reduce(lambda a, b: a | b, (F.contains(folded, F.lit(x)) for x in wanted)), all_).otherwise(0) if wanted else all_


def category_points(folded: Column, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> Column:
    """The points of each category in a folded text, in one expression: array of (categoria, pontos), those without
    points left out."""
    points = lambda all_: reduce(lambda a, b: a + b, (F.least(_count(folded, p), F.lit(MOST_PER_TERM)) * F.lit(w) for p, w in all_))
    each = F.array(*(F.struct(F.lit(c).alias("categoria"), points(all_).cast("long").alias("pontos")) for c, all_ in (lexicon or TERMS).items() if all_))
    return F.filter(each, lambda x: x["pontos"] > 0)


def scored(texts: DataFrame, key: str, text: str, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """key, termos (points of all terms, 0 for none) and categoria (the strongest, ties to the later name). Every text is
    read and folded once; nothing is shuffled."""
    counted = texts.select(key, fold(F.coalesce(F.col(text), F.lit(""))).alias("_d")).select(key, category_points(F.col("_d"), lexicon).alias("_c"))
    strongest = F.element_at(F.array_sort(F.transform("_c", lambda x: F.struct(x["pontos"].alias("p"), x["categoria"].alias("categoria")))), -1)
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda acc, x: acc + x["pontos"])
    return counted.select(key, total.alias("termos"), F.when(F.size("_c") > 0, strongest["categoria"]).alias("categoria"))


def triage(texts: DataFrame, key: str, text: str, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """Every text with its score, density by 1,000 words, strongest category and place in the order of reading.

    key, pontos, palavras, densidade, categoria, firmas, dominios, posicao. Firms' numbers and domains add their
    bonus. Texts with no hit have 0 points and come last; null texts count as empty."""
    base = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = F.size(F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
    domains = F.array_distinct(F.filter(F.transform(identifiers.emails(F.col("_t")), identifiers.domain), lambda d: d.isNotNull()))
    facts = base.select(key, words.alias("palavras"), F.size(F.array_distinct(identifiers.cnpjs(F.col("_t")))).alias("firmas"), F.size(domains).alias("dominios"), fold(F.col("_t")).alias("_d"))
    counted = facts.select(key, "palavras", "firmas", "dominios", category_points(F.col("_d"), lexicon).alias("_c"))
    strongest = F.element_at(F.array_sort(F.transform("_c", lambda x: F.struct(x["pontos"].alias("p"), x["categoria"].alias("categoria")))), -1)
    terms = F.aggregate("_c", F.lit(0).cast("long"), lambda acc, x: acc + x["pontos"])
    points = terms + F.when(F.col("firmas") >= 2, BONUS_FIRMS).otherwise(0) + F.when(F.col("dominios") >= 2, BONUS_DOMAINS).otherwise(0)
    full = counted.select(key, points.alias("pontos"), "palavras", F.when(F.size("_c") > 0, strongest["categoria"]).alias("categoria"), "firmas", "dominios")
    return rank(full.withColumn("densidade", F.round(F.col("pontos") * 1000.0 / F.greatest("palavras", F.lit(1)), 1)), F.desc("pontos"), F.asc(key)).select(key, "pontos", "palavras", "densidade", "categoria", "firmas", "dominios", "posicao")


def rank(df: DataFrame, *order: Column, name: str = "posicao") -> DataFrame:
    """A global place for every row without one task sorting all of them: ranges are sorted apart, and their
    sizes, one row each, tell where each range begins."""
    spark = df.sparkSession
    df = materialize(df, "sem_ordem")  # ranges are found by sampling, which would compute the rows twice
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_parte", F.spark_partition_id()), "ordem")
    sizes = kept.groupBy("_parte").count()
    before = sizes.withColumn("_antes", F.coalesce(F.sum("count").over(Window.orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("_parte").orderBy(*order))
    return kept.withColumn("_lugar", own).join(F.broadcast(before), "_parte").withColumn(name, F.col("_lugar") + F.col("_antes")).drop("_parte", "_lugar", "_antes")


def snippets(texts: DataFrame, key: str, text: str, most: int | None = 2, lexicon: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """The first `most` places (all where None) of each term in each text: key, categoria, padrao, ordem, posicao, trecho."""
    flat = [(c, p) for c, all_ in (lexicon or TERMS).items() for p, _ in all_]
    base = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), fold(F.col(text)).alias("_d"))
    found = lambda p: F.regexp_extract_all("_d", F.lit(p), F.lit(0)) if most is None else F.slice(F.regexp_extract_all("_d", F.lit(p), F.lit(0)), 1, most)
    each = F.array(*(F.struct(F.lit(c).alias("categoria"), F.lit(p).alias("padrao"), found(p).alias("achados"), F.split("_d", p).alias("entre")) for c, p in flat))
    some = base.select(key, "_t", F.explode(F.filter(each, lambda x: F.size(x["achados"]) > 0)).alias("x")).select(key, "_t", "x.*")
    # a hit begins after the pieces and hits before it; each takes its one piece along, so that many hits stay linear
    hits = some.select(key, "_t", "categoria", "padrao", F.posexplode(F.zip_with("achados", F.slice("entre", 1, F.size("achados")), lambda a, e: F.struct(a.alias("achado"), F.length(e).alias("antes")))).alias("k", "y")).select(key, "_t", "categoria", "padrao", "k", "y.*")
    w = Window.partitionBy(key, "padrao").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("posicao", (F.sum(F.col("antes") + F.length("achado")).over(w) - F.length("achado")))
    return placed.select(key, "categoria", "padrao", (F.col("k") + 1).alias("ordem"), "posicao", snippet(F.col("_t"), F.col("posicao"), F.col("posicao") + F.length("achado")).alias("trecho"))


# What tells a contract, and kinds of communication by their beginning in order of precedence.
CONTRACT_TITLE = r"\b(contrato|termo aditivo|aditivo contratual|instrumento particular|termo de compromisso|acordo de (cooperacao|parceria|consorcio|acionistas|cotistas)|compromisso de constituicao de consorcio)\b"
CONTRACT_SIGNS = r"\b(contratante|contratada|clausula|partes contratantes|objeto do contrato|vigencia)\b"
KINDS = [
    ("transcrição de conversa", r"\btranscri(cao|coes)\b|\binterlocutor(es)?\b|\b(ligacao|dialogo|conversa) telefonic"),
    ("ata de reunião", r"\bata\b.{0,60}\breuniao\b|\bata da\b.{0,40}\b(reuniao|assembleia)\b|\b(presentes|participantes)\s*:"),
    ("memorando", r"\bmemorando\b|\bcomunicacao interna\b|\bmemo\s*n"),
    ("carta ou ofício", r"\b(prezad[oa]s?|ilustrissim[oa]|caro senhor|cara senhora)\b"),
    ("fax", r"\bfax\b.{0,40}\b(de|para|n[o.]?|pagina)"),
]
# Pages of a document on which titles and wording, headers, a letter's closing and signs of a contract count.
TITLE_PAGES, HEADER_PAGES, CLOSING_PAGES, SIGNS_PAGES = 2, 3, 6, 10
LETTER_CLOSING = r"\b(atenciosamente|cordialmente|respeitosamente|saudacoes)\b"


def is_contract(beginning: Column, whole: Column, named: Column | None = None) -> Column:
    """A title of a contract in the first 600 signs and three signs of one in the text, or a trusted name."""
    by_text = fold(F.substring(beginning, 1, 600)).rlike(CONTRACT_TITLE) & (F.regexp_count(fold(whole), F.lit(CONTRACT_SIGNS)) >= 3)
    return F.coalesce(by_text | (fold(named).rlike("contrato|aditivo") if named is not None else F.lit(False)), F.lit(False))


def communication_kind(text: Column, headers: Column, chat_pairs: Column, act: Column | None = None, beginning: Column | None = None) -> Column:
    """The kind of communication that a document is, or null: a message header, a chat of two exchanges, or the
    wording of its beginning (of `beginning`, where given). A letter needs a closing formula anywhere in `text` and
    mustn't be an authority's act."""
    begin = fold(F.substring(text if beginning is None else beginning, 1, 4000))
    letter = fold(text).rlike(LETTER_CLOSING) & (act.isNull() if act is not None else F.lit(True))
    chain = F.when(headers > 0, "e-mail").when(chat_pairs >= 2, "conversa")
    return reduce(lambda c, kind: c.when(begin.rlike(kind[1]) & (letter if kind[0] == "carta ou ofício" else F.lit(True)), kind[0]), KINDS, chain)


def priorities(documents: DataFrame, key: str, text: str, kind: str | None = None, first_names: Iterable[str] = ()) -> DataFrame:
    """Whether a document is to be read first, and why: key, prioridade, motivos. Two firms, two people, a
    message, a contract or a communication are reasons; `kind` names a column with the communication's kind."""
    base = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("_k"))
    base = base.withColumns({"_f": people.firms(F.col("_t")), "_p": people.people(F.col("_t"), first_names)})
    firms_n = F.greatest(F.size(F.array_distinct(identifiers.cnpjs(F.col("_t")))), F.size("_f"))
    people_n = F.size("_p") + F.size(F.array_distinct(identifiers.cpfs(F.col("_t"))))
    reasons = F.array_compact(F.array(
        F.when(firms_n >= 2, F.concat(firms_n.cast("string"), F.lit(" empresas"))),
        F.when(people_n >= 2, F.concat(people_n.cast("string"), F.lit(" pessoas"))),
        F.when(is_contract(F.col("_t"), F.col("_t")), "contrato"),
        F.col("_k"),
    ))
    return base.select(key, (F.size(reasons) > 0).alias("prioridade"), reasons.alias("motivos"))
