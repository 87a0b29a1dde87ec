"""DuckDB counterparts of the core's queries; nothing here comes from the code that they check. Where SQL can't say what a query does (checks with lookaround, places of
matches, similarity of quotes, parsing of messages and dates), there is none, and tests hold it against brute force."""

from __future__ import annotations

import unicodedata

# Fixed values, written out here too, so that a wrong one on the other side shows: the lexicon with its weights and most
# occurrences that count, patterns of addresses and chat lines, public providers, and words without meaning.
TERMS = {
    'Licitação: cobertura, rodízio, supressão': [
        (r'\bpropostas? de cobertura\b', 4),
        (r'\bpropostas? (ficticias?|de fachada|figurativas?|pro forma)\b', 4),
        (r'\brodizio\b', 3),
        (r'\brevezamento\b', 3),
        (r'\b(agora e a sua vez|sua vez|nossa vez|vez de voces|vez deles)\b', 2),
        (r'\bdeixa(r|mos)? (voces |eles |a gente |o outro )?ganhar\b', 4),
        (r'\bnao (vamos |iremos |vou )?(participar|disputar|concorrer|cotar)\b', 3),
        (r'\bdesist(ir|imos|encia|iu)\b', 2),
        (r'\bcobertura\b', 1),
        (r'\b(compensac\w+|subcontrat\w+)\b', 1),
        (r'\b(licitac\w+|pregao|pregoes|certame|edital|concorrencia publica)\b', 1),
    ],
    'Fixação de preços e condições': [
        (r'\bfix(ar|amos|acao|ado|ados) (o |os |de )?precos?\b', 4),
        (r'\btabela (de precos?|unica|comum)\b', 3),
        (r'\bpreco (minimo|combinado|acertado|de referencia do grupo)\b', 3),
        (r'\b(manter|segurar|nao baixar|nao reduzir) (o |os |nosso |nossos )?precos?\b', 3),
        (r'\b(reajuste|aumento) (conjunto|combinado|de todos|linear)\b', 3),
        (r'\bdesconto maximo\b', 2),
        (r'\bmargem\b', 1),
        (r'\breajuste\b', 1),
    ],
    'Divisão de mercado, clientes ou lotes': [
        (r'\bdivisao (de |do |dos |das )?(mercado|clientes|regioes|territorios?|lotes|contratos|obras)\b', 4),
        (r'\bdividir (o |os |as )?(mercado|clientes|lotes|regioes|contratos|obras)\b', 4),
        (r'\bnao (atender|atacar|entrar|prospectar) (no|na|nos|nas|o|a|os|as) (cliente|regiao|territorio|area)\w*\b', 3),
        (r'\b(cliente|regiao|area|lote) (de voces|deles|da outra|do outro|dele)\b', 2),
        (r'\bterritori\w+\b', 1),
    ],
    'Troca de informação sensível': [
        (r'\bnossa proposta (sera|vai ser|fica|ficara)\b', 3),
        (r'\bvamos (entrar|cotar|ofertar|dar lance) com\b', 3),
        (r'\bqual (vai ser |sera )?(o |a )?(seu |sua |teu |tua )?(preco|proposta|lance|desconto)\b', 3),
        (r'\b(planilha|estrutura|composicao) de custos?\b', 2),
        (r'\b(capacidade|volume|carteira) (de|dos) clientes?\b', 1),
    ],
    'Coordenação entre concorrentes': [
        (r'\bconforme (combinado|acertado|conversado|alinhado)\b', 3),
        (r'\b(conluio|cartel|clube)\b', 3),
        (r'\b(combinad|acertad)[oa]s?\b', 2),
        (r'\b(alinhad[oa]s?|alinhamento|alinhar)\b', 1),
        (r'\b(acordo|ajuste|entendimento) entre\b', 2),
        (r'\bconcorrentes?\b', 1),
    ],
    'Sigilo e ocultação': [
        (r'\b(apague|apagar|delete|deletar|destrua|destruir) (este|esse|essa|esta|a|o)\b', 4),
        (r'\bnao (comente|comentar|repasse|repassar|encaminhe|encaminhar|divulgue)\b', 2),
        (r'\bnao (por|pelo) e-?mail\b', 3),
        (r'\b(por|pelo) (telefone|celular|whats\w*|zap|signal|telegram)\b', 2),
        (r'\b(e-?mail|celular|telefone|numero) (pessoal|particular)\b', 2),
        (r'\b(pessoalmente|ao vivo|fora do escritorio)\b', 1),
        (r'\b(confidencial|sigiloso|reservado)\b', 1),
    ],
    'Encontros e contatos': [
        (r'\breuni(ao|oes|r|mos|ram)\b', 1),
        (r'\b(cafe|almoco|jantar|happy hour|encontro)\b', 1),
        (r'\b(associacao|sindicato|entidade de classe)\b', 1),
    ],
}
MOST_PER_TERM = 5
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CHAT = r"^\[?(\d{1,2})/(\d{1,2})/(\d{2,4}),?\s+(\d{1,2}):(\d{2})(?::\d{2})?\]?\s*(?:-\s*)?([^:\n]{2,60}?):\s+(.*)$"
GENERIC_DOMAINS = ['gmail.com', 'hotmail.com', 'outlook.com', 'yahoo.com', 'yahoo.com.br', 'uol.com.br', 'bol.com.br', 'terra.com.br', 'icloud.com', 'live.com', 'msn.com', 'ig.com.br']
STOPWORDS = (
    "a o as os um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sob sobre entre ate e ou que qual quais "
    "quem quando onde como porque se ja nao mais menos muito muita foi foram ser sao era eram tem teve ha houve isso isto esse essa este esta "
    "aquele aquela seu sua seus suas"
).split()


def _accents() -> tuple[str, str]:
    """Letters with marks and the letters that they are without, by the names that Unicode gives them."""
    pairs = []
    for code in range(0xC0, 0x2200):
        letter, first = chr(code), chr(code)
        while (parts := unicodedata.decomposition(first)) and not parts.startswith("<"):
            head, *marks = (chr(int(x, 16)) for x in parts.split())
            if any(not unicodedata.combining(m) for m in marks):
                break
            first = head
        if first != letter and not unicodedata.combining(first):
            pairs.append((letter, first))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(c: str) -> str:
    return f"lower(translate({c}, '{ACCENTED}', '{PLAIN}'))"


def tokens(c: str) -> str:
    return rf"regexp_extract_all({fold(c)}, '[\p{{L}}\p{{N}}]+')"


def clean_breaks(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t\x{{00A0}}]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{00A0}}\x{{0085}}\v]+|[\s\x{{00A0}}\x{{0085}}\v]+$', '', 'g')"


def unhyphenate(c: str) -> str:
    return rf"regexp_replace({c}, '([\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])-[ \t]*\n(?:[ \t]*\n)?[ \t]*([\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])', '\1\2', 'g')"


def name_key(c: str) -> str:
    return rf"array_to_string(regexp_extract_all(regexp_replace({fold(c)}, '\bs\s*[./]?\s*a\b\.?', ' sa ', 'g'), '[a-z0-9]+'), ' ')"


def joined_words(c: str) -> str:
    """A text in small letters without accents, its words cut at line ends in one piece."""
    return rf"strip_accents(lower(regexp_replace({c}, '([\p{{L}}\p{{N}}])-[ \t]*\n[ \t]*([\p{{L}}\p{{N}}])', '\1\2', 'g')))"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


LEXICON = "lexico(categoria, padrao, peso) AS (VALUES " + ", ".join(f"({_q(c)}, {_q(p)}, {w})" for c, all_ in TERMS.items() for p, w in all_) + ")"
COUNTS = f"""dobrado AS (SELECT doc_id, {fold("text")} AS d FROM documents WHERE text IS NOT NULL),
achados_ AS (SELECT doc_id, categoria, padrao, peso, len(regexp_extract_all(d, padrao)) AS n FROM dobrado, lexico),
termos AS (SELECT doc_id, categoria, padrao, n, least(n, {MOST_PER_TERM}) * peso AS pontos FROM achados_ WHERE n > 0)"""
PAGES = "paginas_ AS (SELECT * FROM paginas WHERE pagina_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pagina_id ORDER BY extraido_em) = 1)"
FILES = "arquivos_ AS (SELECT * FROM arquivos WHERE documento_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY documento_id ORDER BY extraido_em DESC) = 1)"
FINDINGS = "achados_ AS (SELECT * FROM achados WHERE achado_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY achado_id ORDER BY criado_em, documento_id) = 1)"


def _values() -> str:
    parts = " UNION ALL ".join(f"SELECT documento_id, '{k}' AS tipo, unnest({k}) AS x FROM entidades_" for k in ("cnpjs", "cpfs", "emails", "valores"))
    return f"""entidades_ AS (SELECT * FROM entidades WHERE documento_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entidade_id ORDER BY extraido_em) = 1),
itens AS ({parts}), paginas_x AS (SELECT documento_id, tipo, x.valor AS valor, unnest(CASE WHEN len(x.paginas) > 0 THEN x.paginas ELSE [NULL] END) AS p FROM itens WHERE x.valor IS NOT NULL),
valores_ AS (SELECT documento_id, tipo, valor, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)) AS paginas FROM paginas_x GROUP BY ALL)"""


def _bm25_pages(limit: int) -> str:
    """The best pages for the words that the page queries ask for, with their key as `chave`."""
    return f"""palavras AS (SELECT pagina_id AS chave, {tokens(unhyphenate("texto"))} AS w FROM paginas_ WHERE texto IS NOT NULL),
estat AS (SELECT count(*) AS textos, avg(len(w)) AS media FROM palavras),
hits AS (SELECT chave, len(w) AS tamanho, t.termo, len(list_filter(w, lambda x: x = t.termo)) AS tf FROM palavras, (VALUES ('almoxarifado'), ('vistoria')) t(termo)),
df AS (SELECT termo, count(*) AS df FROM hits WHERE tf > 0 GROUP BY termo),
melhores AS (SELECT chave, sum(greatest(ln((textos - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tamanho / media))) AS pontos
 FROM hits JOIN df USING (termo), estat WHERE tf > 0 GROUP BY chave ORDER BY pontos DESC, chave LIMIT {limit})"""


def _bm25(limit: int) -> str:
    return f"""palavras AS (SELECT doc_id, {tokens(unhyphenate("text"))} AS w FROM documents WHERE text IS NOT NULL),
estat AS (SELECT count(*) AS textos, avg(len(w)) AS media FROM palavras),
hits AS (SELECT doc_id, len(w) AS tamanho, t.termo, len(list_filter(w, lambda x: x = t.termo)) AS tf FROM palavras, (VALUES ('fianca'), ('vistoria'), ('cronograma')) t(termo)),
df AS (SELECT termo, count(*) AS df FROM hits WHERE tf > 0 GROUP BY termo),
melhores AS (SELECT doc_id, sum(greatest(ln((textos - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tamanho / media))) AS pontos
 FROM hits JOIN df USING (termo), estat WHERE tf > 0 GROUP BY doc_id ORDER BY pontos DESC, doc_id LIMIT {limit})"""


def _vectors(key: str = "vec_id", vector: str = "embedding", rows: str = "embeddings") -> str:
    asked = "[" + ", ".join("1.0" if i % 3 else "-0.5" for i in range(64)) + "]::DOUBLE[]"
    dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
    return f"""asked AS (SELECT {asked} AS q), vetores AS (SELECT {key}, {vector}::DOUBLE[] AS e FROM {rows} WHERE len({vector}) = 64 AND len(list_filter({vector}, lambda x: x IS NULL OR x = 0)) < 64),
perto AS (SELECT {key}, {dot("e", "q")} / (sqrt({dot("e", "e")}) * sqrt({dot("q", "q")})) AS s FROM vetores, asked WHERE {dot("e", "e")} > 0 ORDER BY s DESC, {key} LIMIT 50)"""


def _network() -> str:
    generic = ", ".join(_q(d) for d in GENERIC_DOMAINS)
    return f"""m AS (SELECT * FROM mensagens WHERE mensagem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mensagem_id ORDER BY recebido_em) = 1),
men AS (SELECT mensagem_id, 'de' AS papel, de.nome AS nome, lower(de.endereco) AS endereco FROM m
 UNION ALL SELECT mensagem_id, 'para', p.nome, lower(p.endereco) FROM (SELECT mensagem_id, unnest(para) AS p FROM m)
 UNION ALL SELECT mensagem_id, 'cc', p.nome, lower(p.endereco) FROM (SELECT mensagem_id, unnest(cc) AS p FROM m)),
mk AS (SELECT *, {name_key("coalesce(nome, '')")} AS chave FROM men), mkf AS (SELECT * FROM mk WHERE chave <> '' OR endereco <> ''),
visto AS (SELECT chave, arg_min(endereco, (mensagem_id, endereco)) AS achado FROM mkf WHERE endereco <> '' AND chave <> '' GROUP BY chave),
ident AS (SELECT mkf.*, coalesce(CASE WHEN endereco <> '' THEN endereco END, achado, chave) AS pessoa FROM mkf LEFT JOIN visto USING (chave)),
env AS (SELECT DISTINCT mensagem_id, pessoa AS de_ FROM ident WHERE papel = 'de'),
pes AS (SELECT pessoa, list_sort(list(DISTINCT nome) FILTER (trim(nome) <> '')) AS nomes,
 max(CASE WHEN split_part(endereco, '@', 2) <> '' AND split_part(endereco, '@', 2) NOT IN ({generic}) THEN split_part(endereco, '@', 2) END) AS organizacao FROM ident GROUP BY pessoa),
rec AS (SELECT i.pessoa, count(DISTINCT mensagem_id) AS recebidas FROM (SELECT DISTINCT mensagem_id, pessoa FROM ident WHERE papel <> 'de') i LEFT JOIN env USING (mensagem_id) WHERE de_ IS NULL OR de_ <> i.pessoa GROUP BY 1),
para_ AS (SELECT mensagem_id, pessoa, min(CASE WHEN papel = 'cc' THEN 1 ELSE 0 END) = 1 AS copia FROM ident WHERE papel <> 'de' GROUP BY ALL),
elos AS (SELECT mensagem_id, least(de_, pessoa) AS a, greatest(de_, pessoa) AS b, copia FROM para_ JOIN env USING (mensagem_id) WHERE de_ <> pessoa),
pares AS (SELECT a, b, count(*) AS total, count(*) FILTER (copia) AS copias, min(CASE WHEN data <> '' THEN data END) AS primeira, max(CASE WHEN data <> '' THEN data END) AS ultima,
 count(DISTINCT documento_id) AS documentos FROM elos JOIN m USING (mensagem_id) GROUP BY a, b),
cruz AS (SELECT pares.*, x.organizacao AS org_a, y.organizacao AS org_b, coalesce(x.organizacao <> y.organizacao, false) AS cruzada FROM pares LEFT JOIN pes x ON a = x.pessoa LEFT JOIN pes y ON b = y.pessoa)"""


def _headers(texts: str) -> str:
    """The header blocks of the texts (k, t) of a table as `blocos` (k, ordem, de, para, cc, data_bruta, assunto)."""
    field = _q(r"(?i)^\s*(enviado em|enviada em|assunto|enviado|subject|para|from|sent|data|date|de|to|cc)\s*:\s*(.*)$")
    value = lambda c: f"arg_min(valor, i) FILTER (campo = '{c}' AND valor <> '')"
    return f"""hl AS (SELECT k, string_split(t, chr(10)) AS ls FROM {texts} WHERE t IS NOT NULL), hz AS (SELECT k, unnest(list_zip(range(0, len(ls)), ls, list_slice(ls, 2, len(ls)))) AS z FROM hl),
hf AS (SELECT k, CAST(z[1] AS INT) AS i, z[2] AS l, z[3] AS prox, lower(regexp_extract(z[2], {field}, 1)) AS nome, trim(rtrim(regexp_extract(z[2], {field}, 2), chr(13))) AS dito FROM hz WHERE regexp_matches(z[2], {field})),
hb AS (SELECT *, dito = '' AND prox IS NOT NULL AND NOT coalesce(regexp_matches(prox, {field}), false) AS abaixo FROM hf),
hv AS (SELECT k, i, i + abaixo::INT AS fim, CASE WHEN nome IN ('de', 'from') THEN 'de' WHEN nome IN ('para', 'to') THEN 'para' WHEN nome = 'cc' THEN 'cc' WHEN nome IN ('assunto', 'subject') THEN 'assunto' ELSE 'data' END AS campo, CASE WHEN abaixo THEN trim(rtrim(prox, chr(13))) ELSE dito END AS valor FROM hb),
hg AS (SELECT *, coalesce(i - lag(fim) OVER (PARTITION BY k ORDER BY i) > 4, true)::INT AS novo FROM hv), hs AS (SELECT *, sum(novo) OVER (PARTITION BY k ORDER BY i) AS g FROM hg),
hd AS (SELECT *, greatest(sum((campo = 'de' AND valor <> '')::INT) OVER (PARTITION BY k, g ORDER BY i), 1) AS b FROM hs),
hx AS (SELECT k, g, b, {value("de")} AS de, {value("para")} AS para, {value("cc")} AS cc, {value("data")} AS data_bruta, {value("assunto")} AS assunto FROM hd GROUP BY k, g, b),
blocos AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY g, b) AS INT) AS ordem, de, para, cc, data_bruta, assunto FROM hx WHERE de IS NOT NULL AND (data_bruta IS NOT NULL OR assunto IS NOT NULL))"""


#: Kinds of communication by the wording of their beginning, in order.
KINDS = {
    "transcrição de conversa": r"\btranscri(cao|coes)\b|\binterlocutor(es)?\b|\b(ligacao|dialogo|conversa) telefonic",
    "ata de reunião": r"\bata\b.{0,60}\breuniao\b|\bata da\b.{0,40}\b(reuniao|assembleia)\b|\b(presentes|participantes)\s*:",
    "memorando": r"\bmemorando\b|\bcomunicacao interna\b|\bmemo\s*n",
    "carta ou ofício": r"\b(prezad[oa]s?|ilustrissim[oa]|caro senhor|cara senhora)\b",
    "fax": r"\bfax\b.{0,40}\b(de|para|n[o.]?|pagina)",
}
CLOSING = r"\b(atenciosamente|cordialmente|respeitosamente|saudacoes)\b"
CONTRACT_TITLE = r"\b(contrato|termo aditivo|aditivo contratual|instrumento particular|termo de compromisso|acordo de (cooperacao|parceria|consorcio|acionistas|cotistas)|compromisso de constituicao de consorcio)\b"
CONTRACT_SIGNS = r"\b(contratante|contratada|clausula|partes contratantes|objeto do contrato|vigencia)\b"


def _digits(kind: str) -> str:
    """Whether the check digits of `valor` hold."""
    if kind == "cpf":
        d = r"regexp_replace(valor, '\D', '', 'g')"
        digit = lambda n: f"((list_sum(list_transform(range(1, {n + 1}), lambda i: ({n + 2} - i) * CAST(substr({d}, i, 1) AS INT))) * 10) % 11) % 10 = CAST(substr({d}, {n + 1}, 1) AS INT)"
        return f"(length({d}) = 11 AND {d} <> repeat(substr({d}, 1, 1), 11) AND {digit(9)} AND {digit(10)})"
    s = "regexp_replace(upper(valor), '[./-]', '', 'g')"

    def digit(weights: list[int]) -> str:
        n = len(weights)
        total = f"(list_sum(list_transform(range(1, {n + 1}), lambda i: ({weights})[i] * (ord(substr({s}, i, 1)) - 48))) % 11)"
        return f"(CASE WHEN {total} < 2 THEN 0 ELSE 11 - {total} END) = CAST(substr({s}, {n + 1}, 1) AS INT)"

    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return rf"(CASE WHEN regexp_full_match({s}, '[0-9A-Z]{{12}}\d{{2}}') AND {s} <> repeat(substr({s}, 1, 1), 14) THEN {digit(first)} AND {digit([6, *first])} ELSE false END)"


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(_q(w) for w in STOPWORDS)
    email = EMAIL.replace("'", "''")
    chat = _q(CHAT)
    group = lambda k: f"regexp_extract(l, {chat}, {k})"
    chat_rows = rf"""linhas AS (SELECT documento_id, n, unnest(list_zip(range(1, len(string_split(texto, chr(10))) + 1), string_split(texto, chr(10)))) AS z FROM paginas_ WHERE texto IS NOT NULL),
falas AS (SELECT documento_id, n, CAST(z[1] AS INT) AS linha, trim(z[2]) AS l FROM linhas)"""
    found = {
        "triage_lexicon_rank": f"WITH {LEXICON}, {COUNTS}, p AS (SELECT doc_id, sum(pontos) AS s FROM termos GROUP BY doc_id) SELECT doc_id, CAST(coalesce(s, 0) AS BIGINT) AS pontos, row_number() OVER (ORDER BY coalesce(s, 0) DESC, doc_id) AS posicao FROM documents LEFT JOIN p USING (doc_id)",
        "triage_density": f"WITH {LEXICON}, {COUNTS}, p AS (SELECT doc_id, sum(pontos) AS s FROM termos GROUP BY doc_id), w AS (SELECT doc_id, len({words("coalesce(text, '')")}) AS palavras FROM documents) SELECT doc_id, CAST(palavras AS INT) AS palavras, CAST(round(CAST(coalesce(s, 0) AS DOUBLE) * 1000.0 / greatest(palavras, 1), 1) AS DOUBLE) AS densidade FROM w LEFT JOIN p USING (doc_id)",
        "triage_category_totals": f"WITH {LEXICON}, {COUNTS} SELECT categoria, count(DISTINCT doc_id) AS textos, CAST(sum(pontos) AS BIGINT) AS pontos FROM termos GROUP BY categoria",
        "text_fold": f"SELECT doc_id, length({fold('text')}) AS tamanho, md5({fold('text')}) AS resumo FROM documents",
        "text_clean_breaks": f"WITH {PAGES} SELECT pagina_id, md5({clean_breaks('texto')}) AS resumo FROM paginas_",
        "text_unhyphenate": f"WITH {PAGES} SELECT pagina_id, md5({unhyphenate('texto')}) AS resumo FROM paginas_",
        "text_tokens": f"SELECT termo, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS termo FROM documents) GROUP BY termo",
        "name_keys": f"SELECT DISTINCT nome, {name_key('nome')} AS chave FROM achados WHERE nome IS NOT NULL",
        "question_keywords": rf"SELECT DISTINCT assunto, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL), ' OU ') AS consulta FROM (SELECT assunto, list_filter(regexp_extract_all(assunto, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4 AND {fold('x')} NOT IN ({stop})) AS w FROM mensagens WHERE assunto IS NOT NULL)",
        "entity_emails": f"SELECT doc_id, email, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{email}'))) AS email FROM documents) GROUP BY ALL",
        "entity_amounts": rf"""WITH {PAGES}, v AS (SELECT pagina_id, unnest(regexp_extract_all(texto, '(?i)R\$\s?(?:\d{{1,3}}(?:\.\d{{3}})+|\d+)(?:,\d{{1,2}})?(?:\s*(?:mil|milh[aã]o|milh[oõ]es|bilh[aã]o|bilh[oõ]es|mi|bi)\b)?')) AS r FROM paginas_),
 p AS (SELECT pagina_id, CAST(replace(regexp_extract(r, '(?i)R\$\s?(\d{{1,3}}(?:\.\d{{3}})+|\d+)', 1), '.', '') AS DECIMAL(30,2)) + CAST(rpad(regexp_extract(r, ',(\d{{1,2}})', 1), 2, '0') AS DECIMAL(30,2)) / 100 AS x, lower(regexp_extract(r, '(?i)\s*(mil|milh[aã]o|milh[oõ]es|bilh[aã]o|bilh[oõ]es|mi|bi)$', 1)) AS u FROM v)
 SELECT pagina_id, count(*) AS n, CAST(sum(x * CASE WHEN u LIKE 'bi%' THEN 1000000000 WHEN u = 'mil' THEN 1000 WHEN u LIKE 'mi%' THEN 1000000 ELSE 1 END) AS DOUBLE) AS total FROM p GROUP BY pagina_id""",
        "entity_ids_validated": f"WITH {_values()} SELECT DISTINCT tipo, valor, CASE WHEN tipo = 'cpfs' THEN {_digits('cpf')} ELSE {_digits('cnpj')} END AS valido FROM valores_ WHERE tipo IN ('cpfs', 'cnpjs')",
        "entity_values": f"WITH {_values()} SELECT documento_id, tipo, valor, coalesce(array_to_string(paginas, ','), '') AS paginas FROM valores_",
        "entity_directory": f"WITH {_values()} SELECT tipo, valor, count(DISTINCT documento_id) AS documentos, array_to_string(list_slice(list_sort(list(DISTINCT documento_id)), 1, 8), ', ') AS lugares FROM valores_ GROUP BY tipo, valor",
        "mail_domains": f"WITH c AS (SELECT DISTINCT ON (pessoa_id) * FROM comunicacoes WHERE endereco IS NOT NULL), d AS (SELECT lower(split_part(endereco, '@', 2)) AS d FROM c) SELECT CASE WHEN d <> '' AND d NOT IN ({', '.join(_q(x) for x in GENERIC_DOMAINS)}) THEN d END AS organizacao, count(*) AS pessoas FROM d GROUP BY 1",
        "ocr_policy": f"WITH {PAGES} SELECT pagina_id, CASE WHEN coalesce(caracteres, 0) < 200 THEN 'pouco texto digital' WHEN cobertura_imagem >= 0.5 AND caracteres < 1500 THEN 'imagem cobre a página' END AS motivo FROM paginas_",
        "export_coverage": f"WITH {PAGES}, c AS (SELECT documento_id, count(*) AS paginas, count(*) FILTER (metodo IN ('texto_digital', 'html', 'texto')) AS digitais, count(*) FILTER (metodo = 'ocr') AS ocr FROM paginas_ WHERE documento_id IS NOT NULL GROUP BY 1) SELECT documento_id, paginas, digitais, ocr, round((digitais + ocr) / paginas::DOUBLE, 4) AS cobertura, paginas - digitais - ocr AS invisiveis FROM c",
        "export_doubtful": f"WITH {PAGES} SELECT pagina_id, documento_id, n, confianca_media, ocr_palavras FROM paginas_ WHERE metodo = 'ocr' AND (confianca_media < 70 OR ocr_palavras < 20)",
        "page_alerts": f"""WITH {PAGES}, c AS (SELECT documento_id, count(*) AS paginas, count(*) FILTER (metodo = 'ocr') AS paginas_ocr, min(CASE WHEN metodo = 'ocr' THEN confianca_media END) AS confianca_minima,
 count(*) FILTER (metodo = 'ocr' AND confianca_media < 70) AS baixa, count(*) FILTER (metodo = 'ocr' AND coalesce(caracteres, 0) < 20) AS vazias, count(*) FILTER (metodo = 'erro') AS erro FROM paginas_ WHERE documento_id IS NOT NULL GROUP BY 1)
 SELECT documento_id, paginas, paginas_ocr, confianca_minima, vazias, concat_ws('; ', CASE WHEN baixa > 0 THEN baixa || ' páginas com confiança baixa' END, CASE WHEN vazias > 0 THEN vazias || ' páginas de OCR quase vazias' END, CASE WHEN erro > 0 THEN erro || ' páginas com erro' END) AS alertas,
 CASE WHEN erro = paginas THEN 'erro' WHEN erro > 0 THEN 'parcial' ELSE 'ok' END AS situacao FROM c""",
        "text_file_pages": r"WITH t AS (SELECT doc_id, len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS k FROM documents WHERE text <> ''), p AS (SELECT doc_id, k, unnest(range(1, CAST(ceil(k / 10.0) AS INT) + 1)) AS n FROM t) SELECT doc_id, CAST(n AS INT) AS n, CAST((n - 1) * 10 + 1 AS INT) AS primeira, CAST(least(n * 10, k) AS INT) AS ultima FROM p",
        "passages_windows": f"WITH t AS (SELECT doc_id, len({words('text')}) AS k FROM documents), p AS (SELECT doc_id, k, unnest(range(0, greatest(CAST(ceil((k - 50) / 42.0) AS INT), 0) + 1)) AS i FROM t WHERE k > 0) SELECT doc_id, CAST(i + 1 AS INT) AS n, CAST(least(50, k - i * 42) AS INT) AS palavras FROM p",
        "bm25_search_topk": f"WITH {_bm25(200)} SELECT doc_id, round(pontos, 6) AS pontos FROM melhores",
        "boolean_phrase_prefix_search": f"WITH p AS (SELECT doc_id, ' ' || array_to_string({tokens(unhyphenate('text'))}, ' ') || ' ' AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM p WHERE (contains(w, ' carta de fianca ') AND contains(w, ' atestad')) OR contains(w, ' tabela de descontos ')",
        "substring_search": "SELECT doc_id FROM documents WHERE contains(text, 'carta de fiança')",
        "search_statistics": f"SELECT count(*) AS textos, round(avg(len({tokens(unhyphenate('text'))})), 6) AS media FROM documents WHERE text IS NOT NULL",
        "vector_topk": f"WITH {_vectors()} SELECT vec_id, round(s, 6) AS similaridade FROM perto",
        "hybrid_rrf": f"""WITH {PAGES}, {FILES}, {_bm25_pages(50)}, passagens_ AS (SELECT DISTINCT ON (passagem_id) * FROM passagens WHERE passagem_id IS NOT NULL AND documento_id IS NOT NULL AND pagina IS NOT NULL), {_vectors("passagem_id", "vetor", "passagens_")},
 l AS (SELECT documento_id, n AS pagina, min(k) AS k, 'palavra' AS o FROM (SELECT chave, row_number() OVER (ORDER BY pontos DESC, chave) AS k FROM melhores) JOIN paginas_ ON chave = pagina_id GROUP BY 1, 2
  UNION ALL SELECT documento_id, pagina, min(k), 'significado' FROM (SELECT passagem_id, row_number() OVER (ORDER BY s DESC, passagem_id) AS k FROM perto) JOIN passagens_ USING (passagem_id) GROUP BY 1, 2),
 f AS (SELECT documento_id, pagina, sum(1.0::DOUBLE / (60 + k)) AS pontos, array_to_string(list_sort(list(DISTINCT o)), '+') AS origens FROM l WHERE k <= 50 GROUP BY 1, 2)
 SELECT documento_id, pagina, nome, round(pontos, 9) AS pontos, origens FROM f JOIN arquivos_ USING (documento_id) ORDER BY f.pontos DESC, documento_id, pagina LIMIT 20""",
        "vector_status": "SELECT count(DISTINCT documento_id) AS documentos, count(*) AS passagens FROM (SELECT DISTINCT ON (passagem_id) * FROM passagens WHERE vetor IS NOT NULL)",
        "vector_stale": "SELECT passagem_id FROM (SELECT DISTINCT ON (passagem_id) * FROM passagens) p WHERE NOT EXISTS (SELECT 1 FROM entidades e WHERE e.documento_id = p.documento_id)",
        "vector_pending": "WITH p AS (SELECT DISTINCT ON (passagem_id) * FROM passagens) SELECT passagem_id FROM p WHERE passagem_id NOT IN (SELECT passagem_id FROM p WHERE vetor IS NOT NULL AND modelo = 'vetor-b')",
        "network_people": f"WITH {_network()} SELECT pessoa, coalesce(list_sort(list_transform(nomes, lambda x: {{'l': -length(x), 'n': x}}))[1].n, pessoa) AS rotulo, organizacao, coalesce(e.enviadas, 0) AS enviadas, coalesce(recebidas, 0) AS recebidas, CAST(coalesce(len(nomes), 0) AS INT) AS nomes FROM pes LEFT JOIN (SELECT de_ AS pessoa, count(*) AS enviadas FROM env GROUP BY 1) e USING (pessoa) LEFT JOIN rec USING (pessoa)",
        "network_pairs": f"WITH {_network()} SELECT a, b, total, copias, primeira, ultima, documentos, cruzada FROM cruz",
        "network_organisations": f"WITH {_network()} SELECT least(org_a, org_b) AS org_a, greatest(org_a, org_b) AS org_b, CAST(sum(total) AS BIGINT) AS mensagens, count(*) AS pares FROM cruz WHERE cruzada GROUP BY 1, 2",
        "chat_lines": rf"""WITH {PAGES}, {chat_rows} SELECT documento_id, n, linha, trim({group(6)}) AS autor, (CASE WHEN length({group(3)}) = 2 THEN '20' || {group(3)} ELSE lpad({group(3)}, 4, '0') END) || '-' || lpad({group(2)}, 2, '0') || '-' || lpad({group(1)}, 2, '0') || 'T' || lpad({group(4)}, 2, '0') || ':' || {group(5)} AS data FROM falas WHERE regexp_matches(l, {chat})""",
        "findings_first": f"WITH {FINDINGS} SELECT achado_id, caso_id, nome, criado_em FROM achados_",
        "findings_reviewed": f"WITH {FINDINGS}, r AS (SELECT achado_id, arg_max(situacao, criado_em) AS s FROM achados WHERE situacao IN ('validado', 'rejeitado', 'pendente') GROUP BY 1) SELECT tipo, coalesce(s, 'pendente') AS revisao, count(*) AS n FROM achados_ LEFT JOIN r USING (achado_id) GROUP BY ALL",
        "dramatis_personae": f"""WITH {FINDINGS}, k AS (SELECT *, {name_key('nome')} AS chave FROM achados_ WHERE tipo = 'pessoas' AND trim(nome) <> '' AND coalesce(situacao, 'pendente') = 'validado'),
 s AS (SELECT chave, nome, count(*) AS n FROM k WHERE chave <> '' GROUP BY ALL), d AS (SELECT chave, count(DISTINCT documento_id) AS documentos FROM k GROUP BY 1)
 SELECT chave, arg_min(nome, (-n, nome)) AS nome, CAST(count(*) AS INT) AS grafias, CAST(sum(n) AS BIGINT) AS achados, any_value(documentos) AS documentos FROM s JOIN d USING (chave) GROUP BY chave""",
        "firms_consolidated": rf"""WITH {FINDINGS}, {_values()}, c AS (SELECT documento_id, min(valor) AS cnpj FROM valores_ WHERE tipo = 'cnpjs' GROUP BY 1 HAVING count(DISTINCT valor) = 1),
 f AS (SELECT DISTINCT nome, cnpj FROM achados_ LEFT JOIN c USING (documento_id) WHERE tipo = 'empresas' AND trim(nome) <> ''),
 k AS (SELECT nome, {name_key('nome')} AS k, nullif(regexp_replace(upper(coalesce(cnpj, '')), '[^0-9A-Z]', '', 'g'), '') AS num FROM f),
 u AS (SELECT k, min(num) AS achado FROM k WHERE num IS NOT NULL AND k <> '' GROUP BY k HAVING count(DISTINCT num) = 1)
 SELECT coalesce(num, achado, k) AS chave, max(num) AS cnpj, CAST(count(DISTINCT nome) AS INT) AS grafias FROM k LEFT JOIN u USING (k) WHERE coalesce(num, achado, k) <> '' GROUP BY 1""",
        "findings_timeline": f"WITH {FINDINGS} SELECT achado_id, strftime(criado_em, '%Y-%m-%d') AS data, localizador FROM achados_ WHERE tipo = 'eventos'",
        "status_rollups": "SELECT tipo, coalesce(situacao, 'pendente') AS situacao, count(*) AS n FROM achados GROUP BY ALL",
        "latest_overlay": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
        "dedup_by_content_hash": "WITH h AS (SELECT sha256(coalesce(text, '')) AS sha256, CAST(doc_id AS VARCHAR) AS caminho FROM documents) SELECT sha256, substr(sha256, 1, 16) AS documento_id, min(caminho) AS caminho, count(*) AS copias FROM h GROUP BY sha256",
        "incremental_pending": "SELECT DISTINCT sha256 FROM arquivos WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM arquivos WHERE versao_extrator = '1.2' AND coalesce(situacao, '') <> 'erro' AND sha256 IS NOT NULL)",
        "orphan_archive": "SELECT DISTINCT documento_id FROM arquivos a WHERE NOT EXISTS (SELECT 1 FROM entidades e WHERE e.documento_id = a.documento_id)",
        "manifest_full_outer": rf"""WITH {PAGES}, {FILES}, r AS (SELECT documento_id, sha256(string_agg(coalesce(texto, ''), chr(12) ORDER BY n, pagina_id)) AS x, sha256(string_agg({clean_breaks("coalesce(texto, '')")}, chr(12) ORDER BY n, pagina_id)) AS y FROM paginas_ WHERE documento_id IS NOT NULL GROUP BY 1),
 j AS (SELECT documento_id AS caminho, x, y, coalesce(tipo, '') <> 'txt' AS antes, coalesce(situacao, '') <> 'erro' AS depois FROM arquivos_ LEFT JOIN r USING (documento_id))
 SELECT caminho, CASE WHEN NOT depois THEN 'original ausente' WHEN NOT antes THEN 'arquivo novo' ELSE 'extração alterada' END AS problema FROM j WHERE (antes OR depois) AND (NOT antes OR NOT depois OR x IS DISTINCT FROM y)""",
        "import_plan": rf"""WITH {FILES}, s AS (SELECT nome AS caminho, min(sha256) AS sha256 FROM arquivos_ WHERE sha256 IS NOT NULL GROUP BY 1), t AS (SELECT nome AS caminho, max(sha256) AS t FROM arquivos_ WHERE sha256 IS NOT NULL AND tipo = 'pdf' GROUP BY 1),
 j AS (SELECT caminho, sha256, CASE WHEN starts_with(lower(caminho), '~$') OR starts_with(caminho, '.') OR lower(caminho) IN ('thumbs.db', 'desktop.ini') THEN 'ignorar' WHEN t IS NULL THEN 'copiar' WHEN t = sha256 THEN 'identico' ELSE 'renomear' END AS acao FROM s LEFT JOIN t USING (caminho))
 SELECT caminho, sha256, acao, CASE acao WHEN 'renomear' THEN regexp_replace(caminho, '(\.[^./]*)?$', ' (2)\1') WHEN 'copiar' THEN caminho END AS destino FROM j""",
        "run_summary": f"WITH {FILES} SELECT coalesce(situacao, 'desconhecida') AS situacao, count(*) AS documentos FROM arquivos_ GROUP BY 1",
        "report_overview": "SELECT (SELECT count(DISTINCT documento_id) FROM arquivos) AS documentos, p.paginas, p.paginas_ocr, m.mensagens, m.sem_data FROM (SELECT count(*) AS paginas, count(*) FILTER (metodo = 'ocr') AS paginas_ocr FROM (SELECT DISTINCT ON (pagina_id) * FROM paginas)) p, (SELECT count(*) AS mensagens, count(*) FILTER (coalesce(trim(data), '') = '') AS sem_data FROM (SELECT DISTINCT ON (mensagem_id) * FROM mensagens)) m",
        "model_duration": f"SELECT count(*) AS trechos, round(coalesce(sum(len({words('text')})), 0) * 1.9 / 50.0 + count(*) * 400 / 5.0, 1) AS segundos FROM documents",
        "triage_full": rf"""WITH {LEXICON}, {COUNTS}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, categoria, sum(pontos) AS p FROM termos GROUP BY 1, 2),
 s AS (SELECT doc_id, sum(p) AS p, arg_max(categoria, (p, categoria)) AS categoria FROM c GROUP BY 1),
 f AS (SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{EMAIL}'), lambda x: lower(split_part(x, '@', 2))), lambda x: x NOT IN ({", ".join(_q(d) for d in GENERIC_DOMAINS)})))) AS dominios,
  len({words("t")}) AS palavras FROM d), v AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9A-Z]{{2}}\.[0-9A-Z]{{3}}\.[0-9A-Z]{{3}}/[0-9A-Z]{{4}}-\d{{2}}')) AS valor FROM d),
 n AS (SELECT doc_id, count(DISTINCT valor) AS firmas FROM v WHERE {_digits("cnpj")} GROUP BY 1),
 j AS (SELECT doc_id, coalesce(p, 0) + CASE WHEN coalesce(firmas, 0) >= 2 THEN 3 ELSE 0 END + CASE WHEN dominios >= 2 THEN 2 ELSE 0 END AS pontos, palavras, categoria, coalesce(firmas, 0) AS firmas, dominios FROM f LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id))
 SELECT doc_id, CAST(pontos AS BIGINT) AS pontos, CAST(palavras AS INT) AS palavras, CAST(round(CAST(pontos AS DOUBLE) * 1000.0 / greatest(palavras, 1), 1) AS DOUBLE) AS densidade, categoria, CAST(firmas AS INT) AS firmas, CAST(dominios AS INT) AS dominios, row_number() OVER (ORDER BY pontos DESC, doc_id) AS posicao FROM j""",
        "lexicon_fingerprint": f"WITH {LEXICON} SELECT substr(sha256(array_to_string(list_sort(list(categoria || chr(31) || padrao || chr(31) || peso)), chr(10))), 1, 16) AS hash FROM lexico",
        "locators": rf"""WITH {PAGES}, {FILES}, p AS (SELECT documento_id, list_sort(list(DISTINCT n) FILTER (n IS NOT NULL)) AS ns FROM paginas_ WHERE documento_id IS NOT NULL GROUP BY 1),
 l AS (SELECT documento_id, nome, nome || CASE WHEN len(ns) = 0 THEN '' WHEN len(ns) = 1 THEN ', p. ' || ns[1] ELSE ', pp. ' || array_to_string(ns, ', ') END AS localizador FROM arquivos_ JOIN p USING (documento_id))
 SELECT documento_id, localizador, CASE WHEN contains(localizador, ', p. ') THEN regexp_replace(localizador, '^(.*), p\..*$', '\1') ELSE localizador END AS documento, regexp_replace(trim(regexp_replace(nome, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '[. ]+$', '') AS nome_seguro FROM l""",
        "links_and_paths": rf"""WITH {FILES}, c AS (SELECT documento_id, replace(caminhos[1], chr(92), '/') AS c FROM arquivos_)
 SELECT documento_id, array_to_string(list_transform(list_filter(string_split(c, '/'), lambda x: trim(x) NOT IN ('', '.', '..')), lambda x: regexp_replace(trim(regexp_replace(x, '[<>:"|?*\x00-\x1f]', '_', 'g')), '[. ]+$', '')), '/') AS seguro,
 array_to_string(list_transform(string_split(c, '/'), lambda x: url_encode(x)), '/') AS ligacao FROM c""",
        "corrections_overlay": f"""WITH {FINDINGS}, l AS (SELECT achado_id, arg_max(CASE WHEN literal THEN upper(cargo) ELSE '' END, criado_em) AS v, bool_or(true) AS tem FROM (SELECT *, row_number() OVER (PARTITION BY achado_id ORDER BY criado_em DESC) AS k FROM achados WHERE achado_id IS NOT NULL) WHERE k = 1 GROUP BY 1)
 SELECT achado_id, nome, nullif(trim(coalesce(v, '')), '') AS cargo, empresa FROM achados_ JOIN l USING (achado_id)""",
        "chat_adjacency_pairs": rf"""WITH {PAGES}, {chat_rows}, f AS (SELECT documento_id, n, linha, trim({group(6)}) AS autor, (CASE WHEN length({group(3)}) = 2 THEN '20' || {group(3)} ELSE lpad({group(3)}, 4, '0') END) || '-' || lpad({group(2)}, 2, '0') || '-' || lpad({group(1)}, 2, '0') || 'T' || lpad({group(4)}, 2, '0') || ':' || {group(5)} AS data FROM falas WHERE regexp_matches(l, {chat})),
 w AS (SELECT *, lag(autor) OVER (PARTITION BY documento_id ORDER BY n, linha) AS para FROM f) SELECT documento_id, n, linha, autor AS de, para, data FROM w WHERE {name_key("autor")} <> {name_key("para")}""",
        "export_texts": rf"""WITH {PAGES}, {FILES}, t AS (SELECT documento_id, regexp_replace(nome, '\.[^.]*$', '') AS alvo FROM arquivos_ WHERE nome IS NOT NULL),
 d AS (SELECT alvo, documento_id, string_agg(coalesce(texto, ''), chr(12) ORDER BY n, coalesce(texto, '')) AS x FROM paginas_ JOIN t USING (documento_id) GROUP BY 1, 2) SELECT alvo, count(*) AS documentos, md5(string_agg(x, chr(12) ORDER BY documento_id)) AS resumo FROM d GROUP BY 1""",
        "files_moved": "SELECT DISTINCT sha256 FROM (SELECT sha256, min(tipo) AS tipo, min(caminhos) AS c FROM arquivos WHERE sha256 IS NOT NULL GROUP BY 1) WHERE tipo = 'pdf' AND len(list_filter(c, lambda x: starts_with(x, 'originais/'))) > 0",
        "question_windows": f"""WITH q AS (SELECT list_transform(list_filter(['Quem', 'recebeu', 'carta', 'fiança', 'fornecedor'], lambda x: length(x) >= 4), lambda x: substr({fold("x")}, 1, 6)) AS q),
 w AS (SELECT doc_id, {words("text")} AS w FROM documents), h AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: list_contains(q, substr({fold("x")}, 1, 6))), true) AS h FROM w, q)
 SELECT doc_id, CASE WHEN w IS NOT NULL THEN array_to_string(list_slice(w, greatest(coalesce(h, 0) - 13, 1), greatest(coalesce(h, 0) - 13, 1) + 39), ' ') END AS janela FROM h""",
        "report_quality": rf"""WITH {PAGES}, {FILES}, c AS (SELECT documento_id, count(*) FILTER (metodo = 'ocr' AND confianca_media < 70) AS baixa, count(*) FILTER (metodo = 'ocr' AND coalesce(caracteres, 0) < 20) AS vazias, count(*) FILTER (metodo = 'erro') AS erro FROM paginas_ WHERE documento_id IS NOT NULL GROUP BY 1)
 SELECT documento_id, baixa || ' páginas com confiança baixa' AS problema FROM c WHERE baixa > 0 UNION SELECT documento_id, vazias || ' páginas de OCR quase vazias' FROM c WHERE vazias > 0 UNION SELECT documento_id, erro || ' páginas com erro' FROM c WHERE erro > 0
 UNION SELECT documento_id, unnest(alertas) FROM arquivos_ UNION SELECT documento_id, len(caminhos) || ' cópias' FROM arquivos_ WHERE len(caminhos) > 1 UNION SELECT documento_id, 'tipo não reconhecido' FROM arquivos_ WHERE tipo IS NULL OR tipo NOT IN ('pdf', 'html', 'txt')
 UNION SELECT documento_id, 'documento numerado sem processo' FROM arquivos_ WHERE regexp_matches(nome, '(?i)^\s*doc(?:umento)?\.?\s*\d+') AND NOT regexp_matches(coalesce(caminhos[1], ''), '(?:^|\D)\d{{6,7}}(?:\D|$)')""",
        "entity_ids_in_text": f"""WITH e AS (SELECT DISTINCT ON (entidade_id) * FROM entidades WHERE entidade_id IS NOT NULL), a AS (SELECT entidade_id, unnest(cpfs).valor AS valor FROM e), b AS (SELECT entidade_id, unnest(cnpjs).valor AS valor FROM e),
 x AS (SELECT entidade_id, string_agg(valor, ',' ORDER BY valor) AS v FROM a WHERE {_digits("cpf")} GROUP BY 1), y AS (SELECT entidade_id, string_agg(valor || CASE WHEN regexp_matches(valor, '[A-Z]') THEN '' ELSE ',' || valor END, ',' ORDER BY valor) AS v FROM b WHERE {_digits("cnpj")} GROUP BY 1)
 SELECT entidade_id, coalesce(x.v, '') AS cpfs, coalesce(y.v, '') AS cnpjs FROM x FULL JOIN y USING (entidade_id)""",
        "pair_messages": f"WITH {_network()} SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY nullif(data, '') NULLS LAST, mensagem_id) AS INT) AS ordem, mensagem_id, nullif(data, '') AS data FROM elos JOIN m USING (mensagem_id)",
        "cast_sources": f"WITH {FINDINGS} SELECT {name_key('nome')} AS chave, documento_id, localizador, count(*) AS achados FROM achados_ WHERE tipo = 'pessoas' AND trim(nome) <> '' AND {name_key('nome')} <> '' GROUP BY 1, 2, 3",
        "search_index_check": f"SELECT count(*) AS indexados, 0::BIGINT AS faltam, 0::BIGINT AS sobram, CAST(sum(len({tokens(unhyphenate('text'))})) AS BIGINT) AS palavras, true AS confere FROM documents WHERE text IS NOT NULL",
        "search_pages_ranked": f"WITH {PAGES}, {FILES}, {_bm25_pages(200)} SELECT pagina_id, documento_id, nome, n, round(pontos, 6) AS pontos FROM melhores JOIN paginas_ ON chave = pagina_id JOIN arquivos_ USING (documento_id)",
        "report_pairs": f"WITH {_network()} SELECT a, b, total FROM cruz WHERE cruzada ORDER BY total DESC, a, b LIMIT 40",
        "report_entities": f"WITH {_values()}, d AS (SELECT tipo, valor, count(DISTINCT documento_id) AS documentos, array_to_string(list_slice(list_sort(list(DISTINCT documento_id)), 1, 8), ', ') AS lugares FROM valores_ GROUP BY tipo, valor) SELECT tipo, valor, documentos, lugares, greatest(documentos - 8, 0) AS outros FROM d QUALIFY row_number() OVER (PARTITION BY tipo ORDER BY documentos DESC, valor) <= 200",
        "review_page": f"WITH {FINDINGS} SELECT achado_id, nome, documento_id FROM achados_ WHERE tipo = 'pessoas' AND coalesce(situacao, 'pendente') = 'pendente' ORDER BY criado_em, achado_id LIMIT 15 OFFSET 15",
        "display_rows": f"WITH {FINDINGS} SELECT 'achado' AS origem, coalesce(situacao, 'pendente') AS situacao, count(*) AS n, count(criado_em) AS com_data FROM achados_ GROUP BY 1, 2 UNION ALL SELECT 'mensagem', 'máquina', count(*), count(data) FROM (SELECT DISTINCT ON (mensagem_id) * FROM mensagens WHERE mensagem_id IS NOT NULL)",
        "quote_literal": rf"""WITH {FINDINGS}, {PAGES}, q AS (SELECT achado_id, documento_id, regexp_extract_all({joined_words("trecho_fonte")}, '[\p{{L}}\p{{N}}]+') AS w FROM achados_ WHERE trecho_fonte IS NOT NULL),
 p AS (SELECT documento_id, n, ' ' || array_to_string(regexp_extract_all({joined_words("texto")}, '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM paginas_ WHERE documento_id IS NOT NULL AND texto IS NOT NULL)
 SELECT achado_id, min(n) AS pagina FROM q JOIN p USING (documento_id) WHERE len(w) >= 3 AND contains(t, ' ' || array_to_string(w, ' ') || ' ') GROUP BY 1""",
        "export_names": rf"""WITH {FILES}, c AS (SELECT documento_id, regexp_replace(string_split(caminhos[1], '/')[-1], '\.[^.]{{1,5}}$', '') AS s, regexp_replace(string_split(caminhos[1], '/')[-1], '\.[^./]*$', '') AS nome FROM arquivos_ WHERE len(caminhos) > 0),
 l AS (SELECT *, regexp_replace(s, '\d{{5}}\.?\d{{6}}[/_.\-]?\d{{4}}[/_.\-]?\d{{2}}|\d{{7}}-?\d{{2}}\.?\d{{4}}\.?\d\.?\d{{2}}\.?\d{{4}}', ' ', 'g') AS livre FROM c)
 SELECT documento_id, coalesce(nullif(regexp_extract(s, '^\[(\d+)\]\s*-\s*(\d{{6,7}})[_\s-]+(.+)$', 2), ''), nullif(regexp_extract(livre, '(?:^|\D)(\d{{6,7}})(?:\D|$)', 1), ''), nome) AS alvo FROM l""",
        "person_sheets": f"""WITH {_network()}, {FINDINGS}, asked AS (SELECT DISTINCT {name_key("nome")} AS k FROM achados_ WHERE tipo = 'pessoas' AND trim(nome) <> ''), a AS (SELECT k FROM asked WHERE k <> ''),
 known AS (SELECT DISTINCT pessoa, {name_key("x")} AS k FROM (SELECT pessoa, unnest(nomes) AS x FROM pes)), found AS (SELECT DISTINCT k AS ficha, pessoa FROM a JOIN known USING (k)),
 ev AS (SELECT DISTINCT {name_key("n.nome")} AS k, e.localizador, strftime(e.criado_em, '%Y-%m-%d') AS data FROM achados_ e JOIN achados_ n USING (documento_id) WHERE e.tipo = 'eventos' AND n.tipo = 'pessoas' AND trim(n.nome) <> '')
 SELECT ficha, 'pessoa' AS tipo, pessoa AS alvo, NULL AS data FROM found UNION SELECT ficha, 'par', b, ultima FROM found JOIN cruz ON a = pessoa UNION SELECT ficha, 'par', a, ultima FROM found JOIN cruz ON b = pessoa UNION SELECT k, 'evento', localizador, data FROM a JOIN ev USING (k)""",
        "mail_headers": f"WITH {PAGES}, ht AS (SELECT pagina_id AS k, texto AS t FROM paginas_), {_headers('ht')} SELECT k AS pagina_id, ordem, de, para, cc, data_bruta, assunto FROM blocos",
        "communication_kinds": f"""WITH {PAGES}, pp AS (SELECT * FROM paginas_ WHERE documento_id IS NOT NULL AND n IS NOT NULL), {chat_rows}, f AS (SELECT documento_id, n, linha, trim({group(6)}) AS autor FROM falas WHERE n IS NOT NULL AND documento_id IS NOT NULL AND regexp_matches(l, {chat})),
 w AS (SELECT *, lag(autor) OVER (PARTITION BY documento_id ORDER BY n, linha) AS antes FROM f), tr AS (SELECT documento_id, count(*) AS trocas FROM w WHERE {name_key("autor")} <> {name_key("antes")} GROUP BY 1),
 d AS (SELECT documento_id, {", ".join(f"coalesce(string_agg(coalesce(texto, ''), chr(10) ORDER BY n, coalesce(texto, '')) FILTER (n <= {k}), '') AS t{k}" for k in (2, 3, 6, 10))} FROM pp GROUP BY 1),
 ht AS (SELECT documento_id AS k, t3 AS t FROM d), {_headers("ht")}, c AS (SELECT k AS documento_id, count(*) AS cab FROM blocos GROUP BY 1)
 SELECT documento_id, CASE WHEN coalesce(cab, 0) > 0 THEN 'e-mail' WHEN coalesce(trocas, 0) >= 2 THEN 'conversa' {" ".join(f"WHEN regexp_matches({fold('substr(t2, 1, 4000)')}, {_q(x)}){f' AND regexp_matches({fold(chr(116) + chr(54))}, {_q(CLOSING)})' if kind.startswith('carta') else ''} THEN '{kind}'" for kind, x in KINDS.items())} END AS tipo,
 regexp_matches({fold("substr(t2, 1, 600)")}, {_q(CONTRACT_TITLE)}) AND len(regexp_extract_all({fold("t10")}, {_q(CONTRACT_SIGNS)})) >= 3 AS contrato FROM d LEFT JOIN c USING (documento_id) LEFT JOIN tr USING (documento_id)""",
        "corrections_checked": f"""WITH {FINDINGS}, {PAGES}, q AS (SELECT achado_id, documento_id, pagina, coalesce(nome, '') AS v, array_to_string({tokens("coalesce(nome, '')")}, ' ') AS w FROM achados_),
 p AS (SELECT documento_id, n, ' ' || array_to_string({tokens("texto")}, ' ') || ' ' AS t FROM paginas_ WHERE texto IS NOT NULL),
 s AS (SELECT DISTINCT achado_id FROM q JOIN p USING (documento_id) WHERE (q.pagina IS NULL OR q.pagina = p.n) AND w <> '' AND contains(t, ' ' || w || ' '))
 SELECT q.achado_id, CASE WHEN trim(v) = '' THEN 'vazio' WHEN s.achado_id IS NOT NULL THEN 'confere' ELSE 'nao_consta' END AS conferencia FROM q LEFT JOIN s USING (achado_id)""",
        "custody_manifest": f"""WITH {FILES}, m AS (SELECT caminhos, sha256(CAST(to_json({{'nome': nome, 'tipo': tipo, 'tamanho_bytes': tamanho_bytes, 'alertas': alertas}}) AS VARCHAR)) AS extracao_sha256, sha256 AS sha256_original, situacao FROM arquivos_),
 h AS (SELECT sha256(CAST(to_json({{'caminhos': caminhos, 'extracao_sha256': extracao_sha256, 'sha256_original': sha256_original, 'situacao': situacao}}) AS VARCHAR)) AS h FROM m),
 s AS (SELECT count(*) AS documentos, {", ".join(f"coalesce(sum(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, {8 * k} + i, 1)) - 1) * (16::BIGINT ** (8 - i))::BIGINT))), 0)::HUGEINT AS s{k}" for k in range(8))} FROM h)
 SELECT documentos, sha256(concat_ws(',', documentos, {", ".join(f"s{k}" for k in range(8))})) AS hash FROM s""",
    }
    return found | {"report_priorities": found["triage_full"] + " WHERE pontos > 0 ORDER BY pontos DESC, doc_id LIMIT 25"}
