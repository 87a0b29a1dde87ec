import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lavra.functions.people import plain
from lavra.operators import citations, custody, findings, headers, lexicon, network, passages, reports, search, vectors

TEXTS = [
    (1, "Conforme combinado, vamos manter os preços da tabela única. Rodízio e rodízio."),
    (2, "O pregão e o edital; licitação: carta de fiança."),
    (3, "Nada aqui."),
    (4, None),
    (5, ""),
    (6, "carta de fi-\nança do pregão, a carta sem fiança " + "rodízio " * 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def brute_points(text):
    total = 0
    folded = plain((text or "").lower())
    for terms in lexicon.TERMS.values():
        for pattern, weight in terms:
            total += min(len(list(re.finditer(pattern, folded))), lexicon.MOST_PER_TERM) * weight
    return total


def test_triage_against_brute_force(docs):
    got = {r["doc_id"]: r for r in lexicon.triage(docs, "doc_id", "text").collect()}
    assert {k: r["pontos"] for k, r in got.items()} == {k: brute_points(t) for k, t in TEXTS}
    order = sorted(TEXTS, key=lambda x: (-brute_points(x[1]), x[0]))
    assert [k for k, _ in order] == sorted(got, key=lambda k: got[k]["posicao"])


def test_triage_bonus_and_empty(spark):
    rows = spark.createDataFrame([(1, "11.222.333/0001-81 e 12.ABC.345/01DE-35; a@alfa.com b@beta.com c@gmail.com")], "doc_id long, text string")
    assert lexicon.triage(rows, "doc_id", "text").first()["pontos"] == 5
    assert lexicon.triage(rows.limit(0), "doc_id", "text").count() == 0


def test_rank_is_global(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "id long, v long")
    got = [r["posicao"] for r in lexicon.rank(rows, F.desc("v"), F.asc("id")).orderBy(F.desc("v"), "id").collect()]
    assert got == list(range(1, 501))


def test_snippets_have_true_places(docs):
    rows = lexicon.snippets(docs, "doc_id", "text", most=3).collect()
    by_id = dict(TEXTS)
    assert rows
    for r in rows:
        folded = plain(by_id[r["doc_id"]].lower())
        starts = [m.start() for m in re.finditer(r["padrao"], folded)]
        assert r["posicao"] == starts[r["ordem"] - 1]


def test_kinds(spark):
    def kind(text, headers=0, pairs=0):
        return spark.createDataFrame([(text,)], "t string").select(lexicon.communication_kind(F.col("t"), F.lit(headers), F.lit(pairs)).alias("k")).first()["k"]

    assert kind("x", 1) == "e-mail" and kind("x", 0, 2) == "conversa" and kind("x") is None
    assert kind("Ata da 3ª reunião") == "ata de reunião"
    assert kind("Prezado senhor,\nAtenciosamente,") == "carta ou ofício" and kind("Prezado senhor,") is None


def test_priorities(spark):
    rows = spark.createDataFrame([(1, "Carlos Lima e Maria Souza"), (2, "neutro"), (3, None)], "id long, t string")
    got = {r["id"]: (r["prioridade"], r["motivos"]) for r in lexicon.priorities(rows, "id", "t", first_names=["carlos", "maria"]).collect()}
    assert got == {1: (True, ["2 pessoas"]), 2: (False, []), 3: (False, [])}


def test_search(docs):
    ids = lambda q: {r["doc_id"] for r in search.search(docs, "doc_id", "text", q, limit=None).collect()}
    assert ids("FIANCA") == {2, 6} and ids('"carta de fianca"') == {2, 6} and ids("prega*") == {2, 6}
    assert ids("edital rodizio") == set() and ids("edital OU tabela") == {1, 2} and ids("OU edital OU OU") == {2}
    assert ids('" ( ) *') == set() and ids("") == set()
    assert ids('edital pregao OU "tabela unica"') == {1, 2}


def test_bm25_against_brute_force(docs):
    words = {k: re.findall(r"[^\W_]+", plain(re.sub(r"(\w)-\n(\w)", r"\1\2", t).lower())) for k, t in TEXTS if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for term in ("fianca", "pregao"):
        df = sum(term in w for w in words.values())
        idf = max(1e-6, math.log((len(words) - df + 0.5) / (df + 0.5)))
        for k, w in words.items():
            tf = w.count(term)
            if tf:
                want[k] = want.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {r["doc_id"]: r["pontos"] for r in search.search(docs, "doc_id", "text", "fianca OU pregao").collect()}
    assert got == pytest.approx(want)


def test_search_snippet(docs):
    got = search.snippet_of(docs.where("doc_id = 1"), "text", "precos", 5).first()["trecho"]
    assert "«preços»" in got and got.startswith("… ") and got.endswith(" …")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [1.0]), (6, [1.0, None])], "id long, v array<float>")
    got = vectors.top_k(rows, "id", "v", [1.0, 0.0], 5).collect()
    assert [r["id"] for r in got] == [1, 3] and got[0]["similaridade"] == pytest.approx(1)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, posicao int")
    b = spark.createDataFrame([(2, 1), (2, 5), (3, 2), (9, 51)], "id long, posicao int")
    got = {r["id"]: (r["pontos"], r["origens"]) for r in vectors.fuse(a, b, ["id"]).collect()}
    assert got[2] == (pytest.approx(1 / 62 + 1 / 61), ["palavra", "significado"]) and set(got) == {1, 2, 3}
    assert vectors.fuse(a, b.limit(0), ["id"]).count() == 2


def test_passages(spark):
    text = " ".join(f"p{i}" for i in range(600))
    rows = spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, "um\n dois ")], "id long, t string")
    got = {(r["id"], r["n"]): r for r in passages.passages(rows, ["id"], "t").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (4, 1)] and got[1, 2]["texto"].startswith("p210 ") and got[1, 3]["palavras"] == 180
    placed = passages.passage_offsets(rows, ["id"], "t").collect()
    assert {(r["id"], r["n"]): r["texto"].split() for r in placed} == {k: r["texto"].split() for k, r in got.items()}
    assert all((text if r["id"] == 1 else "um\n dois ")[r["inicio"] : r["fim"]] == r["texto"] for r in placed)


def test_chunks(spark):
    page = lambda n: " ".join(["w"] * n)
    rows = spark.createDataFrame([("d", 1, page(500)), ("d", 2, page(500)), ("d", 3, page(300)), ("d", 4, page(300)), ("d", 5, " "), ("e", 1, page(2500)), ("e", 2, page(700) + "\n\n" + page(700))], "d string, n int, t string")
    got = sorted((r["d"], r["trecho"], r["palavras"], tuple(r["paginas"])) for r in passages.chunks(rows, "d", "n", "t").collect())
    assert got == [("d", 1, 1000, (1, 2)), ("d", 2, 600, (3, 4)), ("e", 1, 1200, (1,)), ("e", 2, 1200, (1,)), ("e", 3, 800, (1, 2)), ("e", 4, 700, (2,))]


MAIL = "De: Carlos <carlos@alfa.com>\nEnviado em:\n14/03/2024 10:00\nPara: Ana\nAssunto: Lote\n\nOi\n\n\n\nDe: Ana <ana@b.com>\nData: 13/03/2024\nDe: Beto\nAssunto: x\nPara: Ana"


def test_headers(spark):
    rows = spark.createDataFrame([(1, MAIL), (2, None), (3, "Assunto: só")], "id long, t string")
    got = [(r["id"], r["ordem"], r["de"], r["data_iso"], r["assunto"]) for r in headers.headers(rows, "id", "t").orderBy("id", "ordem").collect()]
    assert got == [(1, 1, "Carlos <carlos@alfa.com>", "2024-03-14T10:00", "Lote"), (1, 2, "Ana <ana@b.com>", "2024-03-13", None), (1, 3, "Beto", None, "x")]
    messages = headers.mail_messages(headers.headers(rows, "id", "t"), "id").collect()
    assert [m["de"]["nome"] for m in messages] == ["Carlos", "Beto"]


def test_chat(spark):
    text = "14/03/2024 10:32 - Carlos: oi\n[14/03/24, 10:33:15] Ana: olá\nlinha\n14/03/2024 10:34 - ANA: de novo\n14/03/2024 10:35 - Carlos: ok"
    lines = headers.chat_lines(spark.createDataFrame([("d", 1, text), ("e", 1, None)], "d string, n int, t string"), "d", "n", "t")
    assert [r["data"] for r in lines.orderBy("linha").collect()] == ["2024-03-14T10:32", "2024-03-14T10:33", "2024-03-14T10:34", "2024-03-14T10:35"]
    assert {(r["de"], r["para"]) for r in headers.chat_pairs(lines, "d", "n").collect()} == {("Ana", "Carlos"), ("Carlos", "ANA")}


def test_network(spark):
    p = lambda n, e=None: (n, e)
    rows = [
        (1, "d1", p("Carlos", "carlos@alfa.com"), [p("Ana", "ana@beta.com")], [p("Beto", "beto@gmail.com")], "2024-01-01"),
        (1, "d1", p("Carlos", "carlos@alfa.com"), [p("Ana", "ana@beta.com")], [p("Beto", "beto@gmail.com")], "2024-01-01"),
        (2, "d2", p("ANA"), [p("Carlos")], None, ""),
        (3, "d2", p(None, None), None, [p("", None)], None),
        (4, "d3", p("Ana", "ana@beta.com"), [p("Ana", "ANA@beta.com")], [], None),
    ]
    who = "struct<nome string, endereco string>"
    messages = spark.createDataFrame(rows, f"mensagem_id long, documento_id string, de {who}, para array<{who}>, cc array<{who}>, data string")
    known = network.identities(network.mentions(messages))
    persons = network.people(known)
    got = {r["pessoa"]: (r["rotulo"], r["organizacao"], r["enviadas"], r["recebidas"]) for r in persons.collect()}
    assert got == {"carlos@alfa.com": ("Carlos", "alfa.com", 1, 1), "ana@beta.com": ("ANA", "beta.com", 2, 1), "beto@gmail.com": ("Beto", None, 0, 1)}
    pairs = network.pairs(network.edges(known), messages, persons)
    found = {(r["a"], r["b"]): (r["total"], r["copias"], r["primeira"], r["cruzada"]) for r in pairs.collect()}
    assert found == {("ana@beta.com", "carlos@alfa.com"): (2, 0, "2024-01-01", True), ("beto@gmail.com", "carlos@alfa.com"): (1, 1, "2024-01-01", False)}
    assert [tuple(r) for r in network.organisations(pairs).collect()] == [("alfa.com", "beta.com", 2, 1)]
    assert {tuple(r) for r in network.counterparts(pairs, "carlos@alfa.com").collect()} == {("ana@beta.com", 2), ("beto@gmail.com", 1)}
    assert '"ana@beta.com" -- "carlos@alfa.com"' in network.dot_graph(pairs, persons).first()["dot"]


PAGES = [{"n": 1, "texto": "Ata de reunião.\nPresentes os diretores comerciais."}, {"n": 2, "texto": "Ficou acertado manter os preços da tabela única e a divi-\nsão de clientes por região a partir de junho."}, {"n": 3, "texto": "Proposta de cobertura com va1or acima do orçamento."}]


def test_quotes():
    r = citations.find_quote("MANTER OS PRECOS DA TABELA UNICA e a divisão de clientes", PAGES)
    assert r["pagina"] == 2 and r["literal"] and "divi-\nsão de clientes" in r["trecho_fonte"]
    r = citations.find_quote("proposta de cobertura com valor acima do orçamento", PAGES)
    assert r["pagina"] == 3 and not r["literal"] and r["similaridade"] >= 0.9
    for bad in ("as empresas combinaram dividir os lotes do pregão", "a empresa", "", None, "decidiram conservar os valores da lista comum"):
        assert citations.find_quote(bad, PAGES) is None


def test_locate(spark):
    quotes = spark.createDataFrame([(1, "d", "manter os preços da tabela"), (2, "d", "inventado por completo aqui"), (3, None, "manter os preços da"), (4, "d", None)], "id long, documento_id string, trecho_fonte string")
    pages = spark.createDataFrame([("d", p["n"], p["texto"]) for p in PAGES] + [("d", 9, None)], "documento_id string, n int, texto string")
    got = {r["id"]: r["lugar"] for r in citations.locate(quotes, pages).collect()}
    assert got[1]["pagina"] == 2 and got[1]["literal"] and got[2] is None and got[3] is None and got[4] is None


def test_proposals(spark):
    chunk = "O diretor Carlos Mendes da Alfa Ltda. disse que manteria os preços."
    rows = [(1, "Carlos Mendes", "diretor", "Beta", "disse que manteria os preços", chunk), (2, "João", None, None, "disse que manteria os preços", chunk), (3, "Carlos Mendes", None, None, "nunca disse isso a ninguém", chunk)]
    got = {r["id_"]: r for r in citations.verify_proposals(spark.createDataFrame(rows, "id_ long, nome string, cargo string, empresa string, trecho_fonte string, trecho string")).collect()}
    assert got[1]["aceito"] and got[1]["empresa"] is None and got[1]["alertas"] == ["empresa não confirmada"] and got[1]["cargo"] == "diretor"
    assert got[2]["motivo"] == "nome não aparece no trecho" and got[3]["motivo"] == "trecho não encontrado"


def test_claims(spark):
    sources = spark.createDataFrame([(1, "A", 1, PAGES[1]["texto"]), (1, "B", 2, PAGES[2]["texto"])], "resposta_id long, fonte string, n int, texto string")
    claims = spark.createDataFrame([(1, 1, "B", "manter os preços da tabela única"), (1, 2, "A", "coisa que ninguém disse")], "resposta_id long, afirmacao_id long, fonte string, trecho string")
    got = citations.verify_claims(claims, sources)
    assert {r["afirmacao_id"]: (r["confirmada"], r["fonte_achada"]) for r in got.collect()} == {1: (True, "A"), 2: (False, None)}
    flags = spark.createDataFrame([(1, True), (2, True)], "resposta_id long, responde boolean")
    assert {r["resposta_id"]: r["respondivel"] for r in citations.answers(got, flags).collect()} == {1: True, 2: False}


def test_corrections_are_checked(spark):
    pages = spark.createDataFrame([("d", 1, "CNPJ 11.222.333/0001-81 de Carlos Mendes")], "documento_id string, n int, texto string")
    rows = [(1, "d", 1, "nome", "CARLOS mendes"), (2, "d", None, "cnpj", "11222333000181"), (3, "d", 1, "nome", "João"), (4, "d", 1, "nota", "x"), (5, "d", 1, "nome", " ")]
    got = {r["id"]: r["conferencia"] for r in citations.check_correction(spark.createDataFrame(rows, "id long, documento_id string, pagina int, campo string, valor string"), pages).collect()}
    assert got == {1: "confere", 2: "confere", 3: "nao_consta", 4: "nao_verificavel", 5: "vazio"}


def test_findings(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "d1", "pessoas", "Carlos Souza", "diretor", "Alfa", "validado", t), (1, "d1", "pessoas", "outro", None, None, "validado", t + timedelta(1)), (2, "d2", "pessoas", "CARLOS  SOUZA", None, None, "validado", t),
            (3, "d2", "pessoas", "Carlos", None, None, "validado", t), (4, "d3", "pessoas", "Ana", None, None, None, t), (5, "d3", "pessoas", " ", None, None, "validado", t)]
    first = findings.first_seen(spark.createDataFrame(rows, "achado_id long, documento_id string, tipo string, nome string, cargo string, empresa string, situacao string, criado_em timestamp"))
    assert {r["achado_id"]: r["nome"] for r in first.collect()}[1] == "Carlos Souza"
    got = {r["chave"]: (r["nome"], r["grafias"], r["documentos"]) for r in findings.cast_of_characters(first, "pessoas").collect()}
    assert got == {"carlos souza": ("CARLOS  SOUZA", ["CARLOS  SOUZA", "Carlos Souza"], 2), "carlos": ("Carlos", ["Carlos"], 1)}
    reviews = spark.createDataFrame([(1, "rejeitado", "n", t), (1, "validado", "m", t + timedelta(1)), (2, "inválido", None, t)], "achado_id long, estado string, nota string, em timestamp")
    assert {r["achado_id"]: r["revisao"] for r in findings.with_review(first, reviews).collect()} == {1: "validado", 2: "pendente", 3: "pendente", 4: "pendente", 5: "pendente"}
    log = spark.createDataFrame([(1, "nome", "X", 1), (1, "nome", "Y", 2), (1, "cargo", "", 3), (2, "outro", "Z", 1)], "alvo long, campo string, valor string, ordem long")
    over = {r["achado_id"]: (r["nome"], r["cargo"]) for r in findings.overlay(first, log, "achado_id", ["nome", "cargo"]).collect()}
    assert over[1] == ("Y", None) and over[2] == ("CARLOS  SOUZA", None)


def test_firms_by_number(spark):
    rows = spark.createDataFrame([("Alfa S/A", "11.222.333/0001-81"), ("ALFA S.A.", None), ("Beta", None), (None, None)], "nome string, cnpj string")
    got = {r["chave"]: r["nomes"] for r in findings.firms_by_number(rows).collect()}
    assert got == {"11222333000181": ["ALFA S.A.", "Alfa S/A"], "beta": ["Beta"]}


def test_custody(spark):
    e = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("d", "4", "x")], "caminho string, sha256 string, extracao_sha256 string")
    n = spark.createDataFrame([("a", "1", "x"), ("b", "9", "x"), ("c", "3", "y"), ("e", "5", None)], "caminho string, sha256 string, extracao_sha256 string")
    assert {tuple(r) for r in custody.verify(e, n).collect()} == {("b", "original alterado"), ("c", "extração alterada"), ("d", "original ausente"), ("e", "arquivo novo")}
    assert custody.manifest_hash(e).first()["hash"] == custody.manifest_hash(e.repartition(3)).first()["hash"] != custody.manifest_hash(n).first()["hash"]
    current = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "sha256 string")
    done = spark.createDataFrame([("1", "v", "{}", "ok"), ("2", "v", "{}", "erro"), ("3", "u", "{}", "ok"), ("9", "v", "{}", "ok")], "sha256 string, versao string, parametros string, situacao string")
    assert {r[0] for r in custody.pending(current, done, "v").collect()} == {"2", "3", "4"}
    assert {r["sha256"] for r in custody.orphans(done, current).collect()} == {"9"}
    same = custody.by_content(spark.createDataFrame([("b", "h"), ("a", "h"), ("c", None)], "caminho string, sha256 string")).collect()
    assert [(r["caminho"], r["copias"]) for r in same] == [("a", 2)]


def test_import_plan(spark):
    s = spark.createDataFrame([("a/x.pdf", "1"), ("a/y.pdf", "2"), ("z.txt", "3"), ("~$t.doc", "4"), ("Thumbs.db", "5"), ("sem", "6")], "caminho string, sha256 string")
    t = spark.createDataFrame([("a/x.pdf", "1"), ("a/y.pdf", "9"), ("sem", "0")], "caminho string, sha256 string")
    got = {r["caminho"]: (r["acao"], r["destino"]) for r in custody.import_plan(s, t).collect()}
    assert got == {"a/x.pdf": ("identico", None), "a/y.pdf": ("renomear", "a/y (2).pdf"), "z.txt": ("copiar", "z.txt"), "~$t.doc": ("ignorar", None), "Thumbs.db": ("ignorar", None), "sem": ("renomear", "sem (2)")}
    assert not custody.safe_to_import("/a", "/a/b") and not custody.safe_to_import("/a/b", "/a") and custody.safe_to_import("/a", "/ab")


def test_excerpts_keep_apart(spark):
    places = [(1, 1, p) for p in (0, 100, 250, 600, 900)] + [(1, 2, 50)]
    got = {(r["pagina"], r["posicao"]) for r in reports.spaced_excerpts(spark.createDataFrame(places, "id long, pagina int, posicao int"), "id", "pagina").collect()}
    assert got == {(1, 0), (1, 250), (1, 600)}


def test_dates_near_terms(spark):
    far = "Em 14/03/2024. " + "x " * 300 + "Propusemos rodízio. Em 05.06.2024."
    got = reports.dates_near_terms(spark.createDataFrame([(1, far), (2, None)], "id long, t string"), ["id"], "t").collect()
    assert [(r["data"], r["termos"]) for r in got] == [("2024-06-05", 1)]


def test_random_tokens_match_counts(spark):
    rng = random.Random(3)
    words = ["a1", "bê", "c", "d-e", "F"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    index = search.term_frequencies(search.postings(spark.createDataFrame(texts, "id long, t string"), "id", "t"), "id")
    want = Counter((w, i) for i, t in texts for w in re.findall(r"[^\W_]+", plain(t.lower())))
    assert {(r["termo"], r["id"]): r["tf"] for r in index.collect()} == dict(want)


def test_dates_near_late_terms(spark):
    late = "rodízio " * 1001 + "x " * 300 + "rodízio Em 05.06.2024."
    got = reports.dates_near_terms(spark.createDataFrame([(1, late)], "id long, t string"), ["id"], "t").collect()
    assert [(r["data"], r["termos"]) for r in got] == [("2024-06-05", 1)]
