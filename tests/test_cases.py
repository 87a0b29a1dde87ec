import json

import pytest
from pyspark.sql import functions as F

from lavra import __main__ as cli
from lavra.functions import identifiers, people
from lavra.operators import cases, citations, custody, search
from lavra.sources import files

PERSON = "struct<nome:string,endereco:string>"


def test_export_names(spark):
    rows = [("a", ["[9]-3141592_Anexo/sub/Planta baixa.pdf"]), ("b", ["[5]-2034567_Oficio.pdf"]), ("c", ["pasta/livre.tar.gz"]), ("d", None)]
    path = F.try_element_at("caminhos", F.lit(1))
    made = spark.createDataFrame(rows, "documento_id string, caminhos array<string>").withColumn("identidade", identifiers.file_identity(path, F.lit(".pdf"), F.lit("")))
    assert {tuple(r) for r in cases.export_names(made).collect()} == {("a", "3141592/sub - Planta baixa"), ("b", "2034567"), ("c", "livre.tar")}


def test_reading_order_and_what_to_analyse(spark):
    scores = spark.createDataFrame([(1, 5), (2, 9), (3, 0), (4, 9)], "id long, pontos long")
    first = spark.createDataFrame([(3, True, ["contrato"]), (2, False, [])], "id long, prioridade boolean, motivos array<string>")
    order = cases.reading_order(scores, first, "id")
    assert [r["id"] for r in order.orderBy("posicao").collect()] == [3, 2, 4, 1]
    documents = spark.createDataFrame([(1,), (3,), (9,)], "id long")
    assert [r["id"] for r in cases.to_analyse(documents, order, "id", first=2).collect()] == [3, 1]
    assert {r["id"] for r in cases.to_analyse(documents, order, "id", only=spark.createDataFrame([(9,)], "id long")).collect()} == {9}
    assert cases.to_analyse(documents.limit(0), None, "id").count() == 0


def test_messages_of_both_kinds(spark):
    mails = spark.createDataFrame([("d", 1, ("Ana", "ana@b.example"), [("Beto", None)], None, "2024-01-02", "Lote")], f"documento_id string, pagina int, de {PERSON}, para array<{PERSON}>, cc array<{PERSON}>, data string, assunto string")
    chats = spark.createDataFrame([("e", 2, "Beto", "Ana", "2024-01-03T10:00"), ("e", 2, None, "Ana", None)], "documento_id string, pagina int, de string, para string, data string")
    both = cases.all_messages(mails, chats)
    got = {r["meio"]: r for r in both.where("data is not null").collect()}
    assert got["e-mail"]["de"]["endereco"] == "ana@b.example" and got["conversa"]["para"][0]["nome"] == "Ana" and got["conversa"]["cc"] == []
    target = got["e-mail"]["mensagem_id"]
    log = spark.createDataFrame([(target, "de", "ninguem <x@y.example>", 1), (target, "de", "", 2), (target, "para", "Caio <c@d.example>; Duda", 1), (target, "assunto", "Outro", 1), ("z", "de", "x", 1), (target, "nota", "x", 1)], "alvo string, campo string, valor string, ordem long")
    fixed = cases.corrected_messages(both, log).where(F.col("mensagem_id") == target).first()
    assert fixed["de"]["nome"] == "Ana" and [p["nome"] for p in fixed["para"]] == ["Caio", "Duda"] and fixed["cc"] == [] and fixed["assunto"] == "Outro" and fixed["data"] == "2024-01-02"
    shown = cases.display_rows(spark.createDataFrame([(1, "d", 1, "pessoas", "Ana", "diz", None, None)], "achado_id long, documento_id string, pagina int, tipo string, nome string, trecho_fonte string, situacao string, criado_em timestamp"), both)
    assert {r["descricao"] for r in shown.collect()} >= {"pessoas: Ana", "e-mail: Ana → Beto · «Lote»", "conversa: Beto → Ana"}


def test_filters_and_pages(spark):
    rows = spark.createDataFrame([(i, "pessoas" if i % 2 else "eventos", None if i % 3 else "validado", f"d{i % 2}") for i in range(20)], "achado_id long, tipo string, situacao string, documento_id string")
    assert {r["achado_id"] for r in cases.filtered(rows, ["validado"], ["pessoas"]).collect()} == {3, 9, 15}
    assert {r["achado_id"] for r in cases.filtered(rows, document="d0").collect()} == set(range(0, 20, 2))
    assert [r["achado_id"] for r in cases.page_of(rows, [F.col("achado_id")], 2, 8).collect()] == list(range(8, 16))
    assert cases.page_of(rows, [F.col("achado_id")], 9, 8).count() == 0


def test_people_keys(spark):
    rows = spark.createDataFrame([("Renata Lima, CPF 111.444.777-35", "Ana Reis <a@b.example>; c@d.example"), (None, None)], "t string, de string")
    got = [r["x"] for r in rows.select(people.people_keys(F.coalesce("t", F.lit("")), ["renata"], F.col("de")).alias("x")).collect()]
    assert got == [["ana reis", "cpf:11144477735", "renata lima"], []]


def test_events_and_firms_are_checked(spark):
    chunk = "Em 10/11/2020 a Gráfica Boreal, CNPJ 04.252.011/0001-10, reuniu Renato Dias e a diretoria na sede."
    rows = [
        (1, "eventos", None, "reuniu Renato Dias e a diretoria", "2020-11-10", ["Renato Dias", "Zoroastro"], "troca de informação sensível", None),
        (2, "eventos", None, "reuniu Renato Dias e a diretoria", "2020-11-11", [], "festa", None),
        (3, "empresas", "Gráfica Boreal", "a Gráfica Boreal, CNPJ 04.252.011/0001-10", None, None, None, "04.252.011/0001-10"),
        (4, "empresas", "Gráfica Boreal", "a Gráfica Boreal, CNPJ 04.252.011/0001-10", None, None, None, "11.444.777/0001-61"),
        (5, "empresas", "", "a Gráfica Boreal, CNPJ", None, None, None, None),
    ]
    made = spark.createDataFrame([(*r, None, None, chunk) for r in rows], "n long, tipo string, nome string, trecho_fonte string, data string, participantes array<string>, categoria string, cnpj string, cargo string, empresa string, trecho string")
    got = {r["n"]: r for r in citations.verify_proposals(made).collect()}
    assert got[1]["aceito"] and got[1]["data"] == "2020-11-10" and got[1]["participantes"] == ["Renato Dias"] and got[1]["alertas"] == ["participantes não confirmados: Zoroastro"]
    assert got[2]["data"] is None and got[2]["categoria"] == "outro" and got[2]["alertas"] == ["data não confirmada"]
    assert got[3]["cnpj"] == "04.252.011/0001-10" and got[3]["alertas"] == [] and got[4]["cnpj"] is None and got[4]["alertas"] == ["CNPJ inválido ou ausente"]
    assert got[5]["motivo"] == "sem nome"


def test_custody_of_copies_and_changes(spark):
    one = spark.createDataFrame([("a", 1), ("a", 1)], "caminho string, n long")
    none = spark.createDataFrame([], "caminho string, n long")
    hashes = {custody.manifest_hash(x).first()["hash"] for x in (one, one.limit(1), none)}
    assert len(hashes) == 3  # equal rows don't cancel out
    assert custody.tombstone(one, "C1", "ana", "fim").first()["documentos"] == 2
    tasks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "caminho string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "9")], "caminho string, sha256 string")
    assert {r["caminho"]: r["erro"] for r in custody.unchanged(tasks, now).collect()} == {"a": None, "b": "arquivo mudou", "c": "arquivo ausente"}


def test_written_index(spark, tmp_path):
    texts = spark.createDataFrame([(1, "carta de fiança e a carta"), (2, "carta de-\nfiança"), (3, None), (4, "")], "id long, t string")
    path = f"{tmp_path}/indice"
    assert search.open_index(spark, "id", path) is None
    index = search.ensure_index(texts, "id", "t", path)
    assert search.check_index(index, texts, "t").first().asDict() == {"indexados": 3, "faltam": 0, "sobram": 0, "palavras": 8, "confere": True}
    assert not search.check_index(index, texts.where("id <> 1").unionByName(spark.createDataFrame([(9, "x")], "id long, t string")), "t").first()["confere"]
    for query in ("carta", '"carta de"', "fian*", "carta OU fianca", "", "nada"):
        want = {(r["id"], round(r["pontos"], 9)) for r in search.search(texts, "id", "t", query).collect()}
        assert {(r["id"], round(r["pontos"], 9)) for r in search.search_index(search.ensure_index(texts, "id", "t", path), query).collect()} == want
    pages = spark.createDataFrame([(1, "d", 2, "carta de fiança e a carta"), (2, "x", 1, "carta")], "pagina_id long, documento_id string, n int, texto string")
    hits = search.search(pages, "pagina_id", "texto", "carta")
    got = search.located(hits, pages, spark.createDataFrame([("d", "a.pdf")], "documento_id string, nome string"), "carta").collect()
    assert [(r["pagina_id"], r["localizador"], r["trecho"]) for r in got] == [(1, "a.pdf, p. 2", "«carta» de fiança e a «carta»")]


def test_log_order(spark, tmp_path):
    import os
    import time

    for k, name in enumerate(["b.json", "a.json"]):
        with open(tmp_path / name, "w") as f:
            f.writelines(json.dumps({"alvo": "x", "valor": f"{name}{i}"}) + "\n" for i in range(3))
        os.utime(tmp_path / name, (time.time() + 100 * k,) * 2)
    log = files.log_records(spark, str(tmp_path), "alvo string, valor string")
    assert [r["valor"] for r in log.orderBy("ordem").collect()] == ["b.json0", "b.json1", "b.json2", "a.json0", "a.json1", "a.json2"]
    assert log.groupBy("alvo").agg(F.max_by("valor", "ordem").alias("v")).first()["v"] == "a.json2"


@pytest.fixture
def case(tmp_path):
    (tmp_path / "originais" / "sala").mkdir(parents=True)
    (tmp_path / "originais" / "sala" / "oficio.txt").write_text("Renata Lima e Olga Reis.\nContato: renata@alfa.example\n" * 3)
    (tmp_path / "originais" / "nota.html").write_text("<html><body><p>Vamos manter os preços da tabela única.</p></body></html>")
    return tmp_path


def test_command_line(spark, case, capsys, monkeypatch):
    run = lambda *a: cli.main([*a], spark)
    embed = lambda frame: frame[["passagem_id", "documento_id", "pagina", "modelo"]].assign(vetor=[[1.0, 0.0]] * len(frame))
    answer = lambda frame: frame[["documento_id", "trecho", "hash", "modelo"]].assign(resposta="{}")
    assert run("processar", str(case)) == 0 and run("verificar", str(case)) == 0
    assert "Integridade OK" in capsys.readouterr().out
    assert run("processar", str(case)) == 0  # nothing new
    assert spark.read.parquet(f"{case}/dados/paginas").count() == 2
    assert run("relatorio", str(case)) == 0 and "renata@alfa.example" in capsys.readouterr().out
    assert run("exportar", str(case)) == 0
    assert {p.name for p in (case / "exportado").iterdir() if p.is_dir()} == {"alvo=oficio", "alvo=nota"}
    monkeypatch.setattr(cli, "_provider", lambda name: {"v": embed, "m": answer}.get(name))
    assert run("indexar-vetores", str(case), "--modelo", "v") == 0 and run("indexar-vetores", str(case), "--modelo", "v") == 0
    assert spark.read.parquet(f"{case}/dados/vetores").count() == 2
    assert run("analisar-ia", str(case), "--modelo", "m", "--primeiros", "1") == 0 and spark.read.parquet(f"{case}/dados/respostas").count() == 1
    assert run("analisar-ia", str(case), "--modelo", "m") == 0 and spark.read.parquet(f"{case}/dados/respostas").count() == 2
    assert run("analisar-ia", str(case)) == 1 and run("ia") == 1 and run("diagnostico") == 0
    (case / "originais" / "nota.html").write_text("<p>outra</p>")
    (case / "fora").mkdir()
    (case / "fora" / "novo.txt").write_text("novo")
    assert run("verificar", str(case)) == 1 and "nota.html - original alterado" in capsys.readouterr().out
    assert run("importar", str(case), str(case / "fora"), "--copiar") == 0 and (case / "originais" / "novo.txt").read_text() == "novo"
    assert run("importar", str(case), str(case / "originais" / "sala")) == 1


def test_pdf_plan_and_ocr(spark):
    from lavra.sources import providers

    def reader(frame):
        import pandas as pd

        if frame["documento_id"].iloc[0] == "mau":
            raise ValueError("cifrado")
        full = [{"x0": 0.0, "y0": 0.0, "x1": 595.0, "y1": 842.0}]
        return pd.DataFrame({"documento_id": ["d"] * 3, "n": [1, 2, 3], "texto": ["x" * 1600, "pouco", "y" * 300], "largura": [595.0] * 3, "altura": [842.0] * 3, "imagens": [[], [], full]})

    files_ = spark.createDataFrame([("d", b"1"), ("mau", b"2")], "documento_id string, content binary")
    got = {(r["documento_id"], r["n"]): (r["metodo"], r["motivo_ocr"], r["dpi_efetivo"]) for r in providers.plan_pdf(files_, reader).collect()}
    assert got == {("d", 1): ("texto_digital", None, 300), ("d", 2): ("pendente_ocr", "pouco texto digital", 300), ("d", 3): ("pendente_ocr", "imagem cobre a página", 300), ("mau", 1): ("erro", None, None)}

    def engine(frame):
        if (frame["n"] == 3).any():
            raise RuntimeError("sem memória")
        line = "5\t1\t1\t1\t1\t{}\t0\t0\t9\t9\t{}\t{}"
        return frame[["documento_id", "n"]].assign(tsv="\n".join([line.format(1, 90, "carta"), line.format(2, 80, "nova")]))

    pages = spark.createDataFrame([("d", 2), ("d", 3)], "documento_id string, n int")
    read = {r["n"]: r for r in providers.read_by_ocr(pages, engine).collect()}
    assert (read[2]["texto"], read[2]["confianca_media"], read[2]["ocr_palavras"], read[2]["metodo"]) == ("carta nova", 85.0, 2, "ocr") and len(read[2]["tsv_sha256"]) == 64
    assert read[3]["metodo"] == "erro" and "sem memória" in read[3]["erro"]
    present = providers.capabilities(spark, providers.Capability("ocr", "5", "abc"))
    needed = spark.createDataFrame([("ocr", "abc"), ("ocr", "xyz"), ("modelo", None)], "nome string, resumo string")
    assert {(r["nome"], r["estado"]) for r in providers.status(present, needed).collect()} == {("ocr", "pronto"), ("ocr", "outra versão"), ("modelo", "ausente")}


def test_sheets_by_excerpt_and_annex(spark):
    from lavra.operators import findings, network, vectors

    asked = spark.createDataFrame([("olga reis", "Olga Reis")], "ficha string, nome string")
    persons = spark.createDataFrame([], "pessoa string, nomes array<string>")
    linked = spark.createDataFrame([], "a string, b string, ultima string")
    events = spark.createDataFrame([(["Renato"], "p. 1", "2020", "a Sra. Olga Reis assinou"), (["OLGA REIS"], "p. 2", "2021", None), ([], "p. 3", "2022", "Olga Reisinha")], "participantes array<string>, localizador string, data string, trecho string")
    assert {(r["alvo"]) for r in findings.person_sheet(asked, persons, linked, events).collect()} == {"p. 1", "p. 2"}
    manifested = custody.manifest(spark.createDataFrame([("1", ["a"], "ok", "x")], "sha256 string, caminhos array<string>, situacao string, texto string"), ["texto"])
    ignored = spark.createDataFrame([("~$a.doc", "temporário")], "caminho string, motivo string")
    tools = spark.createDataFrame([("ocr", "5", "abc")], "nome string, versao string, resumo string")
    assert {(r["parte"], r["nome"]) for r in custody.annex(manifested, ignored, tools).collect()} == {("documento", "a"), ("ignorado", "~$a.doc"), ("ferramenta", "ocr")}
    links = spark.createDataFrame([("m1", "a", "b", False), ("m2", "a", "b", False), ("m3", "a", "b", True)], "mensagem_id string, a string, b string, copia boolean")
    sent = spark.createDataFrame([("m1", ""), ("m2", "2020-02"), ("m3", "2020-01")], "mensagem_id string, data string")
    assert [r["mensagem_id"] for r in network.pair_messages(links, sent).orderBy("ordem").collect()] == ["m3", "m2", "m1"]
    found = spark.createDataFrame([(i, float(i)) for i in range(12)], "passagem_id long, pontos double")
    assert [r["passagem_id"] for r in vectors.first_passages(found, found.select("passagem_id"), ["passagem_id"]).orderBy("posicao").collect()] == [11, 10, 9, 8, 7, 6, 5, 4]
