import pytest

from lavra.llm import scans

BODY = "A comissão de licitação reapresentou a proposta de preços do fornecedor no almoxarifado. O contrato do fornecedor e o sócio-gerente da secretaria."
SCHEMA = "pagina_id long, documento_id string, n int, metodo string, texto string, extra string"


def pages(spark, damaged):
    clean = [(1000 + i, f"c{i}", 1, "html", BODY, "x") for i in range(60)]
    return spark.createDataFrame(clean + damaged, SCHEMA)


def test_damage(spark):
    first = "RELATÓRIO Nº 9\n\nA comissão de licita-\nção reapresentou a prop0sta de preços ~\ndo fornecedor e do sócio-\ngerente no almoxa-\n\n— 4 —"
    second = "RELATÓRIO Nº 9\n\nrifado. O c o n t r a t o do fornecedor.\nA secretaria.\n\n— 5 —"
    rows = [(1, "d", 1, "ocr", first, None), (1, "d", 1, "ocr", first, None), (2, "d", 2, "ocr", second, None), (3, "d", 3, "ocr", None, None), (4, None, None, "ocr", "", None), (5, "d", 4, "texto", first, None)]
    got = {tuple(r) for r in scans.find_damage(pages(spark, rows)).collect()}
    assert got == {
        (1, 1, "cabecalho"), (1, 3, "hifen"), (1, 4, "caractere"), (1, 6, "hifen"), (1, 8, "numero_pagina"),
        (2, 1, "cabecalho"), (2, 3, "caractere"), (2, 6, "numero_pagina"),
    }
    fixed = {r["pagina_id"]: r["texto"] for r in scans.repair_pages(pages(spark, rows)).collect()}
    assert fixed[1] == "A comissão de licitação reapresentou a proposta de preços do fornecedor e do sócio-gerente no almoxa-"
    assert fixed[2] == "rifado. O contrato do fornecedor. A secretaria."


def test_empty(spark):
    assert scans.find_damage(pages(spark, []).limit(0)).count() == 0


def test_very_long_text(spark):
    long = "\n".join(["A comissão de licitação reapresentou a proposta."] * 20_000)
    assert scans.find_damage(pages(spark, [(1, "d", 1, "ocr", long, None)])).count() == 0


@pytest.mark.parametrize(("line", "value"), [("— 12 —", 12), ("fl. 3", 3), ("Página 2 de 10", 2), ("[142]", 142), ("xiv", 14), ("Fls. 23/25", 23), ("pág. 001", 1)])
def test_page_numbers(line, value):
    assert scans.page_number(line)[1] == value


@pytest.mark.parametrize("line", ["R$ 4,1 milhões", "Lote 3", "", "Total", "12.5"])
def test_no_page_numbers(line):
    assert scans.page_number(line) is None


def test_shares_decide_nothing(spark, monkeypatch):
    """Rare words and line forms count by joins as if all were broadcast."""
    rows = []
    for d in range(4):
        for n in range(1, 4):
            head = f"RELATÓRIO {['da Obra', 'de Voo', 'em Curso', 'por Lote 9'][d]}"
            rows.append((10 * d + n, f"d{d}", n, "ocr", f"{head}\n\nA comissão de licita-\nção reapresentou a prop0sta de precos do fornecedor.\nO guarda-\nchuva e o guarda-\nnapo do socio e o C o n t r a t o.\n\n— {n} —", None))
    rare = [(500 + i, f"r{i}", 1, "html", "guarda-roupa guarda-chuva guardanapo " + "socio " * 4, None) for i in range(3)]
    whole = {tuple(r) for r in scans.find_damage(pages(spark, rows + rare)).collect()}
    fixed = {tuple(r) for r in scans.repair_pages(pages(spark, rows + rare)).collect()}
    assert {(1, 1, "cabecalho"), (13, 1, "cabecalho")} <= whole
    monkeypatch.setattr(scans, "WORD_SHARE", 0.01)
    monkeypatch.setattr(scans, "FORM_SHARE", 0.2)
    assert {tuple(r) for r in scans.find_damage(pages(spark, rows + rare)).collect()} == whole
    assert {tuple(r) for r in scans.repair_pages(pages(spark, rows + rare)).collect()} == fixed


def test_words_over_page_ends(spark):
    first = "RELATÓRIO Nº 9\n\nA comissão de licitação reapresentou a proposta no almoxa-\n\n— 4 —"
    second = "RELATÓRIO Nº 9\n\nrifado. O contrato do fornecedor e o sócio-\n\n— 5 —"
    third = "RELATÓRIO Nº 9\n\ngerente da secretaria. A proposta da comis-\n\n— 6 —"
    rows = [(1, "d", 4, "ocr", first, None), (2, "d", 5, "ocr", second, None), (3, "d", 6, "ocr", third, None), (4, "d", 8, "ocr", "são de preços.", None), (5, None, 6, "ocr", "são de preços.", None)]
    fixed = {r["pagina_id"]: r["texto"] for r in scans.repair_pages(pages(spark, rows), join_pages=True).collect()}
    assert fixed == {
        1: "A comissão de licitação reapresentou a proposta no almoxarifado.", 2: "O contrato do fornecedor e o sócio-gerente",
        3: "da secretaria. A proposta da comis-", 4: "são de preços.", 5: "são de preços.",
    }


def test_copies_change_nothing(spark):
    """The verdict on a page doesn't depend on how often it was delivered."""
    rows = [(10 * d + n, f"d{d}", n, "ocr", f"RELATÓRIO {['da Obra', 'de Voo'][d]}\n\nA comissão de licita-\nção reapresentou a prop0sta de precos do fornecedor.\nO guarda-\nchuva do socio.\n\n— {n} —", None) for d in range(2) for n in (1, 2, 3)]
    alone = {tuple(r) for r in scans.find_damage(pages(spark, rows)).collect()}
    copies = [(i + 1000 * k, f"{d}.{k}", n, m, t, x) for k in range(1, 20) for i, d, n, m, t, x in rows]
    among = {tuple(r) for r in scans.find_damage(pages(spark, rows + copies)).collect()}
    assert alone and {r for r in among if r[0] < 1000} == alone


def test_headers_nearly_alike(spark):
    """Damage beyond the known confusions doesn't hide a running line; sentences that are alike are none."""
    heads = ["Tribunal de Contas da Vila", "Trjbvnal de Conkas da Vila", "Tribunal de Contas da Vjla"]
    rows = [(n, "d", n, "ocr", f"{heads[n - 1]}\n\nForam ouvidas {n}77 pessoas no processo de contas da obra\nA comissão reapresentou a proposta de preços.", None) for n in (1, 2, 3)]
    got = {tuple(r) for r in scans.find_damage(pages(spark, rows)).collect()}
    assert {r for r in got if r[2] == "cabecalho"} == {(1, 1, "cabecalho"), (2, 1, "cabecalho"), (3, 1, "cabecalho")}


def test_footers_in_small_letters(spark):
    body = ["A comissão de licitação reapresentou a proposta", "de preços do fornecedor e o contrato", "com o sócio-gerente da secretaria", "no almoxarifado o contrato", "da comissão e a proposta do sócio-gerente", "o fornecedor do contrato", "e da secretaria com a proposta de preços"]
    rows = []
    for d in range(6):
        for n in (1, 2):
            k = (d + 3 * n) % 7
            rows.append((10 * d + n, f"d{d}", n, "ocr", "\n".join([*body[k:], *body[:k], *body[k:], f"via arquivada – Vila {'ABCDEF'[d]}ria"]), None))
    got = {tuple(r) for r in scans.find_damage(pages(spark, rows)).where("tipo = 'cabecalho'").collect()}
    assert got == {(i, t.count("\n") + 1, "cabecalho") for i, _, _, _, t, _ in rows}


def test_long_lines_and_many_odd_signs(spark):
    head = "Secretaria " + " ".join(f"Nome{i}" for i in range(60))
    assert scans.line_form(head + " de 1") != scans.line_form(head + " do 1")
    assert "secretaria" in set(scans._readings("53cr3t4r14"))
    next_first = "x" * 5000 + "y"
    assert scans._FIRST.match(next_first)[0] == next_first
