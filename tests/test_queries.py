import pytest

from lavra.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    def write(**rows):
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_kinds_read_all_pages(spark, tables):
    texts = {
        "contrato": ["Contrato de obra", "x", "CONTRATANTE e contratada", "cláusula"],
        "mail": ["x", "x", "De: Ana\nPara: Beto\nAssunto: Lote"],
        "conversa": ["x", "x", "01/02/20 10:00 - Ana: oi", "01/02/20 10:01 - Beto: oi\n01/02/20 10:02 - Ana: sim"],
        "carta": ["Prezado senhor", "x", "Atenciosamente"],
        "nada": ["x", "x", "Contrato, memorando", "contratante contratada cláusula vigência"],
    }
    rows = [(100 * i + n, d, n, t) for i, (d, pages) in enumerate(texts.items()) for n, t in enumerate(pages, 1)]
    sf = tables(paginas=(rows, "pagina_id long, documento_id string, n int, texto string"))
    got = {r["documento_id"]: (r["tipo"], r["contrato"]) for r in registry.queries()["communication_kinds"](spark, sf).collect()}
    assert got == {"contrato": (None, True), "mail": ("e-mail", False), "conversa": ("conversa", False), "carta": ("carta ou ofício", False), "nada": (None, False)}


def test_proposals_are_held_against_their_page(spark, tables):
    page = "O diretor Carlos Mendes da Alfa Ltda. disse que manteria todos os preços da tabela única."
    quotes = [(1, 1, "disse que manteria todos os preços"), (2, 1, "nunca disse isso a ninguém"), (3, 1, "disse que manteriam todos os preços da tabela única"), (4, 2, "disse que manteria todos os preços"), (5, None, "disse que manteria todos os preços")]
    found = [(i, "d", "pessoas", "Carlos Mendes", "diretor", "Alfa Ltda", n, q, "2024-01-01") for i, n, q in quotes]
    sf = tables(
        achados=(found, "achado_id long, documento_id string, tipo string, nome string, cargo string, empresa string, pagina int, trecho_fonte string, criado_em string"),
        paginas=([(1, "d", 1, page), (2, "d", 2, "Outra coisa bem diferente daquela.")], "pagina_id long, documento_id string, n int, texto string"),
    )
    got = {r["achado_id"]: (r["motivo"], r["alertas"]) for r in registry.queries()["proposal_verification"](spark, sf).collect()}
    assert got == {1: (None, ""), 2: ("trecho não encontrado", ""), 3: (None, "trecho aproximado"), 4: ("trecho não encontrado", "cargo não confirmado; empresa não confirmada"), 5: (None, "")}
