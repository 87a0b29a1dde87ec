from datetime import datetime

from lavra.llm import spellings

NAMES = ["Renata Alves", "Carlos Lima", "Antônia Prado", "Antônio Prado", "Isabel Castro", "Francisco Melo", "Paulo Reis", "Paula Reis"]


def tables(spark, achados, comunicacoes):
    t = datetime(2024, 1, 1)
    many = [(10_000 + i * 100 + k, f"K{k}", "pessoas", n, t) for i, n in enumerate(NAMES) for k in range(12)]
    firms = [(20_000 + k, f"K{k}", "empresas", f"Marca{'abcdefghijkl'[k]}xo {a} Ltda.", t) for k, a in enumerate(["Engenharia", "Transportes", "Comércio e Serviços"] * 4)]
    rows = [(i, c, kind, n, t) for i, c, kind, n in achados]
    return (
        spark.createDataFrame(many + firms + rows, "achado_id long, caso_id string, tipo string, nome string, criado_em timestamp"),
        spark.createDataFrame(comunicacoes, "pessoa_id long, caso_id string, nomes array<string>, endereco string, extra string"),
    )


def clusters(spark, achados, comunicacoes=()):
    a, c = tables(spark, achados, list(comunicacoes))
    out = {}
    for r in spellings.attribute(a, c).where("caso_id = 'C'").collect():
        out.setdefault(r["entidade"], set()).add(r["nome"])
    return {frozenset(v) for v in out.values()}


def test_people(spark):
    names = ["Isabel Borba Castro", "ISABEL CASTRO", "CASTRO Isabel", "Castro, Isabel Borba", "I. Castro", "isabel.castro", "Dra. Castro", "Izabel Castro", "Isabel Catsro", "IB Castro", "Bel"]
    others = ["Antônia Prado", "Antônio Prado", "Paulo Reis", "Paulo Reis Filho"]
    got = clusters(spark, [(i, "C", "pessoas", n) for i, n in enumerate(names + others)], [(1, "C", ["Bel", "Isabel Castro", None, ""], "isabel.castro@x.example", "y")])
    assert frozenset(names + ["Isabel Castro"]) in got
    assert all(frozenset([n]) in got for n in others)


def test_firms(spark):
    one = ["Zeltor Engenharia Ltda.", "ZELTOR ENG.", "Empresa Zeltor Engenharia", "Engenharia Zeltor Ltda.", "Zetor Engenharia Ltda", "zeltor engenharia"]
    sister = ["Zeltor Transportes S.A.", "Zeltor Transp. S/A"]
    got = clusters(spark, [(i, "C", "empresas", n) for i, n in enumerate(one + sister)])
    assert frozenset(one) in got and frozenset(sister) in got


def test_pairs_and_edges(spark):
    a, c = tables(spark, [(1, "C", "pessoas", "Carlos Lima"), (1, "C", "pessoas", "Carlos Lima"), (2, "C", "pessoas", "CARLOS LIMA"), (3, "D", "pessoas", "Carlos  Lima"), (4, None, "pessoas", "Carlos Lima"), (5, "C", "pessoas", None), (6, "C", "pessoas", "  "), (7, "C", "pessoas", "x" * 5000)], [(1, None, None, None, None), (2, "C", [], None, None)])
    got = {tuple(r) for r in spellings.same_names(a, c).where("caso_id in ('C', 'D')").collect()}
    assert got == {("C", "CARLOS LIMA", "Carlos Lima")}


def test_empty(spark):
    a, c = tables(spark, [], [])
    assert spellings.same_names(a.limit(0), c).count() == 0


def test_edits():
    assert spellings.edits("luciana", "lcuiana") == 1 and spellings.edits("abc", "abc") == 0 and spellings.edits("abcdef", "x", 2) == 3
