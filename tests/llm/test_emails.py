from lavra.llm import emails

HEAD = "De: Ana Lima <ana@x.example>\nEnviado em: 10/10/2020 10:00\nPara: Beto <beto@y.example>\nAssunto: RE: Lote 3\n"


def new(text):
    lines, labels, _ = emails.label_lines(text)
    return [x for x, label in zip(lines, labels) if label == emails.NEW]


def test_layouts():
    assert new(HEAD + "Oi Beto\n\nEm 09.02.2017 ele escreveu que não participaria.\nDe: 10 a 20 unidades.\n\nAtt,\nAna\nTel.: 1\n\nEnviado do meu celular") == ["Oi Beto", "Em 09.02.2017 ele escreveu que não participaria.", "De: 10 a 20 unidades."]
    assert new(HEAD + "novo\nEm qui., 30 de nov. de 2023 às 02:38, Beto\n<beto@y.example> escreveu:\n\nvelho\nvelho 2") == ["novo"]
    assert new(HEAD + "--- Em 30/08/21, Beto escreveu ---\n| velho\nresposta no meio\n| velho 2\n\nresposta no fim") == ["resposta no meio", "resposta no fim"]
    assert new(HEAD + "novo\n-- \nAna\n\n-----Mensagem original-----\nDe: Beto <b@y.example>\nData: 1/1/2020\nAssunto: Lote 3\nvelho") == ["novo"]
    assert new(HEAD + "-- vou insistir nisso.\nAtenciosamente aguardo a posição.\nP.S.: mais isto") == ["-- vou insistir nisso.", "Atenciosamente aguardo a posição.", "P.S.: mais isto"]
    assert new("De:\nAna Lima <ana@x.example>\nEnviado em:\n10/10/2020\nAssunto:\nLote 3\n\nnovo\r\nAVISO LEGAL: sigiloso.\r\n") == ["novo"]


def test_tables(spark):
    text = HEAD + "Primeira frase nova, com o valor de R$ 10,00.\nSegunda frase nova.\n\nAtt,\nAna"
    copy = HEAD.replace("Ana Lima <ana", "Beto <beto") + "Resposta.\nPrimeira frase nova, com o valor de R$ 10,00.\nSegunda frase nova.\nfim"
    pages = spark.createDataFrame([(1, "d", text, 1), (1, "d", text, 1), (2, "e", copy, 1), (3, "d", None, 1), (4, "d", "", 1), (5, "z", text, 1), (None, "d", text, 1), (6, None, text, 1)], "pagina_id long, documento_id string, texto string, caso_id int")
    files = spark.createDataFrame([("d", "C", "e-mail"), ("d", "C", "e-mail"), ("e", "C", "e-mail"), ("z", "C", "carta"), (None, "C", "e-mail")], "documento_id string, caso_id string, tipo_comunicacao string")
    got = {tuple(r) for r in emails.new_lines(pages.drop("caso_id"), files).collect()}
    assert got == {(1, 5), (1, 6), (2, 5), (2, 8)}  # what was copied without quote marks from the thread is not new
    assert emails.new_lines(pages.limit(0), files).count() == 0


def test_long(spark):
    text = HEAD + "\n".join(f"linha {i}" for i in range(30_000))
    assert len(new(text)) == 30_000


def test_patterns_decide(spark):
    """Earlier sentences without marks, wrapped anew, joined to other words, in part, and by the order of instants."""
    head = lambda who, day: f"De: {who} <{who.lower()}@x.example>\nEnviado em: {day}/10/2020 10:00\nPara: Beto <beto@y.example>\nAssunto: RE: Lote 3\n"
    first = head("Ana", 10) + "A medição do trecho norte ficou em doze mil metros cúbicos e será paga em março.\nPrecisamos da planilha antes da reunião de quinta."
    wrapped = head("Beto", 11) + "De acordo.\n\nA medição do trecho norte ficou em\ndoze mil metros cúbicos e será\npaga em março. Precisamos da planilha\nantes da reunião de quinta.\n\nSegue o resto amanhã."
    joined = head("Caio", 12) + "ela disse: a medição do trecho norte ficou\nem doze mil metros cúbicos e será paga em março, mas eu duvido.\nnada mais"
    part = head("Dora", 13) + "trecho norte ficou em doze mil metros\ncúbicos e será paga em março\nObrigada pelo aviso."
    before = head("Eva", 9) + "A medição do trecho norte ficou em doze mil metros cúbicos e será paga em março."
    other = before.replace("Lote 3", "Lote 4").replace("/10/", "/11/")
    goes_on = "Precisamos da planilha antes da\nreunião de quinta. A medição do trecho norte ficou em doze mil metros cúbicos\nfim"
    quoted = head("Gil", 14) + "Veja.\n> O laudo do perito chegou ontem à tarde no protocolo central sem anexo.\n"
    after = head("Hugo", 15) + "O laudo do perito chegou ontem\nà tarde no protocolo central sem anexo.\nRecebi."
    rows = [(1, "a", 1, first), (2, "b", 1, wrapped), (3, "c", 1, joined), (4, "d", 1, part), (5, "e", 1, before), (6, "f", 1, other), (7, "d", 2, goes_on), (8, "g", 1, quoted), (9, "h", 1, after)]
    pages = spark.createDataFrame(rows, "pagina_id long, documento_id string, n int, texto string")
    files = spark.createDataFrame([(d, "C", "e-mail") for d in "abcdefgh"], "documento_id string, caso_id string, tipo_comunicacao string")
    got = {}
    for page, line in emails.new_lines(pages, files).collect():
        got.setdefault(page, []).append(line)
    assert sorted(got.pop(1)) == [6]  # the sentence of line 5 is Eva's, of the day before
    assert sorted(got.pop(2)) == [5, 12]
    assert sorted(got.pop(3)) == [5, 6, 7]  # lines with words of their own stay
    assert sorted(got.pop(4)) == [7]
    assert sorted(got.pop(5)) == [5] and sorted(got.pop(6)) == [5]
    assert sorted(got.pop(7)) == [3]  # the second page belongs to the message of the first
    assert sorted(got.pop(8)) == [5] and sorted(got.pop(9)) == [7] and not got


def test_copies_and_undated(spark):
    dated = HEAD + "O parecer da comissão foi favorável ao pagamento da última medição da obra."
    undated = dated.replace("Enviado em: 10/10/2020 10:00\n", "").replace("Ana Lima <ana@x.example>", "Caio <caio@x.example>")
    pages = spark.createDataFrame([(1, "a", 1, dated), (2, "b", 1, dated), (3, "c", 1, undated)], "pagina_id long, documento_id string, n int, texto string")
    files = spark.createDataFrame([(d, "C", "e-mail") for d in "abc"], "documento_id string, caso_id string, tipo_comunicacao string")
    assert {tuple(r) for r in emails.new_lines(pages, files).collect()} == {(1, 5), (2, 5)}


def test_hot_thread(spark):
    """A third of all messages in one thread, each quoting the first without marks."""
    text = "De: P{0} <p{0}@x.example>\nEnviado em: 10/10/2020 {1:02d}:{2:02d}\nAssunto: Lote 3\nNúmero {0} de hoje.\nO mesmo aviso de sempre sobre o prazo da obra da ponte."
    rows = [(i, f"d{i}", 1, text.format(i, i // 60, i % 60)) for i in range(600)]
    pages = spark.createDataFrame(rows, "pagina_id long, documento_id string, n int, texto string")
    files = spark.createDataFrame([(f"d{i}", "C", "e-mail") for i in range(600)], "documento_id string, caso_id string, tipo_comunicacao string")
    assert {tuple(r) for r in emails.new_lines(pages, files).collect()} == {(0, 5), *((i, 4) for i in range(600))}


def test_thread_of_sentences_that_share_runs(spark):
    """Very many different sentences of one thread begin with the same words: each run counts once, where it came first."""
    text = "De: P{0} <p{0}@x.example>\nEnviado em: 10/10/2020 {1:02d}:{2:02d}\nAssunto: Lote 3\nSegue em anexo o relatório de medição número {0} da obra da ponte."
    rows = [(i, f"d{i}", 1, text.format(i, i // 60, i % 60)) for i in range(900)]
    rows.append((5000, "d5000", 1, text.format(5000, 23, 59).replace("Segue", "Ele disse:\nsegue").replace("5000 da obra", "7 da\nobra")))
    pages = spark.createDataFrame(rows, "pagina_id long, documento_id string, n int, texto string")
    files = spark.createDataFrame([(d, "C", "e-mail") for _, d, _, _ in rows], "documento_id string, caso_id string, tipo_comunicacao string")
    assert emails.page_patterns(emails._pages(pages, files)).agg({"pagina_id": "count"}).first()[0] == 900
    got = {tuple(r) for r in emails.new_lines(pages, files).collect()}
    assert got == {*((i, 4) for i in range(900)), (5000, 4)}
