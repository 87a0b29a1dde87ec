import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lavra.sources import files, ocr, providers, sinks
from lavra.streaming import incremental


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("\n".join(f"linha {i}" for i in range(160)).encode())
    (tmp_path / "sub" / "b ç.html").write_bytes("<html><head><title>T á</title><script>x</script></head><body>Um<br>dois<p>três &amp; quatro</p></body></html>".encode("latin-1"))
    (tmp_path / "~$c.docx").write_bytes(b"x")
    (tmp_path / ".oculto").write_bytes(b"x")
    (tmp_path / "d.xyz").write_bytes(b"x")
    rows = files.with_digest(files.scan(spark, str(tmp_path)))
    got = {r["caminho"]: r["tipo"] for r in rows.collect()}
    assert got == {"a.txt": "txt", "sub/b ç.html": "html", "d.xyz": None}
    texts = files.decoded(rows.where("tipo = 'txt'"), "documento_id", "content")
    assert [(r["n"], r["primeira"], r["ultima"]) for r in files.text_pages(texts, "documento_id", "texto").orderBy("n").collect()] == [(1, 1, 150), (2, 151, 160)]
    page = files.html_pages(rows.where("tipo = 'html'"), "documento_id", "content").first()
    assert page["titulo"] == "T á" and [x for x in page["texto"].split("\n") if x] == ["Um", "dois", "três & quatro"]


def test_decode():
    assert files.decode("é".encode()) == files.decode("é".encode("utf-8-sig")) == files.decode("é".encode("cp1252")) == "é"
    assert files.decode(None) == "" and files.decode(b"\x81") == "\x81"


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"a": 1}), "{quebrado", json.dumps({"a": 2})]))
    assert sorted(r["a"] for r in files.log_records(spark, str(tmp_path), "a int").collect() if r["a"] is not None) == [1, 2]


def test_ocr_boxes(spark):
    line = lambda *c: "\t".join(map(str, c))
    tsv = "\n".join(["level\tpage\t...", line(5, 1, 1, 1, 1, 1, 0, 0, 0, 0, 90, "Ata"), line(5, 1, 1, 1, 1, 2, 0, 0, 0, 0, 80, "de"), line(5, 1, 1, 1, 2, 1, 0, 0, 0, 0, -1, "reunião"), line(5, 1, 1, 2, 1, 1, 0, 0, 0, 0, 70, "Fim"), line(4, 1, 1, 2, 1, 0, 0, 0, 0, 0, -1, " ")])
    words = ocr.boxes(spark.createDataFrame([(1, tsv), (2, None)], "id long, tsv string"), "id", "tsv")
    got = ocr.page_text(words, "id").first()
    assert (got["texto"], got["confianca"], got["palavras"]) == ("Ata de\nreunião\n\nFim", 80.0, 4)
    assert ocr.export_text(words, "id").first()["texto"] == "Ata de\nFim"


def test_providers(spark):
    def shout(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["id"] == 3).any():
            raise RuntimeError("sem rede")
        return pd.DataFrame({"id": frame["id"], "resposta": frame["t"].str.upper()})

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    got = {r["id"]: (r["resposta"], r["erro"]) for r in providers.run_provider(rows, shout, "id long, resposta string").collect()}
    assert got[1] == ("A", None) and got[2] == ("B", None) and got[3][0] is None and "sem rede" in got[3][1]
    with pytest.raises(ValueError):
        providers.run_provider(rows, shout, "id long, resposta string", capability=providers.Capability("nuvem", "1", local=False))


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("d", 1), ("e", 2)], "d string, v int")
    sinks.replace_partitions(a, str(tmp_path / "t"), "d")
    sinks.replace_partitions(spark.createDataFrame([("d", 9)], "d string, v int"), str(tmp_path / "t"), "d")
    assert {(r["d"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("d", 9), ("e", 2)}
    for _ in range(2):
        sinks.append_log(a, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert "| d | v |" in sinks.markdown(a, "Título", 5)


def test_new_files_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    handle = lambda df, n: df.write.mode("append").parquet(out)
    for k in range(2):
        spark.createDataFrame([(k,)], "v long").write.mode("append").parquet(source)
        incremental.process_new(spark, source, "v long", str(tmp_path / "ck"), handle).awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [0, 1]


def test_current_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, o long").write.parquet(source)
    stream = incremental.current_state(spark.readStream.schema("k long, v string, o long").parquet(source), ["k"], "o")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("estado").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["v"]) for r in spark.table("estado").collect()} == {(1, "b"), (2, "c")}


def test_run_state(spark):
    rows = spark.createDataFrame([("a", True), ("b", False)], "execucao string, terminado boolean").withColumn("batimento", F.current_timestamp() - F.expr("interval 1 minute"))
    assert {r["execucao"]: r["estado"] for r in incremental.run_state(rows).collect()} == {"a": "concluída", "b": "interrompida"}
