from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lavra.operators import timestamps
from lavra.operators.timestamps import normalize

SP, LISBON = "America/Sao_Paulo", "Europe/Lisbon"


@pytest.mark.parametrize(
    ("raw", "us", "zone", "normal"),
    [
        ("18/02/2020 12:41", False, SP, "2020-02-18T15:41:00Z"),
        ("5/31/2013 1:54 PM", True, SP, "2013-05-31T16:54:00Z"),
        ("12:00", False, SP, None),
        ("Sat, 10 Jan 2015 11:59:52 -0200", False, LISBON, "2015-01-10T13:59:52Z"),
        ("28 Oct 2021 14:30:27 -0330", False, SP, "2021-10-28T18:00:27Z"),
        ("quarta-feira, 14 de fevereiro de 2018 21:11", False, LISBON, "2018-02-14T21:11:00Z"),
        ("seg., 19 de nov. de 2018 às 17:11", False, "America/Manaus", "2018-11-19T21:11:00Z"),
        ("22-02-2012 10:31:30 (UTC-04:00)", False, SP, "2012-02-22T14:31:30Z"),
        ("02/12/2014 10:27 AMT", False, SP, "2014-12-02T14:27:00Z"),
        ("Sun Sep  4 11:57:47 BRT 2016", False, LISBON, "2016-09-04T14:57:47Z"),
        ("[10/09/2022, 12:42:38]", False, LISBON, "2022-09-10T11:42:38Z"),
        ("1556021889", False, None, "2019-04-23T12:18:09Z"),
        ("1406396203369", False, None, "2014-07-26T17:36:43Z"),
        ("20130620T225304Z", False, SP, "2013-06-20T22:53:04Z"),
        ("20161028152010", False, "America/Cuiaba", "2016-10-28T18:20:10Z"),
        ("2018-11-04T01:10:33.5-02:00", False, None, "2018-11-04T03:10:33Z"),
        ("09/08/2012 06:47 (horário de Brasília)", False, LISBON, "2012-08-09T09:47:00Z"),
        ("17/03/2020 - 15h57", False, SP, "2020-03-17T18:57:00Z"),
        ("Sunday, July 23, 2023 3:05 PM", True, LISBON, "2023-07-23T14:05:00Z"),
        ("17/01/13", False, SP, "2013-01-17"),
        ("1º de março de 2016", False, SP, "2016-03-01"),
        ("23 NOV 2020", False, SP, "2020-11-23"),
        ("Fevereiro/2013", False, SP, "2013-02"),
        ("03/2020", False, SP, "2020-03"),
        ("31/02/2019 10:00", False, SP, None),
        ("32 de maio de 2017 09:00", False, SP, None),
        ("0000-00-00 00:00", False, SP, None),
        ("13/25/2020", True, SP, None),
        ("10/10/2020 10:00", False, None, None),
        ("ontem", False, SP, None),
        ("", False, SP, None),
        (None, False, SP, None),
    ],
)
def test_notations(raw, us, zone, normal):
    assert normalize(raw, us, zone) == normal


def test_daylight_saving():
    # 02:30 doesn't exist on this day in New York; it counts with the offset before the change
    assert normalize("2021-03-14 02:30", False, "America/New_York") == "2021-03-14T07:30:00Z"
    # 01:30 occurs twice and means the first
    assert normalize("2021-11-07 01:30", False, "America/New_York") == "2021-11-07T05:30:00Z"


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2037, 1, 1)), st.sampled_from([SP, LISBON, "America/New_York"]))
def test_round_trip(when, zone):
    when = when.replace(microsecond=0)
    local = when.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
    shown = f"{local:%d/%m/%Y %H:%M:%S}"
    back = normalize(shown, False, zone)
    if local.fold == 0:
        assert back == f"{when:%Y-%m-%dT%H:%M:%S}Z"
    else:
        assert back == f"{when - timedelta(hours=1):%Y-%m-%dT%H:%M:%S}Z"


def _tables(spark, mensagens, entidades, arquivos):
    return (
        spark.createDataFrame(mensagens, "mensagem_id long, documento_id string, data string, idioma_cliente string, fuso_origem string, normal string"),
        spark.createDataFrame(entidades, "entidade_id long, documento_id string, datas array<struct<bruto string, paginas array<int>>>"),
        spark.createDataFrame(arquivos, "documento_id string, fuso_coleta string, extraido_em timestamp"),
    )


def test_tables(spark, tmp_path):
    t = datetime(2024, 1, 1)
    m, e, a = _tables(
        spark,
        [(1, "d", "01/02/2020 10:00", "pt-BR", None, "x"), (1, "d", "01/02/2020 10:00", "pt-BR", None, "x"), (2, "z", None, None, None, None), (3, "z", "01/02/2020", None, None, None), (None, "d", "01/02/2020", None, None, None)],
        [(7, "d", [("01/02/2020", [1]), (None, None), ("03/2020", [2])]), (7, "d", [("01/02/2020", [1]), (None, None), ("03/2020", [2])]), (8, "d", None)],
        [("d", LISBON, t), ("d", SP, t + timedelta(1)), (None, SP, t), ("z", None, t)],
    )
    got = {tuple(r) for r in timestamps.message_and_entity_dates(m, e, a, str(tmp_path / "dict")).collect()}
    assert got == {("mensagens", 1, 0, "2020-02-01T13:00:00Z"), ("mensagens", 3, 0, "2020-02-01"), ("entidades", 7, 1, "2020-02-01"), ("entidades", 7, 3, "2020-03")}


def test_dictionary_grows_only_by_new_entries(spark, tmp_path):
    path = str(tmp_path / "dict")
    rows = lambda *v: spark.createDataFrame([(x, False, SP) for x in v], "bruto string, mes_antes boolean, fuso string")
    timestamps.update_dictionary(rows("01/02/2020", "nada"), path)
    again = timestamps.update_dictionary(rows("01/02/2020", "nada", "02/02/2020"), path)
    assert sorted(r["bruto"] for r in again.collect()) == ["01/02/2020", "02/02/2020", "nada"]


def test_empty_tables(spark, tmp_path):
    m, e, a = _tables(spark, [], [], [])
    assert timestamps.message_and_entity_dates(m, e, a, str(tmp_path / "dict")).count() == 0
