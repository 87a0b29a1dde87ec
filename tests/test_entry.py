import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_keys():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "pontos", "posicao"]


@pytest.mark.parametrize("name", ["triage_lexicon_rank", "bm25_search_topk", "entity_ids_validated", "network_pairs", "dramatis_personae", "entity_directory", "hybrid_rrf"])
def test_against_sql(spark, name):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = lambda rs, at: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in at))) for r in rs)
    assert sorted(names) == sorted(got.columns)
    assert rows(got.collect(), range(len(names))) == rows(want.fetchall(), [names.index(c) for c in got.columns])
