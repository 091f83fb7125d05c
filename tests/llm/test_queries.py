"""Registered corpus queries against their SQL, and against what the contract says where SQL can't."""

import duckdb
import pytest

from tidemark.llm import near_dedup, queries

SF = "/root/testdata/sf0.001"


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].convert_dtypes().astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name_} as select * from read_parquet('{SF}/{name_}.parquet')")
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(con.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("members", [256, 5])
def test_no_link_of_the_given_documents_is_lost(spark, monkeypatch, members):
    """Recall of links on whole sf0.01, whatever the blocks: components equal those of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = plain(con.execute(near_dedup.OP5_SQL).df())
    assert plain(queries.QUERIES["op5_minhash_near_dedup"](spark, "/root/testdata/sf0.01").toPandas()) == want
