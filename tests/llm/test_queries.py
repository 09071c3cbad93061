"""The registered queries over a driver table, with their SQL where they have some."""

import duckdb
import pytest

from threatloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    columns = sorted(df.columns)
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_chat_format_holds_the_extra_conversation(spark):
    row = queries.op7_chat_format(spark, DATA).where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars, row.n_examples) == (2, len("</s>[INST] ok [/INST]"), 1)
