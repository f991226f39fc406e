"""Every query with SQL agrees with it, row for row, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, tiny, con):
    df = QUERIES[name](spark, tiny)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", ["slim_context", "pca_view", "prompts", "embed"])
def test_gives_rows(name, spark, tiny):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_memory_holds_every_document(spark):
    """Documents without a given vector are remembered too, and come into blocks."""
    import re

    from flowwarden.catalog import memory

    sf_dir = "/root/testdata/sf0.01"  # half of its documents have no vector
    documents, given = ({r[0] for r in duckdb.sql(f"SELECT {c} FROM '{sf_dir}/{t}.parquet'").fetchall()}
                        for c, t in (("doc_id", "documents"), ("vec_id", "embeddings")))
    held = {int(r.doc_id): len(r.embedding) for r in memory.stored_whole(spark, sf_dir).select("doc_id", "embedding").collect()}
    assert documents - given and set(held) == documents | given and len(set(held.values())) == 1
    blocks = QUERIES["context_block_documents"](spark, sf_dir).collect()
    assert {int(r.query_id) for r in blocks} == given
    shown = {int(n) for r in blocks for n in re.findall(r"\. Event (\d+) →", r.block)}
    assert shown & (documents - given) and shown & given
