"""Exact neighbours through the inverted file and the broadcast sides, against all pairs."""

import numpy as np
import pytest

from flowwarden.operators import vectors


def all_pairs(queries, corpus, n):
    out = {}
    units = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for i, v in corpus}
    for i, v in queries:
        u = np.array(v) / (np.linalg.norm(v) or 1.0)
        near = sorted((round(float(1 - u @ w), 9), j) for j, w in units.items() if j != i)[:n]
        out[i] = near
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((round(r.distance, 9), r.doc_id))
    return out


@pytest.fixture(scope="module")
def cloud():
    """Tight groups, zero vectors, equal vectors and one group with a third of all rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (8, 6))
    rows = [(f"d{i:03d}", (centres[i % 8 if i % 3 else 0] + rng.normal(0, 0.05, 6)).tolist()) for i in range(300)]
    return rows + [("z1", [0.0] * 6), ("z2", [0.0] * 6), ("same1", rows[5][1]), ("same2", [2 * x for x in rows[5][1]])]


@pytest.mark.parametrize("packed, block", [(1000, 64), (0, 1000), (0, 40), (0, 7)])
@pytest.mark.parametrize("n", [1, 4])
def test_nearest_equals_all_pairs(spark, cloud, packed, block, n):
    corpus = spark.createDataFrame(cloud, "id string, embedding array<double>").repartition(3)
    asked = [*cloud[::4], ("new", [1.0, -1.0, 0.0, 0.0, 2.0, 0.0]), cloud[-3], cloud[-4]]
    queries = spark.createDataFrame(asked, "id string, embedding array<double>").dropDuplicates(["id"])
    got = found(vectors.nearest(queries, corpus, n, packed, block))
    assert got == {i: near for i, near in all_pairs(asked, cloud, n).items() if near}


def test_packed_queries_emit_n_rows_a_partition(spark, cloud, monkeypatch):
    corpus = spark.createDataFrame(cloud, "id string, embedding array<double>").repartition(2)
    queries = spark.createDataFrame(cloud[:5], "id string, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        pairs = vectors._against_packed(corpus, queries.toPandas(), 2, False)
        assert pairs.count() <= 2 * 5 * 2
        assert found(vectors._top(pairs, 2)) == all_pairs(cloud[:5], cloud, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_and_no_documents(spark, cloud):
    shape = "id string, embedding array<double>"
    queries, two, none = (spark.createDataFrame(r, shape) for r in (cloud[:6], cloud[:2], []))
    assert found(vectors.nearest(queries, two, 3, 0, 4)) == all_pairs(cloud[:6], cloud[:2], 3)
    assert vectors.nearest(queries, none, 3).count() == 0 and vectors.nearest(none, two, 3, 0, 4).count() == 0


def test_vectors_travel_once_a_part(spark, cloud, monkeypatch):
    """Many small blocks: what the search stores, and the rows it deals, do not grow with queries times blocks."""
    kept = []
    monkeypatch.setattr(vectors, "materialise", lambda df: kept.append(df.persist()) or kept[-1])
    corpus = spark.createDataFrame(cloud, "id string, embedding array<double>")
    got = found(vectors.nearest(corpus, corpus, 3, 0, 4))
    assert got == all_pairs(cloud, cloud, 3)
    assert sum(k.count() for k in kept) <= len(cloud)


def test_lines_show_cut_documents(spark):
    memory = spark.createDataFrame(
        [(c, f"{c[:1]}", "é" * 500, {"event_id": "7", "correction_type": "FP", "playbook": "ALLOW", "fused_risk": "0.5", "threat": "DoS"}, [1.0, 0.5])
         for c in (vectors.INCIDENTS, vectors.CORRECTIONS, vectors.RULES)],
        "collection string, doc_id string, document string, metadata map<string,string>, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.4])], "id string, embedding array<double>")
    block = vectors.context_block(asked, memory)
    assert [line.count("é") for line in block.first().block.split("\n") if "é" in line] == [160, 180, 200]


def test_far_clusters_are_not_visited(spark, cloud, monkeypatch):
    """Pairs that leave the search stay far below queries times blocks."""
    rows = [(i, v) for i, v in cloud if any(v)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>")
    pairs = vectors._indexed(corpus, corpus, 1, 20)
    assert pairs.count() < len(rows) * 8


@pytest.fixture(scope="module")
def few_vectors(tmp_path_factory):
    """Items 1 to 40, none divisible by 100, documents of the odd ones, and the folder of these tables."""
    import pandas as pd

    rng, folder = np.random.default_rng(5), tmp_path_factory.mktemp("few")
    ids = list(range(1, 41))
    pd.DataFrame({"vec_id": ids, "label": [i % 3 for i in ids], "embedding": rng.random((40, 4)).tolist()}).to_parquet(folder / "embeddings.parquet")
    pd.DataFrame({"doc_id": ids[::2], "text": [f"text {i}" for i in ids[::2]]}).to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["knn_blocked", "knn", "context_block", "context_block_documents"])
def test_every_vector_asks(spark, few_vectors, name):
    """No row is left out of the search because of its id."""
    from flowwarden.catalog import load

    asked = {r.query_id for r in load()[0][name](spark, few_vectors).collect()}
    assert asked == {str(i) for i in range(1, 41)}
