"""Cross-tokenizer alignment against whole texts and all interval pairs."""

import numpy as np
import pytest

from flowwarden.llm import alignment, queries
from tests.llm import brute

ODD = ["  a  b \n\tc ", "foo▁bar", "<s>x</s><0x41> <|endoftext|> x", "\x00a", "ﬁ é  x", " ", "", None, " a", "a ", "a  b  c", "\n", "a \n b",
       "a\n \nb", "\x1c x \x85 y", "don't 's  'll", "\U0001f600 \U0001f3f4 日本語 テスト", "x" * 300 + " y", "a　 b ​ c", "﻿a\xa0 b"]


def test_coalesce_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cuts = [np.unique(np.append(rng.integers(1, 30, rng.integers(0, 12)), 30)) for _ in range(2)]
        (a, b), (c, d) = [(np.concatenate([[0], x[:-1]]), x) for x in cuts]
        ga, gb, i, j = alignment.coalesce(a, b, c, d)
        assert list(zip(i, j, strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(c)) if a[x] < d[y] and c[y] < b[x]]
        both = np.intersect1d(b, d)
        assert (ga == np.searchsorted(both, b)).all() and (gb == np.searchsorted(both, d)).all()
    assert [len(x) for x in alignment.coalesce(*[np.zeros(0, np.int64)] * 4)] == [0, 0, 0, 0]


@pytest.mark.parametrize("parts", [1, 7])
def test_alignment(spark, rows, parts):
    texts = [r[1] for r in rows if len(r[1] or "") < 8000] + ODD
    frame = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, pairs array<int>").repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(frame, queries.BYTE_LEVEL, queries.PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == brute.alignment(texts, queries.BYTE_LEVEL, queries.PIECES)


def test_memory_begins_anew(monkeypatch, rows):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    own = alignment.Aligner(open(queries.BYTE_LEVEL, encoding="utf-8").read(), open(queries.PIECES, "rb").read())
    texts = [r[1] for r in rows if len(r[1] or "") < 3000] + ODD
    found = [own.documents([t])[0] for t in texts]
    want = brute.alignment(texts, queries.BYTE_LEVEL, queries.PIECES)
    assert [(*f[0], f[1]) for f in found] == [(*w[:4], w[6]) for w in want]
    groups = alignment.aligned_groups("hello wörld", queries.BYTE_LEVEL, queries.PIECES)
    assert groups and all(a and b for a, b in groups) and alignment.aligned_groups("foo▁bar", queries.BYTE_LEVEL, queries.PIECES) == []


def test_alignment_on_odd_tables(odd, empty):
    found = alignment.align(odd.filter("length(text) < 5000 OR text IS NULL"), queries.BYTE_LEVEL, queries.PIECES).collect()
    texts = [r.text for r in odd.collect() if len(r.text or "") < 5000]
    want = brute.alignment(texts, queries.BYTE_LEVEL, queries.PIECES)
    assert sorted(tuple(r)[1:] for r in found) == sorted(want)
    assert sum(r.doc_id is None for r in found) == 2
    assert alignment.align(empty, queries.BYTE_LEVEL, queries.PIECES).count() == 0


def test_answers_are_not_gathered_in_the_jvm(spark, monkeypatch):
    """Several blocks of one task: each is a row group of its own, and answers of all blocks meet theirs in a cogroup."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from flowwarden.llm import common

    kept = {}
    monkeypatch.setattr(alignment, "stored", lambda df, name, **o: kept.setdefault(name, common.stored(df, name, **o)))
    docs = spark.range(26, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("here there again "), 60_000).alias("text"))
    got = alignment.align(docs, queries.BYTE_LEVEL, queries.PIECES)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == list(range(26)) and len({r[1:] for r in found}) == 1
    assert found[0].n_links > 0 and found[0].count_sum == 26 * found[0].n_links
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept["aligned"].inputFiles()]
    assert sum(g.num_rows for g in groups) > 2 and all(g.num_row_groups == g.num_rows for g in groups)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
