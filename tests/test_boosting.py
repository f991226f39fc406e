"""Boosted trees over categories: splits, counts, curves, round trips."""

from itertools import combinations as choose

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwarden.models import boosting
from flowwarden.models.boosting import Booster, Encoding, grow, isotonic


@pytest.fixture
def table():
    rng = np.random.default_rng(7)
    codes = np.array([(a, b, c) for a in range(5) for b in range(3) for c in range(2)])
    n = rng.integers(1, 60, len(codes)).astype(float)
    p = 1 / (1 + np.exp(-(codes[:, 0] % 3 - 1.0 + (codes[:, 1] == 1) * codes[:, 2])))
    return codes, np.floor(n * p), n


def test_first_split_is_the_best_of_all_sets(table):
    """A single level: no set of a feature's categories gains more than the prefix that was taken."""
    codes, ones, n = table
    own = grow(codes, ones, n, n, [5, 3, 2], 1, 1, 0.05)
    p = ones.sum() / n.sum()
    g, h = n * p - ones, n * p * (1 - p)
    best = (0.0, None)
    for j, k in enumerate([5, 3, 2]):
        for size in range(1, k):
            for chosen in choose(range(k), size):
                left = np.isin(codes[:, j], chosen)
                score = sum(g[m].sum() ** 2 / (h[m].sum() + boosting.L2) for m in (left, ~left))
                if score > best[0] + 1e-9:
                    best = score, (j, left)
    j, left = best[1]
    assert own.feature[0, 0] == j
    got = own.left[0, 0][codes[:, j]]
    assert (got == left).all() or (got == ~left).all()
    leaf = np.where(got, 0, 1)
    want = [-0.05 * g[leaf == x].sum() / (h[leaf == x].sum() + boosting.L2) for x in (0, 1)]
    assert own.value[0] == pytest.approx(want)
    assert own.margin(codes) == pytest.approx(own.prior + np.array(want)[leaf])


def test_loss_falls_and_counts_stand_for_rows(table):
    codes, ones, n = table
    loss = []
    for rounds in (1, 10, 100, 400):
        p = grow(codes, ones, n, n, [5, 3, 2], rounds, 4, 0.1).probability(codes)
        loss.append(-(ones * np.log(p) + (n - ones) * np.log(1 - p)).sum())
    assert loss == sorted(loss, reverse=True) and loss[-1] < loss[0]
    each = np.repeat(np.arange(len(codes)), n.astype(int))
    label = np.concatenate([np.arange(int(k)) < o for k, o in zip(n, ones, strict=True)]).astype(float)
    rows = grow(codes[each], label, np.ones(len(each)), np.ones(len(each)), [5, 3, 2], 20, 3, 0.1)
    assert rows.probability(codes) == pytest.approx(grow(codes, ones, n, n, [5, 3, 2], 20, 3, 0.1).probability(codes))


def test_one_class_unseen_and_no_rows(table):
    codes, ones, n = table
    assert grow(codes, n, n, n, [5, 3, 2], 5, 3, 0.1).probability(codes).min() > 0.99
    assert grow(codes, 0 * n, n, n, [5, 3, 2], 5, 3, 0.1).probability(codes).max() < 0.01
    assert grow(codes[:0], n[:0], n[:0], n[:0], [0, 0, 0], 5, 3, 0.1).probability(codes) == pytest.approx(0.5)
    own = grow(codes, ones, n, n, [5, 3, 2], 30, 3, 0.1)
    assert np.isfinite(own.probability(np.array([[5, 3, 2]]))).all()
    again = Booster.of(boosting.from_bytes(boosting.to_bytes(own.parts())))
    assert (again.probability(codes) == own.probability(codes)).all()
    strict = grow(codes, ones, n, np.ones(len(n)), [5, 3, 2], 30, 3, 0.1, min_rows=len(n))
    assert (strict.feature < 0).all()


def test_isotonic_is_the_least_squares_curve():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, w = rng.integers(0, 12, 25) / 10, rng.integers(1, 5, 25).astype(float)
        y = np.floor(w * rng.random(25))
        points, values = isotonic(x, w, y)
        xs = np.unique(x)
        means, weights = [y[x == v].sum() / w[x == v].sum() for v in xs], [w[x == v].sum() for v in xs]
        # The largest mean over left ends of the smallest over right ends is the isotonic fit.
        fit = [max(min(np.average(means[a:b + 1], weights=weights[a:b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
        assert np.interp(xs, points, values) == pytest.approx(fit)
        assert (np.diff(values) >= 0).all() and (np.diff(points) > 0).all()
    assert [c.tolist() for c in isotonic(*[np.zeros(0)] * 3)] == [[0.0], [0.0]]


def test_combinations_count_every_row(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("a", "x", 0), (None, "x", 0)] * 5, "c1 string, c2 string, label int").repartition(3)
    found = boosting.combinations(df, ["c1", "c2"], F.col("label"))
    assert sorted(found.itertuples(index=False, name=None)) == [("a", "unknown", 1, 10), ("a", "x", 0, 5), ("unknown", "x", 0, 5)]
    kept = boosting.combinations(df, ["c1", "c2"], F.col("label"), bound=2)
    assert len(kept) == 2 and kept.equals(boosting.combinations(df.repartition(2), ["c1", "c2"], F.col("label"), bound=2))
    codes = Encoding(("c1",), (("a", "b"),)).codes([pa.array(["b", None, "z", "a"])])
    assert codes.ravel().tolist() == [1, 2, 2, 0]
    table, line, n = boosting.table_of(pd.DataFrame({"c0": ["b", "a", "b"], "label": [1, 0, 0], "n": [3, 4, 5]}), Encoding(("c0",), (("a", "b"),)))
    assert table.ravel().tolist() == [0, 1] and line.tolist() == [1, 0, 1] and n.tolist() == [3, 4, 5]
