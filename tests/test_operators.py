"""Ordered helpers, evaluation, sampling and scalers against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.functions import scores
from flowwarden.operators import evaluation, features, ordered, sampling


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2500):
        label = int(rng.random() < .35)
        score = min(1.0, max(0.0, rng.gauss(.6 if label else .4, .2)))
        if i % 3 == 0:
            score = .01 + rng.randint(0, 999) * (.98 / 999)  # on a sweep point
        if i % 3 == 1:
            score = .5  # one hot value
        rows.append((i, label, score, rng.choice("abc")))
    return rows, spark.createDataFrame(rows, "seq long, label int, score double, k string").repartition(6)


def test_percentiles_equal_numpy(scored):
    rows, df = scored
    shares = [0.0, .01, .05, .25, .5, .95, .99, .999, 1.0]
    got = ordered.exact_percentiles(df, ["k"], "score", shares).collect()
    for r in got:
        own = [x[2] for x in rows if x[3] == r.k]
        assert [r[f"p{i}"] for i in range(len(shares))] == pytest.approx(list(np.percentile(own, [s * 100 for s in shares])), abs=1e-12)
    one = ordered.exact_percentiles(df, [], "score", [.5]).first()
    assert one.p0 == pytest.approx(np.percentile([x[2] for x in rows], 50))


def test_sweep_equals_brute_force(scored):
    rows, df = scored
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    got = {round(r.threshold, 9): (r.tn, r.fp, r.fn, r.tp) for r in evaluation.sweep_table(df, "label", "score").collect()}
    assert len(got) == 1000
    best, best_cost = .5, math.inf
    for t in np.linspace(.01, .99, 1000):
        p = s >= t
        want = (int((~p & (y == 0)).sum()), int((p & (y == 0)).sum()), int((~p & (y == 1)).sum()), int((p & (y == 1)).sum()))
        assert got[round(float(t), 9)] == want, t
        tn, fp, fn, tp = want
        if tp + fp and tp / (tp + fp) >= .4 and tp / (tp + fn) >= .3 and fn * 10 + fp * 2 < best_cost:
            best, best_cost = float(t), fn * 10 + fp * 2
    assert best_cost < math.inf
    r = evaluation.optimal_threshold(df, "label", "score", min_precision=.4, min_recall=.3).first()
    assert (r.optimal_threshold, r.soc_cost, r.is_fallback) == (pytest.approx(best), best_cost, False)


def test_sweep_without_positives_falls_back(spark):
    df = spark.createDataFrame([(0, .2), (0, .7)], "label int, score double")
    r = evaluation.optimal_threshold(df, "label", "score").first()
    assert (r.optimal_threshold, r.is_fallback, r.soc_cost, r.achieved_recall) == (.5, True, 2, 0.0)


def test_published_threshold_is_sweep_point_794(spark):
    r = spark.range(1).select(evaluation.sweep_point(F.lit(794), 1000).alias("t")).first()
    assert r.t == pytest.approx(0.788898898898899, abs=1e-15)
    assert 651 * 12 + 14860 * 2 == 37532


def test_auc_equals_pair_count(scored):
    rows, df = scored
    pos, neg = [r[2] for r in rows if r[1] == 1], np.array([r[2] for r in rows if r[1] == 0])
    wins = sum((neg < p).sum() + (neg == p).sum() / 2 for p in pos)
    assert evaluation.roc_auc(df, "label", "score").first().auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    curve = sorted((r.fpr, r.tpr) for r in evaluation.roc_curve(df, "label", "score").collect())
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-9)


@pytest.mark.parametrize("width", [19, 20, 64, 1 << 20])
def test_trailing_mean_over_gaps_and_any_block_width(spark, width):
    rng = random.Random(width)
    seq, rows = 0, []
    for _ in range(300):
        seq += rng.choice([1, 1, 2, 50])
        rows.append((seq, rng.choice("xy"), rng.random()))
    df = spark.createDataFrame(rows, "seq long, k string, v double").repartition(5)
    for keys in ([], ["k"]):
        got = {r.seq: r.m for r in ordered.trailing_mean(df, "v", "seq", "m", keys=keys, width=width).collect()}
        assert len(got) == len(rows)
        seen = {}
        for s, k, v in rows:
            buffer = seen.setdefault(k if keys else None, [])
            buffer.append(v)
            assert got[s] == pytest.approx(sum(buffer[-20:]) / len(buffer[-20:]))


def test_folds_and_holdout_are_stratified_and_repeatable(scored):
    rows, df = scored
    a = {r.seq: r.fold for r in sampling.stratified_folds(df, "k", "seq").collect()}
    b = {r.seq: r.fold for r in sampling.stratified_folds(df.repartition(3), "k", "seq").collect()}
    assert a == b
    for k in "abc":
        sizes = np.bincount([a[r[0]] for r in rows if r[3] == k], minlength=5)
        assert sizes.max() - sizes.min() <= 1
    held = sampling.stratified_holdout(df, "k", "seq", .1).groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_holdout").alias("h"))
    assert all(r.h == math.floor(r.n * .1 + .5) for r in held.collect())
    s = sampling.balanced_sample(df, "label", "seq", 60).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in s} == {0: 30, 1: 30}


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (2.0, 5.0, 1), (3.0, 5.0, 1), (10.0, 5.0, 0)], "a double, b double, label int")
    robust = features.fit_robust(df, ["a", "b"], F.col("label") == 1)
    assert [r.a for r in robust.transform(df).orderBy("a").collect()] == [-1.0, 0.0, 1.0, 8.0]
    standard = features.fit_standard(df, ["a", "b"])
    assert standard.spread == pytest.approx((float(np.std([1, 2, 3, 10])), 0.0))
    assert {r.b for r in standard.transform(df).collect()} == {0.0}
    back = features.LinearScaler.from_table(standard.as_table(spark))
    assert back == standard
    with pytest.raises(ValueError):
        standard.transform(df.drop("b"))


def test_probability_measures(spark):
    rows = [([.5, .5, 0.0],), ([2.0, 1.0, 1.0],), ([.1, .45, .45],)]
    p = F.col("p")
    df = spark.createDataFrame(rows, "p array<double>").select(
        scores.class_entropy(p).alias("h"), scores.top2_margin(p).alias("m"),
        scores.penalised_class(p, F.array(F.lit("A"), F.lit("Normal"), F.lit("B"))).alias("c"))
    got = df.collect()
    assert got[0].h == pytest.approx(math.log(2), abs=1e-9)
    assert got[1].h == pytest.approx(-(0.5 * math.log(.5) + 2 * .25 * math.log(.25)))
    assert [r.m for r in got] == pytest.approx([0.0, 1.0, 0.0])
    assert [r.c for r in got] == ["A", "A", "B"]
