"""Forest, fusion and classifiers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwarden.models import forest as forests, fusion, threats
from flowwarden.models.forest import Forest
from flowwarden.operators.features import META_FEATURES


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(1200)]
    return spark.createDataFrame(rows, "seq long, x array<double>").repartition(4)


def test_samples_are_bounded_and_the_newest_claim_stands(cloud):
    s = forests.tree_samples(cloud, trees=6, size=32)
    assert s.count() == 6 * 32
    newest = max(cloud.collect(), key=lambda r: r.seq).x
    assert s.filter(F.col("x") == F.array(*[F.lit(v) for v in newest])).count() == 6
    few = forests.tree_samples(cloud.filter("seq < 10"), trees=2, size=32)
    assert sorted(r.slot for r in few.collect()) == sorted(list(range(10)) * 2)


def test_tree_shape():
    points = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 5.0], [2.0, 1.0], [9.0, 9.0]])
    nodes = forests._grow(points, np.random.default_rng(1)).set_index("node")
    assert nodes.loc[0, "n"] == 5 and (nodes["left"] < 0).sum() == 4
    for _, node in nodes[nodes["left"] >= 0].iterrows():
        left, right = nodes.loc[node["left"]], nodes.loc[node["right"]]
        assert node["n"] == left["n"] + right["n"]
        assert left["high"][node["dim"]] <= node["cut"] < right["low"][node["dim"]]


def one_by_one(x, key, tree, number):
    """Displacement of a single row, as a plain walk with explicit ratios."""
    node, ratios, depth = 0, [], 0
    while True:
        low, high = tree["low"][node], tree["high"][node]
        stretch = sum(max(l - v, v - h, 0.0) for v, l, h in zip(x, low, high))
        salt = forests._mix(np.array([(number * 1_000_003 + depth) & 0xFFFFFFFFFFFF], dtype=np.uint64))
        draw = float((forests._mix(np.array([key], dtype=np.uint64) ^ salt) >> np.uint64(11))[0]) * 2.0 ** -53
        if draw * (sum(h - l for l, h in zip(low, high)) + stretch) < stretch:
            ratios.append(tree["n"][node])
            return max(ratios)
        if tree["left"][node] < 0:
            return max(ratios)
        child, other = tree["left"][node], tree["right"][node]
        if x[tree["dim"][node]] > tree["cut"][node]:
            child, other = other, child
        ratios.append(tree["n"][other] / (tree["n"][child] + 1))
        node, depth = child, depth + 1


def test_vector_walk_equals_single_walks():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(64, 3))
    tree = Forest.pack(forests._grow(points, rng).assign(tree=0)).trees[0]
    x = np.concatenate([rng.normal(size=(50, 3)) * 2, points[:5]])
    key = rng.integers(0, 2**63, len(x)).astype(np.uint64)
    with np.errstate(over="ignore"):
        got = forests._displacement(x, key, tree, 3)
        want = [one_by_one(x[i], key[i], tree, 3) for i in range(len(x))]
    assert got == pytest.approx(want)


class Counted(np.ndarray):
    """Keys that count the rows they are taken for."""

    taken = 0

    def take(self, indices, *args, **kwargs):
        Counted.taken += len(indices)
        return np.asarray(self).take(indices, *args, **kwargs).view(Counted)


def test_walk_ends_where_no_ratio_below_can_be_larger():
    # 63 equal points and one far off: for a row at the far one, the first cut has a ratio above all sizes below it.
    points = np.concatenate([np.zeros((63, 2)), [[9.0, 9.0]]])
    tree = Forest.pack(forests._grow(points, np.random.default_rng(1)).assign(tree=0)).trees[0]
    x, key = np.full((20, 2), 9.0), np.arange(20, dtype=np.uint64).view(Counted)
    with np.errstate(over="ignore"):
        assert forests._displacement(x, key, tree, 0).tolist() == [63 / 2] * 20
        # A row inside the root's box needs no draw there, and none of these walks goes on to the leaf.
        assert Counted.taken == 0
        rng = np.random.default_rng(2)
        many = Forest.pack(forests._grow(rng.integers(0, 9, (300, 9)).astype(float), rng).assign(tree=0)).trees[0]
        x, key = rng.normal(4, 4, (200, 9)), rng.integers(0, 2**63, 200).astype(np.uint64)
        assert forests._displacement(x, key, many, 5).tolist() == pytest.approx([one_by_one(x[i], key[i], many, 5) for i in range(200)])


def test_a_combination_is_scored_once_in_a_task(monkeypatch):
    scored = []

    class Counting:
        def probability(self, codes):
            scored.extend(map(tuple, codes.tolist()))
            return (codes[:, 0] + 10 * codes[:, 1]) / 100

    encoding = threats.Encoding(("p", "s"), (("a", "b"), ("x", "y", "z")))
    rows = [{"c0": "ab?"[i % 3], "c1": "zyx"[i % 2]} for i in range(60)]
    batches = [pa.array(rows[i:i + 10]) for i in range(0, 60, 10)]
    want = [["ab?".index(r["c0"]) / 100 + "xyz".index(r["c1"]) / 10] for r in rows]
    for bound, times in ((100, 6), (0, 36)):
        monkeypatch.setattr(threats, "REMEMBERED", bound)
        scored.clear()
        got = [v for out in threats._by_combination(iter(batches), encoding, (Counting(),), None) for v in out.to_pylist()]
        assert got == [pytest.approx(w) for w in want] and len(scored) == times


def test_outliers_score_high_and_partitions_do_not_matter(spark, cloud, tmp_path):
    grown = forests.fit_forest(cloud, trees=20, size=64)
    probe = spark.createDataFrame([(1, [0.1, 0.0, 0.1]), (2, [30.0, -30.0, 30.0])], "seq long, x array<double>")
    raw = {r.seq: r.anomaly_risk for r in grown.anomaly_risk(probe, attack_trained=False).collect()}
    assert raw[2] == 1.0 and raw[1] < 0.5
    turned = {r.seq: r.anomaly_risk for r in grown.anomaly_risk(probe).collect()}
    assert turned[2] == 0.0 and turned[1] == pytest.approx(1 - raw[1])
    a = {r.seq: r.codisp for r in grown.raw_scores(cloud).collect()}
    b = {r.seq: r.codisp for r in grown.raw_scores(cloud.repartition(9)).collect()}
    assert a == b
    grown.save(spark, str(tmp_path / "forest"))
    back = Forest.load(spark, str(tmp_path / "forest"))
    assert {r.seq: r.codisp for r in back.raw_scores(cloud).collect()} == a and back.anchors == grown.anchors
    with pytest.raises(ValueError):
        Forest.pack(grown.nodes).save(spark, str(tmp_path / "none"))


def test_fusion_equals_gradient_descent(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    y = (x[:, 0] + .3 * x[:, 3] + rng.normal(0, .2, 400) > .8).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)],
                               ", ".join(f"{c} double" for c in META_FEATURES) + ", label int")
    model = fusion.fit_fusion(df, "label", 12, 2)
    z = (x - x.mean(0)) / x.std(0)
    w, b, cost = np.zeros(4), 0.0, np.where(y == 1, 12, 2)
    for _ in range(20000):
        e = (1 / (1 + np.exp(-(z @ w + b))) - y) * cost
        w, b = w - .1 * (z.T @ e / 400 + .1 / 400 * w), b - .1 * e.mean()
    assert list(model.weights) == pytest.approx(list(w), abs=2e-3) and model.bias == pytest.approx(b, abs=2e-3)
    got = [r.fused_risk for r in model.transform(df).collect()]
    want = 1 / (1 + np.exp(-(z @ np.array(model.weights) + model.bias)))
    assert sorted(got) == pytest.approx(sorted(want.tolist()), abs=1e-9)
    model.save(spark, str(tmp_path / "fusion"))
    assert fusion.FusionModel.load(spark, str(tmp_path / "fusion")) == model
    assert not model.primary_is_weak()
    with pytest.raises(ValueError):
        fusion.fit_fusion(df.drop("cat_risk"), "label")


def test_classifiers_save_and_load(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], int(i % 2 == 0), "Normal" if i % 2 else ("DoS" if i % 4 else "Worms")) for i in range(240)]
    df = spark.createDataFrame(rows, "seq long, c1 string, c2 string, label int, attack_cat string")
    risk = threats.fit_risk(df, ["c1", "c2"], rounds=3, depth=2)
    scored = risk.transform(df)
    assert scored.columns == df.columns + ["cat_risk"]
    low, high = [scored.filter(F.col("label") == v).agg(F.avg("cat_risk")).first()[0] for v in (0, 1)]
    assert low < .5 < high
    assert risk.importances(spark).first().feature == "c1"
    risk.save(str(tmp_path / "risk"))
    again = threats.RiskModel.load(str(tmp_path / "risk"), ["c1", "c2"]).transform(df)
    assert again.exceptAll(scored).isEmpty()
    unseen = spark.createDataFrame([(1, "new", "new")], "seq long, c1 string, c2 string")
    assert risk.transform(unseen).count() == 1
    threat = threats.fit_threat(df, df, ["c1", "c2"], rounds=2, depth=2)
    out = threat.transform(df).collect()
    assert threat.names() == ["DoS", "Normal", "Worms"]
    assert all(sum(r.probability) == pytest.approx(1.0) for r in out)
    assert all((r.threat == "Normal") == (r.attack_cat == "Normal") for r in out)
    threat.save(str(tmp_path / "threat"))
    assert threats.ThreatModel.load(str(tmp_path / "threat")).transform(unseen).count() == 1


def test_newest_rows_equal_a_sort(spark):
    from flowwarden.operators.ordered import newest_rows
    df = spark.createDataFrame([(i * 7 % 1009 * 3,) for i in range(700)], "seq long").repartition(5)
    want = sorted((r.seq for r in df.collect()), reverse=True)
    for n in (1, 50, 700, 900):
        assert sorted((r.seq for r in newest_rows(df, "seq", n, width=64).collect()), reverse=True) == want[:n]


def test_responder_failures_become_failsafes(spark):
    from flowwarden.operators.responder import respond
    prompts = spark.createDataFrame([(i, "s", "bad" if i > 2 else "u") for i in range(4)], "event_id long, system_prompt string, user_prompt string")

    def answer(batch):
        if (batch["user_prompt"] == "bad").any():
            raise RuntimeError("model is down")
        return batch["event_id"].map(lambda i: '{"playbook": "ALLOW", "reasoning": "n%d"}' % i)

    got = {r.event_id: r.answer for r in respond(prompts.coalesce(1), answer).collect()}
    assert got[0].playbook == "ALLOW" and got[0].reasoning == "n0"
    assert got[3].playbook == "NETWORK_ISOLATION" and got[3].is_llm_failsafe


def test_remember_takes_any_encoder(spark):
    from flowwarden.operators import vectors
    from flowwarden.schemas import VECTOR
    empty = spark.createDataFrame([], VECTOR)
    docs = spark.createDataFrame([("c", "d1", "alpha beta", {"k": "v"}, 1), ("c", "d1", "alpha gamma", {"k": "w"}, 2)],
                                 "collection string, doc_id string, document string, metadata map<string,string>, version long")
    own = vectors.remember(empty, docs, lambda df: df.withColumn("embedding", F.array(F.lit(1.0))))
    assert [(r.document, r.embedding) for r in own.collect()] == [("alpha gamma", [1.0])]
    hashed = vectors.remember(empty, docs).first()
    assert np.linalg.norm(hashed.embedding) == pytest.approx(1.0)


def test_model_queries_fit_at_library_size(monkeypatch):
    """Rounds, depth, folds and trees of the registered queries are the library defaults."""
    from types import SimpleNamespace

    from flowwarden.catalog import learning
    from flowwarden.models import threats
    from flowwarden.plans import training

    class Asked(Exception):
        pass

    def asked(*args, **named):
        raise Asked(next((a for a in args if isinstance(a, training.Settings)), training.Settings()), named)

    monkeypatch.setattr(learning, "_frame", lambda *_: (None, [], []))
    monkeypatch.setattr(learning, "typed_flows", lambda *_: None)
    monkeypatch.setattr(learning, "scratch_path", lambda *_: "")
    monkeypatch.setattr(learning.sampling, "stratified_holdout", lambda *_: SimpleNamespace(filter=lambda c: None))
    for module, name in ((threats, "fit_risk"), (threats, "fit_threat"), (training, "attack_forest"), (training, "train")):
        monkeypatch.setattr(module, name, asked)
    assert (threats.ROUNDS, threats.DEPTH) == (training.Settings().rounds, training.Settings().depth) == (500, 6)
    for name in ("binary_risk", "feature_importance", "threat_model", "oof_scores", "trained_scores"):
        with pytest.raises(Asked) as seen:
            getattr(learning, name)(None, "")
        settings, named = seen.value.args
        assert settings == training.Settings() and not {"rounds", "depth"} & set(named), name
