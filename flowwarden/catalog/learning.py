"""Model queries. All fits have the library's folds, trees, rounds and depth; the README has their times."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden.catalog import inputs
from flowwarden.catalog.registry import query
from flowwarden.catalog.scans import typed_flows
from flowwarden.catalog.sqltext import sql
from flowwarden.functions.scores import top2_margin
from flowwarden.models import forest as forests, fusion, threats
from flowwarden.operators import sampling
from flowwarden.plans import scoring, training
from flowwarden.session import scratch_path

FULL = training.Settings()
NUMERIC = ["spkts", "dpkts", "h"]


def _frame(spark, sf_dir):
    return training.prepare(typed_flows(spark, sf_dir), "id")


def points(spark, sf_dir):
    f = inputs.contexts(spark, sf_dir)
    return f.select("event_id", "seq", "label", F.array(
        F.col("spkts") / 100.0, F.col("dpkts") / 10.0, F.col("h") / 500000.0, F.col("cat_risk")).alias("x"))


@query(sql("""SELECT CAST(tree AS INTEGER) AS tree, CAST(slot AS INTEGER) AS slot, arg_max(round(x[1] + 10 * x[2] + 100 * x[3] + 1000 * x[4], 6), seq) AS x FROM (
  SELECT *, CASE WHEN i < 256 THEN i ELSE CAST('0x' || substr(md5('0|' || seq || '|' || tree), 1, 6) AS BIGINT) % 256 END AS slot
  FROM (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS i, [spkts / 100.0, dpkts / 10.0, h / 500000.0, cat_risk] AS x
        FROM flows WHERE label = 1), (SELECT unnest(generate_series(0, 79)) AS tree)) GROUP BY 1, 2""", "flows"))
def forest_sample(spark, sf_dir):
    s = forests.tree_samples(points(spark, sf_dir).filter("label = 1"))
    weighed = sum(F.get("x", F.lit(i)) * float(10 ** i) for i in range(4))
    return s.select("tree", "slot", F.round(weighed, 6).alias("x"))


@query()
def forest_score(spark, sf_dir):
    p = points(spark, sf_dir)
    grown = forests.fit_forest(p.filter("label = 1"))
    return grown.anomaly_risk(p).select("event_id", F.round("anomaly_risk", 6).alias("anomaly_risk"))


@query()
def binary_risk(spark, sf_dir):
    frame, categorical, _ = _frame(spark, sf_dir)
    model = threats.fit_risk(frame, categorical)
    return model.transform(frame).select("seq", "label", F.round("cat_risk", 6).alias("cat_risk"))


@query()
def feature_importance(spark, sf_dir):
    frame, categorical, _ = _frame(spark, sf_dir)
    return threats.fit_risk(frame, categorical).importances(spark)


@query()
def threat_model(spark, sf_dir):
    frame, categorical, _ = _frame(spark, sf_dir)
    split = sampling.stratified_holdout(frame, "attack_cat", "seq", 0.10)
    model = threats.fit_threat(split.filter("not is_holdout"), split.filter("is_holdout"), categorical)
    return model.transform(frame).select("seq", "attack_cat", "threat", "penalised_threat",
                                         F.round("incident_entropy", 6).alias("incident_entropy"), F.round("top2_margin", 6).alias("top2_margin"))


@query()
def meta_learner(spark, sf_dir):
    margins = inputs.probabilities(spark, sf_dir).select("event_id", top2_margin(F.col("probability")).alias("top2_margin"))
    f = inputs.contexts(spark, sf_dir).join(margins, "event_id")
    model = fusion.fit_fusion(f, "label", 12, 2)
    table = model.as_table(spark).select("feature", F.round("weight", 4).alias("weight"))
    return table.withColumn("primary_share", F.round(F.lit(model.primary_share()), 4))


@query()
def oof_scores(spark, sf_dir):
    frame, categorical, numeric = _frame(spark, sf_dir)
    _, grown = training.attack_forest(frame, numeric, FULL)
    oof = training.out_of_fold(frame, categorical, numeric, grown.anchors, FULL)
    return oof.select("seq", "fold", "label", *[F.round(c, 6).alias(c) for c in ("cat_risk", "anomaly_risk", "incident_entropy", "top2_margin")])


@query()
def trained_scores(spark, sf_dir):
    """Whole plan: train, save, load, score."""
    rows = typed_flows(spark, sf_dir)
    path = scratch_path(spark, "models")
    fitted = training.train(rows, "id", FULL)
    fitted.save(spark, path)
    loaded = training.Artifacts.load(spark, path, list(fitted.categorical))
    scored = scoring.flag(scoring.score_flows(rows, loaded), loaded)
    return scored.select("seq", "label", "threat", F.round("fused_risk", 6).alias("fused_risk"), "is_flagged")
