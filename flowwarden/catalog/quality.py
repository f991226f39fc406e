"""Score functions, threshold sweep, evaluation tables, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden.catalog import inputs
from flowwarden.catalog.registry import query
from flowwarden.catalog.sqltext import sql
from flowwarden.functions import scores
from flowwarden.operators import evaluation, ordered, sampling
from flowwarden.session import scratch_path
from flowwarden.sources import documents


@query(sql("SELECT event_id, round(-sum(greatest(1e-12, least(1.0, p)) * ln(greatest(1e-12, least(1.0, p)))), 6) AS entropy FROM probs GROUP BY 1", "probs"))
def entropy(spark, sf_dir):
    return inputs.probabilities(spark, sf_dir).select(
        "event_id", F.round(scores.class_entropy(F.col("probability")), 6).alias("entropy"))


@query(sql("""SELECT event_id, round(max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2), 6) AS margin
              FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC) AS r FROM probs) GROUP BY 1""", "probs"))
def top2_margin(spark, sf_dir):
    return inputs.probabilities(spark, sf_dir).select(
        "event_id", F.round(scores.top2_margin(F.col("probability")), 6).alias("margin"))


_CLASSES = "classes AS (SELECT event_id, label, threat, class FROM probs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY adj DESC, pos) = 1)"


@query(sql("SELECT event_id, class, CAST(CASE WHEN class <> 'Normal' THEN 1 ELSE 0 END AS INTEGER) AS is_attack FROM classes", "probs", extra=_CLASSES))
def penalised_class(spark, sf_dir):
    p = inputs.probabilities(spark, sf_dir)
    c = scores.penalised_class(F.col("probability"), F.col("classes"))
    return p.select("event_id", c.alias("class"), scores.is_attack_class(c).alias("is_attack"))


@query(sql("""SELECT class, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM classes), 6) AS pct FROM classes GROUP BY 1""", "probs", extra=_CLASSES))
def class_counts(spark, sf_dir):
    p = inputs.probabilities(spark, sf_dir)
    named = p.select(scores.penalised_class(F.col("probability"), F.col("classes")).alias("class"))
    return evaluation.value_counts(named, "class").withColumn("pct", F.round("pct", 6))


# Fixed values of the fusion model used by the query below.
MEANS, STDS, WEIGHTS, BIAS = (0.5, 0.45, 0.75, 0.5), (0.29, 0.31, 0.61, 0.29), (1.2, -0.4, 0.3, 0.8), -0.25


@query(sql("""SELECT event_id, round(1.0 / (1.0 + exp(-greatest(-250, least(250,
    (cat_risk - 0.5) / 0.29::DOUBLE * 1.2 + (anomaly_risk - 0.45) / 0.31::DOUBLE * -0.4 + (incident_entropy - 0.75) / 0.61::DOUBLE * 0.3
    + (fused_risk - 0.5) / 0.29::DOUBLE * 0.8 - 0.25)))), 6) AS score FROM flows""", "flows"))
def meta_score(spark, sf_dir):
    cols = [F.col(c) for c in ("cat_risk", "anomaly_risk", "incident_entropy", "fused_risk")]
    return inputs.flows(spark, sf_dir).select(
        "event_id", F.round(scores.fused_risk(cols, MEANS, STDS, WEIGHTS, BIAS), 6).alias("score"))


@query(sql("""SELECT event_id, round(greatest(0, least(1, (value - p1) / (p999 - p1))), 6) AS score,
              round(1 - greatest(0, least(1, (value - p1) / (p999 - p1))), 6) AS inverted,
              round(1 / (1 + exp(-ln(1 + value))), 6) AS uncalibrated
              FROM events, (SELECT quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.999) AS p999 FROM events)"""))
def normalise_score(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    low, high = ordered.exact_percentiles(e, [], "value", [0.01, 0.999]).first()
    score = scores.normalise_score(F.col("value"), low, high)
    return e.select("event_id", F.round(score, 6).alias("score"), F.round(scores.inverted(score), 6).alias("inverted"),
                    F.round(scores.normalise_score(F.col("value"), None, None), 6).alias("uncalibrated"))


@query(sql("""SELECT min(fused_risk) AS min, round(avg(fused_risk), 6) AS mean, max(fused_risk) AS max,
              round(avg(CASE WHEN fused_risk >= 0.999 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_at_ceiling,
              avg(CASE WHEN fused_risk >= 0.999 THEN 1.0 ELSE 0.0 END) * 100 > 1.0 AS saturated FROM flows""", "flows"))
def score_profile(spark, sf_dir):
    p = evaluation.score_profile(inputs.flows(spark, sf_dir), "fused_risk")
    return p.withColumns({"mean": F.round("mean", 6), "pct_at_ceiling": F.round("pct_at_ceiling", 6)})


_SWEEP = """
grid AS (SELECT i, 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01::DOUBLE) / 999) AS t FROM (SELECT unnest(generate_series(0, 999)) AS i)),
by_score AS (SELECT fused_risk AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM flows GROUP BY 1),
sweep AS (
  SELECT i, t, sum(CASE WHEN s < t THEN neg ELSE 0 END) AS tn, sum(CASE WHEN s >= t THEN neg ELSE 0 END) AS fp,
    sum(CASE WHEN s < t THEN pos ELSE 0 END) AS fn, sum(CASE WHEN s >= t THEN pos ELSE 0 END) AS tp FROM grid, by_score GROUP BY 1, 2)"""


def _best(floor: str, label: str) -> str:
    return f"""SELECT '{label}' AS variant, round(t, 9) AS optimal_threshold, CAST(fn * 12 + fp * 2 AS BIGINT) AS soc_cost, false AS is_fallback,
      round(tp / (tp + fp), 6) AS achieved_precision, round(tp / (tp + fn), 6) AS achieved_recall,
      CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
    FROM sweep WHERE {floor} QUALIFY row_number() OVER (ORDER BY fn * 12 + fp * 2, t) = 1"""


@query(sql("SELECT * FROM (" + _best("tp + fp > 0 AND tp / (tp + fp) >= 0.75 AND tp / (tp + fn) >= 0.83", "floors") + ")"
           + " UNION ALL SELECT * FROM (" + _best("true", "open") + ")"
           + """ UNION ALL SELECT 'none', 0.5, CAST(fn * 12 + fp * 2 AS BIGINT), true, round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), tn, fp, fn, tp FROM (
    SELECT count(*) FILTER (WHERE label = 0 AND fused_risk < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND fused_risk >= 0.5) AS fp,
      count(*) FILTER (WHERE label = 1 AND fused_risk < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND fused_risk >= 0.5) AS tp FROM flows)""",
           "flows", extra=_SWEEP))
def threshold_sweep(spark, sf_dir):
    f = inputs.contexts(spark, sf_dir).select("label", "fused_risk")

    def record(variant, **kw):
        r = evaluation.optimal_threshold(f, "label", "fused_risk", cost_fn=12, cost_fp=2, **kw)
        return r.select(F.lit(variant).alias("variant"), F.round("optimal_threshold", 9).alias("optimal_threshold"), "soc_cost",
                        "is_fallback", F.round("achieved_precision", 6).alias("achieved_precision"),
                        F.round("achieved_recall", 6).alias("achieved_recall"), "confusion.*")

    return (record("floors", min_precision=0.75, min_recall=0.83).unionByName(record("open", floors=False))
            .unionByName(record("none", min_precision=1.1)))


@query(sql("SELECT t AS optimal_threshold, CAST(fn * 12 + fp * 2 AS BIGINT) AS soc_cost FROM sweep WHERE tp / nullif(tp + fp, 0) >= 0.75 AND tp / (tp + fn) >= 0.83 QUALIFY row_number() OVER (ORDER BY fn * 12 + fp * 2, t) = 1",
           "flows", extra=_SWEEP))
def threshold_record(spark, sf_dir):
    path = scratch_path(spark, "threshold")
    documents.write_threshold(evaluation.optimal_threshold(
        inputs.contexts(spark, sf_dir), "label", "fused_risk", 12, 2, min_precision=0.75, min_recall=0.83), path)
    return documents.read_threshold(spark, path).select("optimal_threshold", "soc_cost")


_RATES = """tn, fp, fn, tp, CAST(fn * 12 + fp * 2 AS BIGINT) AS soc_cost, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall"""


def _counts_sql(pred: str, source: str, by: str = "") -> str:
    return f"""SELECT {by} count(*) FILTER (WHERE label = 0 AND NOT ({pred})) AS tn, count(*) FILTER (WHERE label = 0 AND ({pred})) AS fp,
      count(*) FILTER (WHERE label = 1 AND NOT ({pred})) AS fn, count(*) FILTER (WHERE label = 1 AND ({pred})) AS tp FROM {source}"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


@query(sql(f"SELECT rule, {_RATES} FROM (SELECT 'at least' AS rule, * FROM ({_counts_sql('fused_risk >= 0.5', 'flows')}) UNION ALL SELECT 'above', * FROM ({_counts_sql('fused_risk > 0.5', 'flows')}))", "flows"))
def confusion(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    parts = [evaluation.confusion(f, "label", p).withColumn("rule", F.lit(n)) for n, p in
             (("at least", F.col("fused_risk") >= 0.5), ("above", F.col("fused_risk") > 0.5))]
    return _rounded(evaluation.with_rates(parts[0].unionByName(parts[1])))


@query(sql(f"SELECT thr, {_RATES} FROM ({_counts_sql('''playbook NOT IN ('ALLOW', 'LOG_ONLY')''', 'decided', 'thr,')} GROUP BY thr)", "decided"))
def soc_eval(spark, sf_dir):
    parts = [evaluation.confusion(inputs.decisions(spark, sf_dir, t), "label", evaluation.playbook_verdict(F.col("playbook"))).withColumn("thr", F.lit(t))
             for t in (inputs.LOW, inputs.HIGH)]
    return _rounded(evaluation.with_rates(parts[0].unionByName(parts[1])))


@query(sql("""SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT class, precision, recall, f1, support FROM per
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)""",
           "probs", extra=_CLASSES + """,
names AS (SELECT threat AS class FROM classes UNION SELECT class FROM classes),
raw AS (SELECT n.class, count(*) FILTER (WHERE c.threat = n.class) AS support, count(*) FILTER (WHERE c.class = n.class) AS called,
          count(*) FILTER (WHERE c.threat = n.class AND c.class = n.class) AS hits FROM names n, classes c GROUP BY 1),
pr AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM raw),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""))
def class_report(spark, sf_dir):
    p = inputs.probabilities(spark, sf_dir)
    named = p.select("threat", scores.penalised_class(F.col("probability"), F.col("classes")).alias("predicted"))
    report = evaluation.class_report(named, "threat", "predicted")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(sql("""SELECT label, round(avg(fused_risk), 6) AS mean, count(*) AS n, round(quantile_cont(fused_risk, 0.05), 6) AS p05,
              round(quantile_cont(fused_risk, 0.95), 6) AS p95 FROM flows GROUP BY 1""", "flows"))
def score_by_class(spark, sf_dir):
    s = evaluation.score_by_class(inputs.contexts(spark, sf_dir), "label", "fused_risk")
    return s.select("label", F.round("mean", 6).alias("mean"), "n", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


_ROC = """
pts AS (SELECT fused_risk AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM flows GROUP BY 1),
cum AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
        FROM pts WINDOW w AS (ORDER BY s DESC))"""


@query(sql("""SELECT CAST(s AS VARCHAR) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum UNION ALL SELECT 'inf', 0, 0""", "flows", extra=_ROC))
def roc_curve(spark, sf_dir):
    c = evaluation.roc_curve(inputs.contexts(spark, sf_dir), "label", "fused_risk")
    return c.select(F.when(F.col("threshold") == float("inf"), "inf").otherwise(F.col("threshold").cast("string")).alias("threshold"),
                    F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(sql("""SELECT round(sum(neg * (2 * tp - pos)) / (2.0 * max(np) * max(nn)), 9) AS auc, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg FROM cum""", "flows", extra=_ROC))
def roc_auc(spark, sf_dir):
    a = evaluation.roc_auc(inputs.contexts(spark, sf_dir), "label", "fused_risk")
    return a.select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


_FOLD_RANK = "(row_number() OVER (PARTITION BY threat ORDER BY md5('42|' || event_id)))"


@query(sql(f"SELECT event_id, threat, CAST(({_FOLD_RANK} - 1) % 5 AS INTEGER) AS fold FROM flows", "flows"))
def oof_folds(spark, sf_dir):
    return sampling.stratified_folds(inputs.flows(spark, sf_dir).select("event_id", "threat"), "threat", "event_id")


@query(sql(f"SELECT event_id, threat, {_FOLD_RANK} <= floor(count(*) OVER (PARTITION BY threat) * 0.2 + 0.5) AS is_holdout FROM flows", "flows"))
def strat_split(spark, sf_dir):
    return sampling.stratified_holdout(inputs.flows(spark, sf_dir).select("event_id", "threat"), "threat", "event_id", 0.20)


@query(sql("""SELECT event_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('69|' || event_id)) <= 50""", "flows"))
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(inputs.flows(spark, sf_dir).select("event_id", "label"), "label", "event_id", 100, seed=69).select("event_id", "label")


@query(sql("""SELECT event_id, round(avg(anomaly_risk) OVER (ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smoothed,
              round(avg(anomaly_risk) OVER (PARTITION BY service ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS by_service
              FROM flows""", "flows"))
def smooth(spark, sf_dir):
    f = inputs.flows(spark, sf_dir).select("event_id", "seq", "service", "anomaly_risk")
    whole = ordered.trailing_mean(f, "anomaly_risk", "seq", "smoothed", width=4096)
    keyed = ordered.trailing_mean(whole, "anomaly_risk", "seq", "by_service", keys=["service"], width=1024)
    return keyed.select("event_id", F.round("smoothed", 6).alias("smoothed"), F.round("by_service", 6).alias("by_service"))
