"""Detection quality: confusion and cost, reports, threshold sweep, ROC, correction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.config import COST_FN, COST_FP, FALLBACK_THRESHOLD
from flowwarden.functions.cases import cases
from flowwarden.operators.decide import PASSED
from flowwarden.operators.ordered import cumulative_counts, exact_percentiles

SWEEP_START, SWEEP_END = 0.01, 0.99


def confusion(df: DataFrame, truth: str, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP in one aggregate."""
    p = predicted.cast("int")
    t = F.col(truth)
    return df.groupBy(*(by or [])).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero when the denominator is."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame, cost_fn: int = COST_FN, cost_fp: int = COST_FP) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "soc_cost": fn * F.lit(cost_fn) + fp * F.lit(cost_fp),
        "accuracy": share(tn + tp, tn + fp + fn + tp),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
    })


def playbook_verdict(playbook: Column) -> Column:
    """0 for playbooks that let traffic pass, 1 for all others, a missing playbook included."""
    return F.when(playbook.isin(*PASSED), 0).otherwise(1)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows.

    Only the (truth, predicted) pair counts are shuffled; everything after that is classes squared.
    """
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hits")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    precision, recall = share(F.col("hits"), F.col("called")), share(F.col("hits"), F.col("support"))
    scored = per_class.select(
        "class", "support", "hits", precision.alias("precision"), recall.alias("recall"),
    ).withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    n = F.sum("support")

    def weighted(name: str) -> Column:
        return share(F.sum(F.col(name) * F.col("support")), n)

    overall = scored.agg(
        n.alias("support"), share(F.sum("hits"), n).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    lines = overall.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("class"), *[c.alias(m) for c, m in zip(cols, ("precision", "recall", "f1"))],
                 F.col("support"))
        for name, cols in (
            ("accuracy", [F.col("accuracy")] * 3),
            ("macro avg", [F.col(f"macro_{m}") for m in ("precision", "recall", "f1")]),
            ("weighted avg", [F.col(f"weighted_{m}") for m in ("precision", "recall", "f1")]),
        )
    ])).alias("l")).select("l.*")
    return scored.select("class", "precision", "recall", "f1", "support").unionByName(lines)


def sweep_point(index: Column, n: int) -> Column:
    return F.lit(SWEEP_START) + index * F.lit((SWEEP_END - SWEEP_START) / (n - 1))


def thresholds_reached(score: Column, n: int) -> Column:
    """How many sweep points are <= score.

    Estimated by division, then corrected by comparing with the points themselves.
    """
    step = (SWEEP_END - SWEEP_START) / (n - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((score - SWEEP_START) / F.lit(step)) + 1))
    return cases([
        ((guess < n) & (score >= sweep_point(guess, n)), guess + 1),
        ((guess > 0) & (score < sweep_point(guess - 1, n)), guess - 1),
    ], guess).cast("int")


def sweep_table(df: DataFrame, truth: str, score: str, n: int = 1000) -> DataFrame:
    """TN, FP, FN, TP for every sweep point in one pass: at most n + 1 bins reach the shuffle."""
    bins = df.groupBy(thresholds_reached(F.col(score), n).alias("reached")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("reached"),
                                           F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    spans = bins.unionByName(grid).groupBy("reached").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = W.orderBy(F.col("reached").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.col("reached").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = spans.select(
        "reached",
        F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("fp"),
        F.sum("pos").over(everything).alias("all_pos"), F.sum("neg").over(everything).alias("all_neg"),
    )
    return counted.filter(F.col("reached") < n).select(
        sweep_point(F.col("reached"), n).alias("threshold"),
        (F.col("all_neg") - F.col("fp")).alias("tn"), "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"), "tp",
    )


def optimal_threshold(df: DataFrame, truth: str, score: str, cost_fn: int = 10, cost_fp: int = 2,
                      n: int = 1000, min_precision: float = 0.80, min_recall: float = 0.0,
                      floors: bool = True) -> DataFrame:
    """One-row threshold record: the cheapest sweep point above both floors, the lowest one on ties.

    Without any such point the record is the 0.5 fallback and `is_fallback` is true. With
    `floors=False` every point takes part, also those that predict nothing.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    allowed = (tp + fp > 0) & (tp + fn > 0) & (precision >= min_precision) & (recall >= min_recall)
    ranked = sweep_table(df, truth, score, n).withColumn("cost", fn * F.lit(cost_fn) + fp * F.lit(cost_fp))
    whole = F.struct("threshold", "tn", "fp", "fn", "tp", "cost")
    keep = allowed if floors else F.lit(True)
    best = ranked.agg(F.min_by(F.when(keep, whole), F.when(keep, F.struct("cost", "threshold"))).alias("best"))
    half = df.agg(
        F.count_if((F.col(truth) == 0) & (F.col(score) < FALLBACK_THRESHOLD)).alias("tn"),
        F.count_if((F.col(truth) == 0) & (F.col(score) >= FALLBACK_THRESHOLD)).alias("fp"),
        F.count_if((F.col(truth) == 1) & (F.col(score) < FALLBACK_THRESHOLD)).alias("fn"),
        F.count_if((F.col(truth) == 1) & (F.col(score) >= FALLBACK_THRESHOLD)).alias("tp"),
    ).select(F.struct(
        F.lit(FALLBACK_THRESHOLD).alias("threshold"), "tn", "fp", "fn", "tp",
        (F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp)).alias("cost"),
    ).alias("half"))
    record = best.select("best", F.col("best").isNull().alias("is_fallback"), half.scalar().alias("half"))
    chosen = record.select(F.coalesce("best", "half").alias("r"), "is_fallback")
    return chosen.select(
        F.col("r.threshold").alias("optimal_threshold"),
        F.col("r.cost").alias("soc_cost"),
        "is_fallback",
        F.lit(cost_fn).cast("long").alias("cost_fn"), F.lit(cost_fp).cast("long").alias("cost_fp"),
        F.lit(float(min_precision)).alias("min_precision"), F.lit(float(min_recall)).alias("min_recall"),
        share(F.col("r.tp"), F.col("r.tp") + F.col("r.fp")).alias("achieved_precision"),
        share(F.col("r.tp"), F.col("r.tp") + F.col("r.fn")).alias("achieved_recall"),
        F.struct("r.tn", "r.fp", "r.fn", "r.tp").alias("confusion"),
    )


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One point per distinct score, highest first, and the origin at infinity."""
    counted = cumulative_counts(df, [], score, {
        "pos": (F.col(truth) == 1).cast("long"), "neg": (F.col(truth) == 0).cast("long")})
    sizes = df.agg(F.count_if(F.col(truth) == 1).alias("all_pos"), F.count_if(F.col(truth) == 0).alias("all_neg"))
    pos, neg = sizes.select("all_pos").scalar(), sizes.select("all_neg").scalar()
    points = counted.select(
        F.col(score).alias("threshold"),
        (pos - F.col("pos_upto") + F.col("pos")).alias("tp"), (neg - F.col("neg_upto") + F.col("neg")).alias("fp"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    return points.unionByName(origin).select(
        "threshold", share(F.col("fp"), neg).alias("fpr"), share(F.col("tp"), pos).alias("tpr"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Trapezoid area from whole-number counts: each value's negatives sit below the positives above it."""
    counted = cumulative_counts(df, [], score, {
        "pos": (F.col(truth) == 1).cast("long"), "neg": (F.col(truth) == 0).cast("long")})
    doubled = F.sum(F.col("pos").cast("decimal(38,0)") * (2 * F.col("neg_upto") - F.col("neg")).cast("decimal(20,0)"))
    return counted.agg(
        doubled.cast("double").alias("area2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    ).select(
        F.try_divide(F.col("area2"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def score_by_class(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Mean, p05 and p95 of a score per truth label."""
    means = df.groupBy(truth).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    spans = exact_percentiles(df, [truth], score, [0.05, 0.95]).select(
        truth, F.col("p0").alias("p05"), F.col("p1").alias("p95"))
    return means.join(spans, truth)


def score_profile(df: DataFrame, score: str, ceiling: float = 0.999, warn_pct: float = 1.0) -> DataFrame:
    """Range of a score, the share at its ceiling, and whether that share is worth a warning."""
    pct = F.avg((F.col(score) >= F.lit(ceiling)).cast("double")) * 100
    return df.agg(F.min(score).alias("min"), F.avg(score).alias("mean"), F.max(score).alias("max"),
                  pct.alias("pct_at_ceiling")).withColumn("saturated", F.col("pct_at_ceiling") > F.lit(warn_pct))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Counts and percentages of a low-cardinality column."""
    counted = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(W.partitionBy())
    return counted.withColumn("pct", F.col("n") * F.lit(100.0) / whole)


def playbook_counts(decisions: DataFrame) -> DataFrame:
    """Events and false-positive overrides per playbook; no playbook counts as UNKNOWN."""
    return decisions.groupBy(F.coalesce("playbook", F.lit("UNKNOWN")).alias("playbook")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_false_positive").alias("fp_overrides"))


def correction_stats(corrections: DataFrame, truth: DataFrame, run_start: Column) -> DataFrame:
    """FP and FN corrections and rules written since `run_start`, joined to the truth by event id."""
    recent = corrections.filter(F.col("corrected_at") >= run_start)
    joined = recent.join(truth.select("event_id", F.col("label").alias("_truth")), "event_id")
    return joined.agg(
        F.count_if(F.col("_truth") == 0).alias("fp_corrections"),
        F.count_if(F.col("_truth") == 1).alias("fn_corrections"),
        F.count_if(F.col("rule_id").isNotNull()).alias("rules_generated"),
    )
