"""Class-probability measures, score normalisation and fused-risk arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def class_entropy(probabilities: Column) -> Column:
    """Natural-log entropy of the row-normalised vector, each share held within [1e-12, 1]."""
    whole = total(probabilities)
    shares = F.transform(
        probabilities, lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p / whole))
    )
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log(p))


def top2_margin(probabilities: Column) -> Column:
    ranked = F.sort_array(probabilities, asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def penalised_class(probabilities: Column, classes: Column, penalty: float = 0.15, normal: str = "Normal") -> Column:
    """Class of the largest probability after the normal class gave up `penalty`; first one on ties."""
    adjusted = F.zip_with(
        probabilities, classes,
        lambda p, c: F.greatest(F.lit(0.0), F.when(c == normal, p - F.lit(penalty)).otherwise(p)),
    )
    return F.element_at(classes, F.array_position(adjusted, F.array_max(adjusted)).cast("int"))


def is_attack_class(threat: Column, normal: str = "Normal") -> Column:
    return (threat != normal).cast("int")


def normalise_score(raw: Column, low: float | None, high: float | None) -> Column:
    """Linear stretch between two anchors; a logistic curve when there are none or they coincide."""
    if low is not None and high is not None and high - low > 0:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - F.lit(low)) / F.lit(high - low)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.log1p(raw)))


def inverted(score: Column) -> Column:
    """Forests grown on attacks score normal traffic high, so the risk is the complement."""
    return F.lit(1.0) - score


def logistic(linear: Column) -> Column:
    held = F.greatest(F.lit(-250.0), F.least(F.lit(250.0), linear))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) / (F.lit(1.0) + F.exp(-held))))


def fused_risk(columns: list[Column], means: list[float], stds: list[float],
               weights: list[float], bias: float) -> Column:
    """Sigmoid of the weighted z-scores; plain arithmetic, so it stays in generated code."""
    linear = F.lit(0.0)
    for column, mean, std, weight in zip(columns, means, stds, weights):
        linear = linear + (column - F.lit(mean)) / F.lit(std if std > 0 else 1.0) * F.lit(weight)
    return logistic(linear + F.lit(bias))
