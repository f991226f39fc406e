"""Scalers fitted in one aggregate, principal components, score matrix assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.operators.ordered import exact_percentiles

META_FEATURES = ("cat_risk", "anomaly_risk", "incident_entropy", "top2_margin")


@dataclass(frozen=True)
class LinearScaler:
    """(x - centre) / spread per column; a zero spread counts as one."""

    columns: tuple[str, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        return (F.col(name) - F.lit(self.centre[i])) / F.lit(self.spread[i] or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"scaler was fitted on columns the frame lacks: {missing}")
        return df.withColumns({c: self.column(c) for c in self.columns})

    def as_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.columns, self.centre, self.spread)),
                                     "feature string, centre double, spread double")

    @classmethod
    def from_table(cls, table: DataFrame) -> "LinearScaler":
        rows = sorted(table.collect())
        return cls(tuple(r.feature for r in rows), tuple(r.centre for r in rows), tuple(r.spread for r in rows))


def fit_standard(df: DataFrame, columns: list[str]) -> LinearScaler:
    """Mean and population deviation of every column from one aggregate row."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return LinearScaler(tuple(columns), tuple(row[f"m_{c}"] for c in columns),
                        tuple(row[f"s_{c}"] for c in columns))


def fit_robust(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> LinearScaler:
    """Median and interquartile range of every column, optionally from some rows only."""
    rows = df if fit_on is None else df.filter(fit_on)
    melted = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("f")).select("f.*")
    quartiles = {r.feature: r for r in exact_percentiles(melted, ["feature"], "value", [0.25, 0.5, 0.75]).collect()}
    return LinearScaler(tuple(columns), tuple(quartiles[c].p1 for c in columns),
                        tuple(quartiles[c].p2 - quartiles[c].p0 for c in columns))


def fit_pca(scaled: DataFrame, columns: list[str], variance: float = 0.95):
    """(assembler, model, k): the fewest components whose cumulative explained variance exceeds `variance`."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    model = PCA(k=len(columns), inputCol="features", outputCol="components").fit(assembler.transform(scaled))
    covered, k = 0.0, 0
    for part in model.explainedVariance.toArray():
        k += 1
        covered += float(part)
        if covered > variance:
            break
    return assembler, model, k


def project_pca(scaled: DataFrame, fitted) -> DataFrame:
    assembler, model, k = fitted
    kept = VectorSlicer(inputCol="components", outputCol="pc", indices=list(range(k)))
    return kept.transform(model.transform(assembler.transform(scaled))).drop("features", "components")


def check_meta_features(df: DataFrame) -> None:
    """The fusion model reads exactly four columns, in this order."""
    missing = [c for c in META_FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"expected the four score columns {META_FEATURES}, missing {missing}")
