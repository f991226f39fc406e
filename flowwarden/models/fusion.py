"""Cost-weighted logistic fusion of the four score columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.functions.scores import fused_risk
from flowwarden.operators.features import META_FEATURES, check_meta_features, fit_standard

PRIMARY_SHARE_FLOOR = 0.30


@dataclass(frozen=True)
class FusionModel:
    means: tuple[float, ...]
    stds: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """Fused risk as column arithmetic: scoring needs no model object on the executors."""
        return fused_risk([F.col(c) for c in META_FEATURES], list(self.means), list(self.stds),
                          list(self.weights), self.bias)

    def transform(self, df: DataFrame, name: str = "fused_risk") -> DataFrame:
        check_meta_features(df)
        return df.withColumn(name, self.score())

    def primary_share(self) -> float:
        """Share of the first score in the total absolute weight; below 0.30 deserves a warning."""
        whole = sum(abs(w) for w in self.weights)
        return abs(self.weights[0]) / whole if whole > 0 else 0.0

    def primary_is_weak(self) -> bool:
        return self.primary_share() < PRIMARY_SHARE_FLOOR

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(4), META_FEATURES, self.means, self.stds, self.weights)) + [(4, "bias", 0.0, 1.0, self.bias)]
        return spark.createDataFrame(rows, "ord int, feature string, mean double, std double, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.as_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FusionModel":
        rows = spark.read.parquet(path).orderBy("ord").collect()
        return cls(tuple(r["mean"] for r in rows[:4]), tuple(r["std"] for r in rows[:4]),
                   tuple(r["weight"] for r in rows[:4]), rows[4]["weight"])


def fit_fusion(df: DataFrame, label: str, cost_fn: float = 10, cost_fp: float = 2,
               l2: float = 0.1, max_iter: int = 500) -> FusionModel:
    """Logistic regression on population z-scores; a row weighs its misdecision cost.

    Dividing the penalty by the total weight gives the objective sum(w * loss) + l2/2 * |b|^2.
    """
    check_meta_features(df)
    scaler = fit_standard(df, list(META_FEATURES))
    scaled = scaler.transform(df).select(
        *META_FEATURES, F.col(label).cast("double").alias("_y"),
        F.when(F.col(label) == 1, F.lit(float(cost_fn))).otherwise(F.lit(float(cost_fp))).alias("_w"))
    total = scaled.agg(F.sum("_w")).first()[0]
    frame = VectorAssembler(inputCols=list(META_FEATURES), outputCol="_x").transform(scaled)
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", regParam=l2 / total, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-10).fit(frame)
    return FusionModel(scaler.centre, tuple(s or 1.0 for s in scaler.spread),
                       tuple(float(c) for c in model.coefficients), float(model.intercept))
