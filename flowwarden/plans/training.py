"""Training plan: out-of-fold scores → fusion → threshold → final models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.config import COST_FN, COST_FP
from flowwarden.models.forest import Forest, fit_forest
from flowwarden.models.fusion import FusionModel, fit_fusion
from flowwarden.models.threats import RiskModel, ThreatModel, fit_risk, fit_threat
from flowwarden.operators.evaluation import optimal_threshold
from flowwarden.operators.features import LinearScaler, fit_robust
from flowwarden.operators.sampling import stratified_folds, stratified_holdout
from flowwarden.session import materialise
from flowwarden.sources.documents import read_threshold, write_threshold
from flowwarden.sources.flows import column_roles, feature_views, split_labels


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    trees: int = 80
    tree_size: int = 256
    rounds: int = 500
    depth: int = 6
    seed: int = 42
    fold_holdout: float = 0.20
    final_holdout: float = 0.10


@dataclass(frozen=True)
class Artifacts:
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    scaler: LinearScaler
    forest: Forest
    risk: RiskModel
    threat: ThreatModel
    fusion: FusionModel
    threshold: DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.as_table(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        self.forest.save(spark, f"{path}/forest")
        self.risk.save(f"{path}/risk")
        self.threat.save(f"{path}/threat")
        self.fusion.save(spark, f"{path}/fusion")
        write_threshold(self.threshold, f"{path}/threshold")

    @classmethod
    def load(cls, spark: SparkSession, path: str, categorical: list[str]) -> "Artifacts":
        scaler = LinearScaler.from_table(spark.read.parquet(f"{path}/scaler"))
        return cls(tuple(categorical), scaler.columns, scaler, Forest.load(spark, f"{path}/forest"),
                   RiskModel.load(f"{path}/risk", categorical), ThreatModel.load(f"{path}/threat"),
                   FusionModel.load(spark, f"{path}/fusion"), read_threshold(spark, f"{path}/threshold"))


def prepare(flows: DataFrame, row_id: str) -> tuple[DataFrame, list[str], list[str]]:
    """Typed feature views with `seq`, plus the categorical and numeric feature names."""
    labelled = split_labels(flows.withColumn("seq", F.col(row_id)))
    categorical, numeric = column_roles(labelled.drop("seq"))
    return feature_views(labelled).withColumn("seq", F.col("seq").cast("long")), categorical, numeric


def with_points(df: DataFrame, scaler: LinearScaler) -> DataFrame:
    return df.withColumn("x", F.array(*[scaler.column(c) for c in scaler.columns]))


def attack_forest(df: DataFrame, numeric: list[str], s: Settings, anchors=None) -> tuple[LinearScaler, Forest]:
    """Robust scaler and forest, both fitted on attack rows only."""
    scaler = fit_robust(df, numeric, F.col("label") == 1)
    attacks = with_points(df.filter(F.col("label") == 1), scaler).select("seq", "x")
    return scaler, fit_forest(attacks, s.trees, s.tree_size, s.seed, anchors)


def score_features(df: DataFrame, scaler: LinearScaler, forest: Forest, risk: RiskModel, threat: ThreatModel) -> DataFrame:
    """The four score columns of a frame of feature views."""
    scored = threat.transform(risk.transform(forest.anomaly_risk(with_points(df, scaler)).drop("x")))
    return scored.drop("probability", "classes")


@dataclass(frozen=True)
class Fitters:
    """The model fits a plan uses; any of them can be exchanged for one with the same signature."""

    risk: Callable = fit_risk
    threat: Callable = fit_threat
    forest: Callable = attack_forest


def out_of_fold(df: DataFrame, categorical: list[str], numeric: list[str], anchors, s: Settings = Settings(),
                fit: Fitters = Fitters()) -> DataFrame:
    """Scores of every row by models that never saw it. Anchors come from the full-data forest."""
    folded = materialise(stratified_folds(df, "attack_cat", "seq", s.folds, s.seed))

    def scored(fold: int) -> DataFrame:
        rest, held = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        scaler, forest = fit.forest(rest, numeric, s, anchors)
        risk = fit.risk(rest, categorical, rounds=s.rounds, depth=s.depth, seed=s.seed)
        split = stratified_holdout(rest, "attack_cat", "seq", s.fold_holdout, s.seed)
        threat = fit.threat(split.filter(~F.col("is_holdout")), split.filter("is_holdout"), categorical,
                            rounds=s.rounds, depth=s.depth, seed=s.seed)
        return score_features(held, scaler, forest, risk, threat).select(
            "seq", "fold", "label", "attack_cat", "cat_risk", "anomaly_risk", "incident_entropy", "top2_margin")

    with ThreadPool(s.folds) as pool:  # folds are independent jobs
        parts = pool.map(scored, range(s.folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train(flows: DataFrame, row_id: str = "id", s: Settings = Settings(), cost_fn: int = COST_FN, cost_fp: int = COST_FP,
          min_precision: float = 0.75, min_recall: float = 0.83, fit: Fitters = Fitters()) -> Artifacts:
    frame, categorical, numeric = prepare(flows, row_id)
    frame = materialise(frame)
    scaler, forest = fit.forest(frame, numeric, s)
    oof = materialise(out_of_fold(frame, categorical, numeric, forest.anchors, s, fit))
    fusion = fit_fusion(oof, "label", cost_fn, cost_fp)
    threshold = optimal_threshold(fusion.transform(oof), "label", "fused_risk", cost_fn, cost_fp,
                                  min_precision=min_precision, min_recall=min_recall)
    risk = fit.risk(frame, categorical, rounds=s.rounds, depth=s.depth, seed=s.seed)
    split = stratified_holdout(frame, "attack_cat", "seq", s.final_holdout, s.seed)
    threat = fit.threat(split.filter(~F.col("is_holdout")), split.filter("is_holdout"), categorical,
                        rounds=s.rounds, depth=s.depth, seed=s.seed)
    return Artifacts(tuple(categorical), tuple(numeric), scaler, forest, risk, threat, fusion, materialise(threshold))
