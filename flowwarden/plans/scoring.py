"""Batch scoring plan: flows → four scores → fused risk → scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.plans.training import Artifacts, prepare, score_features


def score_flows(flows: DataFrame, artifacts: Artifacts, row_id: str = "id") -> DataFrame:
    """Scored rows. No shuffle: models are applied per row or per Arrow batch, fusion is arithmetic."""
    frame, _, _ = prepare(flows, row_id)
    scored = score_features(frame, artifacts.scaler, artifacts.forest, artifacts.risk, artifacts.threat)
    return artifacts.fusion.transform(scored)


def flag(scored: DataFrame, artifacts: Artifacts) -> DataFrame:
    """Add `is_flagged`: the final test uses at least the threshold, not above it."""
    cut = artifacts.threshold.select("optimal_threshold").scalar()
    return scored.withColumn("is_flagged", F.col("fused_risk") >= cut)
