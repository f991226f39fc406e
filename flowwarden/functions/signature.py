"""Risk buckets, behaviour signatures and severity words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden.config import ANOMALY_EDGES, ENTROPY_EDGES, RISK_EDGES, VOLUME_EDGES
from flowwarden.functions.cases import cases


def graded(value: Column, edges: tuple, grades: list[str]) -> Column:
    """The first grade whose upper edge lies above `value`; the last grade when none does."""
    return cases(((value < F.lit(edge), grade) for edge, grade in zip(edges, grades)), grades[-1])


def risk_bucket(fused: Column) -> Column:
    return graded(F.coalesce(fused, F.lit(0.0)), RISK_EDGES, ["R1", "R2", "R3", "R4"])


def anomaly_bucket(anomaly: Column) -> Column:
    return graded(F.coalesce(anomaly, F.lit(0.0)), ANOMALY_EDGES, ["A1", "A2", "A3"])


def packets(spkts: Column) -> Column:
    """Packet counts are truncated toward zero before they are bucketed or priced."""
    return F.coalesce(spkts.cast("long"), F.lit(0).cast("long"))


def volume_bucket(spkts: Column) -> Column:
    return graded(packets(spkts), VOLUME_EDGES, ["V1", "V2", "V3"])


def entropy_bucket(entropy: Column) -> Column:
    return graded(F.coalesce(entropy, F.lit(0.0)), ENTROPY_EDGES, ["E1", "E2", "E3"])


def _key(proto: Column, service: Column, state: Column, threat: Column, *buckets: Column) -> Column:
    known = [F.coalesce(c, F.lit("unknown")) for c in (proto, service, state)]
    return F.concat_ws("_", *known, threat, *buckets)


def behaviour_signature(proto, service, state, threat, fused, anomaly, spkts, entropy) -> Column:
    """Ledger key of an evaluated event; case is kept as given."""
    return _key(
        proto, service, state, F.coalesce(threat, F.lit("UNKNOWN")),
        risk_bucket(fused), anomaly_bucket(anomaly), volume_bucket(spkts), entropy_bucket(entropy),
    )


def fallback_signature(proto, service, state, threat, has_profile, fused, anomaly, spkts, entropy) -> Column:
    """Key used when a decision carries no evaluation; zero buckets when it has no risk profile."""
    bucketed = [risk_bucket(fused), anomaly_bucket(anomaly), volume_bucket(spkts), entropy_bucket(entropy)]
    empty = [F.lit("R0"), F.lit("A0"), F.lit("V0"), F.lit("E0")]
    chosen = [F.when(has_profile, b).otherwise(e) for b, e in zip(bucketed, empty)]
    return _key(proto, service, state, F.coalesce(threat, F.lit("unknown")), *chosen)


def risk_severity(fused: Column) -> Column:
    return graded(F.coalesce(fused, F.lit(0.0)), RISK_EDGES, ["LOW", "MEDIUM", "HIGH", "CRITICAL"])


def anomaly_severity(anomaly: Column) -> Column:
    return graded(F.coalesce(anomaly, F.lit(0.0)), ANOMALY_EDGES, ["LOW", "MEDIUM", "HIGH"])


def traffic_volume(spkts: Column) -> Column:
    """Unlike the bucket, the word is chosen on the untruncated count."""
    return graded(F.coalesce(spkts.cast("double"), F.lit(0.0)), VOLUME_EDGES, ["LOW", "MEDIUM", "HIGH"])


def classification_certainty(entropy: Column) -> Column:
    return graded(
        F.coalesce(entropy, F.lit(0.0)), ENTROPY_EDGES, ["HIGH (certain)", "MEDIUM", "LOW (uncertain)"]
    )
