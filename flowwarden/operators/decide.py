"""Gate, native response rules, decision cascade, feedback and misdecisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.config import GREY_ZONE_LIMIT, LOW_RISK_SHARE
from flowwarden.functions.text import fixed, isolation_trigger

ESCALATED = ("NETWORK_ISOLATION", "STEP_UP_AUTH", "RATE_LIMIT_DOS")
CONTAINED = ("NETWORK_ISOLATION", "RATE_LIMIT_DOS")
#: What is executed when an answer names no playbook.
UNNAMED = "NETWORK_ISOLATION"
#: Columns of the policy stage.
EVALUATED = ("trust_score", "is_acceptable", "factors", "violations")
PASSED = ("ALLOW", "LOG_ONLY")


def gated(fused: Column, threshold: float) -> Column:
    """True when an event goes on to the policy stage; equality does not."""
    return F.coalesce(fused, F.lit(0.0)) > F.lit(threshold)


def native_route(threshold: float, looks_benign: Column | None = None) -> Column:
    """First matching native rule as struct(rule, playbook, is_false_positive).

    Rule 7 asks for an inspection; `looks_benign` decides it and defaults to never.
    """
    fused, threat = F.coalesce(F.col("fused_risk"), F.lit(0.0)), F.coalesce(F.col("threat"), F.lit("UNKNOWN"))
    mfa, iso = F.lit(threshold), F.lit(isolation_trigger(threshold))
    benign = F.lit(False) if looks_benign is None else looks_benign

    def outcome(rule: int, playbook, fp: bool) -> Column:
        playbook = F.lit(playbook) if isinstance(playbook, str) else playbook
        return F.struct(F.lit(rule).alias("rule"), playbook.alias("playbook"), F.lit(fp).alias("is_false_positive"))

    return (
        F.when((fused <= mfa) & (threat == "Normal"), outcome(1, "ALLOW", True))
        .when((fused <= mfa) & (threat != "Normal"), outcome(2, "ALLOW", False))
        .when(threat == "DoS", outcome(3, "RATE_LIMIT_DOS", False))
        .when((threat == "Shellcode") & (F.col("proto") == "udp") & (F.col("dpkts") == 0) & (fused < mfa),
              outcome(4, "ALLOW", True))
        .when(fused > iso, outcome(5, "NETWORK_ISOLATION", False))
        .when((threat != "Normal") & (threat != "DoS"), outcome(6, "NETWORK_ISOLATION", False))
        .otherwise(outcome(7, F.when(benign, "ALLOW").otherwise("STEP_UP_AUTH"), False))
    )


def decide(events: DataFrame, threshold: float, looks_benign: Column | None = None) -> DataFrame:
    """Cascade over frames that carry `trust_score`, `is_acceptable` and, when joined, ledger `status`."""
    fused = F.coalesce(F.col("fused_risk"), F.lit(0.0))
    trusted = F.col("is_acceptable") & (fused < F.lit(GREY_ZONE_LIMIT))
    status = F.col("status") if "status" in events.columns else F.lit(None).cast("string")
    quarantined = F.coalesce(status == "quarantined", F.lit(False))
    routed = events.withColumn("_route", native_route(threshold, looks_benign))
    branch = (
        F.when(~gated(F.col("fused_risk"), threshold), "gate")
        .when(trusted, "trusted")
        .when(quarantined, "quarantine")
        .otherwise("responder")
    )
    at = F.col("branch")
    # The policy stage never sees gated events, so nothing it says about them is kept.
    kept = [F.when(at != "gate", F.col(c)).alias(c) if c in EVALUATED else F.col(c) for c in events.columns]
    return routed.withColumn("branch", branch).select(
        *kept, "branch",
        F.when(at == "gate", "LOG_ONLY").when(at == "trusted", "ALLOW")
        .when(at == "quarantine", "NETWORK_ISOLATION").otherwise(F.col("_route.playbook")).alias("playbook"),
        F.when(at == "responder", F.col("_route.rule")).alias("rule"),
        F.when(at == "trusted", fused < F.lit(threshold * LOW_RISK_SHARE))
        .when(at == "responder", F.col("_route.is_false_positive")).otherwise(F.lit(False))
        .alias("is_false_positive"),
        F.lit(False).alias("is_llm_failsafe"),
        F.when(at == "gate", "Anomaly score did not exceed the detection threshold; logged as benign.")
        .when(at == "trusted", F.concat(F.lit("Trust score "), fixed(F.col("trust_score"), 4),
                                        F.lit(" meets the policy threshold; no escalation required.")))
        .when(at == "quarantine", F.concat(F.lit("Signature '"), F.col("signature"),
                                           F.lit("' is in active quarantine; immediate isolation.")))
        .otherwise(F.concat(F.lit("Rule "), F.col("_route.rule").cast("string"), F.lit(" matched first.")))
        .alias("reasoning"),
    )


def with_responses(events: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace responder outcomes by parsed model answers keyed by event id; others stay as decided.

    `responses` holds `event_id, answer` with the struct of `decision_from_response`.
    """
    joined = events.join(responses.select("event_id", "answer"), "event_id", "left")
    use = (F.col("branch") == "responder") & F.col("answer").isNotNull()
    fields = ["playbook", "reasoning", "is_false_positive", "is_llm_failsafe"]
    changed = {f: F.when(use, F.col(f"answer.{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(changed).drop("answer")


def feedback(decisions: DataFrame, stored_threshold: float) -> DataFrame:
    """Evidence rows the decisions imply: normal for false-positive ALLOWs, attack for containment."""
    fused = F.coalesce(F.col("fused_risk"), F.lit(0.0))

    def held(value: Column) -> Column:
        return F.greatest(F.lit(0.1), F.least(F.lit(1.0), value))

    executed = F.coalesce("playbook", F.lit(UNNAMED))
    benign = (executed == "ALLOW") & F.col("is_false_positive")
    attack = executed.isin(*CONTAINED)
    near = F.lit(1.0) - F.abs(fused - F.lit(stored_threshold)) * F.lit(2.0)
    return decisions.filter((F.col("branch") != "gate") & (benign | attack)).select(
        "event_id", "signature", "seq",
        F.when(benign, "normal").otherwise("attack").alias("verdict"),
        F.when(benign, held(near)).otherwise(held(fused)).alias("confidence"),
    )


def misdecisions(decisions: DataFrame, label: str = "label") -> DataFrame:
    """Benign events that were escalated (FP) and attacks that were allowed (FN)."""
    wrong = (
        F.when((F.col(label) == 0) & F.col("playbook").isin(*ESCALATED), "FP")
        .when((F.col(label) == 1) & (F.col("playbook") == "ALLOW"), "FN")
    )
    return decisions.withColumn("mistake", wrong).filter(F.col("mistake").isNotNull())
