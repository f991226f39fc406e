"""Decision loop that corrects itself: after each decision its own evidence and, if it was wrong, a full-weight
correction reach the ledger before the next event of the signature is decided.

Corrections move a signature's state both ways, so each decision may depend on all earlier ones of its signature
and no closed form is known. The loop is a fold in arrival order: rows are dealt by signature, sorted, and streamed
through a state of four values, so memory does not depend on how long a signature is. Its time does: a signature is
walked by one task, at about a microsecond for each escalated event. Only the handful of numbers a decision needs goes through
Python; gated events, scores, factors and texts stay with Spark's expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.config import (
    ALLOW_EVIDENCE, BIAS_CEILING, BIAS_FLOOR, BIAS_STEP, COUNTER_EVIDENCE, GREY_ZONE_LIMIT, LOW_RISK_SHARE,
    MIN_CONFIDENCE, QUARANTINE_EVIDENCE, Policy,
)
from flowwarden.operators.decide import CONTAINED, ESCALATED, decide, gated, native_route, with_responses
from flowwarden.operators.ledger import lookup_ledger
from flowwarden.operators.ordered import join_keys
from flowwarden.operators.trust import evaluation, with_trust
from flowwarden.schemas import LEDGER
from flowwarden.session import materialise, ship_package

STATE = ("confirmed_normal", "confirmed_attack", "trust_bias", "status")
_ENTRY = "struct<n:double,a:double,bias:double,status:string>"


@dataclass(frozen=True)
class Rates:
    """Numbers of the fold."""

    threshold: float
    trust: float
    floor: float
    ceiling: float
    bonus: float
    penalty: float

    @classmethod
    def of(cls, threshold: float, policy: Policy) -> Rates:
        return cls(threshold, *[float(policy[k]) for k in (
            "trust_score_threshold", "score_floor", "score_ceiling", "allowlist_bonus", "quarantine_penalty")])


State = tuple[float, float, float, str]
FRESH: State = (0.0, 0.0, 0.0, "monitoring")


def add_evidence(state: State, normal: bool, confidence: float, rates: Rates) -> State:
    """Ledger entry after one piece of evidence."""
    n, a, bias, status = state
    c = min(1.0, max(MIN_CONFIDENCE, confidence))
    n, a = (n + c, a) if normal else (n, a + c)
    if status == "allowlisted":
        return (n, a, 0.0, "monitoring") if a >= QUARANTINE_EVIDENCE else (n, a, bias, status)
    if status == "quarantined":
        return (n, a, 0.0, "monitoring") if n >= ALLOW_EVIDENCE else (n, a, bias, status)
    if n >= ALLOW_EVIDENCE and a < COUNTER_EVIDENCE:
        return n, a, rates.bonus, "allowlisted"
    if a >= QUARANTINE_EVIDENCE and n < COUNTER_EVIDENCE:
        return n, a, -rates.penalty, "quarantined"
    bias = min(BIAS_CEILING, bias + BIAS_STEP * c) if normal else max(BIAS_FLOOR, bias - BIAS_STEP * c)
    return n, a, bias, status


def step(state: State, fused: float, before: float, after: float, playbook: str, benign: bool, failsafe: bool,
         truth: int | None, rates: Rates) -> State:
    """State after one escalated event: decision, its own evidence, its correction.

    `playbook`, `benign` and `failsafe` are what the responder says if it is asked; an answer without a playbook is
    executed as isolation but is no mistake to correct.
    """
    _, _, bias, status = state
    memory = -rates.penalty if status == "quarantined" else rates.bonus if status == "allowlisted" else bias
    score = math.floor((before + memory + after) * 1e6 + 0.5) / 1e6
    score = max(rates.floor, min(rates.ceiling, score))
    if score >= rates.trust and fused < GREY_ZONE_LIMIT:
        playbook, benign, failsafe = "ALLOW", fused < rates.threshold * LOW_RISK_SHARE, False
    elif status == "quarantined":
        playbook, benign, failsafe = "NETWORK_ISOLATION", False, False
    done = playbook or "NETWORK_ISOLATION"
    if done == "ALLOW" and benign:
        state = add_evidence(state, True, min(1.0, max(0.1, 1.0 - abs(fused - rates.threshold) * 2.0)), rates)
    elif done in CONTAINED:
        state = add_evidence(state, False, min(1.0, max(0.1, fused)), rates)
    if not failsafe:
        if truth == 0 and playbook in ESCALATED:
            state = add_evidence(state, True, 1.0, rates)
        elif truth == 1 and playbook == "ALLOW":
            state = add_evidence(state, False, 1.0, rates)
    return state


def _walk(rates: Rates):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, FRESH, False
        for batch in batches:
            seen, left = [], []
            for signature, _, fused, before, after, playbook, benign, failsafe, truth, n, a, bias, status in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or signature != current:
                    current, begun = signature, True
                    state = (n or 0.0, a or 0.0, bias or 0.0, status or "monitoring")
                seen.append(state)
                state = step(state, fused, before, after, playbook, bool(benign), bool(failsafe), truth, rates)
                left.append(state)
            kind = pa.struct([("n", pa.float64()), ("a", pa.float64()), ("bias", pa.float64()), ("status", pa.string())])
            own = [pa.array([dict(zip(("n", "a", "bias", "status"), s, strict=True)) for s in states], kind) for states in (seen, left)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["signature", "seq", "seen", "left"])

    return walked


@dataclass(frozen=True)
class Corrected:
    decisions: DataFrame
    ledger: DataFrame


def replay_corrected(events: DataFrame, threshold: float, policy: Policy, label: str = "label",
                     ledger: DataFrame | None = None, responses: DataFrame | None = None,
                     looks_benign: Column | None = None, detail: bool = False) -> Corrected:
    """Decisions of all events, each seeing the corrections of the ones before it, and the ledger they leave.

    `events` are context rows with `signature`, a `seq` unique per signature, and the truth in `label` (null: unknown, never
    corrected). `responses` holds event_id and answer, a model's answer for events that reach the responder.
    """
    spark = events.sparkSession
    ship_package(spark)
    before = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    early, late = evaluation(policy).around_memory()
    asked = events.filter(gated(F.col("fused_risk"), threshold)).withColumn("_route", native_route(threshold, looks_benign))
    said = {"playbook": F.col("_route.playbook"), "benign": F.col("_route.is_false_positive"), "failsafe": F.lit(False)}
    if responses is not None:
        asked = asked.join(responses.select("event_id", "answer"), "event_id", "left")
        answered = F.col("answer").isNotNull()
        said = {k: F.when(answered, F.col(f"answer.{f}")).otherwise(said[k]) for k, f in (
            ("playbook", "playbook"), ("benign", "is_false_positive"), ("failsafe", "is_llm_failsafe"))}
    needed = asked.select(
        "signature", "seq", F.coalesce("fused_risk", F.lit(0.0)).alias("fused"), early.alias("early"), late.alias("late"),
        *[c.alias(k) for k, c in said.items()], F.col(label).cast("int").alias("truth"))
    started = lookup_ledger(needed, before.select("signature", *STATE))
    ordered = started.select(*needed.columns, *STATE).repartition("signature").sortWithinPartitions("signature", "seq")
    walked = materialise(ordered.mapInArrow(
        _walk(Rates.of(threshold, policy)), f"signature string, seq bigint, seen {_ENTRY}, left {_ENTRY}"))

    states = walked.select("signature", "seq", *[F.col(f"seen.{s}").alias(c) for s, c in zip(("n", "a", "bias", "status"), STATE, strict=True)])
    decided = decide(with_trust(join_keys(events, states, ["signature", "seq"], "left"), policy, from_ledger=True, detail=detail),
                     threshold, looks_benign)
    if responses is not None:
        decided = with_responses(decided, responses)
    last = walked.groupBy("signature").agg(F.max_by("left", "seq").alias("end"), F.max("seq").alias("last_seq"))
    updated = last.select("signature", F.col("end.n").alias("confirmed_normal"), F.col("end.a").alias("confirmed_attack"),
                          F.col("end.bias").alias("trust_bias"), F.col("end.status").alias("status"), "last_seq")
    written = updated.filter((F.col("confirmed_normal") > 0) | (F.col("confirmed_attack") > 0))
    carried = before.join(written.select("signature"), "signature", "left_anti").select(*LEDGER.names)
    return Corrected(decided, written.unionByName(carried))
