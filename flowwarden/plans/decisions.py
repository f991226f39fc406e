"""Decision loop with ledger feedback, replayed exactly in a few set-at-a-time rounds.

An event's trust depends on what its signature's earlier decisions wrote to the ledger, and nothing
crosses signatures. Native routing writes attack evidence only, so per signature the state moves along
a short chain: every step adds at least the smallest gated confidence, and the chain ends when the
signature is quarantined (2 attacks) or its bias has reached the floor. Between two steps the state is
constant and all decisions are plain expressions.

Each round therefore finds, for every unfinished signature, the first event that would write evidence
under the current state. That is one aggregate with map-side combine, so a signature that owns a third
of all events is never walked event by event. The number of rounds does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.config import (
    BIAS_FLOOR, BIAS_STEP, COUNTER_EVIDENCE, GREY_ZONE_LIMIT, QUARANTINE_EVIDENCE, Policy,
)
from flowwarden.functions.text import isolation_trigger
from flowwarden.operators.decide import CONTAINED, decide, gated
from flowwarden.operators.ledger import lookup_ledger
from flowwarden.operators.trust import evaluation, memory_change, with_trust
from flowwarden.schemas import LEDGER
from flowwarden.session import materialise, rows_within

START = -(1 << 62)
BROADCAST_SIGNATURES = 100_000
STATE = ("confirmed_normal", "confirmed_attack", "trust_bias", "status")


@dataclass(frozen=True)
class Replay:
    decisions: DataFrame
    ledger: DataFrame
    rounds: int


def _contained_by_rules(threshold: float) -> Column:
    """Native route of an escalated event is isolation or rate limiting: rules 3, 5 and 6."""
    threat = F.coalesce(F.col("threat"), F.lit("UNKNOWN"))
    return (threat != "Normal") | (F.col("fused_risk") > F.lit(isolation_trigger(threshold)))


def _emits(policy: Policy) -> Column:
    """Would the event write attack evidence under the state columns joined to it?

    Only rows whose native route contains are asked.
    """
    score = F.col("_before") + memory_change(F.col("status"), F.col("trust_bias"), policy) + F.col("_after")
    held = F.greatest(F.lit(float(policy["score_floor"])), F.least(F.lit(float(policy["score_ceiling"])), F.round(score, 6)))
    trusted = (held >= F.lit(float(policy["trust_score_threshold"]))) & (F.col("fused_risk") < F.lit(GREY_ZONE_LIMIT))
    return ~trusted


def _stepped(policy: Policy) -> dict[str, Column]:
    """State after one attack of confidence `_conf`."""
    attacks = F.col("confirmed_attack") + F.col("_conf")
    walked = F.greatest(F.lit(BIAS_FLOOR), F.col("trust_bias") - F.lit(BIAS_STEP) * F.col("_conf"))
    allowed = F.col("status") == "allowlisted"
    demoted = allowed & (attacks >= F.lit(QUARANTINE_EVIDENCE))
    jailed = ~allowed & (attacks >= F.lit(QUARANTINE_EVIDENCE)) & (F.col("confirmed_normal") < F.lit(COUNTER_EVIDENCE))
    return {
        "confirmed_attack": attacks,
        "trust_bias": F.when(demoted, F.lit(0.0)).when(allowed, F.col("trust_bias"))
        .when(jailed, F.lit(-float(policy["quarantine_penalty"]))).otherwise(walked),
        "status": F.when(demoted, "monitoring").when(jailed, "quarantined").otherwise(F.col("status")),
    }


def _finished() -> Column:
    """No later evidence can change how this signature's events are decided."""
    at_floor = (F.col("status") == "monitoring") & (F.col("trust_bias") <= F.lit(BIAS_FLOOR)) & (
        F.col("confirmed_normal") >= F.lit(COUNTER_EVIDENCE))
    return (F.col("status") == "quarantined") | at_floor


def replay(events: DataFrame, threshold: float, policy: Policy, ledger: DataFrame | None = None,
           looks_benign: Column | None = None, detail: bool = False,
           store: Callable[[DataFrame], DataFrame] | None = None) -> Replay:
    """Decisions of all events and the ledger they leave behind.

    `detail` adds factors and violations to the decisions; `store` may write the decisions and return
    the stored table, which the ledger is then computed from. `events` are context rows with `signature` and a `seq` that is unique per signature. `ledger` is the
    state before the first event (default: empty).
    """
    spark = events.sparkSession
    before = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    fused = F.coalesce(F.col("fused_risk"), F.lit(0.0))
    escalated = events.filter(gated(F.col("fused_risk"), threshold))
    held = F.greatest(F.lit(0.1), F.least(F.lit(1.0), fused))
    before_memory, after_memory = evaluation(policy).around_memory()
    writers = materialise(escalated.filter(_contained_by_rules(threshold)).select(
        "signature", "seq", "fused_risk", before_memory.alias("_before"), after_memory.alias("_after"),
        held.alias("_conf")))

    names = writers.select("signature").distinct()
    state = lookup_ledger(names, before).select(
        "signature",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in STATE[:3]],
        F.coalesce("status", F.lit("monitoring")).alias("status"), F.lit(START).alias("since"))
    open_states = materialise(state)
    few = rows_within(open_states, BROADCAST_SIGNATURES)  # later states are of the same signatures

    def side(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    spans, rounds = open_states, 0
    emits, unfinished, stepped = _emits(policy), ~_finished(), _stepped(policy)
    while True:
        live = open_states.filter(unfinished)
        due = writers.join(side(live), "signature").filter((F.col("seq") > F.col("since")) & emits)
        first = due.groupBy("signature").agg(F.min(F.struct("seq", "_conf")).alias("_hit"))
        moved = live.join(first, "signature").select(
            "signature", *STATE, F.col("_hit.seq").alias("since"), F.col("_hit._conf").alias("_conf"))
        open_states = materialise(moved.withColumns(stepped).drop("_conf"))
        if open_states.isEmpty():
            break
        rounds += 1
        spans = spans.unionByName(open_states)

    # One row per signature: its few state spans in order. Bounded by the number of rounds.
    history = materialise(spans.groupBy("signature").agg(
        F.array_sort(F.collect_list(F.struct("since", *STATE))).alias("_spans")))
    placed = events.join(side(history), "signature", "left").withColumn(
        "_at", F.element_at(F.filter("_spans", lambda s: s["since"] < F.col("seq")), -1))
    known = lookup_ledger(placed, before.select("signature", *STATE)) if ledger is not None else None
    base = known if known is not None else placed.select(
        "*", *[F.lit(None).cast("double").alias(c) for c in STATE[:3]], F.lit(None).cast("string").alias("status"))
    live_state = base.withColumns({c: F.coalesce(F.col(f"_at.{c}"), F.col(c)) for c in STATE}).drop("_spans", "_at")
    decided = decide(with_trust(live_state, policy, from_ledger=True, detail=detail), threshold, looks_benign)

    if store is not None:
        decided = store(decided)
    wrote = decided.filter((F.col("branch") != "gate") & F.col("playbook").isin(*CONTAINED)).groupBy("signature").agg(
        F.sum(held).alias("_attacks"), F.max("seq").alias("_last"))
    final = history.select("signature", F.element_at("_spans", -1).alias("_end"))
    touched = wrote.join(final, "signature", "left").join(
        before.select("signature", *[F.col(c).alias(f"_o_{c}") for c in STATE]), "signature", "left")
    status = F.coalesce("_end.status", "_o_status", F.lit("monitoring"))
    updated = touched.select(
        "signature",
        F.coalesce("_o_confirmed_normal", F.lit(0.0)).alias("confirmed_normal"),
        (F.coalesce("_o_confirmed_attack", F.lit(0.0)) + F.col("_attacks")).alias("confirmed_attack"),
        F.coalesce("_end.trust_bias", "_o_trust_bias", F.lit(0.0)).alias("trust_bias"),
        status.alias("status"), F.col("_last").alias("last_seq"))
    carried = before.join(updated.select("signature"), "signature", "left_anti").select(*LEDGER.names)
    return Replay(decided, updated.unionByName(carried), rounds)


def snapshot_decisions(events: DataFrame, threshold: float, policy: Policy, ledger: DataFrame,
                       looks_benign: Column | None = None) -> DataFrame:
    """Approximation for large batches: every event sees the ledger as it was before the batch."""
    return decide(with_trust(lookup_ledger(events, ledger), policy, from_ledger=True), threshold, looks_benign)
