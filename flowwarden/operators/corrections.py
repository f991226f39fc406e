"""Self-correction as a batch job over decisions, truth and model responses; prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.conditions import implicated_rule
from flowwarden.functions.responses import rule_from_response
from flowwarden.functions.signature import (
    anomaly_severity, classification_certainty, fallback_signature, risk_severity, traffic_volume,
)
from flowwarden.functions.text import context_text, evidence_summary, rendered_rules
from flowwarden.operators.decide import misdecisions
from flowwarden.config import NO_ANALYSIS
from flowwarden.operators.vectors import NO_SIGNAL
from flowwarden.sources.flows import slim_context


def event_text() -> Column:
    """Context text over the usual event columns."""
    return context_text(*[F.col(c) for c in ("threat", "fused_risk", "cat_risk", "anomaly_risk", "proto",
                                            "service", "state", "spkts", "dpkts")])


def ledger_key(decisions: DataFrame) -> Column:
    """The evaluated signature, or the fallback for decisions that were never evaluated."""
    fallback = fallback_signature(
        F.col("proto"), F.col("service"), F.col("state"), F.col("threat"), F.col("fused_risk").isNotNull(),
        F.col("fused_risk"), F.col("anomaly_risk"), F.col("spkts"), F.col("incident_entropy"))
    return F.coalesce("signature", fallback) if "signature" in decisions.columns else fallback


def correct(decisions: DataFrame, responses: DataFrame, label: str = "label") -> DataFrame:
    """One record per corrected misdecision, answered or not.

    Fail-safe decisions are left alone. `responses` holds event_id, analysis, rule_raw, corrected_at; without an
    answer the analysis is the fallback text, there is no rule, and the event's own time stands for the correction.
    A rule is read only when the analysis is a real one; a missed attack also names the rule to blame.
    """
    wrong = misdecisions(decisions, label).filter(~F.coalesce("is_llm_failsafe", F.lit(False)))
    own_time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "ts" in decisions.columns else F.lit(None).cast("string")
    joined = wrong.join(responses, "event_id", "left").withColumns({
        "analysis": F.coalesce("analysis", F.lit(NO_ANALYSIS)), "corrected_at": F.coalesce("corrected_at", own_time),
    }).withColumn(
        "rule", F.when(~F.contains("analysis", F.lit(NO_SIGNAL)), rule_from_response(F.col("rule_raw"))))
    blamed = F.when(F.col("mistake") == "FN", implicated_rule(
        F.concat_ws(" ", F.coalesce("reasoning", F.lit("")), "analysis")))
    return joined.select(
        *decisions.columns, "mistake", "analysis", "rule", "corrected_at",
        ledger_key(decisions).alias("ledger_signature"),
        blamed.alias("implicated"), event_text().alias("context_text"), F.col("rule.id").alias("rule_id"),
    )


def correction_evidence(records: DataFrame) -> DataFrame:
    """Full-weight evidence: a false positive counts as normal, a missed attack as attack.

    It follows the decision's own evidence, hence the odd position after `2 * seq`.
    """
    return records.select(
        F.col("ledger_signature").alias("signature"), (F.col("seq") * 2 + 1).alias("seq"),
        F.when(F.col("mistake") == "FP", "normal").otherwise("attack").alias("verdict"),
        F.lit(1.0).alias("confidence"))


def interleaved(feedback: DataFrame, corrections: DataFrame) -> DataFrame:
    """Both evidence logs in arrival order: a decision's own evidence first, its correction next."""
    own = feedback.select("signature", (F.col("seq") * 2).alias("seq"), "verdict", "confidence")
    return own.unionByName(correction_evidence(corrections))


def new_rules(records: DataFrame) -> DataFrame:
    """Rules the corrections produced, in arrival order."""
    return records.filter(F.col("rule").isNotNull()).select(
        "event_id", "seq", "mistake", F.col("rule.id").alias("id"), F.col("rule.condition").alias("condition"),
        F.col("rule.playbook").alias("playbook"), F.col("rule.rationale").alias("rationale"),
        F.col("corrected_at").alias("created_at"))


def rule_incidents(records: DataFrame) -> DataFrame:
    return records.filter(F.col("implicated").isNotNull()).select(
        F.col("implicated").alias("rule_id"), "event_id", "reasoning", F.col("corrected_at").alias("recorded_at"))


# ---- prompts ----------------------------------------------------------------------------------

def severity_lines() -> Column:
    named = [
        ("fused risk", risk_severity(F.col("fused_risk"))), ("anomaly", anomaly_severity(F.col("anomaly_risk"))),
        ("volume", traffic_volume(F.col("spkts"))), ("certainty", classification_certainty(F.col("incident_entropy"))),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), c) for n, c in named])


RESPONSE_HEAD = "Act as a SOC analyst: the first rule that matches decides. Answer with one JSON object only."
RESPONSE_TAIL = ('ANSWER: {"reasoning": text, "playbook": ALLOW|STEP_UP_AUTH|NETWORK_ISOLATION|RATE_LIMIT_DOS, '
                 '"is_false_positive": bool}')
NEAR_HEAD = "LEARNED RULES (only when no rule above matches):"
PRIOR_HEAD = "SIMILAR PAST CORRECTIONS:"


def ml_profile() -> Column:
    """JSON of the four model figures of an event; missing figures stay as null."""
    return F.to_json(F.struct(F.col("cat_risk").alias("categorical_risk"), "anomaly_risk", "fused_risk", "incident_entropy"),
                     {"ignoreNullFields": "false"})


def _optional(frame: DataFrame, name: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast("string")


def _titled(head: str, text: Column) -> Column:
    """The text under its head; null, which joins leave out, where there is no text."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(head + "\n"), text))


def history() -> Column:
    """Evidence block of a frame that `lookup_ledger` has joined; empty without an entry."""
    return evidence_summary(*[F.col(c) for c in ("confirmed_normal", "confirmed_attack", "status", "trust_bias")])


def response_prompts(events: DataFrame, threshold: float) -> DataFrame:
    """System and user prompt per escalated event: evidence block, filled-in rules, near learned rules.

    The lines of near learned rules come in the column `near`, if there is one (`plans.prompts`).
    """
    system = F.concat_ws(
        "\n\n", F.lit(RESPONSE_HEAD), _titled("BEHAVIORAL HISTORY:", history()),
        F.lit("RULES:\n" + "\n".join(rendered_rules(threshold))), _titled(NEAR_HEAD, _optional(events, "near")),
        F.lit(RESPONSE_TAIL))
    return events.select("event_id", system.alias("system_prompt"), slim_context(events).alias("user_prompt"))


def audit_prompts(records: DataFrame) -> DataFrame:
    """Prompt per misdecision that asks for the root cause.

    Optional columns: `prior` (lines of similar past corrections), `evidence` (block of the ledger), `factors`.
    """
    goal = F.when(F.col("mistake") == "FP", "benign traffic was contained").otherwise("an attack was allowed")
    system = F.concat(F.lit("Audit a security decision: "), goal,
                      F.lit(". Explain the cause in two to four plain sentences."))
    factors = F.to_json("factors") if "factors" in records.columns else F.lit(None).cast("string")
    user = F.concat_ws(
        "\n", _titled(PRIOR_HEAD, _optional(records, "prior")), F.nullif(_optional(records, "evidence"), F.lit("")),
        F.concat(F.lit("Decision: "), F.col("playbook")), F.concat(F.lit("Reasoning: "), F.col("reasoning")),
        F.concat(F.lit("ML profile: "), ml_profile()),
        F.concat(F.lit("Context: "), event_text()), severity_lines(),
        F.concat(F.lit("Trust factors: "), factors))
    return records.select("event_id", "mistake", system.alias("system_prompt"), user.alias("user_prompt"))


def rule_prompts(records: DataFrame) -> DataFrame:
    """Prompt per analysed misdecision that asks for one routing rule; a failed analysis asks for none.

    Optional columns: `assigned` (the id the rule is to carry), `evidence`.
    """
    wanted = wanted_playbook()
    system = F.concat(
        F.lit("Write one JSON routing rule with id, condition (field=value joined by AND), playbook "), wanted,
        F.lit(" and a rationale of at most 20 words, so that the same mistake is not repeated."))
    user = F.concat_ws(
        "\n", F.concat(F.lit("Rule id to assign: "), _optional(records, "assigned")),
        F.concat(F.lit("Analysis: "), F.col("analysis")), F.nullif(_optional(records, "evidence"), F.lit("")),
        F.concat(F.lit("ML profile: "), ml_profile()), F.concat(F.lit("Context: "), event_text()), severity_lines())
    return analysed(records).select("event_id", "mistake", system.alias("system_prompt"), user.alias("user_prompt"))


def wanted_playbook() -> Column:
    return F.when(F.col("mistake") == "FP", "ALLOW").otherwise("NETWORK_ISOLATION")


def analysed(records: DataFrame) -> DataFrame:
    return records.filter(~F.contains(F.coalesce("analysis", F.lit(NO_SIGNAL)), F.lit(NO_SIGNAL)))
