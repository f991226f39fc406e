"""Zero-trust evaluation: seven factors, violations and the clamped score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.config import HIGH_SEVERITY_PENALTY, Policy
from flowwarden.functions.cases import cases
from flowwarden.functions.signature import packets
from flowwarden.functions.text import fixed


def asset_tier(dstip: Column, policy: Policy) -> Column:
    """Prefix of the first configured tier the destination starts with, else DEFAULT."""
    ip = F.coalesce(dstip, F.lit(""))
    return cases([(ip.startswith(p), F.lit(p)) for p, _ in policy.tiers()], "DEFAULT")


def asset_multiplier(dstip: Column, policy: Policy) -> Column:
    ip = F.coalesce(dstip, F.lit(""))
    return cases([(ip.startswith(p), F.lit(float(m))) for p, m in policy.tiers()], float(policy.default_tier()))


def threat_penalty(threat: Column, policy: Policy) -> Column:
    listed = [(threat == c, F.lit(float(p))) for c, p in policy["threat_class_penalties"].items()]
    return cases(listed, float(policy.unlisted_penalty()))


def combo(proto: Column, service: Column) -> Column:
    return F.concat_ws("_", F.lower(F.coalesce(proto, F.lit(""))), F.lower(F.coalesce(service, F.lit(""))))


def unapproved(proto: Column, service: Column, policy: Policy) -> Column:
    """True when the pair is off the approved list; an empty list switches the rule off."""
    approved = policy["approved_proto_service_combos"]
    return ~combo(proto, service).isin(approved) if approved else F.lit(False)


def written_hour(timestamp: Column) -> Column:
    """Hour of an ISO text as written (its offset is not applied); null when it is not a time."""
    hour = F.regexp_extract(timestamp.cast("string"), r"^\d{4}-\d{2}-\d{2}[T ](\d{2})(?::|$|[+-])", 1)
    value = F.nullif(hour, F.lit("")).cast("int")
    return F.when(value < 24, value)


def after_hours(hour: Column, policy: Policy) -> Column:
    """Outside [start, end); a null hour counts as inside, callers can flag it."""
    span = policy["business_hours"]
    return F.coalesce(~((hour >= F.lit(span["start"])) & (hour < F.lit(span["end"]))), F.lit(False))


MEMORY_FACTORS = ("quarantine_history", "allowlist_bonus", "evidence_bias")


@dataclass(frozen=True)
class Evaluated:
    """Expressions of one evaluation; texts are only put together when asked for."""

    base: list[tuple[str, Column, Column, Callable[[], Column]]]
    violations: Callable[[], Column]
    policy: Policy

    def score(self) -> Column:
        """1 plus every signed change in factor order, rounded to six places, held in the policy range."""
        running = F.lit(1.0)
        for _, present, delta, _ in self.base:
            running = running + F.when(present, delta).otherwise(F.lit(0.0))
        return self.held(running)

    def held(self, score: Column) -> Column:
        floor, ceiling = float(self.policy["score_floor"]), float(self.policy["score_ceiling"])
        return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.round(score, 6)))

    def around_memory(self) -> tuple[Column, Column]:
        """Sums of the changes before and after the ledger factors, for callers that vary the ledger."""
        before, after, passed = F.lit(1.0), F.lit(0.0), False
        for name, present, delta, _ in self.base:
            if name in MEMORY_FACTORS:
                passed = True
                continue
            change = F.when(present, delta).otherwise(F.lit(0.0))
            before, after = (before, after + change) if passed else (before + change, after)
        return before, after

    def factors(self) -> Column:
        structs = [
            F.when(present, F.struct(F.lit(name).alias("name"), delta.alias("delta"), reason().alias("reason")))
            for name, present, delta, reason in self.base
        ]
        return F.filter(F.array(*structs), lambda f: f.isNotNull())


def evaluation(policy: Policy, status: Column | None = None, bias: Column | None = None,
               normals: Column | None = None, attacks: Column | None = None) -> Evaluated:
    """Factor expressions over context columns; `status` and `bias` come from the ledger, if joined."""
    fused = F.coalesce(F.col("fused_risk"), F.lit(0.5))
    cat_risk = F.coalesce(F.col("cat_risk"), F.lit(0.0))
    threat = F.coalesce(F.col("threat"), F.lit("UNKNOWN"))
    spkts = packets(F.col("spkts"))
    signature = F.col("signature")
    weight = float(policy["ml_risk_weight"])

    multiplier = asset_multiplier(F.col("dstip"), policy)
    base_penalty = fused * F.lit(weight)
    ml_penalty = base_penalty * multiplier

    def ml_reason() -> Column:
        return F.concat(
            F.lit("fused_risk="), fixed(fused, 4), F.lit(f" × weight={weight:.2f}"),
            F.when(multiplier != 1.0, F.concat(
                F.lit(" × asset_multiplier="), multiplier.cast("string"), F.lit(" (tier '"),
                asset_tier(F.col("dstip"), policy), F.lit("') → base_penalty="), fixed(base_penalty, 4),
                F.lit(", amplified="), fixed(ml_penalty, 4))).otherwise(""),
        )

    penalty = threat_penalty(threat, policy)

    def threat_reason() -> Column:
        return F.concat(F.lit("predicted_threat='"), threat, F.lit("' → penalty="), fixed(penalty, 2))

    status = F.lit(None).cast("string") if status is None else status
    bias = F.lit(0.0) if bias is None else F.coalesce(bias, F.lit(0.0))
    quarantined = F.coalesce(status == "quarantined", F.lit(False))
    allowlisted = F.coalesce(status == "allowlisted", F.lit(False))
    biased = ~quarantined & ~allowlisted & (bias != 0.0)

    def seen(text: Column, second: str) -> Column:
        counts = [F.coalesce(F.lit(0.0) if c is None else c, F.lit(0.0)).cast("string") for c in (normals, attacks)]
        first = "n" if second == "a" else "normal"
        return F.concat(F.lit("signature '"), signature, F.lit("' "), text, F.lit(f" ({first}="), counts[0],
                        F.lit(f", {second}="), counts[1], F.lit(")"))

    pair = combo(F.col("proto"), F.col("service"))
    off_list = unapproved(F.col("proto"), F.col("service"), policy)

    hour = written_hour(F.col("ts"))
    late = after_hours(hour, policy)
    span = policy["business_hours"]

    volume_limit = policy["high_volume_threshold"]
    loud = spkts > F.lit(volume_limit)

    cat_limit = float(policy["high_categorical_risk_threshold"])
    spiked = cat_risk > F.lit(cat_limit)

    def price(key: str) -> Column:
        return F.lit(-float(policy[key]))

    base = [
        ("ml_fused_risk", F.lit(True), -ml_penalty, ml_reason),
        ("threat_classification", penalty > 0, -penalty, threat_reason),
        ("quarantine_history", quarantined, price("quarantine_penalty"),
         lambda: seen(F.lit("is quarantined"), "a")),
        ("allowlist_bonus", allowlisted & ~quarantined, F.lit(float(policy["allowlist_bonus"])),
         lambda: seen(F.lit("is allowlisted"), "a")),
        ("evidence_bias", biased, bias,
         lambda: seen(F.concat(F.lit("monitoring: bias="), fixed(bias, 3, plus=True)), "attack")),
        ("unapproved_proto_service", off_list, price("unapproved_combo_penalty"),
         lambda: F.concat(F.lit("combo '"), pair, F.lit("' not in approved_proto_service_combos"))),
        ("after_hours_access", late, price("after_hours_penalty"),
         lambda: F.concat(F.lit("event at hour="), hour.cast("string"),
                          F.lit(f", outside business hours [{span['start']}–{span['end']})"))),
        ("high_volume_anomaly", loud, price("high_volume_penalty"),
         lambda: F.concat(F.lit("spkts="), spkts.cast("string"), F.lit(f" > threshold={volume_limit}"))),
        ("high_categorical_risk", spiked, price("high_categorical_risk_penalty"),
         lambda: F.concat(F.lit("categorical_risk="), fixed(cat_risk, 4), F.lit(f" > threshold={cat_limit}"))),
    ]

    def violations() -> Column:
        return F.filter(F.array(
            F.when(penalty >= F.lit(HIGH_SEVERITY_PENALTY),
                   F.concat(F.lit("HIGH_SEVERITY_THREAT: "), threat, F.lit(" exceeds critical threshold"))),
            F.when(off_list, F.concat(F.lit("UNAPPROVED_COMBO: "), pair)),
            F.when(late, F.concat(F.lit("AFTER_HOURS_ACCESS: event at "), F.lpad(hour.cast("string"), 2, "0"),
                                  F.lit(":xx local time"))),
            F.when(loud, F.concat(F.lit("HIGH_VOLUME: spkts="), spkts.cast("string"))),
        ), lambda v: v.isNotNull())

    return Evaluated(base, violations, policy)


def memory_change(status: Column, bias: Column, policy: Policy) -> Column:
    """What the ledger adds to a score: penalty, bonus or bias."""
    return (
        F.when(status == "quarantined", F.lit(-float(policy["quarantine_penalty"])))
        .when(status == "allowlisted", F.lit(float(policy["allowlist_bonus"]))).otherwise(bias))


def with_trust(events: DataFrame, policy: Policy, from_ledger: bool = False, detail: bool = True) -> DataFrame:
    """Add `trust_score` and `is_acceptable`, and with `detail` also `factors` and `violations`.

    With `from_ledger` the frame carries the ledger columns of `lookup_ledger`.
    """
    ledger = {}
    if from_ledger:
        ledger = dict(status=F.col("status"), bias=F.col("trust_bias"),
                      normals=F.col("confirmed_normal"), attacks=F.col("confirmed_attack"))
    result = evaluation(policy, **ledger)
    added = {"trust_score": result.score()}
    if detail:
        added |= {"factors": result.factors(), "violations": result.violations()}
    return events.withColumns(added).withColumn(
        "is_acceptable", F.col("trust_score") >= F.lit(float(policy["trust_score_threshold"])))
