"""Texts built from contexts, rules and ledger entries, and stable document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden.config import ISOLATION_CEILING, ISOLATION_MARGIN, NATIVE_RULES


def fixed(value: Column, digits: int, plus: bool = False) -> Column:
    """Decimal text with a fixed number of digits, built from a whole number of units.

    Halves round away from zero; formatting through the platform would leave ties to its own rules.
    """
    scale = 10 ** digits
    units = F.abs(F.round(value * F.lit(float(scale)), 0)).cast("long")
    sign = F.when(F.round(value * F.lit(float(scale)), 0) < 0, "-").otherwise("+" if plus else "")
    whole = F.floor(units / F.lit(scale)).cast("long").cast("string")
    rest = F.lpad((units % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), rest)


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("?"))


def context_text(threat, fused, cat_risk, anomaly, proto, service, state, spkts, dpkts) -> Column:
    """One line of nine `key=value` tokens; a missing value shows as `?`, a missing class as unknown."""
    named = [
        ("threat", F.coalesce(threat, F.lit("unknown"))), ("fused_risk", fused), ("cat_risk", cat_risk),
        ("anomaly_risk", anomaly), ("proto", proto), ("service", service), ("state", state),
        ("spkts", spkts), ("dpkts", dpkts),
    ]
    return F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), _shown(value)) for name, value in named])


def rule_text(rule_id: Column, condition: Column, playbook: Column, rationale: Column,
              native: Column | None = None) -> Column:
    learned = F.concat(
        F.lit("Rule "), _shown(rule_id), F.lit(": IF "), _shown(condition), F.lit(" THEN "),
        _shown(playbook), F.lit(". Rationale: "), F.coalesce(rationale, F.lit("n/a")),
    )
    return learned if native is None else F.coalesce(native, learned)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Same parts, same id: prefix and the first 12 hex digits of an md5 over the joined parts."""
    raw = F.concat_ws("|", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(raw), 1, 12))


def isolation_trigger(threshold: float) -> float:
    return min(threshold + ISOLATION_MARGIN, ISOLATION_CEILING)


def rendered_rules(threshold: float) -> list[str]:
    """Native rules with both trigger values filled in."""
    fill = {
        "{mfa_trigger}": f"{threshold:.4f}",
        "{isolation_trigger}": f"{isolation_trigger(threshold):.4f}",
    }
    out = []
    for rule in NATIVE_RULES:
        for mark, text in fill.items():
            rule = rule.replace(mark, text)
        out.append(rule)
    return out


def rendered_rule(text: Column, threshold: Column) -> Column:
    """Column form of the same, for thresholds that live in a table."""
    isolation = F.least(threshold + F.lit(ISOLATION_MARGIN), F.lit(ISOLATION_CEILING))
    filled = F.replace(text, F.lit("{mfa_trigger}"), fixed(threshold, 4))
    return F.replace(filled, F.lit("{isolation_trigger}"), fixed(isolation, 4))


# The lines of the summary are fixed values: prompts of earlier runs hold them.
def evidence_summary(normal: Column, attack: Column, status: Column, bias: Column) -> Column:
    """Plain-text history of a signature; empty when the ledger has no entry for it."""
    note = (
        F.when(status == "allowlisted",
               "  - Note: signature was previously allowlisted (established benign pattern)")
        .when(status == "quarantined", "  - Note: signature is quarantined (prior confirmed attacks)")
        .when((attack > 0) & (normal > 0), "  - Note: mixed evidence — treat with elevated scrutiny")
    )

    def count(value: Column) -> Column:
        return value.cast("long").cast("string")

    lines = F.concat_ws(
        "\n",
        F.lit("Historical evidence for this behavior signature:"),
        F.concat(F.lit("  - Seen "), count(normal + attack), F.lit(" time(s) total")),
        F.concat(F.lit("  - "), count(normal), F.lit(" confirmed benign, "), count(attack),
                 F.lit(" confirmed malicious")),
        F.concat(F.lit("  - Current status  : "), status),
        F.concat(F.lit("  - Trust bias      : "), fixed(bias, 3, plus=True)),
        note,
    )
    return F.when(status.isNull(), "").otherwise(lines)
