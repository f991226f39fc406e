"""Model responses as text columns → typed decisions and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden.functions.cases import let
from flowwarden.functions.conditions import normalise_condition, stripped

# Reasons of fail-safe decisions.
NO_RESPONSE = "Fail-safe: no response from the model."
NO_JSON = "Fail-safe: model output no parseable JSON (think-chain overflow)."


def parsed_strictly(body: Column) -> Column:
    """Variant of a JSON text, null when it is not JSON as a whole.

    The parser stops after the first value, so the text is embedded in an object whose last key must
    still be found.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"body":'), body, F.lit(',"end of body":1}')))
    return let(wrapped, lambda v: F.when(
        F.try_variant_get(v, '$["end of body"]', "int") == 1, F.try_variant_get(v, "$.body", "variant")))


def _reader(parsed: Column):
    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(parsed, f"$.{name}", kind)
    return field


def decision_from_response(raw: Column) -> Column:
    """Struct of the answer in `raw`, or the isolation fail-safe when there is none.

    A `<think>` block is removed even when it was never closed; the widest `{…}` is then parsed. A playbook the
    answer does not name stays null; isolation is then what is executed.
    """
    rest = F.regexp_replace(raw, r"(?s)<think>.*?(?:</think>|\z)", "")
    body = F.nullif(F.regexp_extract(rest, r"(?s)\{.*\}", 0), F.lit(""))
    reason = F.when(raw.isNull(), NO_RESPONSE).otherwise(NO_JSON)

    def outcome(parsed: Column) -> Column:
        failed, field = parsed.isNull(), _reader(parsed)
        return F.struct(
            F.when(failed, reason).otherwise(field("reasoning")).alias("reasoning"),
            F.when(failed, "NETWORK_ISOLATION").otherwise(field("playbook")).alias("playbook"),
            F.coalesce(field("is_false_positive", "boolean"), F.lit(False)).alias("is_false_positive"),
            failed.alias("is_llm_failsafe"),
        )

    return let(parsed_strictly(body), outcome)


def rule_body(raw: Column) -> Column:
    """JSON text of a rule answer: closed think blocks and fences removed, a cut-off end repaired."""
    c = stripped(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    c = F.regexp_replace(F.regexp_replace(c, "^```json", ""), "^```", "")
    c = stripped(F.regexp_replace(c, "```$", ""))

    def repaired(text: Column) -> Column:
        quote = F.when(F.regexp_count(text, F.lit('"')) % 2 == 1, '"').otherwise("")
        depth = F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))
        ended = F.concat(text, quote, F.repeat(F.lit("}"), F.greatest(depth, F.lit(1))))
        return F.when(F.endswith(text, F.lit("}")), text).otherwise(ended)

    return let(c, repaired)


def rule_from_response(raw: Column) -> Column:
    """Rule struct with a normalised condition; null when the text cannot be parsed as an object."""
    def rule(parsed: Column) -> Column:
        field = _reader(parsed)
        made = F.struct(
            field("id").alias("id"),
            normalise_condition(F.coalesce(field("condition"), F.lit(""))).alias("condition"),
            field("playbook").alias("playbook"),
            field("is_fp", "boolean").alias("is_fp"),
            field("is_fn", "boolean").alias("is_fn"),
            field("rationale").alias("rationale"),
        )
        return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), made)

    return let(parsed_strictly(rule_body(raw)), rule)
