"""Rule conditions: clean-up, clause sets and rule references in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Strip every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_condition(condition: Column) -> Column:
    """Drop a leading IF, doubled equal signs, quotes and runs of blanks."""
    c = stripped(F.regexp_replace(condition, r"(?i)^IF\s+", ""))
    c = F.replace(c, F.lit("=="), F.lit("="))
    for mark in ('\\"', '"', "'"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return stripped(F.regexp_replace(c, r"\s{2,}", " "))


def clauses(condition: Column) -> Column:
    """Sorted distinct lower-case `field=value` clauses; blanks round the equal sign are dropped."""
    parts = F.transform(
        F.split(condition, r"\bAND\b"),
        lambda p: F.lower(F.regexp_replace(stripped(p), r"\s*=\s*", "=")),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def clause_key(clause_array: Column) -> Column:
    return F.array_join(clause_array, " and ")


def numeric_text(value: Column) -> Column:
    """One spelling per number, so that `10`, `10.0` and 10 compare equal; other text is lower-cased."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(number.cast("string"), F.lower(value.cast("string")))


def clause_field(clause: Column) -> Column:
    return F.substring_index(clause, "=", 1)


def clause_value(clause: Column) -> Column:
    return numeric_text(F.substring(clause, F.locate("=", clause) + 1, F.length(clause)))


def implicated_rule(text: Column) -> Column:
    """Rule a text blames: a learned id first, else `rule N` as a native rule, else null."""
    learned = F.nullif(F.regexp_extract(text, r"(?i)\b(LEARNED_\d+|FN_PATCH_\d+)\b", 1), F.lit(""))
    native = F.nullif(F.regexp_extract(text, r"(?i)\brule\s+#?(\d+)\b", 1), F.lit(""))
    return F.coalesce(F.upper(learned), F.concat(F.lit("NATIVE_RULE_"), native))
