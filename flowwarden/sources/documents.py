"""JSON state documents → tables: rules and playbooks, memory snapshots, threshold records."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.config import FALLBACK_THRESHOLD, NATIVE_RULES, Policy
from flowwarden.operators.playbooks import steps_table
from flowwarden.schemas import MEMORY_DOCUMENT, RULE, THRESHOLD


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one per row, as `document`; no rows if there is no such file."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "document string")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Routing rules of a playbook file; without the file the native rules."""
    found = read_documents(spark, path)
    if found.isEmpty():
        natives = json.dumps({"routing_rules": list(NATIVE_RULES)})
        found = spark.createDataFrame([(natives,)], "document string")
    return rules_of(found)


def playbooks_of(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Playbook definitions: playbook, description, steps (step, tool, action, args).

    Every key of the file but `routing_rules` and `rule_audit` is a playbook; what a step holds besides tool and
    action are its arguments.
    """
    keys = keys or []
    named = documents.select(*keys, F.from_json("document", "map<string,string>").alias("d")).select(
        *keys, F.explode("d").alias("playbook", "body")).filter(~F.col("playbook").isin("routing_rules", "rule_audit"))
    parsed = named.select(*keys, "playbook", F.from_json(
        "body", "description string, steps array<map<string,string>>").alias("b")).filter(F.col("b.steps").isNotNull())
    steps = F.transform("b.steps", lambda s, i: F.struct(
        (i + 1).alias("step"), s["tool"].alias("tool"), s["action"].alias("action"),
        F.map_filter(s, lambda k, _: ~k.isin("tool", "action")).alias("args")))
    return parsed.select(*keys, "playbook", F.col("b.description").alias("description"), steps.alias("steps"))


def load_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Playbook definitions of a file; without the file the default ones, which have no description."""
    found = read_documents(spark, path)
    if found.isEmpty():
        return steps_table(spark).select("playbook", F.lit(None).cast("string").alias("description"), "steps")
    return playbooks_of(found)


def rules_of(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per routing rule; `ord` is its position, which is its priority.

    The list mixes sentences (native rules) and objects (learned rules). It is read as an array of
    strings, where an object arrives as its JSON text.
    """
    keys = keys or []
    listed = documents.select(
        *keys, F.from_json("document", "routing_rules array<string>").alias("d")
    ).select(*keys, F.posexplode("d.routing_rules").alias("ord", "entry"))
    learned = F.startswith(F.ltrim("entry"), F.lit("{"))
    return listed.select(
        *keys, "ord",
        F.when(learned, "learned").otherwise("native").alias("kind"),
        F.when(~learned, F.col("entry")).alias("text"),
        F.when(learned, F.from_json("entry", RULE)).alias("rule"),
    ).select(*keys, "ord", "kind", "text", "rule.*")


def memory_documents(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Parsed memory snapshots; a document that cannot be parsed counts as an empty one."""
    return documents.select(*(keys or []), F.from_json("document", MEMORY_DOCUMENT).alias("m"))


def ledger_of(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return memory_documents(documents, keys).select(
        *keys, F.explode("m.signatures").alias("signature", "entry")
    ).select(*keys, "signature", "entry.*")


def trust_history_of(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return memory_documents(documents, keys).select(
        *keys, F.explode("m.trust_scores").alias("signature", "entry")
    ).select(*keys, "signature", "entry.*")


def policy_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """Threat penalties as a table; its size is the number of configured classes."""
    rows = [(c, float(p)) for c, p in policy["threat_class_penalties"].items()]
    return spark.createDataFrame(rows, "threat string, penalty double")


def write_threshold(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    """Stored record; a missing file or one without a threshold falls back to 0.5 and says so."""
    try:
        record = spark.read.schema(THRESHOLD).json(path, multiLine=False)
    except AnalysisException as error:
        if not _missing(error):
            raise
        record = spark.createDataFrame([(None,) * len(THRESHOLD)], THRESHOLD)
    return record.withColumns({
        "is_fallback": F.coalesce("is_fallback", F.col("optimal_threshold").isNull()),
        "optimal_threshold": F.coalesce("optimal_threshold", F.lit(FALLBACK_THRESHOLD)),
    })
