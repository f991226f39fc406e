"""One correction cycle: misdecisions and answers become log rows, rules, audit, health, evidence and memory.

    decisions ─ misdecisions ─ answers ─▶ records ─▶ rules ─ insertion ─ compaction ─▶ rule list, audit
                                              ├─▶ incidents + earlier incidents ─▶ rule health
                                              ├─▶ evidence for the ledger
                                              └─▶ documents for the similarity memory

Records are computed once and stored; everything else is derived from them. Tables of earlier cycles come in as they were
written, so cycles accumulate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.operators import corrections as corr, rules, vectors
from flowwarden.schemas import RULE_HEALTH
from flowwarden.session import materialise
from flowwarden.sources.tables import append_batch, read_log, read_snapshot, write_snapshot


#: Columns of the stored correction log.
LOGGED = ("event_id", "ledger_signature", "mistake", "reasoning", "analysis", "corrected_at", "implicated", "rule_id", "context_text")


@dataclass(frozen=True)
class Cycle:
    """What a cycle leaves: `rules` is the whole list after it, the other tables hold new rows, health is the whole table."""

    records: DataFrame
    rules: DataFrame
    audit: DataFrame
    incidents: DataFrame
    health: DataFrame
    evidence: DataFrame
    documents: DataFrame


def correction_cycle(decisions: DataFrame, responses: DataFrame, existing: DataFrame, incidents: DataFrame | None = None,
                     label: str = "label", mode: str = "intended") -> Cycle:
    """Run a cycle over decisions and the model's answers.

    `existing` is the learned rule list (id, seq, condition, playbook, event_id, mistake, created_at); new rules follow it
    in the order of their events. `incidents` is the log of earlier cycles. Compaction is triggered by the insertion, as soon
    as the list is full.
    """
    spark = decisions.sparkSession
    records = materialise(corr.correct(decisions, responses, label))
    newest = existing.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    fresh = corr.new_rules(records).withColumn("seq", F.col("seq") + F.lit(newest + 1))
    inserted = materialise(rules.insert_rules(existing, fresh, mode))
    kept = rules.compact_rules(rules.active(inserted).drop("action", "replaced_by"), mode="intended" if mode == "intended" else "observed")
    seen = corr.rule_incidents(records)
    whole = seen if incidents is None else incidents.select(*seen.columns).unionByName(seen)
    docs = vectors.correction_documents(records).unionByName(vectors.rule_documents(fresh))
    return Cycle(records, kept, rules.audit_rows(inserted), seen,
                 rules.rule_health(whole, kept, rules.native_table(spark)), corr.correction_evidence(records), docs)


def store_corrections(records: DataFrame, root: str, batch_id: int) -> None:
    """Append a batch of corrections to the stored log and merge it into the stored rule health.

    Below `root`: `corrections` has a partition for each batch, `health` a version. A batch that runs again rewrites its own
    partition and version from the version before it, so its incidents count once; columns outside `LOGGED` are left out; an incident that an earlier batch
    has stored is not counted again. Only the keys of the log are read.
    """
    spark = records.sparkSession
    records = records.select(*[c for c in LOGGED if c in records.columns])
    append_batch(records, f"{root}/corrections", batch_id)
    own = read_log(spark, f"{root}/corrections", T.StructType([records.schema[c] for c in ("implicated", "event_id")] + [
        T.StructField("batch_id", T.LongType())])).filter(F.col("batch_id") < batch_id)
    earlier = own.select(F.col("implicated").alias("rule_id"), "event_id").distinct()
    seen = corr.rule_incidents(read_log(spark, f"{root}/corrections/batch_id={batch_id}", records.schema))
    fresh = seen.dropDuplicates(["rule_id", "event_id"]).join(earlier, ["rule_id", "event_id"], "left_anti")
    before = read_snapshot(spark, f"{root}/health", RULE_HEALTH, before=batch_id)
    write_snapshot(rules.merge_health(before, rules.health_counters(fresh)), f"{root}/health", batch_id)


def stored_health(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Health of every blamed rule as `rules.rule_health` gives it, from the newest stored version."""
    return rules.health_report(read_snapshot(spark, f"{root}/health", RULE_HEALTH), known, rules.native_table(spark))


def consolidated_documents(before: DataFrame, merged: DataFrame, stored: DataFrame) -> DataFrame:
    """Similarity memory after a consolidation.

    Documents of all rules of the old list go; the rules of the new list are stored, merged ones under the correction type
    `merged`. `before` holds id; `merged` is what `consolidate_rules` returns; both lists share their ids' texts.
    """
    rest = vectors.delete_rules(stored, before.select(F.col("id").alias("rule_id")))
    origin = {"event_id": F.lit(None).cast("bigint"), "rationale": F.lit(None).cast("string"),
              "mistake": F.when(F.col("merged") > 1, "merged").otherwise("kept")}
    return vectors.upsert(rest, vectors.rule_documents(merged.withColumns(origin)))
