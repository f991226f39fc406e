"""Playbook steps as a table and the action log of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.config import PLAYBOOKS
from flowwarden.operators.decide import UNNAMED

ACTION_COLUMNS = ("event_id", "playbook", "step", "tool", "action", "args", "error")


def steps_table(spark: SparkSession, playbooks: dict | None = None) -> DataFrame:
    """One row per playbook with its ordered steps; the set of playbooks is configuration."""
    rows = [
        (name, [(i + 1, s["tool"], s["action"], {k: str(v) for k, v in s.items() if k not in ("tool", "action")})
                for i, s in enumerate(steps)])
        for name, steps in (PLAYBOOKS if playbooks is None else playbooks).items()
    ]
    return spark.createDataFrame(
        rows, "playbook string, steps array<struct<step int, tool string, action string, args map<string,string>>>"
    )


def playbook_actions(decisions: DataFrame, steps: DataFrame) -> DataFrame:
    """Explode each executed decision into its steps; an unknown playbook leaves one error row.

    Gated events run nothing; a decision without a playbook is executed as isolation. `steps` is configuration (a handful of rows), hence the broadcast.
    """
    run = decisions.filter(F.col("branch") != "gate").select("event_id", F.coalesce("playbook", F.lit(UNNAMED)).alias("playbook"))
    joined = run.join(F.broadcast(steps), "playbook", "left")
    known = F.col("steps").isNotNull()
    return joined.select(
        "event_id", "playbook", known.alias("known"), F.explode_outer("steps").alias("s")
    ).select(
        "event_id", "playbook",
        F.col("s.step").alias("step"), F.col("s.tool").alias("tool"), F.col("s.action").alias("action"),
        F.col("s.args").alias("args"),
        F.when(~F.col("known"), F.concat(F.lit("playbook '"), F.col("playbook"), F.lit("' not found"))).alias("error"),
    )
