"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "flowwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; keyword names use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a local one when unset in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flowwarden-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever it was imported from; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="flowwarden-zip-")) / root.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))
        _SHIPPED.add(app)


def rows_within(df: DataFrame, bound: int) -> bool:
    """True when `df` has at most `bound` rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def broadcast_within(df: DataFrame, bound: int) -> DataFrame:
    """Hint a broadcast only when the row bound has been checked; otherwise leave it to the planner."""
    return F.broadcast(df) if rows_within(df, bound) else df
