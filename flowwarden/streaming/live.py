"""Live scoring, decisions and playbook actions on Structured Streaming.

State lives in versioned tables on the shared file system and every micro-batch is handled set at a
time by the batch operators, so a hot signature or entity is spread over tasks as in a batch job. A
batch that runs again after a failure reads the version before it and rewrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from flowwarden.config import Policy
from flowwarden.models.forest import Forest
from flowwarden.operators.ordered import trailing_mean
from flowwarden.operators.playbooks import playbook_actions, steps_table
from flowwarden.plans.corrected import replay_corrected
from flowwarden.plans.decisions import replay
from flowwarden.schemas import LEDGER
from flowwarden.session import materialise
from flowwarden.sources.tables import append_batch, read_log, read_snapshot, write_snapshot


def unseen(batch: DataFrame, log: str, batch_id: int, key: str = "event_id") -> DataFrame:
    """Rows of a batch whose event no earlier batch has stored, each event once, however late it comes.

    Counting a re-delivery twice would count its evidence twice. Only the ids of the stored log are read. Rows without
    an id cannot be told from re-deliveries and are kept.
    """
    known = T.StructType([batch.schema[key], T.StructField("batch_id", T.LongType())])
    earlier = read_log(batch.sparkSession, log, known).filter(F.col("batch_id") < batch_id).select(key)
    once = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return once.join(earlier, key, "left_anti").select(*batch.columns).unionByName(batch.filter(F.col(key).isNull()))


def _start(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def live_decisions(stream: DataFrame, root: str, threshold: float, policy: Policy, once: bool = False,
                   label: str | None = None) -> StreamingQuery:
    """Decide every event against the ledger left by all earlier batches.

    Writes `decisions` and `actions` per batch and a new `ledger` version below `root`. A late event is decided in the batch
    that brings it. With `label`, wrong decisions are corrected before the next event is decided, as in
    `replay_corrected`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_snapshot(spark, f"{root}/ledger", LEDGER, before=batch_id)

        def store(decided: DataFrame) -> DataFrame:
            append_batch(decided, f"{root}/decisions", batch_id)
            return spark.read.parquet(f"{root}/decisions/batch_id={batch_id}")

        fresh = materialise(unseen(batch, f"{root}/decisions", batch_id))
        if label is None:
            done = replay(fresh, threshold, policy, before, store=store)
        else:
            done = replay_corrected(fresh, threshold, policy, label, before)
            store(done.decisions)
        append_batch(playbook_actions(done.decisions, steps_table(spark)), f"{root}/actions", batch_id)
        write_snapshot(done.ledger, f"{root}/ledger", batch_id)

    return _start(stream, handle, f"{root}/checkpoint", once)


def live_scores(stream: DataFrame, root: str, value: str, seq: str = "seq", keys: list[str] | None = None,
                window: int = 20, once: bool = False, forest: Forest | None = None) -> StreamingQuery:
    """Smoothed live scores: the mean of the last `window` values over all events or per key.

    Re-deliveries are known by `seq`. With a `forest`, `value` is first computed from the point column `x`. The buffer carried between
    batches is the last window - 1 values per key, found by a group limit.
    """
    keys = keys or []

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = unseen(batch, f"{root}/scores", batch_id, seq)
        scored = forest.anomaly_risk(own, row_id=seq, name=value) if forest is not None else own
        fresh = materialise(scored)
        shape = T.StructType([f for f in fresh.schema.fields if f.name in (*keys, seq, value)])
        carried = read_snapshot(spark, f"{root}/buffer", shape, before=batch_id)
        both = carried.withColumn("_old", F.lit(True)).unionByName(
            fresh.withColumn("_old", F.lit(False)), allowMissingColumns=True)
        smoothed = trailing_mean(both, value, seq, "smoothed", window, keys)
        append_batch(smoothed.filter(~F.col("_old")).drop("_old"), f"{root}/scores", batch_id)
        last = W.partitionBy(*keys).orderBy(F.col(seq).desc()) if keys else None
        slim = both.select(*shape.names)
        kept = (slim.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") < window).drop("_rn")
                if keys else slim.orderBy(F.col(seq).desc()).limit(window - 1))
        write_snapshot(kept, f"{root}/buffer", batch_id)

    return _start(stream, handle, f"{root}/checkpoint", once)
