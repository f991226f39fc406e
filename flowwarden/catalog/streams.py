"""Streaming queries: the tables arrive as files and the streams run until all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden.catalog import inputs
from flowwarden.catalog.policy import MENDED, REPLAY
from flowwarden.catalog.registry import query
from flowwarden.catalog.sqltext import sql
from flowwarden.models import forest as forests
from flowwarden.session import scratch_path
from flowwarden.streaming import live

ARRIVALS = 3


def arrive(spark, df, start):
    """Write `df` as ARRIVALS batches of files in arrival order; after each one the stream goes on from its checkpoint until all
    files are read, which is one micro-batch for all files of an arrival, however many tasks wrote them.

    Some rows come twice in one batch and again in the next ones. `start` makes a started query of the stream.
    """
    path = scratch_path(spark, "arrivals")
    top = df.agg(F.max("seq").alias("m")).first().m + 1
    for i in range(ARRIVALS):
        low, high = i * top // ARRIVALS, (i + 1) * top // ARRIVALS
        part = df.filter((F.col("seq") >= low) & (F.col("seq") < high))
        again = df.filter((F.col("seq") < high) & (F.col("seq") % 10 == 0))
        part.unionByName(again).write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query(sql("SELECT event_id, signature, playbook, score AS trust_score FROM loop WHERE rn > 0", "routed", extra=REPLAY))
def live_decisions(spark, sf_dir):
    root = scratch_path(spark, "live")
    arrive(spark, inputs.contexts(spark, sf_dir), lambda s: live.live_decisions(s, root, inputs.LOW, inputs.POLICY, once=True))
    return spark.read.parquet(f"{root}/decisions").filter("branch <> 'gate'").select(
        "event_id", "signature", "playbook", "trust_score")


@query(sql("""SELECT playbook, CAST(n AS INTEGER) AS steps, count(*) AS events FROM loop l JOIN (VALUES ('ALLOW', 2), ('STEP_UP_AUTH', 3),
              ('NETWORK_ISOLATION', 5), ('RATE_LIMIT_DOS', 3)) AS s(name, n) ON s.name = l.playbook WHERE rn > 0 GROUP BY 1, 2""", "routed", extra=REPLAY))
def playbook_sink(spark, sf_dir):
    root = scratch_path(spark, "sink")
    arrive(spark, inputs.contexts(spark, sf_dir), lambda s: live.live_decisions(s, root, inputs.LOW, inputs.POLICY, once=True))
    per_event = spark.read.parquet(f"{root}/actions").groupBy("event_id", "playbook").agg(F.count(F.lit(1)).cast("int").alias("steps"))
    return per_event.groupBy("playbook", "steps").agg(F.count(F.lit(1)).alias("events"))


@query(sql("""SELECT event_id, round(avg(anomaly_risk) OVER (PARTITION BY service ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smoothed
              FROM flows""", "flows"))
def live_scores(spark, sf_dir):
    root = scratch_path(spark, "scores")
    rows = inputs.contexts(spark, sf_dir).select("event_id", "seq", "ts", "service", "anomaly_risk")
    arrive(spark, rows, lambda s: live.live_scores(s, root, "anomaly_risk", keys=["service"], once=True))
    return spark.read.parquet(f"{root}/scores").select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(sql("SELECT event_id, signature, playbook, score AS trust_score FROM mended WHERE rn > 0 AND thr < 0.6", "routed", extra=MENDED))
def live_corrected(spark, sf_dir):
    root = scratch_path(spark, "mended")
    arrive(spark, inputs.contexts(spark, sf_dir), lambda s: live.live_decisions(s, root, inputs.LOW, inputs.POLICY, once=True, label="label"))
    return spark.read.parquet(f"{root}/decisions").filter("branch <> 'gate'").select(
        "event_id", "signature", "playbook", "trust_score")


@query()
def live_forest_scores(spark, sf_dir):
    """Raw points stream in, a forest fitted on attacks scores them, and the last twenty scores of all are averaged."""
    from flowwarden.catalog.learning import points
    p = points(spark, sf_dir)
    grown, root = forests.fit_forest(p.filter("label = 1")), scratch_path(spark, "forest")
    arrive(spark, p.select("event_id", "seq", "x"), lambda s: live.live_scores(s, root, "anomaly_risk", once=True, forest=grown))
    return spark.read.parquet(f"{root}/scores").select(
        "event_id", F.round("anomaly_risk", 6).alias("anomaly_risk"), F.round("smoothed", 6).alias("smoothed"))
