"""Flow, evidence, rule and response tables derived from the test tables.

Integer arithmetic wherever possible, so that Spark and the SQL oracle derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.config import Policy
from flowwarden.functions.cases import cases
from flowwarden.operators.decide import decide
from flowwarden.operators.trust import with_trust
from flowwarden.session import scratch_path
from flowwarden.sources.flows import read_scored, with_context_columns, write_scored

LOW, HIGH = 0.5, 0.7889
OFFICE = Policy.of({"business_hours": {"start": 8, "end": 20}})
POLICY = Policy.of()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flow rows; `seq`, the arrival number, is the event id."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.expr("(event_id * 7919 + user_id * 104729) % 1000003").alias("h"),
        F.expr("user_id % 12").alias("g"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    g, k = F.col("g"), F.col("k")
    return events.select(
        "event_id", F.col("event_id").alias("seq"), "ts", "user_id", "h", "g", "k",
        F.when(g < 7, "tcp").when(g < 10, "udp").when(g == 10, "unas").otherwise("icmp").alias("proto"),
        F.when(F.col("event_type") == "click", "http").when(F.col("event_type") == "purchase", "dns")
        .when(F.col("event_type") == "signup", "smtp").otherwise("-").alias("service"),
        F.when(g < 7, "FIN").otherwise("INT").alias("state"),
        F.when(k < 3, 4998 + 2 * k).when(k < 10, 100 + k).otherwise(k).alias("spkts"),
        F.when(g >= 7, 0).otherwise(k % 20).cast("long").alias("dpkts"),
        F.expr("""CASE k % 5 WHEN 0 THEN concat('10.0.0.', k) WHEN 1 THEN concat('10.1.2.', k)
                  WHEN 2 THEN concat('172.16.0.', k) WHEN 3 THEN concat('192.168.1.', k)
                  ELSE '8.8.8.8' END""").alias("dstip"),
        F.expr("""CASE WHEN g IN (0, 1, 7) THEN 'Normal' WHEN g = 2 THEN 'Exploits' WHEN g = 3 THEN 'Fuzzers'
                  WHEN g IN (4, 10) THEN 'DoS' WHEN g = 5 THEN 'Reconnaissance' WHEN g = 6 THEN 'Analysis'
                  WHEN g = 8 THEN 'Generic' WHEN g = 9 THEN 'Shellcode' ELSE 'Unlisted' END""").alias("threat"),
        F.expr("CASE WHEN h % 1001 + 4 * k >= 800 THEN 1 ELSE 0 END").alias("label"),
        F.expr("cast(least(1000, ((h % 1001) * 3) div 5 + 4 * k) as double) / 1000D").alias("fused_risk"),
        F.expr("cast((h div 7) % 1001 as double) / 1000D").alias("cat_risk"),
        F.expr("cast(g * 90 as double) / 1000D").alias("anomaly_risk"),
        F.expr("cast(g % 3 as double) * 0.75D").alias("incident_entropy"),
    )


_STORED: dict[tuple[str, str], str] = {}


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored-event table: derived once per application, stored, and read back by later stages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "contexts")
        scored = with_context_columns(flows(spark, sf_dir))
        write_scored(scored.repartition(spark.sparkContext.defaultParallelism), path)
        _STORED[key] = path
    return read_scored(spark, _STORED[key])


def decisions(spark: SparkSession, sf_dir: str, threshold: float, policy: Policy = POLICY,
              detail: bool = False) -> DataFrame:
    """Decisions with an empty ledger."""
    return decide(with_trust(contexts(spark, sf_dir), policy, detail=detail), threshold)


def truth_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence log with the label as verdict."""
    return contexts(spark, sf_dir).select(
        "signature", "seq",
        F.when(F.col("label") == 1, "attack").otherwise("normal").alias("verdict"),
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("fused_risk"))).alias("confidence"),
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten integer weights per event over their sum, with the class names in sorted order."""
    # Class names in sorted order, and one divisor per class.
    classes = ["Analysis", "Backdoor", "DoS", "Exploits", "Fuzzers", "Generic", "Normal",
               "Reconnaissance", "Shellcode", "Worms"]
    divisors = [3, 5, 7, 11, 13, 17, 19, 23, 29, 31]
    weights = F.array(*[F.expr(f"cast(1 + (h div {p}) % 97 as double)") for p in divisors])
    whole = F.aggregate("w", F.lit(0.0), lambda acc, w: acc + w)
    return flows(spark, sf_dir).select("event_id", "label", "threat", weights.alias("w")).select(
        "event_id", "label", "threat",
        F.transform("w", lambda w: w / whole).alias("probability"),
        F.array(*[F.lit(c) for c in classes]).alias("classes"),
    )


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate rule per event, of five shapes; later ones repeat or refine earlier ones."""
    f = flows(spark, sf_dir)
    clause = {n: F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in
              [("proto", "proto"), ("service", "service"), ("state", "state"),
               ("threat_class", "threat"), ("spkts", "spkts")]}
    shapes = [("proto", "state"), ("proto", "service", "state"), ("proto", "state", "threat_class"),
              ("proto", "service", "state", "threat_class"), ("proto", "state", "spkts")]
    condition = cases(
        (F.col("event_id") % 5 == i, F.concat_ws(" AND ", *[clause[n] for n in names]))
        for i, names in enumerate(shapes)
    )
    attack = F.col("label") == 1
    return f.select(
        "event_id", "seq", "user_id", "ts", condition.alias("condition"),
        F.when(attack, "NETWORK_ISOLATION").otherwise("ALLOW").alias("playbook"),
    )
