"""Scans, label and role splits, scalers, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.catalog import inputs
from flowwarden.catalog.registry import query
from flowwarden.catalog.sqltext import sql
from flowwarden.config import NATIVE_RULES
from flowwarden.operators import features, ledger
from flowwarden.session import scratch_path
from flowwarden.sources import documents, flows

RAW_ATTACK = """CASE WHEN threat <> 'Normal' THEN threat WHEN k % 4 = 0 THEN 'NA' WHEN k % 4 = 1 THEN 'null'
                     WHEN k % 4 = 2 THEN 'nan' ELSE '' END"""
FLOW_SCHEMA = ("id bigint, proto string, service string, state string, spkts double, dpkts bigint, rate double, "
               "ct_state_ttl bigint, attack_cat string, label int")


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows as a CSV writer would hold them: texts, with several spellings of a missing value."""
    return inputs.flows(spark, sf_dir).select(
        F.col("event_id").alias("id"), "proto", "service", "state",
        F.expr("CASE WHEN k % 10 = 7 THEN 'N/A' ELSE cast(spkts as string) END").alias("spkts"),
        F.col("dpkts").cast("string").alias("dpkts"),
        F.expr("CASE WHEN k % 10 = 3 THEN 'NaN' ELSE cast(h as string) END").alias("rate"),
        F.expr("CASE WHEN k % 10 = 5 THEN 'None' ELSE cast(k % 7 as string) END").alias("ct_state_ttl"),
        F.expr(RAW_ATTACK).alias("attack_cat"), F.col("label").cast("string").alias("label"),
    )


def typed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows after the CSV round trip."""
    path = scratch_path(spark, "flows")
    raw_flows(spark, sf_dir).write.csv(path, header=True)
    return flows.read_flows(spark, path, FLOW_SCHEMA)


SQL_TYPED = """
typed AS (
  SELECT event_id AS id, proto, service, state,
    CASE WHEN k % 10 <> 7 THEN CAST(spkts AS DOUBLE) END AS spkts, dpkts,
    CASE WHEN k % 10 <> 3 THEN CAST(h AS DOUBLE) END AS rate,
    CASE WHEN k % 10 <> 5 THEN k % 7 END AS ct_state_ttl,
    CASE WHEN threat <> 'Normal' THEN threat END AS attack_cat, label FROM flows)"""


@query(sql("SELECT * FROM typed", "flows", extra=SQL_TYPED))
def scan_flows(spark, sf_dir):
    return typed_flows(spark, sf_dir)


@query(sql("""SELECT coalesce(attack_cat, 'Normal') AS attack_cat, label, count(*) AS n, sum(dpkts) AS dpkts
              FROM typed GROUP BY 1, 2""", "flows", extra=SQL_TYPED))
def label_split(spark, sf_dir):
    split = flows.split_labels(typed_flows(spark, sf_dir))
    return split.groupBy("attack_cat", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("dpkts").cast("decimal(38,0)").alias("dpkts"))


@query(sql("""SELECT id, label, attack_cat, coalesce(CAST(ct_state_ttl AS VARCHAR), 'unknown') AS ct_state_ttl, proto, service,
              state, coalesce(spkts, 0) AS spkts, CAST(dpkts AS DOUBLE) AS dpkts, coalesce(rate, 0) AS rate FROM typed""",
           "flows", extra=SQL_TYPED))
def cat_num_split(spark, sf_dir):
    return flows.feature_views(typed_flows(spark, sf_dir))


NUMERIC = ["spkts", "dpkts", "rate"]
SQL_NUM = SQL_TYPED + """,
num AS (SELECT id, label, coalesce(spkts, 0) AS spkts, CAST(dpkts AS DOUBLE) AS dpkts, coalesce(rate, 0) AS rate FROM typed)"""


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("id", *[F.round(c, 6).alias(c) for c in columns])


@query(sql("""SELECT id, round((spkts - avg(spkts) OVER ()) / stddev_pop(spkts) OVER (), 6) AS spkts,
              round((dpkts - avg(dpkts) OVER ()) / stddev_pop(dpkts) OVER (), 6) AS dpkts,
              round((rate - avg(rate) OVER ()) / stddev_pop(rate) OVER (), 6) AS rate FROM num""", "flows", extra=SQL_NUM))
def zscore(spark, sf_dir):
    frame = flows.feature_views(typed_flows(spark, sf_dir))
    return _rounded(features.fit_standard(frame, NUMERIC).transform(frame), NUMERIC)


_QUARTILES = ", ".join(f"quantile_cont({c}, {q}) AS {c}{q[2:]}" for c in NUMERIC for q in ("0.25", "0.5", "0.75"))


@query(sql("SELECT id, " + ", ".join(
    f"round(({c} - (SELECT {c}5 FROM quart)) / (SELECT CASE WHEN {c}75 = {c}25 THEN 1 ELSE {c}75 - {c}25 END FROM quart), 6) AS {c}"
    for c in NUMERIC) + " FROM num", "flows",
    extra=SQL_NUM + f", quart AS (SELECT {_QUARTILES} FROM num WHERE label = 1)"))
def robust_scale(spark, sf_dir):
    frame = flows.feature_views(typed_flows(spark, sf_dir))
    scaler = features.fit_robust(frame, NUMERIC, F.col("label") == 1)
    return _rounded(scaler.transform(frame), NUMERIC)


@query()
def pca_view(spark, sf_dir):
    frame = flows.feature_views(typed_flows(spark, sf_dir))
    scaled = features.fit_standard(frame, NUMERIC).transform(frame)
    return features.project_pca(scaled, features.fit_pca(scaled, NUMERIC)).select("id", F.col("pc").cast("string").alias("pc"))


@query(sql("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, round(cat_risk, 3) AS categorical_risk,
              round(anomaly_risk, 3) AS anomaly_risk, round(fused_risk, 3) AS fused_risk,
              round(incident_entropy, 4) AS incident_entropy, threat, proto, service, state, spkts, dpkts, dstip
              FROM flows""", "flows"))
def context(spark, sf_dir):
    nested = flows.construct_context(inputs.flows(spark, sf_dir), ["proto", "service", "state", "spkts", "dpkts", "dstip"])
    return nested.select("event_id", F.col("timestamp").alias("stamp"), "ml_risk_profile.*",
                         F.col("predicted_threat_classification").alias("threat"), "network_telemetry.*")


@query(sql("""SELECT event_id, label, fused_risk, cat_risk, anomaly_risk, incident_entropy, threat, signature FROM ctx""", "ctx"))
def scored_events(spark, sf_dir):
    path = scratch_path(spark, "scored")
    flows.write_scored(inputs.contexts(spark, sf_dir), path)
    return flows.read_scored(spark, path).select(
        "event_id", "label", "fused_risk", "cat_risk", "anomaly_risk", "incident_entropy", "threat", "signature")


SLIM = """'{"fused_risk":' || CAST(fused_risk AS VARCHAR) || ',"cat_risk":' || CAST(cat_risk AS VARCHAR) || ',"threat_class":"' || threat
    || '","proto":"' || proto || '","service":' || '"' || service || '"' || ',"state":"' || state
    || '","spkts":' || spkts || ',"dpkts":' || dpkts || ',"fused_risk_severity":"'
    || CASE rb WHEN 'R1' THEN 'LOW' WHEN 'R2' THEN 'MEDIUM' WHEN 'R3' THEN 'HIGH' ELSE 'CRITICAL' END || '","anomaly_severity":"'
    || CASE ab WHEN 'A1' THEN 'LOW' WHEN 'A2' THEN 'MEDIUM' ELSE 'HIGH' END || '","traffic_volume":"'
    || CASE vb WHEN 'V1' THEN 'LOW' WHEN 'V2' THEN 'MEDIUM' ELSE 'HIGH' END || '","classification_certainty":"'
    || CASE eb WHEN 'E1' THEN 'HIGH (certain)' WHEN 'E2' THEN 'MEDIUM' ELSE 'LOW (uncertain)' END || '"}'"""
_SLIM_NULLED = SLIM.replace("'\"' || service || '\"'", "CASE WHEN service = '-' THEN 'null' ELSE '\"' || service || '\"' END")


@query(sql(f"SELECT event_id, {_SLIM_NULLED} AS slim FROM ctx", "ctx"))
def slim_context(spark, sf_dir):
    c = inputs.contexts(spark, sf_dir).withColumn("service", F.nullif("service", F.lit("-")))
    return c.select("event_id", flows.slim_context(c).alias("slim"))


@query(sql("""SELECT threat, CAST(CASE threat WHEN 'Normal' THEN 0.0 WHEN 'Exploits' THEN 0.3 WHEN 'DoS' THEN 0.15
              WHEN 'Analysis' THEN 0.15 WHEN 'Shellcode' THEN 0.45 ELSE 0.4 END AS DOUBLE) AS penalty, count(*) AS events
              FROM flows GROUP BY 1""", "flows"))
def policy_table(spark, sf_dir):
    penalties = documents.policy_table(spark, inputs.POLICY)
    events = inputs.flows(spark, sf_dir).groupBy("threat").agg(F.count(F.lit(1)).alias("events"))
    return events.join(F.broadcast(penalties), "threat", "left").select(
        "threat", F.coalesce("penalty", F.lit(inputs.POLICY.unlisted_penalty())).alias("penalty"), "events")


@query(sql("""SELECT user_id, CAST(0 AS INTEGER) AS ord, 'native' AS kind, '3. rule for user ' || user_id AS text,
                CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS condition, CAST(NULL AS VARCHAR) AS playbook, CAST(NULL AS BOOLEAN) AS is_fp
              FROM (SELECT DISTINCT user_id FROM flows)
              UNION ALL SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY condition) AS INTEGER), 'learned', NULL,
                'LEARNED_' || user_id, condition, 'ALLOW', true
              FROM (SELECT DISTINCT user_id, 'proto=' || proto || ' AND service=' || service AS condition FROM flows)""", "flows"))
def rules_table(spark, sf_dir):
    rule = F.to_json(F.struct(
        F.concat(F.lit("LEARNED_"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("proto="), "proto", F.lit(" AND service="), "service").alias("condition"),
        F.lit("ALLOW").alias("playbook"), F.lit(True).alias("is_fp")))
    native = F.to_json(F.array(F.concat(F.lit("3. rule for user "), F.col("user_id").cast("string"))))
    docs = inputs.flows(spark, sf_dir).select("user_id", rule.alias("r"), native.alias("n")).distinct().groupBy("user_id", "n").agg(
        F.array_join(F.array_sort(F.collect_list("r")), ",").alias("rs")
    ).select("user_id", F.concat(F.lit('{"routing_rules": '), F.expr("left(n, length(n) - 1)"), F.lit(","), "rs", F.lit("]}")).alias("document"))
    return documents.rules_of(docs, ["user_id"]).select("user_id", "ord", "kind", "text", "id", "condition", "playbook", "is_fp")


@query(sql("""SELECT signature, round(confirmed_normal, 6) AS confirmed_normal, round(confirmed_attack, 6) AS confirmed_attack,
              round(trust_bias, 6) AS trust_bias, status FROM ledger""", "ledger"))
def ledger_snapshot(spark, sf_dir):
    built = ledger.build_ledger(inputs.truth_evidence(spark, sf_dir), inputs.POLICY)
    docs = built.select(F.to_json(F.struct(F.create_map("signature", F.struct(
        "confirmed_normal", "confirmed_attack", "trust_bias", "status")).alias("signatures"))).alias("document"))
    path = scratch_path(spark, "memory")
    docs.write.text(path)
    loaded = documents.ledger_of(spark.read.text(path).select(F.col("value").alias("document")))
    return loaded.select("signature", *[F.round(c, 6).alias(c) for c in ("confirmed_normal", "confirmed_attack", "trust_bias")], "status")


@query(sql("""SELECT thr, CAST(ord AS INTEGER) AS ord, replace(replace(text, '{mfa_trigger}', mfa), '{isolation_trigger}', iso) AS text FROM cuts, (VALUES """
           + ", ".join("(%d, '%s')" % (i + 1, t.replace("'", "''")) for i, t in enumerate(NATIVE_RULES)) + """) AS r(ord, text)""", "flows",
           extra="""cuts AS (SELECT thr, printf('%.4f', thr) AS mfa, printf('%.4f', least(thr + 0.15, 0.90)) AS iso
                    FROM (SELECT DISTINCT fused_risk AS thr FROM flows WHERE label = 1))"""))
def rendered_rules(spark, sf_dir):
    from flowwarden.functions.text import rendered_rule
    cuts = inputs.flows(spark, sf_dir).filter("label = 1").select(F.col("fused_risk").alias("thr")).distinct()
    texts = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(t).alias("text")) for i, t in enumerate(NATIVE_RULES)])
    return cuts.select("thr", F.explode(texts).alias("r")).select(
        "thr", "r.ord", rendered_rule(F.col("r.text"), F.col("thr")).alias("text"))
