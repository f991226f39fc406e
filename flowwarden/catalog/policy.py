"""Buckets, signatures, trust, decisions, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden.catalog import inputs
from flowwarden.catalog.registry import query
from flowwarden.catalog.sqltext import fixed, sql
from flowwarden.functions import signature as sig
from flowwarden.functions.text import context_text, evidence_summary as summary_text, rule_text as rule_line, stable_id as stable
from flowwarden.operators import decide, ledger, playbooks, trust


@query(sql("SELECT event_id, rb AS risk, ab AS anomaly, vb AS volume, eb AS entropy FROM buckets", "ctx"))
def buckets(spark, sf_dir):
    return inputs.flows(spark, sf_dir).select(
        "event_id", sig.risk_bucket(F.col("fused_risk")).alias("risk"), sig.anomaly_bucket(F.col("anomaly_risk")).alias("anomaly"),
        sig.volume_bucket(F.col("spkts")).alias("volume"), sig.entropy_bucket(F.col("incident_entropy")).alias("entropy"))


@query(sql("SELECT event_id, signature FROM ctx", "ctx"))
def signature(spark, sf_dir):
    return inputs.contexts(spark, sf_dir).select("event_id", "signature")


@query(sql("""SELECT event_id, CASE WHEN k % 3 = 0 THEN concat_ws('_', proto, CASE WHEN service = '-' THEN 'unknown' ELSE service END, state, threat, 'R0', 'A0', 'V0', 'E0')
              ELSE concat_ws('_', proto, CASE WHEN service = '-' THEN 'unknown' ELSE service END, state, threat, rb, ab, vb, eb) END AS signature FROM ctx""", "ctx"))
def signature_fallback(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    service = F.nullif("service", F.lit("-"))
    return f.select("event_id", sig.fallback_signature(
        F.col("proto"), service, F.col("state"), F.col("threat"), F.col("k") % 3 != 0, F.col("fused_risk"),
        F.col("anomaly_risk"), F.col("spkts"), F.col("incident_entropy")).alias("signature"))


@query(sql("""SELECT event_id,
  CASE rb WHEN 'R1' THEN 'LOW' WHEN 'R2' THEN 'MEDIUM' WHEN 'R3' THEN 'HIGH' ELSE 'CRITICAL' END AS risk,
  CASE ab WHEN 'A1' THEN 'LOW' WHEN 'A2' THEN 'MEDIUM' ELSE 'HIGH' END AS anomaly,
  CASE WHEN spkts + 0.5 < 100 THEN 'LOW' WHEN spkts + 0.5 < 5000 THEN 'MEDIUM' ELSE 'HIGH' END AS volume,
  CASE eb WHEN 'E1' THEN 'HIGH (certain)' WHEN 'E2' THEN 'MEDIUM' ELSE 'LOW (uncertain)' END AS certainty FROM ctx""", "ctx"))
def severity_labels(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    return f.select(
        "event_id", sig.risk_severity(F.col("fused_risk")).alias("risk"), sig.anomaly_severity(F.col("anomaly_risk")).alias("anomaly"),
        sig.traffic_volume(F.col("spkts") + F.lit(0.5)).alias("volume"),
        sig.classification_certainty(F.col("incident_entropy")).alias("certainty"))


EVENT_TEXT = ("'threat=' || threat || ' fused_risk=' || CAST(fused_risk AS VARCHAR) || ' cat_risk=' || CAST(cat_risk AS VARCHAR) || "
         "' anomaly_risk=' || CAST(anomaly_risk AS VARCHAR) || ' proto=' || proto || ' service=' || coalesce(nullif(service, '-'), '?') || "
         "' state=' || state || ' spkts=' || spkts || ' dpkts=' || dpkts")


def _text():
    return context_text(F.col("threat"), F.col("fused_risk"), F.col("cat_risk"), F.col("anomaly_risk"), F.col("proto"),
                        F.nullif("service", F.lit("-")), F.col("state"), F.col("spkts"), F.col("dpkts"))


@query(sql(f"SELECT event_id, {EVENT_TEXT} AS text FROM flows", "flows"), name="context_text")
def context_text_query(spark, sf_dir):
    return inputs.flows(spark, sf_dir).select("event_id", _text().alias("text"))


@query(sql(f"""SELECT event_id, 'inc_' || substr(md5('inc|' || event_id || '|' || substr({EVENT_TEXT}, 1, 40)), 1, 12) AS doc_id,
               'rule_' || substr(md5('rule|LEARNED_' || k), 1, 12) AS rule_doc FROM flows""", "flows"))
def stable_id(spark, sf_dir):
    return inputs.flows(spark, sf_dir).select(
        "event_id", stable("inc", F.col("event_id"), F.substring(_text(), 1, 40)).alias("doc_id"),
        stable("rule", F.concat(F.lit("LEARNED_"), F.col("k").cast("string"))).alias("rule_doc"))


@query(sql("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN condition ELSE 'Rule R' || event_id || ': IF ' || condition || ' THEN ' || playbook
              || '. Rationale: ' || CASE WHEN event_id % 3 = 1 THEN 'n/a' ELSE 'seen at ' || seq END END AS text FROM candidates""", "candidates"))
def rule_text(spark, sf_dir):
    c = inputs.rule_candidates(spark, sf_dir)
    kind = F.col("event_id") % 3
    return c.select("event_id", rule_line(
        F.concat(F.lit("R"), F.col("event_id").cast("string")), F.col("condition"), F.col("playbook"),
        F.when(kind == 2, F.concat(F.lit("seen at "), F.col("seq").cast("string"))),
        native=F.when(kind == 0, F.col("condition"))).alias("text"))


@query(sql("SELECT thr, event_id, fused_risk > thr AS escalated FROM routed", "routed"))
def gate(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    return f.select("event_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("thr"), decide.gated(F.col("fused_risk"), t).alias("escalated")) for t in (inputs.LOW, inputs.HIGH)
    ])).alias("x")).select("x.thr", "event_id", "x.escalated")


@query(sql("SELECT event_id, tier, mult FROM priced", "priced"))
def asset_tier(spark, sf_dir):
    return inputs.flows(spark, sf_dir).select(
        "event_id", trust.asset_tier(F.col("dstip"), inputs.POLICY).alias("tier"),
        trust.asset_multiplier(F.col("dstip"), inputs.POLICY).alias("mult"))


@query(sql("SELECT event_id, proto || '_' || service AS combo FROM priced WHERE off_list", "priced"))
def unapproved(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    p, s = F.upper("proto"), F.col("service")
    return f.filter(trust.unapproved(p, s, inputs.POLICY)).select("event_id", trust.combo(p, s).alias("combo"))


@query(sql("SELECT event_id, hour(ts) AS hour, hour(ts) < 8 OR hour(ts) >= 20 AS late FROM flows", "flows"))
def after_hours(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    hour = trust.written_hour(stamp)
    return inputs.flows(spark, sf_dir).select(
        "event_id", hour.cast("long").alias("hour"), trust.after_hours(hour, inputs.OFFICE).alias("late"))


_LATE = "(hour(ts) < 8 OR hour(ts) >= 20)"


@query(sql(f"""
SELECT event_id, name, round(delta, 6) AS delta FROM (
  SELECT event_id, 'ml_fused_risk' AS name, -(fused_risk * 0.3 * mult) AS delta FROM priced
  UNION ALL SELECT event_id, 'threat_classification', -threat_pen FROM priced WHERE threat_pen > 0
  UNION ALL SELECT event_id, 'unapproved_proto_service', -0.1 FROM priced WHERE off_list
  UNION ALL SELECT event_id, 'after_hours_access', -0.1 FROM priced WHERE {_LATE}
  UNION ALL SELECT event_id, 'high_volume_anomaly', -0.1 FROM priced WHERE loud
  UNION ALL SELECT event_id, 'high_categorical_risk', -0.1 FROM priced WHERE spiked)""", "priced"))
def trust_factors(spark, sf_dir):
    t = trust.with_trust(inputs.contexts(spark, sf_dir), inputs.OFFICE)
    return t.select("event_id", F.explode("factors").alias("f")).select("event_id", "f.name", F.round("f.delta", 6).alias("delta"))


@query(sql("SELECT event_id, trust_score, trust_score >= 0.4 AS is_acceptable FROM scored", "scored"))
def trust_score(spark, sf_dir):
    return trust.with_trust(inputs.contexts(spark, sf_dir), inputs.POLICY, detail=False).select("event_id", "trust_score", "is_acceptable")


@query(sql(f"""SELECT event_id, array_to_string(list_filter([
    CASE WHEN threat_pen >= 0.35 THEN 'HIGH_SEVERITY_THREAT: ' || threat || ' exceeds critical threshold' END,
    CASE WHEN off_list THEN 'UNAPPROVED_COMBO: ' || proto || '_' || service END,
    CASE WHEN {_LATE} THEN 'AFTER_HOURS_ACCESS: event at ' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':xx local time' END,
    CASE WHEN loud THEN 'HIGH_VOLUME: spkts=' || spkts END], lambda v: v IS NOT NULL), '; ') AS violations FROM priced""", "priced"))
def violations(spark, sf_dir):
    t = trust.with_trust(inputs.contexts(spark, sf_dir), inputs.OFFICE)
    return t.select("event_id", F.array_join("violations", "; ").alias("violations"))


@query(sql("""SELECT thr, event_id, CAST(native_rule AS INTEGER) AS rule,
    CASE native_rule WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'ALLOW' WHEN 3 THEN 'RATE_LIMIT_DOS' WHEN 4 THEN 'ALLOW'
      WHEN 5 THEN 'NETWORK_ISOLATION' WHEN 6 THEN 'NETWORK_ISOLATION' ELSE 'STEP_UP_AUTH' END AS playbook,
    native_rule IN (1, 4) AS is_false_positive FROM routed""", "routed"))
def native_route(spark, sf_dir):
    f = inputs.flows(spark, sf_dir)
    return f.select("event_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("thr"), decide.native_route(t).alias("r")) for t in (inputs.LOW, inputs.HIGH)
    ])).alias("x")).select("x.thr", "event_id", "x.r.*")


def both_thresholds(spark, sf_dir, *columns):
    parts = [inputs.decisions(spark, sf_dir, t).select(F.lit(t).alias("thr"), *columns) for t in (inputs.LOW, inputs.HIGH)]
    return parts[0].unionByName(parts[1])


@query(sql("""SELECT thr, event_id, signature, branch, playbook, CAST(CASE WHEN branch = 'responder' THEN native_rule END AS INTEGER) AS rule,
              is_false_positive, trust_score FROM decided""", "decided"))
def decisions(spark, sf_dir):
    return both_thresholds(spark, sf_dir, "event_id", "signature", "branch", "playbook", "rule", "is_false_positive", "trust_score")


@query(sql("""SELECT thr, playbook, count(*) AS events, count(*) FILTER (WHERE is_false_positive) AS fp_overrides FROM decided GROUP BY 1, 2""", "decided"))
def playbook_counts(spark, sf_dir):
    from flowwarden.operators.evaluation import playbook_counts as counts
    parts = [counts(inputs.decisions(spark, sf_dir, t)).withColumn("thr", F.lit(t)) for t in (inputs.LOW, inputs.HIGH)]
    return parts[0].unionByName(parts[1])


_FEEDBACK = """SELECT thr, event_id, signature, verdict, round(CASE verdict WHEN 'normal' THEN greatest(0.1, least(1.0, 1.0 - abs(fused_risk - thr) * 2.0))
    ELSE greatest(0.1, least(1.0, fused_risk)) END, 6) AS confidence FROM (
  SELECT *, CASE WHEN playbook = 'ALLOW' AND is_false_positive THEN 'normal'
    WHEN playbook IN ('NETWORK_ISOLATION', 'RATE_LIMIT_DOS') THEN 'attack' END AS verdict FROM {source} WHERE branch <> 'gate')
  WHERE verdict IS NOT NULL"""


@query(sql(_FEEDBACK.format(source="decided"), "decided"))
def feedback(spark, sf_dir):
    parts = [decide.feedback(inputs.decisions(spark, sf_dir, t), t).withColumn("thr", F.lit(t)) for t in (inputs.LOW, inputs.HIGH)]
    return parts[0].unionByName(parts[1]).select("thr", "event_id", "signature", "verdict", F.round("confidence", 6).alias("confidence"))


@query(sql("""SELECT thr, event_id, playbook, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS mistake FROM decided
              WHERE (label = 0 AND playbook IN ('NETWORK_ISOLATION', 'STEP_UP_AUTH', 'RATE_LIMIT_DOS')) OR (label = 1 AND playbook = 'ALLOW')""", "decided"))
def misdecisions(spark, sf_dir):
    parts = [decide.misdecisions(inputs.decisions(spark, sf_dir, t)).withColumn("thr", F.lit(t)) for t in (inputs.LOW, inputs.HIGH)]
    return parts[0].unionByName(parts[1]).select("thr", "event_id", "playbook", "mistake")


@query(sql("""SELECT event_id, playbook, CAST(step AS INTEGER) AS step, tool, action, error FROM (
  SELECT event_id, CASE WHEN k % 17 = 0 THEN 'QUARANTINE_VLAN' ELSE playbook END AS playbook FROM decided WHERE thr < 0.6 AND branch <> 'gate') d
  LEFT JOIN (VALUES ('ALLOW', 1, 'Splunk_SIEM', 'ingest_telemetry'), ('ALLOW', 2, 'Metrics_Dashboard', 'increment_fp_counter'),
    ('LOG_ONLY', 1, 'Splunk_SIEM', 'ingest_telemetry'), ('STEP_UP_AUTH', 1, 'Okta_IAM', 'trigger_push_mfa'),
    ('STEP_UP_AUTH', 2, 'Splunk_SIEM', 'create_notable_event'), ('STEP_UP_AUTH', 3, 'Jira_ServiceDesk', 'open_ticket'),
    ('NETWORK_ISOLATION', 1, 'VirusTotal_API', 'query_ip_reputation'), ('NETWORK_ISOLATION', 2, 'Palo_Alto_Firewall', 'block_src_ip'),
    ('NETWORK_ISOLATION', 3, 'CrowdStrike_EDR', 'isolate_host_network'), ('NETWORK_ISOLATION', 4, 'Active_Directory', 'revoke_session_tokens'),
    ('NETWORK_ISOLATION', 5, 'PagerDuty', 'page_on_call_engineer'), ('RATE_LIMIT_DOS', 1, 'Cloudflare_WAF', 'enable_under_attack_mode'),
    ('RATE_LIMIT_DOS', 2, 'F5_Load_Balancer', 'throttle_source_ip'), ('RATE_LIMIT_DOS', 3, 'Splunk_SIEM', 'create_notable_event'))
    AS s(name, step, tool, action) ON s.name = d.playbook,
  LATERAL (SELECT CASE WHEN s.step IS NULL THEN 'playbook ''' || d.playbook || ''' not found' END AS error)""", "decided"))
def playbook_actions(spark, sf_dir):
    d = inputs.decisions(spark, sf_dir, inputs.LOW).withColumn(
        "playbook", F.when(F.col("k") % 17 == 0, "QUARANTINE_VLAN").otherwise(F.col("playbook")))
    return playbooks.playbook_actions(d, playbooks.steps_table(spark)).drop("args")


# ---- ledger -----------------------------------------------------------------------------------

@query(sql("""SELECT signature, round(confirmed_normal, 6) AS confirmed_normal, round(confirmed_attack, 6) AS confirmed_attack, status, last_seq
              FROM ledger""", "ledger"))
def ledger_status(spark, sf_dir):
    e = inputs.truth_evidence(spark, sf_dir)
    ends = ledger._after_last(ledger.crossings(e)).select("signature", "status")
    return ledger.ledger_counters(e).join(ends, "signature").select(
        "signature", F.round("confirmed_normal", 6).alias("confirmed_normal"), F.round("confirmed_attack", 6).alias("confirmed_attack"),
        "status", "last_seq")


@query(sql("""SELECT signature, seq, round(n, 6) AS confirmed_normal, round(a, 6) AS confirmed_attack, status FROM fold WHERE rn > 0""", "ledger"))
def ledger_history(spark, sf_dir):
    return ledger.ledger_history(inputs.truth_evidence(spark, sf_dir), width=1024).select(
        "signature", "seq", F.round("confirmed_normal", 6).alias("confirmed_normal"), F.round("confirmed_attack", 6).alias("confirmed_attack"), "status")


@query(sql("SELECT signature, round(trust_bias, 6) AS trust_bias, status FROM ledger", "ledger"))
def ledger_bias(spark, sf_dir):
    built = ledger.build_ledger(inputs.truth_evidence(spark, sf_dir), inputs.POLICY)
    return built.select("signature", F.round("trust_bias", 6).alias("trust_bias"), "status")


SUMMARY = ("'Historical evidence for this behavior signature:' || chr(10) || '  - Seen ' || CAST(trunc(n + a) AS BIGINT) || ' time(s) total' || chr(10) "
            "|| '  - ' || CAST(trunc(n) AS BIGINT) || ' confirmed benign, ' || CAST(trunc(a) AS BIGINT) || ' confirmed malicious' || chr(10) "
            "|| '  - Current status  : ' || status || chr(10) || '  - Trust bias      : ' || " + fixed("bias", 3, True) +
            "|| CASE WHEN status = 'allowlisted' THEN chr(10) || '  - Note: signature was previously allowlisted (established benign pattern)' "
            "WHEN status = 'quarantined' THEN chr(10) || '  - Note: signature is quarantined (prior confirmed attacks)' "
            "WHEN a > 0 AND n > 0 THEN chr(10) || '  - Note: mixed evidence — treat with elevated scrutiny' ELSE '' END")


@query(sql(f"""SELECT signature, {SUMMARY} AS summary FROM (SELECT signature, status, round(confirmed_normal, 6) AS n,
               round(confirmed_attack, 6) AS a, round(trust_bias, 6) AS bias FROM ledger)""", "ledger"))
def evidence_summary(spark, sf_dir):
    built = ledger.build_ledger(inputs.truth_evidence(spark, sf_dir), inputs.POLICY)
    return built.select("signature", summary_text(
        F.round("confirmed_normal", 6), F.round("confirmed_attack", 6), F.col("status"), F.round("trust_bias", 6)).alias("summary"))


@query(sql("""SELECT c.event_id, c.signature, l.status, round(l.trust_bias, 6) AS trust_bias FROM ctx c LEFT JOIN
              (SELECT * FROM ledger WHERE status <> 'monitoring' OR trust_bias <> 0) l USING (signature)""", "ledger"))
def event_ledger(spark, sf_dir):
    built = ledger.build_ledger(inputs.truth_evidence(spark, sf_dir), inputs.POLICY).withColumn("trust_bias", F.round("trust_bias", 9))
    listed = built.filter((F.col("status") != "monitoring") | (F.col("trust_bias") != 0))
    return ledger.lookup_ledger(inputs.contexts(spark, sf_dir), listed).select(
        "event_id", "signature", "status", F.round("trust_bias", 6).alias("trust_bias"))


@query(sql("""SELECT signature, latest, previous, evaluated_at, round(latest - previous, 6) AS delta FROM (
  SELECT signature, trust_score AS latest, lag(trust_score) OVER w AS previous, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS evaluated_at,
    row_number() OVER (PARTITION BY signature ORDER BY seq DESC) AS rn FROM decided WHERE thr < 0.6 AND branch <> 'gate'
  WINDOW w AS (PARTITION BY signature ORDER BY seq)) WHERE rn = 1""", "decided"))
def trust_history(spark, sf_dir):
    escalated = inputs.decisions(spark, sf_dir, inputs.LOW, detail=True).filter("branch <> 'gate'")
    return ledger.trust_history(escalated).select(
        "signature", "latest", "previous", F.date_format("evaluated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("evaluated_at"),
        F.round("delta", 6).alias("delta"))


@query(sql("""SELECT signature, latest, previous, evaluated_at, round(latest - previous, 6) AS delta FROM (
  SELECT signature, trust_score AS latest, lag(trust_score) OVER w AS previous, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS evaluated_at,
    row_number() OVER (PARTITION BY signature ORDER BY seq DESC) AS rn FROM decided WHERE thr < 0.6 AND branch <> 'gate'
  WINDOW w AS (PARTITION BY signature ORDER BY seq)) WHERE rn = 1""", "decided"))
def cycle_history(spark, sf_dir):
    """The same history in two batches, the second on top of the stored first."""
    escalated = inputs.decisions(spark, sf_dir, inputs.LOW, detail=True).filter("branch <> 'gate'")
    first = ledger.trust_history(escalated.filter("seq < 400")).drop("delta")
    return ledger.trust_history(escalated.filter("seq >= 400"), first).select(
        "signature", "latest", "previous", F.date_format("evaluated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("evaluated_at"),
        F.round("delta", 6).alias("delta"))


# Decision loop with feedback, one event after the other per signature.
REPLAY = """
gated AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seq) AS rn FROM routed WHERE thr < 0.6 AND fused_risk > thr),
loop AS (
  SELECT DISTINCT signature, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS bias,
    'monitoring' AS status, '' AS playbook, CAST(0 AS DOUBLE) AS score FROM gated
  UNION ALL
  SELECT signature, rn, event_id, a2,
    CASE WHEN status = 'quarantined' OR NOT hit THEN bias WHEN a2 >= 2 THEN -0.4 ELSE greatest(bias - 0.05 * conf, -0.30) END,
    CASE WHEN status = 'quarantined' OR (hit AND a2 >= 2) THEN 'quarantined' ELSE status END, playbook, score
  FROM (
    SELECT *, playbook IN ('NETWORK_ISOLATION', 'RATE_LIMIT_DOS') AS hit,
      a + CASE WHEN playbook IN ('NETWORK_ISOLATION', 'RATE_LIMIT_DOS') THEN conf ELSE 0 END AS a2
    FROM (
      SELECT *, CASE WHEN score >= 0.4 AND fused_risk < 0.85 THEN 'ALLOW' WHEN status = 'quarantined' THEN 'NETWORK_ISOLATION'
          WHEN native_rule = 3 THEN 'RATE_LIMIT_DOS' WHEN native_rule IN (5, 6) THEN 'NETWORK_ISOLATION'
          WHEN native_rule = 7 THEN 'STEP_UP_AUTH' ELSE 'ALLOW' END AS playbook
      FROM (
        SELECT l.signature, g.rn, g.event_id, l.a, l.bias, l.status, g.fused_risk, g.native_rule, greatest(0.1, least(1.0, g.fused_risk)) AS conf,
          greatest(0.0, least(1.0, round(1.0 - g.fused_risk * 0.3 * g.mult - g.threat_pen
            + CASE WHEN l.status = 'quarantined' THEN -0.4 ELSE l.bias END
            - CASE WHEN g.off_list THEN 0.1 ELSE 0 END - CASE WHEN g.loud THEN 0.1 ELSE 0 END
            - CASE WHEN g.spiked THEN 0.1 ELSE 0 END, 6))) AS score
        FROM loop l JOIN gated g ON g.signature = l.signature AND g.rn = l.rn + 1))))"""


@query(sql("SELECT event_id, signature, playbook, score AS trust_score FROM loop WHERE rn > 0", "routed", extra=REPLAY))
def replay_decisions(spark, sf_dir):
    from flowwarden.plans.decisions import replay
    done = replay(inputs.contexts(spark, sf_dir), inputs.LOW, inputs.POLICY)
    return done.decisions.filter("branch <> 'gate'").select("event_id", "signature", "playbook", "trust_score")


@query(sql("""SELECT signature, round(a, 6) AS confirmed_attack, round(bias, 6) AS trust_bias, status FROM loop
              WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY signature ORDER BY rn DESC) = 1""", "routed", extra=REPLAY))
def replay_ledger(spark, sf_dir):
    from flowwarden.plans.decisions import replay
    done = replay(inputs.contexts(spark, sf_dir), inputs.LOW, inputs.POLICY)
    return done.ledger.select("signature", F.round("confirmed_attack", 6).alias("confirmed_attack"),
                              F.round("trust_bias", 6).alias("trust_bias"), "status")


def _evidence_sql(source: str, verdict: str, conf: str, n: str) -> str:
    """One piece of evidence applied to columns n, a, bias, status; a null verdict changes nothing."""
    return f"""SELECT * REPLACE (n_{n} AS n, a_{n} AS a,
    CASE WHEN {verdict} IS NULL THEN bias
      WHEN status = 'allowlisted' THEN CASE WHEN a_{n} >= 2 THEN 0 ELSE bias END
      WHEN status = 'quarantined' THEN CASE WHEN n_{n} >= 3 THEN 0 ELSE bias END
      WHEN n_{n} >= 3 AND a_{n} < 0.5 THEN 0.15 WHEN a_{n} >= 2 AND n_{n} < 0.5 THEN -0.4
      WHEN {verdict} = 'normal' THEN least(bias + 0.05 * ({conf}), 0.20) ELSE greatest(bias - 0.05 * ({conf}), -0.30) END AS bias,
    CASE WHEN {verdict} IS NULL THEN status
      WHEN status = 'allowlisted' THEN CASE WHEN a_{n} >= 2 THEN 'monitoring' ELSE status END
      WHEN status = 'quarantined' THEN CASE WHEN n_{n} >= 3 THEN 'monitoring' ELSE status END
      WHEN n_{n} >= 3 AND a_{n} < 0.5 THEN 'allowlisted' WHEN a_{n} >= 2 AND n_{n} < 0.5 THEN 'quarantined' ELSE 'monitoring' END AS status)
    FROM (SELECT *, n + CASE WHEN {verdict} = 'normal' THEN {conf} ELSE 0 END AS n_{n},
                 a + CASE WHEN {verdict} = 'attack' THEN {conf} ELSE 0 END AS a_{n} FROM ({source}))"""


_JUDGED = """SELECT *, CASE WHEN playbook IN ('NETWORK_ISOLATION', 'RATE_LIMIT_DOS') THEN 'attack' END AS own,
    CASE WHEN label = 0 AND playbook IN ('NETWORK_ISOLATION', 'STEP_UP_AUTH', 'RATE_LIMIT_DOS') THEN 'normal'
      WHEN label = 1 AND playbook = 'ALLOW' THEN 'attack' END AS fix
  FROM (SELECT *, CASE WHEN score >= 0.4 AND fused_risk < 0.85 THEN 'ALLOW' WHEN status = 'quarantined' THEN 'NETWORK_ISOLATION'
          WHEN native_rule = 3 THEN 'RATE_LIMIT_DOS' WHEN native_rule IN (5, 6) THEN 'NETWORK_ISOLATION'
          WHEN native_rule = 7 THEN 'STEP_UP_AUTH' ELSE 'ALLOW' END AS playbook
    FROM (SELECT l.thr, l.signature, g.rn, g.event_id, l.n, l.a, l.bias, l.status, g.fused_risk, g.native_rule, g.label,
            greatest(0.1, least(1.0, g.fused_risk)) AS conf,
            greatest(0.0, least(1.0, round(1.0 - g.fused_risk * 0.3 * g.mult - g.threat_pen + l.bias
              - CASE WHEN g.off_list THEN 0.1 ELSE 0 END - CASE WHEN g.loud THEN 0.1 ELSE 0 END
              - CASE WHEN g.spiked THEN 0.1 ELSE 0 END, 6))) AS score
          FROM mended l JOIN asked g ON g.thr = l.thr AND g.signature = l.signature AND g.rn = l.rn + 1))"""
# The same loop with the correction of every wrong decision written before the next event is looked at.
MENDED = """
asked AS (SELECT *, row_number() OVER (PARTITION BY thr, signature ORDER BY seq) AS rn FROM routed WHERE fused_risk > thr),
mended AS (
  SELECT DISTINCT thr, signature, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS a,
    CAST(0 AS DOUBLE) AS bias, 'monitoring' AS status, '' AS playbook, CAST(0 AS DOUBLE) AS score FROM asked
  UNION ALL
  SELECT thr, signature, rn, event_id, n, a, bias, status, playbook, score FROM (""" + _evidence_sql(
    _evidence_sql(_JUDGED, "own", "conf", "own"), "fix", "1.0", "fix") + """))"""


def _corrected(spark, sf_dir, part):
    from flowwarden.plans.corrected import replay_corrected
    done = [(t, replay_corrected(inputs.contexts(spark, sf_dir), t, inputs.POLICY)) for t in (inputs.LOW, inputs.HIGH)]
    frames = [part(d).withColumn("thr", F.lit(t)) for t, d in done]
    return frames[0].unionByName(frames[1])


@query(sql("SELECT thr, event_id, signature, playbook, score AS trust_score FROM mended WHERE rn > 0", "routed", extra=MENDED))
def replay_corrected(spark, sf_dir):
    return _corrected(spark, sf_dir, lambda d: d.decisions.filter("branch <> 'gate'").select("event_id", "signature", "playbook", "trust_score"))


@query(sql("""SELECT thr, signature, round(n, 6) AS confirmed_normal, round(a, 6) AS confirmed_attack, round(bias, 6) AS trust_bias, status FROM mended
              QUALIFY row_number() OVER (PARTITION BY thr, signature ORDER BY rn DESC) = 1 AND n + a > 0""", "routed", extra=MENDED))
def replay_corrected_ledger(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("confirmed_normal", "confirmed_attack", "trust_bias")]
    return _corrected(spark, sf_dir, lambda d: d.ledger.select("signature", *rounded, "status"))
