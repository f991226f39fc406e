"""SQL fragments the oracles are put together from."""

from __future__ import annotations

CTES = {}

CTES["flows"] = """
flows AS (
  SELECT event_id, event_id AS seq, ts, user_id, event_type, h, g, k,
    CASE WHEN g < 7 THEN 'tcp' WHEN g < 10 THEN 'udp' WHEN g = 10 THEN 'unas' ELSE 'icmp' END AS proto,
    CASE event_type WHEN 'click' THEN 'http' WHEN 'purchase' THEN 'dns' WHEN 'signup' THEN 'smtp' ELSE '-' END AS service,
    CASE WHEN g < 7 THEN 'FIN' ELSE 'INT' END AS state,
    CASE WHEN k < 3 THEN 4998 + 2 * k WHEN k < 10 THEN 100 + k ELSE k END AS spkts,
    CASE WHEN g >= 7 THEN 0 ELSE k % 20 END AS dpkts,
    CASE k % 5 WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN '10.1.2.' || k WHEN 2 THEN '172.16.0.' || k
      WHEN 3 THEN '192.168.1.' || k ELSE '8.8.8.8' END AS dstip,
    CASE WHEN g IN (0, 1, 7) THEN 'Normal' WHEN g = 2 THEN 'Exploits' WHEN g = 3 THEN 'Fuzzers'
      WHEN g IN (4, 10) THEN 'DoS' WHEN g = 5 THEN 'Reconnaissance' WHEN g = 6 THEN 'Analysis'
      WHEN g = 8 THEN 'Generic' WHEN g = 9 THEN 'Shellcode' ELSE 'Unlisted' END AS threat,
    CASE WHEN h % 1001 + 4 * k >= 800 THEN 1 ELSE 0 END AS label,
    CAST(least(1000, ((h % 1001) * 3) // 5 + 4 * k) AS DOUBLE) / 1000 AS fused_risk,
    CAST((h // 7) % 1001 AS DOUBLE) / 1000 AS cat_risk,
    CAST(g * 90 AS DOUBLE) / 1000 AS anomaly_risk,
    CAST(g % 3 AS DOUBLE) * 0.75 AS incident_entropy
  FROM (SELECT *, (event_id * 7919 + user_id * 104729) % 1000003 AS h, user_id % 12 AS g,
          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""

CTES["ctx"] = """
buckets AS (
  SELECT *,
    CASE WHEN fused_risk < 0.40 THEN 'R1' WHEN fused_risk < 0.65 THEN 'R2' WHEN fused_risk < 0.85 THEN 'R3' ELSE 'R4' END AS rb,
    CASE WHEN anomaly_risk < 0.40 THEN 'A1' WHEN anomaly_risk < 0.70 THEN 'A2' ELSE 'A3' END AS ab,
    CASE WHEN spkts < 100 THEN 'V1' WHEN spkts < 5000 THEN 'V2' ELSE 'V3' END AS vb,
    CASE WHEN incident_entropy < 0.5 THEN 'E1' WHEN incident_entropy < 1.5 THEN 'E2' ELSE 'E3' END AS eb
  FROM flows),
ctx AS (SELECT *, concat_ws('_', proto, service, state, threat, rb, ab, vb, eb) AS signature FROM buckets)"""

CTES["priced"] = """
tiered AS (
  SELECT *,
    CASE WHEN starts_with(dstip, '10.0.0.') THEN '10.0.0.' WHEN starts_with(dstip, '10.1.') THEN '10.1.'
      WHEN starts_with(dstip, '192.168.') THEN '192.168.' WHEN starts_with(dstip, '172.16.') THEN '172.16.' ELSE 'DEFAULT' END AS tier
  FROM ctx),
priced AS (
  SELECT *,
    CAST(CASE tier WHEN '10.0.0.' THEN 1.5 WHEN '10.1.' THEN 1.2 WHEN '172.16.' THEN 1.1 ELSE 1.0 END AS DOUBLE) AS mult,
    CAST(CASE threat WHEN 'Normal' THEN 0.0 WHEN 'Exploits' THEN 0.3 WHEN 'DoS' THEN 0.15 WHEN 'Analysis' THEN 0.15
      WHEN 'Shellcode' THEN 0.45 ELSE 0.4 END AS DOUBLE) AS threat_pen,
    (proto || '_' || service) NOT IN ('tcp_http', 'tcp_https', 'tcp_ftp', 'udp_dns', 'tcp_smtp', 'tcp_ssh', 'tcp_rdp',
      'udp_ntp', 'tcp_-', 'udp_-', 'icmp_-') AS off_list,
    spkts > 5000 AS loud, cat_risk > 0.70 AS spiked
  FROM tiered)"""

# Score without ledger terms; `late` is added by queries that use office hours.
CTES["scored"] = """
scored AS (
  SELECT *, greatest(0.0, least(1.0, round(1.0 - fused_risk * 0.3 * mult - threat_pen
      - CASE WHEN off_list THEN 0.1 ELSE 0 END - CASE WHEN loud THEN 0.1 ELSE 0 END
      - CASE WHEN spiked THEN 0.1 ELSE 0 END, 6))) AS trust_score
  FROM priced)"""

CTES["routed"] = """
thresholds AS (SELECT CAST(0.5 AS DOUBLE) AS thr UNION ALL SELECT CAST(0.7889 AS DOUBLE)),
routed AS (
  SELECT *,
    CASE WHEN fused_risk <= thr AND threat = 'Normal' THEN 1 WHEN fused_risk <= thr THEN 2 WHEN threat = 'DoS' THEN 3
      WHEN threat = 'Shellcode' AND proto = 'udp' AND dpkts = 0 AND fused_risk < thr THEN 4
      WHEN fused_risk > least(thr + 0.15, 0.90) THEN 5 WHEN threat <> 'Normal' THEN 6 ELSE 7 END AS native_rule
  FROM scored, thresholds)"""

CTES["decided"] = """
branched AS (
  SELECT *, CASE WHEN fused_risk <= thr THEN 'gate' WHEN trust_score >= 0.4 AND fused_risk < 0.85 THEN 'trusted'
      ELSE 'responder' END AS branch FROM routed),
decided AS (
  SELECT * REPLACE (CASE WHEN branch <> 'gate' THEN trust_score END AS trust_score),
    CASE branch WHEN 'gate' THEN 'LOG_ONLY' WHEN 'trusted' THEN 'ALLOW' ELSE
      CASE native_rule WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'ALLOW' WHEN 3 THEN 'RATE_LIMIT_DOS' WHEN 4 THEN 'ALLOW'
        WHEN 5 THEN 'NETWORK_ISOLATION' WHEN 6 THEN 'NETWORK_ISOLATION' ELSE 'STEP_UP_AUTH' END END AS playbook,
    CASE branch WHEN 'trusted' THEN fused_risk < thr * 0.75 WHEN 'responder' THEN native_rule IN (1, 4) ELSE false END AS is_false_positive
  FROM branched)"""

# Evidence with the label as verdict, folded row by row: the sequential definition of the ledger.
CTES["ledger"] = """
ev AS (
  SELECT signature, seq, CASE WHEN label = 1 THEN 'attack' ELSE 'normal' END AS verdict,
    greatest(0.1, least(1.0, fused_risk)) AS conf,
    row_number() OVER (PARTITION BY signature ORDER BY seq) AS rn FROM ctx),
fold AS (
  SELECT DISTINCT signature, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS a,
    CAST(0 AS DOUBLE) AS bias, 'monitoring' AS status FROM ev
  UNION ALL
  SELECT signature, rn, seq, n, a,
    CASE WHEN was = 'allowlisted' THEN CASE WHEN a >= 2 THEN 0 ELSE bias END
         WHEN was = 'quarantined' THEN CASE WHEN n >= 3 THEN 0 ELSE bias END
         WHEN n >= 3 AND a < 0.5 THEN 0.15 WHEN a >= 2 AND n < 0.5 THEN -0.4
         WHEN verdict = 'normal' THEN least(bias + 0.05 * conf, 0.20) ELSE greatest(bias - 0.05 * conf, -0.30) END,
    CASE WHEN was = 'allowlisted' THEN CASE WHEN a >= 2 THEN 'monitoring' ELSE was END
         WHEN was = 'quarantined' THEN CASE WHEN n >= 3 THEN 'monitoring' ELSE was END
         WHEN n >= 3 AND a < 0.5 THEN 'allowlisted' WHEN a >= 2 AND n < 0.5 THEN 'quarantined' ELSE 'monitoring' END
  FROM (SELECT f.signature, e.rn, e.seq, e.verdict, e.conf, f.status AS was, f.bias,
          f.n + CASE WHEN e.verdict = 'normal' THEN e.conf ELSE 0 END AS n,
          f.a + CASE WHEN e.verdict = 'attack' THEN e.conf ELSE 0 END AS a
        FROM fold f JOIN ev e ON e.signature = f.signature AND e.rn = f.rn + 1)),
ledger AS (
  SELECT signature, n AS confirmed_normal, a AS confirmed_attack, bias AS trust_bias, status, seq AS last_seq
  FROM fold QUALIFY row_number() OVER (PARTITION BY signature ORDER BY rn DESC) = 1)"""

CTES["probs"] = """
weights AS (
  SELECT event_id, label, threat,
    [CAST(1 + (h // 3) % 97 AS DOUBLE), CAST(1 + (h // 5) % 97 AS DOUBLE), CAST(1 + (h // 7) % 97 AS DOUBLE),
     CAST(1 + (h // 11) % 97 AS DOUBLE), CAST(1 + (h // 13) % 97 AS DOUBLE), CAST(1 + (h // 17) % 97 AS DOUBLE),
     CAST(1 + (h // 19) % 97 AS DOUBLE), CAST(1 + (h // 23) % 97 AS DOUBLE), CAST(1 + (h // 29) % 97 AS DOUBLE),
     CAST(1 + (h // 31) % 97 AS DOUBLE)] AS w FROM flows),
probs AS (
  SELECT event_id, label, threat, p, pos, CASE WHEN pos = 7 THEN greatest(0, p - 0.15) ELSE p END AS adj,
    ['Analysis','Backdoor','DoS','Exploits','Fuzzers','Generic','Normal','Reconnaissance','Shellcode','Worms'][pos] AS class
  FROM (SELECT event_id, label, threat, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) AS pos FROM weights))"""

CTES["candidates"] = """
candidates AS (
  SELECT event_id, seq, user_id, ts,
    CASE event_id % 5
      WHEN 0 THEN 'proto=' || proto || ' AND state=' || state
      WHEN 1 THEN 'proto=' || proto || ' AND service=' || service || ' AND state=' || state
      WHEN 2 THEN 'proto=' || proto || ' AND state=' || state || ' AND threat_class=' || threat
      WHEN 3 THEN 'proto=' || proto || ' AND service=' || service || ' AND state=' || state || ' AND threat_class=' || threat
      ELSE 'proto=' || proto || ' AND state=' || state || ' AND spkts=' || spkts END AS condition,
    CASE WHEN label = 1 THEN 'NETWORK_ISOLATION' ELSE 'ALLOW' END AS playbook,
    proto AS c_proto, state AS c_state,
    CASE WHEN event_id % 5 IN (1, 3) THEN service END AS c_service,
    CASE WHEN event_id % 5 IN (2, 3) THEN threat END AS c_threat,
    CASE WHEN event_id % 5 = 4 THEN spkts END AS c_spkts
  FROM flows),
rules AS (
  SELECT *, (CASE WHEN playbook = 'ALLOW' THEN 'LEARNED_' ELSE 'FN_PATCH_' END)
      || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id,
    2 + CASE WHEN c_service IS NULL THEN 0 ELSE 1 END + CASE WHEN c_threat IS NULL THEN 0 ELSE 1 END
      + CASE WHEN c_spkts IS NULL THEN 0 ELSE 1 END AS n_clauses
  FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (
          SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY lower(condition) ORDER BY seq) = 1)))"""

ORDER = ["flows", "ctx", "priced", "scored", "routed", "decided", "ledger", "probs", "candidates"]
NEEDS = {
    "flows": [], "ctx": ["flows"], "priced": ["ctx"], "scored": ["priced"], "routed": ["scored"],
    "decided": ["routed"], "ledger": ["ctx"], "probs": ["flows"], "candidates": ["flows"],
}


def sql(body: str, *names: str, extra: str = "") -> str:
    """A full statement: the named fragments with all they need, then `extra` CTEs, then the body."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for parent in NEEDS[name]:
            add(parent)
        wanted.add(name)

    for name in names:
        add(name)
    parts = [CTES[n].strip() for n in ORDER if n in wanted] + ([extra.strip()] if extra else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body if parts else body


def fixed(expr: str, digits: int, plus: bool = False) -> str:
    """SQL twin of the fixed-digit number text."""
    scale = 10 ** digits
    units = f"CAST(abs(round(({expr}) * {scale}.0::DOUBLE)) AS BIGINT)"
    positive = "+" if plus else ""
    return (f"(CASE WHEN round(({expr}) * {scale}.0::DOUBLE) < 0 THEN '-' ELSE '{positive}' END || ({units} // {scale}) || '.' "
            f"|| lpad(CAST({units} % {scale} AS VARCHAR), {digits}, '0'))")
