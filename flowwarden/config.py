"""Policy settings, bucket edges, playbooks and native rules."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# ---- fixed values: results depend on these being exactly as they are -------------------------

DEFAULT_POLICY = {
    "trust_score_threshold": 0.40,
    "ml_risk_weight": 0.30,
    "threat_class_penalties": {
        "Normal": 0.00,
        "Generic": 0.40,
        "Exploits": 0.30,
        "Fuzzers": 0.40,
        "DoS": 0.15,
        "Reconnaissance": 0.40,
        "Backdoor": 0.40,
        "Analysis": 0.15,
        "Shellcode": 0.45,
        "Worms": 0.40,
        "UNKNOWN": 0.40,
    },
    "quarantine_penalty": 0.40,
    "allowlist_bonus": 0.15,
    "approved_proto_service_combos": [
        "tcp_http", "tcp_https", "tcp_ftp", "udp_dns", "tcp_smtp", "tcp_ssh",
        "tcp_rdp", "udp_ntp", "tcp_-", "udp_-", "icmp_-",
    ],
    "unapproved_combo_penalty": 0.10,
    "asset_sensitivity_tiers": {
        "10.0.0.": 1.5,
        "10.1.": 1.2,
        "192.168.": 1.0,
        "172.16.": 1.1,
        "DEFAULT": 1.0,
    },
    "business_hours": {"start": 0, "end": 24},
    "after_hours_penalty": 0.10,
    "high_volume_threshold": 5000,
    "high_volume_penalty": 0.10,
    "high_categorical_risk_threshold": 0.70,
    "high_categorical_risk_penalty": 0.10,
    "score_floor": 0.0,
    "score_ceiling": 1.0,
}

RISK_EDGES = (0.40, 0.65, 0.85)
ANOMALY_EDGES = (0.40, 0.70)
VOLUME_EDGES = (100, 5000)
ENTROPY_EDGES = (0.5, 1.5)

HIGH_SEVERITY_PENALTY = 0.35
UNLISTED_THREAT_PENALTY = 0.30
GREY_ZONE_LIMIT = 0.85
LOW_RISK_SHARE = 0.75
ISOLATION_MARGIN = 0.15
ISOLATION_CEILING = 0.90
FALLBACK_THRESHOLD = 0.5

BIAS_STEP = 0.05
BIAS_CEILING = 0.20
BIAS_FLOOR = -0.30
MIN_CONFIDENCE = 0.05
ALLOW_EVIDENCE = 3.0
QUARANTINE_EVIDENCE = 2.0
COUNTER_EVIDENCE = 0.5

MAX_RULES = 30
RULE_HEADROOM = 5
RULE_FN_LIMIT = 2

COST_FN = 12
COST_FP = 2

PLAYBOOKS = {
    "ALLOW": [
        {"tool": "Splunk_SIEM", "action": "ingest_telemetry", "index": "network_traffic_allowed"},
        {"tool": "Metrics_Dashboard", "action": "increment_fp_counter", "status": "success"},
    ],
    "LOG_ONLY": [
        {"tool": "Splunk_SIEM", "action": "ingest_telemetry", "index": "network_traffic_benign"},
    ],
    "STEP_UP_AUTH": [
        {"tool": "Okta_IAM", "action": "trigger_push_mfa", "timeout": "60"},
        {"tool": "Splunk_SIEM", "action": "create_notable_event", "severity": "Medium"},
        {"tool": "Jira_ServiceDesk", "action": "open_ticket", "assignee": "Tier_1_SOC"},
    ],
    "NETWORK_ISOLATION": [
        {"tool": "VirusTotal_API", "action": "query_ip_reputation"},
        {"tool": "Palo_Alto_Firewall", "action": "block_src_ip", "duration": "permanent"},
        {"tool": "CrowdStrike_EDR", "action": "isolate_host_network"},
        {"tool": "Active_Directory", "action": "revoke_session_tokens"},
        {"tool": "PagerDuty", "action": "page_on_call_engineer", "priority": "CRITICAL"},
    ],
    "RATE_LIMIT_DOS": [
        {"tool": "Cloudflare_WAF", "action": "enable_under_attack_mode"},
        {"tool": "F5_Load_Balancer", "action": "throttle_source_ip", "limit": "100_req_per_min"},
        {"tool": "Splunk_SIEM", "action": "create_notable_event", "severity": "High"},
    ],
}

NATIVE_RULES = (
    "1. IF 'fused_risk' <= {mfa_trigger} AND 'predicted_threat_classification' == 'Normal': Playbook is 'ALLOW' (is_false_positive: true).",
    "2. IF 'fused_risk' <= {mfa_trigger} AND 'predicted_threat_classification' != 'Normal': Playbook is 'ALLOW' (is_false_positive: false).",
    "3. IF 'predicted_threat_classification' == 'DoS': Playbook is 'RATE_LIMIT_DOS' (is_false_positive: false).",
    "4. IF 'predicted_threat_classification' == 'Shellcode' AND 'proto' == 'udp' AND 'dpkts' == 0 AND 'fused_risk' < {mfa_trigger}: Playbook is 'ALLOW' (is_false_positive: true). NOTE: This rule applies ONLY to Shellcode misclassifications with low fused risk. Generic, Reconnaissance, or other non-Normal threat classes with dpkts=0 are NOT covered by this rule.",
    "5. IF 'fused_risk' > {isolation_trigger}: Playbook is 'NETWORK_ISOLATION' (is_false_positive: false).",
    "6. IF 'predicted_threat_classification' != 'Normal' AND 'predicted_threat_classification' != 'DoS': Playbook is 'NETWORK_ISOLATION' (is_false_positive: false).",
    "7. IF 'fused_risk' > {mfa_trigger} AND 'predicted_threat_classification' == 'Normal': Inspect telemetry. If standard benign traffic, 'ALLOW'. Otherwise, 'STEP_UP_AUTH'.",
)

# ---- end of fixed values ---------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Zero-trust settings; every key the file lacks comes from the defaults (top level only)."""

    values: dict = field(default_factory=lambda: copy.deepcopy(DEFAULT_POLICY))

    @classmethod
    def of(cls, given: dict | None = None) -> "Policy":
        merged = copy.deepcopy(DEFAULT_POLICY)
        merged.update(given or {})
        return cls(merged)

    @classmethod
    def from_text(cls, text: str) -> "Policy":
        return cls.of(json.loads(text))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Policy":
        """Read one JSON document through Spark's file layer; a missing file means the defaults."""
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop_path):
            return cls.of()
        return cls.from_text(spark.read.text(path, wholetext=True).first().value)

    def override(self, **changes) -> "Policy":
        return Policy({**self.values, **changes})

    def __getitem__(self, key: str):
        return self.values[key]

    def tiers(self) -> list[tuple[str, float]]:
        return [(p, m) for p, m in self["asset_sensitivity_tiers"].items() if p != "DEFAULT"]

    def default_tier(self) -> float:
        return self["asset_sensitivity_tiers"].get("DEFAULT", 1.0)

    def unlisted_penalty(self) -> float:
        return self["threat_class_penalties"].get("UNKNOWN", UNLISTED_THREAT_PENALTY)


# Fixed value: analysis of a misdecision that no model explained.
NO_ANALYSIS = "Unable to generate analysis: LLM unavailable. Autonomous fallback triggered."
# Fixed value: start of the trigger of audit rows; the kind of mistake follows.
AUDIT_TRIGGER = "Autonomous_Evaluation_"
# Section headings of a context block.
SECTION_HEADS = (
    "SIMILAR PAST INCIDENTS (for reference, not binding rules):",
    "\nKNOWN MISTAKE PATTERNS (diagnoses of prior FP/FN errors):",
    "\nRELEVANT LEARNED RULES (AI-synthesised, lower priority than native rules):",
)
