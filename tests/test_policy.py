"""Golden trust scores of saved evaluations, and the edges of every policy rule."""

import pytest
from pyspark.sql import functions as F

from flowwarden import Policy
from flowwarden.operators.decide import decide, feedback, with_responses
from flowwarden.operators.trust import with_trust, written_hour
from flowwarden.sources.flows import with_context_columns

SCHEMA = ("event_id long, seq long, ts string, proto string, service string, state string, spkts double, dpkts double, "
          "dstip string, threat string, label int, fused_risk double, cat_risk double, anomaly_risk double, "
          "incident_entropy double, trust_bias double, status string, confirmed_normal double, confirmed_attack double")


def row(i=0, proto="tcp", service="http", state="FIN", spkts=10.0, dpkts=10.0, dstip=None, threat="Normal", fused=0.5,
        cat=0.1, anomaly=0.1, entropy=0.1, bias=None, status=None, ts="2024-05-01T12:00:00"):
    return (i, i, ts, proto, service, state, spkts, dpkts, dstip, threat, 0, fused, cat, anomaly, entropy, bias, status, 0.0, 0.0)


def frame(spark, rows):
    return with_context_columns(spark.createDataFrame(rows, SCHEMA))


# proto, service, state, threat, fused risk, (anomaly, spkts, entropy), ledger, score, violations
GOLDEN = [
    ("tcp", "smtp", "FIN", "Exploits", .999, (.1, 200, .1), (None, None), .3003, []),
    ("prm", "-", "INT", "DoS", .999, (.9, 2, 2.), (None, None), .3503, ["UNAPPROVED_COMBO: prm_-"]),
    ("vmtp", "-", "INT", "DoS", .999, (.9, 2, 1.), (None, None), .3503, ["UNAPPROVED_COMBO: vmtp_-"]),
    ("ospf", "-", "INT", "Exploits", .999, (.9, 2, 1.), (0.0, "monitoring"), .2003, ["UNAPPROVED_COMBO: ospf_-"]),
    ("ospf", "-", "INT", "Exploits", .999, (.9, 2, 1.), (-.04995, "monitoring"), .15035, ["UNAPPROVED_COMBO: ospf_-"]),
    ("tcp", "http", "FIN", "Exploits", .945, (.5, 2, 1.), (None, None), .4165 - 0.1, []),
    ("tcp", "ftp", "FIN", "Exploits", .988, (.5, 2, 1.), (None, None), .3036, []),
    ("tcp", "smtp", "FIN", "Exploits", 1.0, (.9, 2, .1), (None, None), .3, []),
    ("tcp", "http", "FIN", "Exploits", .958, (.9, 2, 1.), (-.4, "quarantined"), .0126 - 0.1, []),
    ("tcp", "-", "FIN", "Normal", .843, (.9, 2, 1.), (-.4, "quarantined"), .3471 - 0.1, []),
]


def test_golden_scores(spark):
    rows = [row(i, proto=g[0], service=g[1], state=g[2], threat=g[3], fused=g[4], cat=.9, anomaly=g[5][0], spkts=float(g[5][1]),
                entropy=g[5][2], bias=g[6][0], status=g[6][1]) for i, g in enumerate(GOLDEN)]
    got = with_trust(frame(spark, rows), Policy.of(), from_ledger=True).orderBy("event_id").collect()
    for g, r in zip(GOLDEN, got):
        assert r.trust_score == pytest.approx(max(0.0, g[7]), abs=1e-6), g
        assert r.violations == g[8]


def test_golden_without_category_spike(spark):
    rows = [row(0, service="http", threat="Exploits", fused=.945), row(1, service="http", threat="Exploits", fused=.933, bias=-.04725, status="monitoring"),
            row(2, service="http", threat="Exploits", fused=.958, bias=-.4, status="quarantined"),
            row(3, service="-", fused=.843, status="quarantined"), row(4, service="-", fused=.848, status="quarantined")]
    got = with_trust(frame(spark, rows), Policy.of(), from_ledger=True).orderBy("event_id").collect()
    assert [r.trust_score for r in got] == pytest.approx([.4165, .37285, .0126, .3471, .3456], abs=1e-6)


def test_signature_and_bucket_edges(spark):
    edges = [(.399, "R1"), (.40, "R2"), (.649, "R2"), (.65, "R3"), (.849, "R3"), (.85, "R4")]
    got = frame(spark, [row(i, fused=f) for i, (f, _) in enumerate(edges)]).orderBy("event_id").collect()
    assert [r.signature.split("_")[4] for r in got] == [b for _, b in edges]
    edges = [(99.9, "V1"), (100.0, "V2"), (4999.9, "V2"), (5000.0, "V3")]
    got = frame(spark, [row(i, spkts=s) for i, (s, _) in enumerate(edges)]).orderBy("event_id").collect()
    assert [r.signature.split("_")[6] for r in got] == [b for _, b in edges]
    r = frame(spark, [row(0, entropy=.5), row(1, entropy=1.5), row(2, proto=None, threat=None)]).orderBy("event_id").collect()
    assert r[0].signature.endswith("E2") and r[1].signature.endswith("E3")
    assert r[2].signature.startswith("unknown_http_FIN_UNKNOWN_")


def test_missing_risk_defaults(spark):
    r = with_trust(frame(spark, [row(0, fused=None)]), Policy.of()).first()
    assert r.trust_score == pytest.approx(1 - .5 * .3)
    assert "_R1_" in r.signature


def test_reasons_and_tiers(spark):
    r = with_trust(frame(spark, [row(0, fused=.8, dstip="10.0.0.9", spkts=5001.7)]), Policy.of()).first()
    assert r.factors[0].reason == ("fused_risk=0.8000 × weight=0.30 × asset_multiplier=1.5 (tier '10.0.0.') → "
                                   "base_penalty=0.2400, amplified=0.3600")
    assert [f.name for f in r.factors] == ["ml_fused_risk", "high_volume_anomaly"]
    assert r.violations == ["HIGH_VOLUME: spkts=5001"]


def test_hour_is_read_as_written(spark):
    texts = ["2024-01-01T23:10:00+05:00", "2024-01-01 07:00:00", "2024-01-01T08", "not a time", "2024-01-01T25:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(written_hour(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [23, 7, 8, None, None]


def test_empty_combo_list_switches_rule_off(spark):
    policy = Policy.of({"approved_proto_service_combos": []})
    assert with_trust(frame(spark, [row(0, proto="zz")]), policy).first().violations == []


def test_backfill_is_shallow():
    policy = Policy.from_text('{"business_hours": {"start": 9}, "ml_risk_weight": 0.5}')
    assert policy["business_hours"] == {"start": 9} and policy["ml_risk_weight"] == 0.5 and policy["score_ceiling"] == 1.0


def test_policy_file(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text('{"quarantine_penalty": 0.7}')
    assert Policy.load(spark, str(path))["quarantine_penalty"] == 0.7
    assert Policy.load(spark, str(tmp_path / "none.json"))["quarantine_penalty"] == 0.4


def test_veto_quarantine_and_rule_seven(spark):
    rows = [row(0, fused=.5), row(1, fused=.6), row(2, fused=.9), row(3, fused=.6, status="quarantined", threat="Exploits"),
            row(4, fused=.9, threat="DoS")]
    d = decide(with_trust(frame(spark, rows), Policy.of(), from_ledger=True), 0.5).orderBy("event_id")
    assert [(r.branch, r.playbook) for r in d.collect()] == [
        ("gate", "LOG_ONLY"), ("trusted", "ALLOW"), ("responder", "NETWORK_ISOLATION"),
        ("quarantine", "NETWORK_ISOLATION"), ("responder", "RATE_LIMIT_DOS")]
    benign = decide(with_trust(frame(spark, [row(0, fused=.88)]), Policy.of(), from_ledger=True), 0.8, F.col("dpkts") > 0)
    assert (benign.first().rule, benign.first().playbook) == (7, "ALLOW")
    e = {r.event_id: r.confidence for r in feedback(d, 0.5).collect()}
    assert e == {2: .9, 3: .6, 4: .9}


def test_model_answers_replace_native_routes(spark):
    d = decide(with_trust(frame(spark, [row(0, fused=.9), row(1, fused=.9), row(2, fused=.6)]), Policy.of(), from_ledger=True), 0.5)
    from flowwarden.functions.responses import decision_from_response
    raw = spark.createDataFrame([(0, '{"playbook": "STEP_UP_AUTH", "reasoning": "r", "is_false_positive": true}'), (1, "nothing"), (2, '{"playbook": "X"}')],
                                "event_id long, raw string").select("event_id", decision_from_response(F.col("raw")).alias("answer"))
    got = with_responses(d, raw).orderBy("event_id").collect()
    assert [(r.playbook, r.is_llm_failsafe) for r in got] == [("STEP_UP_AUTH", False), ("NETWORK_ISOLATION", True), ("ALLOW", False)]
