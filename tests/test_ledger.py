"""Ledger closed form, chunked folds and the replay against plain sequential code."""

import random

import pytest
from pyspark.sql import functions as F

from flowwarden import Policy
from flowwarden.operators import ledger as L
from flowwarden.plans.decisions import replay, snapshot_decisions
from flowwarden.schemas import EVIDENCE, LEDGER
from flowwarden.operators.decide import native_route
from flowwarden.operators.trust import with_trust
from test_policy import frame, row


def walk(rows, start=(0.0, 0.0, 0.0, "monitoring")):
    """The ledger one row at a time."""
    n, a, bias, status = start
    out = []
    for verdict, conf in rows:
        conf = min(1.0, max(0.05, conf))
        if verdict == "normal":
            n += conf
        else:
            a += conf
        if status == "allowlisted":
            if a >= 2:
                status, bias = "monitoring", 0.0
        elif status == "quarantined":
            if n >= 3:
                status, bias = "monitoring", 0.0
        else:
            bias = min(bias + .05 * conf, .20) if verdict == "normal" else max(bias - .05 * conf, -.30)
            if n >= 3 and a < .5:
                status, bias = "allowlisted", .15
            elif a >= 2 and n < .5:
                status, bias = "quarantined", -.40
        out.append((n, a, bias, status))
    return out


def histories(seed, signatures=60, longest=160):
    rng = random.Random(seed)
    rows, per = [], {}
    seq = 0
    for s in range(signatures):
        lean = rng.random()
        for _ in range(rng.randint(1, longest)):
            seq += rng.randint(1, 3)
            verdict = "normal" if rng.random() < lean else "attack"
            conf = rng.choice([0.01, 0.05, 0.1, 0.5, 1.0, 1.7, rng.random()])
            rows.append((f"s{s}", seq, verdict, conf))
            per.setdefault(f"s{s}", []).append((verdict, conf))
    rng.shuffle(rows)
    return rows, per


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_form_equals_walk(spark, seed):
    rows, per = histories(seed)
    log = spark.createDataFrame(rows, EVIDENCE).repartition(7)
    got = {r.signature: r for r in L.build_ledger(log, Policy.of()).collect()}
    assert set(got) == set(per)
    for s, evidence in per.items():
        n, a, bias, status = walk(evidence)[-1]
        r = got[s]
        assert r.status == status, s
        assert (r.confirmed_normal, r.confirmed_attack, r.trust_bias) == pytest.approx((n, a, bias), abs=1e-9), s


def test_history_equals_walk_with_small_chunks(spark):
    rows, per = histories(3, 20)
    log = spark.createDataFrame(rows, EVIDENCE)
    got = {}
    for r in L.ledger_history(log, width=7).orderBy("signature", "seq").collect():
        got.setdefault(r.signature, []).append((r.confirmed_normal, r.confirmed_attack, r.status))
    for s, evidence in per.items():
        want = [(n, a, status) for n, a, _, status in walk(evidence)]
        assert [g[2] for g in got[s]] == [w[2] for w in want]
        assert [x for g in got[s] for x in g[:2]] == pytest.approx([x for w in want for x in w[:2]])


def test_fold_levels_give_the_same_bias(spark):
    rng = random.Random(5)
    steps = [("hot", i * 3 + 1, rng.choice([-.05, .05, .03, -.01])) for i in range(3000)]
    df = spark.createDataFrame(steps, "k string, pos long, c double").select(
        "k", "pos", "c", F.when(F.col("c") > 0, F.lit(float("-inf"))).otherwise(-.3).alias("lo"),
        F.when(F.col("c") > 0, .2).otherwise(F.lit(float("inf"))).alias("hi"))
    b = 0.0
    for _, _, c in steps:
        b = min(b + c, .2) if c > 0 else max(b + c, -.3)
    for bits, levels in ((16, 3), (4, 4), (8, 2)):
        r = L.fold_shifts(df, "k", levels, bits).first()
        assert max(r.lo, min(r.hi, r.c)) == pytest.approx(b, abs=1e-9)


def test_merge_log_counts_a_replayed_batch_once(spark):
    log = spark.createDataFrame([("s", 1, "attack", 1.0)], EVIDENCE)
    merged = L.merge_log(log, spark.createDataFrame([("s", 1, "attack", 1.0), ("s", 2, "attack", 1.0)], EVIDENCE))
    assert L.ledger_counters(merged).first().confirmed_attack == 2.0


def sequential(events, threshold, start, policy):
    """The decision loop one event at a time, with ledger feedback; returns playbooks and end states."""
    states, out = dict(start), {}
    for e in sorted(events, key=lambda r: r.seq):
        if not e.fused_risk > threshold:
            out[e.event_id] = "LOG_ONLY"
            continue
        state = states.get(e.signature, (0.0, 0.0, 0.0, "monitoring"))
        memory = {"quarantined": -.4, "allowlisted": .15}.get(state[3], state[2])
        score = max(0.0, min(1.0, round(e.base + memory, 6)))
        if score >= .4 and e.fused_risk < .85:
            out[e.event_id] = "ALLOW"
        elif state[3] == "quarantined":
            out[e.event_id] = "NETWORK_ISOLATION"
        else:
            out[e.event_id] = e.native
        if out[e.event_id] in ("NETWORK_ISOLATION", "RATE_LIMIT_DOS"):
            state = walk([("attack", min(1.0, max(.1, e.fused_risk)))], state)[-1]
        states[e.signature] = state
    return out, states


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_replay_equals_sequential_loop_from_any_ledger(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = []
    for i in range(1500):
        service = rng.choice(["http", "dns", "-"])
        rows.append(row(i, service=service, threat=rng.choice(["Normal", "Exploits", "DoS"]), dstip=rng.choice([None, "10.0.0.1"]),
                        fused=round(rng.choice([rng.random(), rng.uniform(.6, .9)]), 3), cat=rng.choice([.1, .9])))
    events = frame(spark, rows).drop("trust_bias", "status", "confirmed_normal", "confirmed_attack")
    policy = Policy.of()
    probe = with_trust(events, policy, detail=False).withColumn("native", native_route(threshold)["playbook"])
    # The unclamped score before ledger factors equals the clamped one here: no row falls below zero.
    listed = probe.select("event_id", "seq", "signature", "fused_risk", "native", F.col("trust_score").alias("base")).collect()
    assert min(r.base for r in listed) > 0
    names = sorted({r.signature for r in listed})
    start = {}
    for s in names:
        start[s] = rng.choice([(0.0, 0.0, 0.0, "monitoring"), (4.0, 0.2, .15, "allowlisted"), (0.1, 3.0, -.4, "quarantined"),
                               (1.0, 1.0, .2, "monitoring"), (0.2, 1.2, -.05, "monitoring"), (3.5, 2.5, -.28, "monitoring")])
    before = spark.createDataFrame([(s, *start[s], 0) for s in names[::2]], LEDGER)
    want, states = sequential(listed, threshold, {s: start[s] for s in names[::2]}, policy)
    done = replay(events.repartition(5), threshold, policy, before)
    assert {r.event_id: r.playbook for r in done.decisions.collect()} == want
    after = {r.signature: r for r in done.ledger.collect()}
    for s, state in states.items():
        if s in after:
            r = after[s]
            assert r.status == state[3], s
            assert (r.confirmed_normal, r.confirmed_attack, r.trust_bias) == pytest.approx(state[:3], abs=1e-9), s
        else:
            assert state[1] == 0.0


def test_snapshot_uses_the_ledger_before_the_batch(spark):
    events = frame(spark, [row(i, threat="Exploits", fused=.95) for i in range(5)]).drop(
        "trust_bias", "status", "confirmed_normal", "confirmed_attack")
    empty = spark.createDataFrame([], LEDGER)
    branches = {r.branch for r in snapshot_decisions(events, .5, Policy.of(), empty).collect()}
    assert branches == {"responder"}
    assert "quarantine" in {r.branch for r in replay(events, .5, Policy.of()).decisions.collect()}
