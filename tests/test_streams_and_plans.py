"""Streams equal batches, retries are harmless, plans keep their shape, files round-trip."""

import json

import pytest
from pyspark.sql import functions as F

from flowwarden import Policy
from flowwarden.catalog import inputs, load
from flowwarden.operators import ledger, rules, vectors
from flowwarden.operators.decide import gated
from flowwarden.schemas import LEDGER, RULE, VECTOR
from flowwarden.sources import documents, flows, tables
from flowwarden.streaming import live


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


QUERIES, ORACLES = load()
HEAVY = {"trained_scores", "oof_scores", "threat_model", "live_decisions", "live_corrected", "playbook_sink", "live_scores"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_no_query_pairs_everything_with_everything(name, spark, tiny):
    text = plan(QUERIES[name](spark, tiny))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_gate_reaches_the_scan_and_columns_are_pruned(spark, tiny):
    df = inputs.contexts(spark, tiny).filter(gated(F.col("fused_risk"), .5)).select("event_id", "fused_risk")
    text = plan(df)
    assert "ReadSchema: struct<event_id:bigint,fused_risk:double>" in text
    decided = inputs.decisions(spark, tiny, .5).select("event_id", "playbook")
    assert "Exchange" not in plan(decided) and "html" not in plan(decided)


def test_top_rows_are_cut_before_the_shuffle(spark, tiny):
    evidence = inputs.truth_evidence(spark, tiny)
    assert "WindowGroupLimit" in plan(ledger.crossings(evidence))
    d = inputs.decisions(spark, tiny, .5, detail=True)
    assert "WindowGroupLimit" in plan(ledger.trust_history(d))


def test_live_stream_retry_and_redelivery(spark, tiny, tmp_path):
    events = inputs.contexts(spark, tiny).filter("seq < 300")
    source = str(tmp_path / "in")
    events.unionByName(events.filter("seq % 5 = 0")).coalesce(1).write.parquet(source)
    root = str(tmp_path / "live")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        live.live_decisions(stream, root, .5, Policy.of(), once=True).awaitTermination()
        return spark.read.parquet(f"{root}/decisions").count(), spark.read.parquet(f"{root}/actions").count()

    first = run()
    assert first[0] == 300
    assert run() == first
    before = tables.read_snapshot(spark, f"{root}/ledger", LEDGER)
    assert before.count() > 0 and before.filter("confirmed_attack <= 0").count() == 0
    assert tables.read_snapshot(spark, f"{root}/ledger", LEDGER, before=0).count() == 0


def test_late_and_redelivered_events(spark, tiny, tmp_path):
    """Events that come a batch late are decided once; re-deliveries across files and rows without id are told apart."""
    events = inputs.contexts(spark, tiny).filter("seq < 200")
    source, root = str(tmp_path / "in"), str(tmp_path / "live")
    late = F.col("seq") % 9 == 0
    events.filter(~late).repartition(1).write.parquet(source)
    events.filter(late | (F.col("seq") % 4 == 0)).repartition(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        live.live_decisions(stream, root, .5, Policy.of(), once=True, label="label").awaitTermination()
    done = spark.read.parquet(f"{root}/decisions")
    assert sorted(r.event_id for r in done.select("event_id").collect()) == sorted(r.event_id for r in events.select("event_id").collect())
    nameless = events.withColumn("event_id", F.lit(None).cast("bigint"))
    assert live.unseen(nameless, f"{root}/decisions", 9).count() == 200


def test_null_keys_keep_their_rows(spark):
    from flowwarden.operators import ordered, sampling

    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"k{i % 3}", float(i)) for i in range(40)], "seq bigint, k string, v double")
    assert ordered.trailing_mean(rows, "v", "seq", "m", 3, ["k"]).count() == 40
    assert sampling.stratified_folds(rows, "k", "seq").count() == 40
    assert sampling.stratified_holdout(rows, "k", "seq", 0.2).count() == 40
    assert ordered.exact_percentiles(rows, ["k"], "v", [0.5]).count() == 4


def test_percentiles_order_only_a_bracket(spark):
    import numpy as np

    from flowwarden.operators import ordered

    rng = np.random.default_rng(1)
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    for n in (3, 9_999, 30_000):
        values, groups = np.round(rng.normal(size=n), 3), rng.integers(0, 2, n)
        rows = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "k int, v double")
        for r in ordered.exact_percentiles(rows, ["k"], "v", shares).collect():
            assert np.allclose(list(r)[1:], np.quantile(values[groups == r.k], shares))
        assert np.allclose(list(ordered.exact_percentiles(rows, [], "v", shares).first()), np.quantile(values, shares))


def test_forest_samples_do_not_depend_on_reach(spark):
    from flowwarden.models.forest import tree_samples

    points = spark.range(900).select(F.col("id").alias("seq"), F.array(F.col("id").cast("double")).alias("x"))
    whole = {tuple(r[:2]): r.x for r in tree_samples(points, 3, 8, reach=1000).collect()}
    near = {tuple(r[:2]): r.x for r in tree_samples(points, 3, 8, reach=1).collect()}
    assert whole == near and len(whole) == 24
    few = {tuple(r[:2]): r.x for r in tree_samples(points.filter("seq < 5"), 2, 8).collect()}
    assert few == {(t, i): [float(i)] for t in range(2) for i in range(5)}


def test_missing_files_give_the_defaults(spark, tmp_path):
    gone = str(tmp_path / "none.json")
    assert documents.read_documents(spark, gone).count() == 0 and documents.ledger_of(documents.read_documents(spark, gone)).count() == 0
    assert [r.kind for r in documents.load_rules(spark, gone).collect()] == ["native"] * 7
    assert {r.playbook: len(r.steps) for r in documents.load_playbooks(spark, gone).collect()} == {
        "ALLOW": 2, "LOG_ONLY": 1, "STEP_UP_AUTH": 3, "NETWORK_ISOLATION": 5, "RATE_LIMIT_DOS": 3}
    record = documents.read_threshold(spark, gone).first()
    assert record.optimal_threshold == 0.5 and record.is_fallback
    book = {"routing_rules": ["1. IF x"], "rule_audit": [], "HOLD": {"description": "wait", "steps": [{"tool": "T", "action": "a", "level": 3}, {"tool": "U", "action": "b"}]}}
    (tmp_path / "book.json").write_text(json.dumps(book, indent=2))
    row = documents.load_playbooks(spark, str(tmp_path / "book.json")).first()
    assert (row.playbook, row.description) == ("HOLD", "wait")
    assert [(x.step, x.tool, x.action, x.args) for x in row.steps] == [(1, "T", "a", {"level": "3"}), (2, "U", "b", {})]


def test_snapshot_without_success_mark_is_ignored(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshot(spark.range(3), path, 1)
    tables.write_snapshot(spark.range(5), path, 2)
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    schema = spark.range(1).schema
    assert tables.read_snapshot(spark, path, schema).count() == 3


def test_csv_spellings_of_null(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("id,proto,rate,attack_cat,label\n1,tcp,1.5,NA,0\n2,null,nan,DoS,1\n3,-,abc,,0\n")
    df = flows.read_flows(spark, str(p), "id bigint, proto string, rate double, attack_cat string, label int")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "tcp", 1.5, None, 0), (2, None, None, "DoS", 1), (3, "-", None, None, 0)]
    split = flows.split_labels(df)
    assert "id" not in split.columns and {r.attack_cat for r in split.collect()} == {"Normal", "DoS"}
    assert flows.column_roles(split) == (["proto"], ["rate"])


def test_saved_documents_load(spark, tmp_path):
    memory = {"dynamic_allowlist": [], "active_quarantines": ["q"], "trust_scores": {
        "q": {"latest": 0.2, "previous": None, "evaluated_at": "t", "violations": ["V"]}},
        "signatures": {"q": {"confirmed_normal": 0.0, "confirmed_attack": 3.0, "trust_bias": -0.4, "status": "quarantined", "last_updated": "t"}}}
    book = {"routing_rules": [{"id": "L1", "condition": "a=1", "playbook": "ALLOW", "is_fp": True}, "1. IF x"], "ALLOW": {"steps": []}}
    for name, doc in (("m", memory), ("p", book)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=4))
    m = documents.read_documents(spark, str(tmp_path / "m.json"))
    assert documents.ledger_of(m).first().status == "quarantined"
    assert documents.trust_history_of(m).first().violations == ["V"]
    r = documents.rules_of(documents.read_documents(spark, str(tmp_path / "p.json"))).orderBy("ord").collect()
    assert [(x.ord, x.kind, x.id, x.text) for x in r] == [(0, "learned", "L1", None), (1, "native", None, "1. IF x")]


def test_threshold_without_value_falls_back(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"soc_cost": 5}')
    r = documents.read_threshold(spark, str(tmp_path / "t.json")).first()
    assert (r.optimal_threshold, r.is_fallback) == (0.5, True)


def test_unreadable_log_lines_are_skipped(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"id": "a"}\n{broken\n{"id": "b"}\n')
    assert {r.id for r in tables.read_json_log(spark, str(tmp_path / "log.json"), RULE).collect()} == {"a", "b"}
    assert tables.read_log(spark, str(tmp_path / "missing"), RULE).count() == 0


def test_vector_store_round_trip_and_neighbours(spark, tmp_path):
    rows = [("synthesized_rules", f"d{i}", [float(i), 1.0], f"text {i}", {"rule_id": f"R{i}"}, i) for i in range(6)]
    v = spark.createDataFrame(rows, VECTOR)
    tables.write_vectors(v, str(tmp_path / "v"))
    back = tables.read_vectors(spark, str(tmp_path / "v"), VECTOR, vectors.RULES)
    assert back.count() == 6 and tables.read_vectors(spark, str(tmp_path / "v"), VECTOR, vectors.INCIDENTS).count() == 0
    q = spark.createDataFrame([("q", [0.0, 2.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    corpus = back.select(F.col("doc_id").alias("id"), "embedding")
    for kw in ({}, {"packed_rows": 3}, {"packed_rows": 0, "block_rows": 2}):
        got = vectors.nearest(q, corpus, 4, **kw).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.doc_id) for r in got] == [("q", f"d{i}") for i in range(4)] + [("z", f"d{i}") for i in range(4)]
    assert vectors.nearest(q, corpus.limit(0), 4).count() == 0


def test_documents_skip_what_carries_no_signal(spark, tiny):
    base = inputs.contexts(spark, tiny).filter("seq < 3").withColumns({
        "mistake": F.lit("FP"), "rule_id": F.lit(None).cast("string"), "corrected_at": F.lit("t"), "context_text": F.lit("ctx"),
        "analysis": F.when(F.col("seq") == 0, "").when(F.col("seq") == 1, "x LLM unavailable y").otherwise("real"),
        "is_llm_failsafe": F.col("seq") == 0, "playbook": F.lit("ALLOW"), "reasoning": F.lit("r")})
    assert vectors.correction_documents(base).count() == 1
    assert vectors.incident_documents(base).count() == 2
    assert rules.native_table(spark).count() == 7


def test_live_forest_scores_are_the_batch_scores(spark, tiny):
    """Points scored in three batches, some delivered again, give the scores and means of one batch."""
    from flowwarden.catalog import load
    queries = load()[0]
    want = {r.event_id: r.anomaly_risk for r in queries["forest_score"](spark, tiny).collect()}
    got = queries["live_forest_scores"](spark, tiny).orderBy("event_id").collect()
    assert [r.event_id for r in got] == sorted(want)
    values = [r.anomaly_risk for r in got]
    assert all(abs(v - want[r.event_id]) < 1e-6 for v, r in zip(values, got))
    for i, r in enumerate(got):
        last = values[max(0, i - 19):i + 1]
        assert abs(r.smoothed - sum(last) / len(last)) < 3e-6


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    """No single task writes an arrival; each is a micro-batch of its own, however many files it has."""
    from flowwarden.catalog import streams
    rows = spark.range(0, 900, 1, 6).selectExpr("id AS seq")
    seen = []

    def start(stream):
        def handle(batch, batch_id):
            seen.append((batch_id, batch.agg({"seq": "max"}).first()[0], batch.count()))
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "place")).trigger(availableNow=True).start()

    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: str(tmp_path / name))
    streams.arrive(spark, rows, start)
    assert seen == [(0, 299, 330), (1, 599, 360), (2, 899, 390)]
    assert len(list((tmp_path / "arrivals").glob("part-*.parquet"))) > streams.ARRIVALS
