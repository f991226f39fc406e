"""The prompt table: near rules and corrections, evidence block, assigned ids."""

import pytest
from pyspark.sql import functions as F

from flowwarden.operators import vectors
from flowwarden.plans import prompts
from flowwarden.plans.prompts import prompt_table

EVENT = """event_id long, seq long, signature string, threat string, fused_risk double, cat_risk double, anomaly_risk double,
proto string, service string, state string, spkts long, dpkts long, incident_entropy double"""
LEDGER = "signature string, confirmed_normal double, confirmed_attack double, trust_bias double, status string"
MEMORY = "collection string, doc_id string, document string, embedding array<double>"


def rows(spark):
    events = [(i, i, "s" if i else None, "DoS", 0.9, 0.5, 0.1, "tcp", None, "FIN", 5, 1, None) for i in range(4)]
    frame = spark.createDataFrame(events, EVENT)
    records = frame.filter("event_id > 0").withColumns({
        "ledger_signature": F.col("signature"), "mistake": F.when(F.col("event_id") == 1, "FN").otherwise("FP"),
        "playbook": F.lit("ALLOW"), "reasoning": F.lit("why"),
        "analysis": F.when(F.col("event_id") != 2, "a cause").otherwise(vectors.NO_SIGNAL + " here")})
    ledger = spark.createDataFrame([("s", 1.0, 2.0, -0.1, "monitoring")], LEDGER)
    return frame, records, ledger


def test_sections_and_ceilings(spark):
    frame, records, ledger = rows(spark)
    key = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    frame, records = (f.withColumn("memory_key", key) for f in (frame, records))
    asked = spark.createDataFrame([("v1", [1.0, 0.0]), ("v3", [0.0, 1.0])], "id string, embedding array<double>")
    # Cosine distances to v1: 0, 0.4, 0.68; the last passes the ceiling of corrections only.
    memory = spark.createDataFrame(
        [(c, f"{c[:1]}{i}", f"{c[:1]}{i} " + "x" * 300, v) for c in (vectors.RULES, vectors.CORRECTIONS)
         for i, v in enumerate([[1.0, 0.0], [0.6, -0.8], [0.32, -0.9474175]]) if not (c == vectors.CORRECTIONS and i == 1)], MEMORY)
    got = {(r.kind, r.event_id): r for r in prompt_table(frame, records, ledger, memory, 0.5, 7, asked).collect()}
    assert len(got) == 4 + 3 + 2
    near = [x for x in got["response", 1].system_prompt.split("\n") if x.startswith("  - s")]
    assert [x[4:6] for x in near] == ["s0", "s1"] and all(len(x) == 4 + 180 for x in near)
    prior = [x for x in got["audit", 1].user_prompt.split("\n") if x.startswith("  - c")]
    assert [x[4:6] for x in prior] == ["c0", "c2"] and all(len(x) == 4 + 200 for x in prior)
    for kind in ("response", "audit"):  # a vector with nothing near, and none at all
        for event in (2, 3):
            text = got[kind, event].system_prompt + got[kind, event].user_prompt
            assert "  - s" not in text and "  - c" not in text
    assert "BEHAVIORAL HISTORY" not in got["response", 0].system_prompt  # null signature
    assert "Seen 3 time(s)" in got["rule", 1].user_prompt and "Seen 3 time(s)" in got["audit", 3].user_prompt
    assert got["rule", 1].user_prompt.startswith("Rule id to assign: FN_PATCH_008\n")
    assert got["rule", 3].user_prompt.startswith("Rule id to assign: LEARNED_009\n")


def test_default_encoder_and_empty_sides(spark):
    frame, records, ledger = rows(spark)
    text = "threat=DoS fused_risk=0.9 cat_risk=0.5 anomaly_risk=0.1 proto=tcp service=? state=FIN spkts=5 dpkts=1"
    memory = vectors.embed(spark.createDataFrame([(vectors.RULES, "r", text, "m")], "collection string, doc_id string, document string, m string"), "document")
    got = prompt_table(frame, records, ledger, memory.drop("m"), 0.7889).collect()
    assert all("LEARNED RULES" in r.system_prompt and "0.7889" in r.system_prompt for r in got if r.kind == "response")
    bare = prompt_table(frame, records, ledger.limit(0), memory.drop("m").limit(0), 0.5).collect()
    assert len(bare) == len(got) and not any("LEARNED RULES" in r.system_prompt or "Seen" in r.user_prompt for r in bare)
    assert prompt_table(frame.limit(0), records.limit(0), ledger, memory.drop("m"), 0.5).collect() == []


def test_lines_found_once_serve_every_table(spark, monkeypatch):
    """Tables of two thresholds share one search, and equal those that search for themselves."""
    frame, records, ledger = rows(spark)
    text = "threat=DoS fused_risk=0.9 cat_risk=0.5 anomaly_risk=0.1 proto=tcp service=? state=FIN spkts=5 dpkts=1"
    memory = vectors.embed(spark.createDataFrame(
        [(vectors.RULES, "r", text), (vectors.CORRECTIONS, "c", text)], "collection string, doc_id string, document string"), "document")
    alone = [sorted(prompt_table(frame, records, ledger, memory, t).collect()) for t in (0.5, 0.7889)]
    asked = prompts.asked_texts(frame, records)
    lines = prompts.memory_lines(asked, memory)
    frame, records = (f.withColumn(prompts.KEY, prompts.text_key()) for f in (frame, records))
    monkeypatch.setattr(vectors, "nearest", None)
    shared = [sorted(prompt_table(frame, records, ledger, memory, t, 0, asked, lines).collect()) for t in (0.5, 0.7889)]
    assert shared == alone and "SIMILAR PAST CORRECTIONS" in str(shared) and "LEARNED RULES" in str(shared)


@pytest.fixture(scope="module")
def small_tables(tmp_path_factory):
    """600 events, and vectors of which one only has an id divisible by 100; vectors of equal parity are alike."""
    import pandas as pd

    folder = tmp_path_factory.mktemp("events")
    ids = range(600)
    pd.DataFrame({"event_id": ids, "ts": pd.to_datetime("2024-01-09") + pd.to_timedelta([97 * i for i in ids], unit="s"),
                  "user_id": [(i * 37) % 1500 for i in ids], "event_type": [("click", "purchase", "signup", "view")[i % 4] for i in ids],
                  "value": 1.0, "props": ['{"k": %d}' % (i * 7 % 100) for i in ids]}).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    pd.DataFrame({"vec_id": range(50), "label": 0, "embedding": [[1.0, 0.1 * (i % 2), 0.01 * i] for i in range(50)]}).to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["enriched_prompts"])
def test_every_text_searches_the_memory(spark, small_tables, name):
    """The memory lies near every event, so prompts of all events have its lines, whatever their ids."""
    from flowwarden.catalog import load
    from flowwarden.operators.corrections import NEAR_HEAD, PRIOR_HEAD

    rows = load()[0][name](spark, small_tables).collect()
    response, audit = ([r for r in rows if r.kind == k and r.event_id % 50] for k in ("response", "audit"))
    assert response and all(NEAR_HEAD in r.system_prompt for r in response)
    assert audit and all(PRIOR_HEAD in r.user_prompt for r in audit)


def test_every_event_asks(spark, small_tables, monkeypatch):
    """The query searches for the text of every escalated event and record; what is stored for that are texts, not vectors."""
    from flowwarden.catalog import load, rulebook

    given, kept = [], []
    monkeypatch.setattr(rulebook, "memory_lines", lambda asked, held: given.append(asked) or prompts.memory_lines(asked, held))
    monkeypatch.setattr(prompts, "materialise", lambda df: kept.append(df.columns) or df, raising=False)
    rows = load()[0]["prompts"](spark, small_tables).filter("kind = 'response'").count()
    events = rulebook.inputs.contexts(spark, small_tables).filter("fused_risk > 0.5")
    texts = {r[0] for r in events.select(prompts.text_key()).collect()}
    assert rows and texts <= {r.id for r in given[0].select("id").collect()} and kept == [[prompts.KEY, "_text"]]
