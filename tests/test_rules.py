"""Conditions, model answers and the rule lifecycle."""

import random

import pytest
from pyspark.sql import functions as F

from flowwarden.functions import conditions, responses
from flowwarden.operators import rules

SCHEMA = "id string, seq long, condition string, playbook string"


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text,want", [
    ('IF proto == "tcp" AND state == "FIN"', "proto = tcp AND state = FIN"),
    ("if  proto=tcp   AND\tstate='FIN' ", "proto=tcp AND\tstate=FIN"),
    ('proto=\\"tcp\\"', "proto=tcp"), ("IFFY=1", "IFFY=1"), ("", ""),
])
def test_normalise_condition(spark, text, want):
    assert one(spark, text, conditions.normalise_condition) == want


@pytest.mark.parametrize("text,want", [
    ("Rule 5 and FN_PATCH_002", "FN_PATCH_002"), ("learned_07 here", "LEARNED_07"), ("see rule #4.", "NATIVE_RULE_4"),
    ("overrule 4", None), ("rule four", None), ("", None),
])
def test_implicated_rule(spark, text, want):
    assert one(spark, text, conditions.implicated_rule) == want


def test_clauses_keep_words_that_contain_and(spark):
    got = one(spark, "service=BRAND AND state = INT AND state=int AND ", conditions.clauses)
    assert got == ["service=brand", "state=int"]


def test_decisions_from_answers(spark):
    answers = [
        ('<think>a {"x":1}</think>\n{"reasoning":"ok","playbook":"ALLOW","is_false_positive":true}', ("ALLOW", True, False)),
        ('<think>never ends {"playbook":"ALLOW"}', ("NETWORK_ISOLATION", False, True)),
        ('text {"playbook":"STEP_UP_AUTH"} tail', ("STEP_UP_AUTH", False, False)),
        ('{"a":1} and {"b":2}', ("NETWORK_ISOLATION", False, True)),
        ("no json", ("NETWORK_ISOLATION", False, True)),
        (None, ("NETWORK_ISOLATION", False, True)),
        ('{"reasoning":"no playbook"}', (None, False, False)),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, t string")
    got = df.select("i", responses.decision_from_response(F.col("t")).alias("d")).orderBy("i").collect()
    assert [(r.d.playbook, r.d.is_false_positive, r.d.is_llm_failsafe) for r in got] == [w for _, w in answers]


def test_rules_from_answers(spark):
    answers = [
        ('```json\n{"id":"A","condition":"IF x == 1","playbook":"ALLOW","is_fp":true}\n```', ("A", "x = 1", "ALLOW")),
        ('{"id":"B","condition":"x=1","playbook":"NETWORK_ISOL', ("B", "x=1", "NETWORK_ISOL")),
        ('<think>t</think>{"id":"C","condition":"y=2"', ("C", "y=2", None)),
        ('{"id":"D","nest":{"k":1', ("D", "", None)),
        ("[1, 2]", None), ("nothing", None), ('<think>open {"id":"E"}', None), (None, None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, t string")
    got = df.select("i", responses.rule_from_response(F.col("t")).alias("r")).orderBy("i").collect()
    assert [None if r.r is None else (r.r.id, r.r.condition, r.r.playbook) for r in got] == [w for _, w in answers]


# The learned rules of the saved list, oldest first.
SAVED = [("FN_PATCH_001", 1, "proto=udp AND state=INT", "NETWORK_ISOLATION"),
         ("FN_PATCH_002", 2, "proto=udp AND state=INT AND service=- AND dpkts=0", "NETWORK_ISOLATION"),
         ("FN_PATCH_003", 3, "proto=tcp AND state=FIN AND spkts=10.0", "NETWORK_ISOLATION"),
         ("FN_PATCH_004", 4, "proto=tcp AND state=FIN AND threat_class=Normal", "NETWORK_ISOLATION"),
         ("LEARNED_005", 5, "proto=tcp AND service=http AND state=FIN AND spkts=10.0 AND dpkts=10.0", "ALLOW")]


def test_saved_list_in_both_modes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    fresh = spark.createDataFrame(SAVED, SCHEMA)
    observed = {r.id: r.action for r in rules.insert_rules(empty, fresh, "observed").collect()}
    assert set(observed.values()) == {"inserted"}
    intended = {r.id: r.action for r in rules.insert_rules(empty, fresh).collect()}
    assert intended.pop("FN_PATCH_002") == "covered" and set(intended.values()) == {"inserted"}


def insert_one_by_one(old, new):
    """Sequential insertion in which a broader rule replaces every narrower one of its playbook."""
    def clause_set(c):
        return frozenset(x.strip().lower() for x in c.split(" AND ") if x.strip())
    live, texts, fate = [], set(), {}
    for is_old, (i, _, cond, playbook) in [(True, r) for r in old] + [(False, r) for r in new]:
        if cond.lower() in texts and not is_old:
            fate[i] = "identical"
            continue
        texts.add(cond.lower())
        mine = clause_set(cond)
        if not is_old and any(p == playbook and s <= mine for _, s, p in live):
            fate[i] = "covered"
            continue
        for other, s, p in [] if is_old else list(live):  # existing rules were listed before the batch
            if p == playbook and mine < s:
                fate[other] = "replaced"
                live = [x for x in live if x[0] != other]
        fate[i] = "kept" if is_old else "inserted"
        live.append((i, mine, playbook))
    return fate


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_insertion_equals_sequential(spark, seed):
    rng = random.Random(seed)
    made, texts = [], set()
    for n in range(160):
        size = rng.randint(1, 4) if n % 40 else 14  # some rules are too long for subset keys
        fields = rng.sample("abcdefghijklmnop", size) if size == 14 else rng.sample("abcd", size)
        cond = " AND ".join(f"{f}={rng.randint(0, 1) if size < 14 else 0}" for f in sorted(fields))
        if n < 40 and cond in texts:
            continue
        texts.add(cond)
        made.append((f"r{n}", n, cond, rng.choice(["ALLOW", "NETWORK_ISOLATION"])))
    old, new = [r for r in made if r[1] < 40], [r for r in made if r[1] >= 40]
    got = {r.id: r.action for r in rules.insert_rules(
        spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA).repartition(4)).collect()}
    assert got == insert_one_by_one(old, new)


def test_long_rules_meet_through_their_rarest_clause(spark):
    long_rule = " AND ".join(f"f{i}=1" for i in range(20))
    df = spark.createDataFrame([("long", 1, long_rule, "ALLOW"), ("a", 2, "f3=1 AND f7=1", "ALLOW"), ("b", 3, "f3=1 AND zz=1", "ALLOW"),
                                ("longer", 4, long_rule + " AND g=1", "ALLOW")], SCHEMA)
    got = {(r.broader, r.narrower) for r in rules.overlaps(df).collect()}
    assert got == {("a", "long"), ("a", "longer"), ("long", "longer")}


def test_match_prefers_newest_and_compares_numbers(spark):
    df = spark.createDataFrame([("old", 2, "proto=tcp", "ALLOW"), ("new", 1, "PROTO=TCP AND spkts=10.0", "NETWORK_ISOLATION"),
                                ("other", 0, "proto=tcp AND unknown_field=1", "ALLOW"), ("bad", -1, "", "ALLOW")],
                               "id string, ord long, condition string, playbook string")
    events = spark.createDataFrame([(1, "tcp", 10), (2, "tcp", 11), (3, "udp", 10)], "e int, proto string, spkts int")
    got = rules.match_rules(events, df, {"proto": F.col("proto"), "spkts": F.col("spkts")}).orderBy("e").collect()
    assert [r.rule_id for r in got] == ["new", "old", None]
    none = rules.match_rules(events, df.filter("id = 'bad'"), {"proto": F.col("proto")})
    assert {r.rule_id for r in none.collect()} == {None}


def test_compaction_and_small_lists(spark):
    big = spark.createDataFrame([(f"r{i}", i, f"a={i}", "ALLOW") for i in range(23)], SCHEMA)
    kept = {r.seq for r in rules.compact_rules(big).collect()}
    assert kept == set(range(5, 23))
    assert rules.compact_rules(big.filter("seq < 22")).count() == 22
    assert {r.seq for r in rules.compact_rules(big, mode="observed").collect()} == set(range(18))


def test_consolidation(spark):
    rows = [("a", 1, "proto=tcp AND state=FIN AND threat_class=DoS AND spkts=2", "ALLOW", "2"),
            ("b", 2, "proto=tcp AND state=FIN AND threat_class=DoS AND spkts=3", "ALLOW", "1"),
            ("c", 3, "proto=tcp AND state=FIN AND threat_class=DoS AND spkts=3", "NETWORK_ISOLATION", "1"),
            ("d", 4, "proto=tcp", "ALLOW", "1")]
    df = spark.createDataFrame(rows, SCHEMA + ", created_at string")
    got = {r.id: (r.condition, r.merged) for r in rules.consolidate_rules(df).collect()}
    assert got == {"b": ("proto=tcp AND state=fin AND threat_class=dos", 2), "c": ("proto=tcp AND spkts=3 AND state=fin AND threat_class=dos", 1),
                   "d": ("proto=tcp", 1)}
    assert {r.id for r in rules.consolidate_rules(df.limit(2)).collect()} == {"a", "b"}


def test_stored_health_is_the_health_of_the_whole_log(spark, tmp_path):
    """Batches that run again or bring old incidents once more leave the same tables."""
    from flowwarden.operators import rules
    from flowwarden.plans.corrections import store_corrections, stored_health

    shape = "event_id long, implicated string, reasoning string, corrected_at string"
    log = [[(i, None if i % 5 == 0 else f"R{i % 3}", f"why {i}" * 40, f"2024-01-{1 + i % 9:02d}") for i in range(k, k + 12)] for k in (0, 12, 24)]
    log[2] += log[0][:4] + log[2][-2:]
    root = str(tmp_path / "log")
    known = spark.createDataFrame([("R1", 1, "proto=tcp"), ("R1", 2, "proto=udp")], "id string, seq long, condition string")

    def run(batch_id):
        store_corrections(spark.createDataFrame(log[batch_id], shape), root, batch_id)
        return sorted(map(str, stored_health(spark, root, known).collect()))

    run(0)
    once, again = run(1), run(1)
    assert once == again
    last = run(2)
    whole = spark.createDataFrame([(r, e, t, at) for batch in log for e, r, t, at in batch if r], "rule_id string, event_id long, reasoning string, recorded_at string")
    assert last == run(2) == sorted(map(str, rules.rule_health(whole, known, rules.native_table(spark)).collect()))
    store_corrections(spark.createDataFrame([], shape), root, 3)
    assert sorted(map(str, stored_health(spark, root, known).collect())) == last
    assert spark.read.parquet(f"{root}/corrections").count() == 12 + 12 + 18


def test_documents_of_corrections_are_made_once(spark, tmp_path):
    """Counting the stored documents joins and parses nothing again."""
    from flowwarden.catalog import rulebook

    rows = [(i, "2024-01-%02d 05:00:00" % (1 + i % 20), i % 40, ("click", "purchase", "view")[i % 3], 1.0, '{"k": %d}' % (i % 100)) for i in range(400)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    counted = rulebook.vec_stats(spark, str(tmp_path))
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {r.collection for r in counted.collect()} == {"correction_analyses", "incident_summaries", "synthesized_rules"}
