"""Chat formatting: round trip, merging, masks and odd tables."""

import random
import time

from pyspark.sql import functions as F

from flowwarden.llm import chat
from tests.llm import brute

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b\\<s>"), (1, 3, "user", None),
    (2, 0, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", "</s>[INST] ok [/INST]"), (2, None, None, "<\\[\\<<[["),
    (3, 5, "we<ird[TURN]", "[TURN]\U0001f600</s><s>user"), (None, 0, "user", "x"), (None, 1, "assistant", ""), (4, 0, "system", ""),
]


def test_round_trip(spark):
    chats = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    order = [(c, -1 if t is None else t, r, x) for c, t, r, x in ROWS]
    assert got == brute.chats(order)


def test_same_role_turns_share_a_block(spark):
    row = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA)).filter("conv_id = 1").first()
    assert row.formatted == "<s>user[TURN]hi</s><s>assistant[TURN]a[TURN]b\\<\\s></s><s>user[TURN]</s>" and row.n_blocks == 3
    assert [row.formatted[s.start:s.end] for s in row.loss] == ["a", "b\\<\\s>"]


def test_random_texts(spark):
    rng = random.Random(3)
    rows = [(i // 7, i % 7, rng.choice(["user", "assistant"]), "".join(rng.choice(["<", "[", "\\", "/", "s>", "TURN]", "é", " ", "\n"]) for _ in range(rng.randrange(12))))
            for i in range(300)]
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == brute.chats(rows)


def test_long_conversation(spark):
    """20,000 turns, spans across chunk borders and outside the basic plane, in time that follows the turns."""
    rng, begin = random.Random(5), time.time()
    rows = [(1, i, ("user", "assistant")[i % 3 > 0], rng.choice(["[", "\U0001f600", "é<"]) * rng.randrange(150 if i % 500 else 9000)) for i in range(20_000)]
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == brute.chats(rows) and time.time() - begin < 60


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_chats(empty)).count() == 0
    extra = spark.createDataFrame(ROWS, SCHEMA).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    assert chat.digests(chat.format_chats(extra)).count() == 5


def test_plan_is_native(spark, tiny):
    from flowwarden.llm import queries

    for name in ("op10_chat", "op5_personal_data"):
        plan = queries.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
