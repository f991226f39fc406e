"""Chat formatting with Spark expressions only.

The turns of a conversation are put in order, collected as structs, sorted and merged: adjacent turns of one role share one
block. A formatted conversation is a concatenation of blocks

    <s>ROLE[TURN]text[TURN]text…</s>

Every control string begins with `<` or `[`. Inside roles and texts a backslash is put after each of these
two characters, so no control string can occur there; taking it out again restores the text exactly.
The loss mask is an array of code-point spans of the formatted text, one per assistant text.

Defined results: a null text is empty; a null role is the empty role; rows of equal turn number are
ordered by role, then text, and null turn numbers come first; repeated rows are repeated turns; a null
conversation id is a conversation of its own; an empty table gives no rows; other columns are ignored. A
conversation becomes one string, so its length is the unit of memory, as in every chat format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, TURN, CLOSE = "<s>", "[TURN]", "</s>"
LEARNED = "assistant"
#: Code points of a chunk that loss spans are read from.
CHUNK = 2048


def escape(text: Column) -> Column:
    """Put a backslash after every `<` and `[`."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learned: str = LEARNED) -> DataFrame:
    """One row per conversation: id, formatted text, loss spans (start, end) and number of blocks.

    A window over the turns of a conversation gives every turn its neighbours' roles and the length of all text before it, so
    blocks and spans cost one sort, whatever the number of turns; the turns' pieces are then concatenated in order.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    seen = rows.select(
        "conv_id", "role", escape(F.col("role")).alias("name"), escape(F.col("text")).alias("body"),
        F.row_number().over(order).alias("place"), F.lag("role").over(order).alias("earlier"), F.lead("role").over(order).alias("later"))
    opens = F.col("earlier").isNull() | (F.col("earlier") != F.col("role"))
    closes = F.col("later").isNull() | (F.col("later") != F.col("role"))
    cut = seen.select(
        "conv_id", "place", "body", (F.col("role") == learned).alias("learned"), opens.cast("long").alias("opens"),
        F.concat(F.when(opens, F.concat(F.lit(OPEN), F.col("name"))).otherwise(F.lit("")), F.lit(TURN)).alias("head"),
        F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"))
    sizes = {c: F.length(c).cast("long") for c in ("head", "body", "tail")}
    before = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(sizes["head"] + sizes["body"] + sizes["tail"]).over(before), F.lit(0).cast("long")) + sizes["head"]
    placed = cut.select("conv_id", "place", "learned", "opens", F.concat("head", "body", "tail").alias("piece"),
                        start.alias("start"), (start + sizes["body"]).alias("end"))
    whole = F.struct("place", "piece", "learned", "start", "end")
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(whole)).alias("turns"), F.sum("opens").alias("n_blocks"))
    return gathered.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"], t["end"])).alias("loss"), "n_blocks")


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), r"\[TURN\]", -1))
    return F.flatten(F.transform(parsed, lambda parts: F.transform(
        F.slice(parts, 2, F.size(parts) - 1),
        lambda body: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(body).alias("text")))))


def loss_text(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask.

    Finding a code point in a string reads it from its beginning, so the text is cut into chunks once and each span
    reads only the chunks it lies in.
    """
    def read(chunks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / CHUNK).cast("int")
        last = F.floor((s["end"] - 1) / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return unescape(F.substr(near, (s["start"] - first * CHUNK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    cut = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    # As the element of an array the chunks are made once, not again for every span.
    return F.get(F.transform(F.array(cut), lambda chunks: F.array_join(F.transform(loss, lambda s: read(chunks, s)), "")), 0)


def digests(chats: DataFrame) -> DataFrame:
    """Turn and loss digests of formatted conversations, read back from the formatted text and mask alone."""
    read = chats.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"),
                        loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
