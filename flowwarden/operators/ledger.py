"""Evidence ledger and trust history, set at a time.

An evidence log holds `signature, seq, verdict, confidence`; seq is unique per signature and rises
with arrival. Confidence is held in [0.05, 1], so the thresholds (3 normals, 2 attacks, 0.5 of
counter-evidence) are all crossed within the first `FIRST_ROWS` rows of a verdict. A signature's whole status
history follows from where four running sums cross:

    allowlisted  from N>=3 (if A<0.5 there) until A>=2
    quarantined  from A>=2 (if N<0.5 there) until N>=3

and a demoted signature is never promoted again, because both sums are large by then. The first
rows per signature and verdict are found with a group limit that runs before the shuffle, so a hot
signature sends that many rows per input task and not its history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.config import (
    ALLOW_EVIDENCE, BIAS_CEILING, BIAS_FLOOR, BIAS_STEP, COUNTER_EVIDENCE, MIN_CONFIDENCE,
    QUARANTINE_EVIDENCE, Policy,
)
from flowwarden.operators.ordered import SEQ_CHUNK, running_sums, seq_chunk
from flowwarden.session import broadcast_within, materialise

#: Rows of a verdict after which every threshold is crossed, whatever their confidence.
FIRST_ROWS = math.ceil(max(ALLOW_EVIDENCE, QUARANTINE_EVIDENCE, COUNTER_EVIDENCE) / MIN_CONFIDENCE) + 1
BROADCAST_SIGNATURES = 100_000
FOLD_BITS = 16
FOLD_LEVELS = 3


def held_confidence(confidence: Column) -> Column:
    return F.greatest(F.lit(MIN_CONFIDENCE), F.least(F.lit(1.0), confidence))


def crossings(evidence: DataFrame) -> DataFrame:
    """Per signature: seq at which N>=3, N>=0.5, A>=2 and A>=0.5 were first reached."""
    held = evidence.select(
        "signature", "verdict", "seq", held_confidence(F.col("confidence")).alias("confidence")
    )
    order = W.partitionBy("signature", "verdict").orderBy("seq")
    first = held.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= FIRST_ROWS)
    summed = first.withColumn(
        "_sum", F.sum("confidence").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )

    def reached(verdict: str, level: float) -> Column:
        return F.min(F.when((F.col("verdict") == verdict) & (F.col("_sum") >= F.lit(level)), F.col("seq")))

    return summed.groupBy("signature").agg(
        reached("normal", ALLOW_EVIDENCE).alias("n_full"),
        reached("normal", COUNTER_EVIDENCE).alias("n_some"),
        reached("attack", QUARANTINE_EVIDENCE).alias("a_full"),
        reached("attack", COUNTER_EVIDENCE).alias("a_some"),
    )


def _promoted(gain: Column, counter: Column) -> Column:
    return F.coalesce(gain < counter, gain.isNotNull())


def promoted_allow() -> Column:
    return _promoted(F.col("n_full"), F.col("a_some"))


def promoted_quarantine() -> Column:
    return _promoted(F.col("a_full"), F.col("n_some"))


def status_at(seq: Column) -> Column:
    """Status right after the evidence row `seq`, from crossing columns."""
    allow = promoted_allow() & (seq >= F.col("n_full")) & F.coalesce(seq < F.col("a_full"), F.lit(True))
    jail = promoted_quarantine() & (seq >= F.col("a_full")) & F.coalesce(seq < F.col("n_full"), F.lit(True))
    return F.when(allow, "allowlisted").when(jail, "quarantined").otherwise("monitoring")


def _after_last(seq_of_crossings: DataFrame) -> DataFrame:
    """Add the final status and `restart`: the demotion row after which the bias walk starts anew."""
    end = F.lit((1 << 63) - 1)
    return seq_of_crossings.withColumn("status", status_at(end)).withColumn(
        "restart",
        F.when(F.col("status") == "monitoring",
               F.when(promoted_allow(), F.col("a_full")).when(promoted_quarantine(), F.col("n_full"))),
    )


def ledger_counters(evidence: DataFrame) -> DataFrame:
    """Totals per signature; a plain aggregate, so it combines before the shuffle."""
    conf = held_confidence(F.col("confidence"))

    def total(verdict: str) -> Column:
        return F.sum(F.when(F.col("verdict") == verdict, conf).otherwise(F.lit(0.0)))

    return evidence.groupBy("signature").agg(
        total("normal").alias("confirmed_normal"),
        total("attack").alias("confirmed_attack"),
        F.max("seq").alias("last_seq"),
    )


def ledger_history(evidence: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """Running counters and status after every evidence row."""
    held = evidence.withColumn("confidence", held_confidence(F.col("confidence")))
    zero = F.lit(0.0)
    running = running_sums(held, ["signature"], ["seq"], seq_chunk("seq", width), {
        "confirmed_normal": F.when(F.col("verdict") == "normal", F.col("confidence")).otherwise(zero),
        "confirmed_attack": F.when(F.col("verdict") == "attack", F.col("confidence")).otherwise(zero),
    })
    joined = running.join(crossings(evidence), "signature")
    return joined.withColumn("status", status_at(F.col("seq"))).drop("n_full", "n_some", "a_full", "a_some")


def _then(first: Column, second: Column) -> Column:
    """Apply clamped shift `first`, then `second`: clip(clip(x+c1,l1,h1)+c2,l2,h2) as one clamped shift."""
    def through(bound: Column) -> Column:
        return F.greatest(second["lo"], F.least(second["hi"], bound + second["c"]))

    return F.struct(
        (first["c"] + second["c"]).alias("c"), through(first["lo"]).alias("lo"), through(first["hi"]).alias("hi")
    )


def fold_shifts(steps: DataFrame, key: str, levels: int = FOLD_LEVELS, bits: int = FOLD_BITS) -> DataFrame:
    """Compose clamped shifts `pos, c, lo, hi` per key in `pos` order.

    Level by level, 2^bits neighbouring positions fold into one; positions are unique per key, so no
    array is longer than that, however hot the key.
    """
    unit = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    current = steps.select(key, "pos", "c", "lo", "hi")
    for level in range(levels):
        last = level == levels - 1
        slot = F.lit(0).cast("long") if last else F.shiftright("pos", bits)
        gathered = current.groupBy(key, slot.alias("_slot")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "c", "lo", "hi"))).alias("_steps")
        )
        current = gathered.select(
            key, F.col("_slot").alias("pos"), F.aggregate("_steps", unit, _then).alias("_f")
        ).select(key, "pos", "_f.c", "_f.lo", "_f.hi")
    return current.drop("pos")


def walked_bias(evidence: DataFrame, ends: DataFrame) -> DataFrame:
    """Bias of monitoring signatures: the clamped walk over the rows after `restart`."""
    step = F.lit(BIAS_STEP) * held_confidence(F.col("confidence"))
    up = F.col("verdict") == "normal"
    open_ends = ends.filter(F.col("status") == "monitoring").select("signature", "restart")
    walking = evidence.join(broadcast_within(open_ends, BROADCAST_SIGNATURES), "signature").filter(F.col("restart").isNull() | (F.col("seq") > F.col("restart")))
    steps = walking.select(
        "signature", F.col("seq").alias("pos"),
        F.when(up, step).otherwise(-step).alias("c"),
        F.when(up, F.lit(float("-inf"))).otherwise(F.lit(BIAS_FLOOR)).alias("lo"),
        F.when(up, F.lit(BIAS_CEILING)).otherwise(F.lit(float("inf"))).alias("hi"),
    )
    folded = fold_shifts(steps, "signature")
    return folded.select("signature", F.greatest("lo", F.least("hi", F.col("c"))).alias("walked"))


def build_ledger(evidence: DataFrame, policy: Policy) -> DataFrame:
    """Final ledger of a whole evidence log. The crossings, one row per signature, are computed once."""
    ends = materialise(_after_last(crossings(evidence)))
    joined = ledger_counters(evidence).join(ends, "signature").join(walked_bias(evidence, ends), "signature", "left")
    bias = (
        F.when(F.col("status") == "allowlisted", F.lit(float(policy["allowlist_bonus"])))
        .when(F.col("status") == "quarantined", F.lit(-float(policy["quarantine_penalty"])))
        .otherwise(F.coalesce("walked", F.lit(0.0)))
    )
    return joined.select("signature", "confirmed_normal", "confirmed_attack",
                         bias.alias("trust_bias"), "status", "last_seq")


def merge_log(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append evidence, keeping one row per signature and seq so that a replayed batch counts once."""
    return log.unionByName(fresh).dropDuplicates(["signature", "seq"])


def lookup_ledger(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Left join by signature. The ledger side is unique, so a hot signature splits under skew join."""
    return events.join(
        ledger.select("signature", "confirmed_normal", "confirmed_attack", "trust_bias", "status"),
        "signature", "left",
    )


def trust_history(evaluated: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Latest and previous score per signature over escalated events; two rows per signature suffice."""
    order = W.partitionBy("signature").orderBy(F.col("seq").desc())
    last = evaluated.select("signature", "seq", "trust_score", "ts", "violations").withColumn(
        "_rn", F.row_number().over(order)
    ).filter(F.col("_rn") <= 2)

    def nth(n: int, name: str) -> Column:
        return F.max(F.when(F.col("_rn") == n, F.col(name)))

    latest = last.groupBy("signature").agg(
        nth(1, "trust_score").alias("latest"),
        nth(2, "trust_score").alias("previous"),
        nth(1, "ts").alias("evaluated_at"),
        F.max_by("violations", "seq").alias("violations"),
    )
    if earlier is not None:
        old = earlier.select("signature", F.col("latest").alias("_old"), F.struct("*").alias("_kept"))
        both = latest.join(old, "signature", "full")
        latest = both.select(
            "signature",
            F.coalesce("latest", "_old").alias("latest"),
            F.when(F.col("latest").isNull(), F.col("_kept.previous"))
            .otherwise(F.coalesce("previous", "_old")).alias("previous"),
            F.coalesce("evaluated_at", "_kept.evaluated_at").alias("evaluated_at"),
            F.coalesce("violations", "_kept.violations").alias("violations"),
        )
    return latest.withColumn("delta", F.col("latest") - F.col("previous"))
