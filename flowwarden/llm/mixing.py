"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks by a hash of their id; a source's target says how often each of
its blocks is taken: `whole` full passes and a share of one more, drawn as the first blocks of a seeded
permutation, without those too long for what is left. The drawn blocks of all sources are then dealt to output
shards: from the root down, each node's block quotas are split between its two halves by a multivariate
hypergeometric draw, so every shard gets an exact quota of every source as a uniform deal would give it.
Quotas become disjoint ranges of each source's permuted blocks, and documents are shuffled inside shards.

Defined results: a null source is a source of its own, after all others; a null or wordless text has size
0 and is never taken; repeated rows are separate documents that share a block; an empty table gives an
empty mix; extra columns are passed through. The draw depends on ids, sizes and the seed only, so reruns agree.

Only tables of sources and of blocks (at most `BLOCKS` for each source) are gathered: the first is the
mixture's own list of weights, the second is filled source by source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.llm.common import fresh, python_tasks, stored
from flowwarden.session import broadcast_within

#: Blocks of each source, and output shards.
BLOCKS, SHARDS = 2048, 64
#: Rows of the block table that may be broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has, and times a source may be used.
SHARE, REPEATS = 1.5, 2
SEED = 17


def word_count(text: Column) -> Column:
    """Words are runs of anything but space and the five ASCII line and tab characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            repeats: float = REPEATS) -> DataFrame:
    """Per source (rows of source, source_size): its weight and target.

    Targets share the whole by weight and stop at `repeats` times the source's size. Passing on the
    excess until nobody is above ends where all open sources stand at one level times their weight. Sources
    in order of size over weight stop first, so the level follows from running sums over them.
    """
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select(
        "source", "source_size", F.get(picks, (F.row_number().over(order) - 1) % len(weights)).alias("weight"))
    stop = (repeats * F.col("source_size")).cast("double")
    fill = every.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = weighed.withColumn("stop", stop).select(
        "*", (share * F.sum("source_size").over(every)).alias("whole"),
        F.coalesce(F.sum("stop").over(before), F.lit(0.0)).alias("stopped"), F.sum("weight").over(after).alias("open"),
        F.row_number().over(fill).alias("turn"))
    level = (F.col("whole") - F.col("stopped")) / F.col("open")
    is_open = level * F.col("weight") <= F.col("stop")
    found = filled.select("*", F.max(F.when(is_open, level)).over(every).alias("_any"),
                          F.min_by(level, F.struct((~is_open).cast("int"), "turn")).over(every).alias("level"))
    target = F.when(F.col("_any").isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("level") * F.col("weight")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def _block(doc_id: str, seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(blocks)).cast("int")


def draw_blocks(blocks: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Times each block is taken: rows of (source, block, words) to (…, place, times).

    Blocks stand in the order of a seeded permutation. One more pass takes every block that fits into what is then left of
    the target, and at last the one block that comes nearest to the rest. No open block fits in the end, so the target is
    missed by at most half of the smallest of them.
    """
    own = plan.select(F.col("source").alias("_planned"), "source_size", "target")
    joined = blocks.join(own, F.col("source").eqNullSafe(F.col("_planned"))).drop("_planned")
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("block")), "block")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - whole * F.col("source_size")
    placed = joined.select("source", "block", "words", F.row_number().over(order).alias("place"), whole.alias("whole"), left.alias("left"))
    # A source has at most as many rows here as blocks.
    return placed.groupBy("source").applyInPandas(_filled, "source string, block int, words bigint, place int, times bigint")


def _filled(own: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source with the times they are taken."""
    own = own.sort_values("place")
    words, left = own["words"].tolist(), float(own["left"].iloc[0])
    more = np.zeros(len(own), np.int64)
    for i, n in enumerate(words):
        if 0 < n <= left:
            more[i], left = 1, left - n
    still = [(abs(n - left), i) for i, n in enumerate(words) if n > 0 and not more[i]]
    if still and min(still)[0] < left:
        more[min(still)[1]] = 1
    times = np.where(own["words"] > 0, own["whole"] + more, 0)
    return own.assign(times=times)[["source", "block", "words", "place", "times"]]


def _child_seed(seed: int, path: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}/{path}".encode()).digest()[:8], "little"))


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shard, source) quotas: counts split in halves from the root down by hypergeometric draws."""
    out = np.zeros((shards, len(counts)), np.int64)

    def split(own: np.ndarray, first: int, last: int, path: str) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        rest, taken = int(own.sum()), np.zeros_like(own)
        draw = rest * (middle - first) // (last - first)
        rng = _child_seed(seed, path)
        for i, n in enumerate(own):
            if draw and n:
                taken[i] = rng.hypergeometric(int(n), rest - int(n), draw) if rest > n else draw
            draw, rest = draw - int(taken[i]), rest - int(n)
        split(taken, first, middle, path + "l")
        split(own - taken, middle, last, path + "r")

    split(np.asarray(counts, np.int64), 0, shards, "")
    return out


def _quotas(shards: int, seed: int):
    def dealt(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("source", na_position="last", kind="stable")
        upto = split_tree(own["drawn"].to_numpy(), shards, seed).cumsum(axis=0)
        past = np.vstack([np.zeros_like(upto[:1]), upto[:-1]])
        return pd.concat([pd.DataFrame({"source": own["source"].to_numpy(), "shard": s, "past": past[s], "upto": upto[s]})
                          for s in range(shards)])

    return dealt


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
             weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS,
             blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(blocks with how often and where they are taken, targets per source)."""
    python_tasks(docs.sparkSession)
    sized = docs.select(F.col(source).cast("string").alias("source"), _block(doc_id, seed, blocks).alias("block"),
                        word_count(F.col(text)).alias("words"))
    totals = stored(sized.groupBy("source", "block").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_docs")), "mix-blocks")
    plan = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    drawn = draw_blocks(totals.select("source", "block", "words"), plan, seed)
    # One entry for every time a block is taken, in permuted order: all first takes, then the second ones.
    entries = drawn.withColumn("time", F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1).cast("long"), F.col("times")))))
    ranked = entries.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("time", "place")))
    counts = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"))
    # One row for each source meets here: the list of mixture weights, never documents or blocks.
    quotas = counts.groupBy(F.lit(0).alias("all")).applyInPandas(
        _quotas(shards, seed), "source string, shard int, past bigint, upto bigint")
    dealt = quotas.select(F.col("source").alias("_dealt"), "shard", "past", "upto")
    placed = ranked.join(dealt, F.col("source").eqNullSafe(F.col("_dealt")) & (F.col("rank") > F.col("past"))
                         & (F.col("rank") <= F.col("upto"))).select("source", "block", "shard")
    homes = placed.groupBy(F.col("source").alias("home"), F.col("block").alias("place_in")).agg(
        F.sort_array(F.collect_list("shard")).alias("shards"))
    # A block is taken as often as the tree has dealt it.
    every = drawn.select("source", "block").join(
        homes, F.col("source").eqNullSafe(F.col("home")) & (F.col("block") == F.col("place_in")), "left").select(
        "source", "block", F.coalesce(F.size("shards"), F.lit(0)).cast("long").alias("times"), "shards")
    return stored(every, "mix-plan"), stored(plan, "mix-targets")


def with_takes(docs: DataFrame, into: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text",
               blocks: int = BLOCKS, seed: int = SEED, **options) -> DataFrame:
    """`docs` plus a struct: size, source_size, target, times, taken words, output shards."""
    drawn, plan = plan_mix(docs, doc_id, source, text, blocks=blocks, seed=seed, **options)
    drawn, plan = drawn.alias("_drawn"), plan.alias("_plan")
    known = drawn.join(plan, F.col("_drawn.source").eqNullSafe(F.col("_plan.source"))).select(
        F.col("_drawn.source").alias("_mix_source"), F.col("_drawn.block").alias("_mix_block"),
        F.struct("times", "shards", "source_size", "target").alias("_mix_plan"))
    size, block = fresh(docs, "_size"), fresh(docs, "_block")
    sized = docs.withColumn(size, word_count(F.col(text))).withColumn(block, _block(doc_id, seed, blocks))
    found = sized.join(broadcast_within(known, BROADCAST_ROWS), F.col(f"`{source}`").cast("string").eqNullSafe(F.col("_mix_source")) & (F.col(block) == F.col("_mix_block")))
    p = F.col("_mix_plan")
    times = F.when(F.col(size) > 0, p["times"]).otherwise(F.lit(0)).cast("long")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.col(size).alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"),
        times.alias("times"), (times * F.col(size)).alias("taken"),
        F.when(times > 0, p["shards"]).alias("shards")).alias(into))


def mix(docs: DataFrame, doc_id: str = "doc_id", shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The mixed documents: one row for every time a document is taken, shards kept together and shuffled inside."""
    into = fresh(docs, "_mix")
    taken = with_takes(docs, into, doc_id, seed=seed, shards=shards, **options)
    shard, lot = fresh(docs, "_shard"), fresh(docs, "_lot")
    rows = taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(F.col(f"{into}.shards")).alias("_take", shard))
    lots = F.xxhash64(F.lit(seed + 2), F.col(doc_id), F.col("_take"))
    spread = rows.withColumn(lot, lots).repartitionByRange(shards, shard, lot).sortWithinPartitions(shard, lot)
    return spread.select(*[F.col(f"`{c}`") for c in docs.columns])
