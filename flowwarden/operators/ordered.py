"""Exact ranks, running sums and percentiles without sending a whole key to one task.

Every helper works in two levels: rows fall into order-preserving chunks, chunk totals are
pre-aggregated and accumulated (they are few), and the row-level window runs per (key, chunk).
A key that owns a third of all rows is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.session import materialise, rows_within

SEQ_CHUNK = 1 << 20
SPLITS = 255
STRIDE = 16
#: Keys up to which the per-key tables of value splits are broadcast.
FEW_KEYS = 1000
#: Accuracy of the first pass over percentiles (its error in rank is the inverse), and half the width of a bracket.
ACCURACY = 10_000
BRACKET = 4 / ACCURACY


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by key columns, where null equals null; the left side's columns come first."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def seq_chunk(seq: str, width: int = SEQ_CHUNK) -> Column:
    """Chunk of a unique arrival number: no more than `width` rows can share one."""
    return F.expr(f"{seq} div {width}")


def hash_order(seed: int, *ids: str) -> Column:
    """Repeatable pseudo-random order key (hex text, evenly spread)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_chunk(order_key: Column) -> Column:
    """Chunk of a hex order key: its first four digits, which sort as the key does."""
    return F.substring(order_key, 1, 4)


def newest_rows(df: DataFrame, seq: str, n: int, width: int = SEQ_CHUNK) -> DataFrame:
    """The n rows with the largest `seq`.

    Counting per chunk first shows how far back the n-th newest row can lie, so the final top-k sees
    about one chunk of rows and not n rows from every input task.
    """
    chunk = seq_chunk(seq, width)
    sizes = df.groupBy(chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    back = W.orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = sizes.withColumn("_upto", F.sum("_n").over(back)).filter(F.col("_upto") >= n)
    start = reached.agg(F.max("_chunk").alias("_start")).scalar()
    recent = df.filter(start.isNull() | (chunk >= start))
    return recent.orderBy(F.col(seq).desc()).limit(n)


def running_sums(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums in `order` within `keys`; `chunk` must rise with `order`.

    Null keys are keys of their own, and rows with a null order value come first.
    """
    staged = df.withColumn("_chunk", chunk)
    totals = staged.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = join_keys(staged, bases, [*keys, "_chunk"])
    added = joined.select(
        "*", *[(F.col(f"_b_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()]
    )
    return added.drop("_chunk", *[f"_b_{n}" for n in sums])


def keyed_rank(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """row_number per key, in two levels."""
    return running_sums(df, keys, order, chunk, {name: F.lit(1).cast("long")})


def trailing_mean(df: DataFrame, value: str, seq: str, name: str, window: int = 20,
                  keys: list[str] | None = None, width: int = SEQ_CHUNK) -> DataFrame:
    """Mean of the last `window` values in arrival order, over all rows or per key.

    Rows are ranked, cut into blocks by rank, and each block also receives the last window - 1 rows
    of the block before it; those helper rows are dropped after the block-local window.
    """
    keys = keys or []
    ranked = keyed_rank(df, keys, [seq], seq_chunk(seq, width), "_rank")
    block = F.expr(f"_rank div {width}")
    owner = F.struct(block.alias("block"), F.lit(False).alias("halo"))
    guest = F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))
    near_end = (F.col("_rank") % width) >= width - (window - 1)
    placed = ranked.select(
        "*", F.explode(F.when(near_end, F.array(owner, guest)).otherwise(F.array(owner))).alias("_place")
    ).select("*", F.col("_place.block").alias("_block"), F.col("_place.halo").alias("_halo"))
    frame = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-(window - 1), 0)
    smoothed = placed.withColumn(name, F.avg(value).over(frame))
    return smoothed.filter(~F.col("_halo")).drop("_rank", "_place", "_block", "_halo")


def cumulative_counts(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct value: its own totals and, as `<name>_upto`, the totals of all values up to it.

    The value splits, at most 255 per key, and the chunk bases, at most 256 per key, are broadcast if the
    keys were counted and are few (column names, classes); with more keys they are joined by shuffle.
    """
    few = not keys or rows_within(df.select(*keys).distinct(), FEW_KEYS)
    distinct = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    points = F.array(*[F.lit((i + 1) / (SPLITS + 1)) for i in range(SPLITS)])
    splits = distinct.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, points, F.lit(10000))).alias("_splits"))
    placed = _attach(distinct, splits, keys, "_splits", few).withColumn(
        "_coarse", F.filter("_splits", lambda s, i: (i + 1) % STRIDE == 0))

    def reached(splits: str | Column) -> Column:
        return F.size(F.filter(splits, lambda s: s <= F.col(value)))

    # Splits passed so far: whole strides first, then the rest within one stride.
    passed = placed.withColumn("_strides", reached("_coarse") * STRIDE)
    chunked = passed.withColumn(
        "_chunk", F.col("_strides") + reached(F.slice("_splits", F.col("_strides") + 1, F.lit(STRIDE)))
    ).drop("_splits", "_coarse", "_strides")
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return join_keys(chunked, F.broadcast(bases) if few else bases, [*keys, "_chunk"]).select(
        *keys, value, *sums,
        *[(F.col(f"_b_{n}") + F.sum(n).over(inside)).alias(f"{n}_upto") for n in sums],
    )


def _attach(df: DataFrame, per_key: DataFrame, keys: list[str], name: str, few: bool) -> DataFrame:
    """Bring a one-row-per-key value to every row: by key, or as a scalar when there is no key."""
    if keys:
        return join_keys(df, F.broadcast(per_key) if few else per_key, keys)
    return df.withColumn(name, per_key.select(name).scalar())


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated percentiles per key as columns `p0, p1, …` in the order of `shares`.

    The built-in exact percentile gathers every distinct value of a group in one task. Here one approximate pass sets a
    narrow bracket around each percentile, wider than its error; a second pass counts the rows below each bracket and keeps
    the few inside. Only these are ordered, and two neighbouring order statistics are read from them. Keys with no
    more than `ACCURACY` rows are ordered whole.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = [e for s in shares for e in (max(0.0, s - BRACKET), min(1.0, s + BRACKET))]
    marks = materialise(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("_ends")))
    few = not keys or rows_within(marks, FEW_KEYS)
    placed = _attach_all(rows, marks, keys, few)
    whole = F.col("_size") <= ACCURACY
    low = [F.when(whole, F.lit(None)).otherwise(F.get("_ends", F.lit(2 * i))) for i in range(len(shares))]
    high = [F.when(whole, F.lit(None)).otherwise(F.get("_ends", F.lit(2 * i + 1))) for i in range(len(shares))]
    before = placed.groupBy(*keys, "_size").agg(*[F.count_if(F.col("_v") < a).alias(f"_before{i}") for i, a in enumerate(low)])
    inside = placed.select(*keys, "_v", F.explode(F.array_compact(F.array(*[
        F.when((low[i].isNull() | (F.col("_v") >= low[i])) & (high[i].isNull() | (F.col("_v") <= high[i])), F.lit(i))
        for i in range(len(shares))]))).alias("_i"))
    counted = cumulative_counts(materialise(inside), [*keys, "_i"], "_v", {"_n": F.lit(1).cast("long")})
    tops = _attach_all(counted, before, keys, few)
    picks = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_size") - 1)
        last = F.col(f"_before{i}") + F.col("_n_upto") - 1
        first = last - F.col("_n") + 1
        for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_i") == i) & (first <= rank) & (rank <= last), F.col("_v"))).alias(f"_{name}{i}"))
    found = tops.groupBy(*keys, "_size").agg(*picks)
    out = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_size") - 1)
        weight = at - F.floor(at)
        lower, upper = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append((lower + (upper - lower) * weight).alias(f"p{i}"))
    return found.select(*keys, *out)


def _attach_all(df: DataFrame, per_key: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Bring the columns of a one-row-per-key table to every row."""
    if keys:
        return join_keys(df, F.broadcast(per_key) if few else per_key, keys)
    return df.withColumn("_one", per_key.select(F.struct(*per_key.columns)).scalar()).select(*df.columns, "_one.*")
