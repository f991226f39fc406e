"""Stratified splits, folds and balanced samples in a repeatable order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.operators.ordered import hash_chunk, hash_order, join_keys, keyed_rank


def _ranked(df: DataFrame, stratum: str, row_id: str, seed: int) -> DataFrame:
    ordered = df.withColumn("_order", hash_order(seed, row_id))
    return keyed_rank(ordered, [stratum], ["_order"], hash_chunk(F.col("_order")), "_rank").drop("_order")


def stratified_folds(df: DataFrame, stratum: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1; within a class the folds differ by at most one row."""
    return _ranked(df, stratum, row_id, seed).withColumn(
        "fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def stratified_holdout(df: DataFrame, stratum: str, row_id: str, share: float, seed: int = 42) -> DataFrame:
    """Mark `share` of every class (rounded half up) as held out."""
    ranked = _ranked(df, stratum, row_id, seed)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    cut = F.floor(F.col("_size") * F.lit(float(share)) + F.lit(0.5))
    return join_keys(ranked, sizes, [stratum]).withColumn("is_holdout", F.col("_rank") <= cut).drop("_rank", "_size")


def balanced_sample(df: DataFrame, label: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n / 2 rows of each label without replacement, in shuffled order.

    The per-label limit runs before the shuffle, so no label travels as a whole.
    """
    ordered = df.withColumn("_order", hash_order(seed, row_id))
    top = W.partitionBy(label).orderBy("_order")
    picked = ordered.withColumn("_rn", F.row_number().over(top)).filter(F.col("_rn") <= n // 2)
    return picked.withColumn("shuffle_key", hash_order(seed + 1, row_id)).orderBy("shuffle_key").drop("_order", "_rn")
