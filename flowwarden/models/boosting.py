"""Boosted symmetric trees over categories, fitted on distinct combinations.

Rows that agree in all categories are one row with a weight, so every labelled row counts while a fit sees one line for each
distinct combination: a Spark aggregate makes them, and all models of a fit (one for each class) are grown
at once, each in a task of its own. At most `FIT_COMBINATIONS` combinations are fitted on, those with the smallest hashes; with
fewer nothing is left out.

Every level of a tree splits all its leaves by one set of categories, which is a prefix of the feature's categories in the order of
their mean gradient. A category that no fit has seen lies outside of every set.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.session import ship_package
from flowwarden.sources.flows import categorical_view

FIT_COMBINATIONS = 200_000
L2 = 15.0


@dataclass(frozen=True)
class Booster:
    """Trees as arrays: per tree and level a feature and the categories that go left, per tree the values of its leaves."""

    prior: float
    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """Log odds of rows of category codes."""
        out = np.full(len(codes), self.prior)
        for feature, left, value in zip(self.feature, self.left, self.value, strict=True):
            leaf = np.zeros(len(codes), np.int64)
            for j, own in zip(feature, left, strict=True):
                if j >= 0:
                    leaf = 2 * leaf + ~own[codes[:, j]]
                else:
                    leaf = 2 * leaf
            out += value[leaf]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Equal rows are computed once."""
        if not len(codes):
            return np.zeros(0)
        distinct, place = np.unique(codes, axis=0, return_inverse=True)
        return (1 / (1 + np.exp(-self.margin(distinct))))[place.ravel()]

    def parts(self) -> dict[str, np.ndarray]:
        return {"prior": np.array(self.prior), "feature": self.feature, "left": np.packbits(self.left, axis=2),
                "width": np.array(self.left.shape[2]), "value": self.value, "gain": self.gain}

    @classmethod
    def of(cls, p: dict[str, np.ndarray]) -> Booster:
        left = np.unpackbits(p["left"], axis=2, count=int(p["width"])).astype(bool)
        return cls(float(p["prior"]), p["feature"], left, p["value"], p["gain"])


def grow(codes: np.ndarray, positive: np.ndarray, weight: np.ndarray, rows: np.ndarray, categories: list[int], rounds: int, depth: int,
         step: float, l2: float = L2, min_rows: int = 1) -> Booster:
    """Newton boosting of the logistic loss. `positive` is the part of a combination's `weight` that has label 1.

    A split counts for a leaf only if `min_rows` rows lie on either side of it.
    """
    features, width = codes.shape[1], max([0, *categories]) + 1  # one more for categories never seen
    whole, ones = weight.sum(), positive.sum()
    prior = float(np.log((ones + 1e-9) / (whole - ones + 1e-9))) if whole > 0 else 0.0
    feature, left = np.full((rounds, depth), -1, np.int32), np.zeros((rounds, depth, width), bool)
    value, gain = np.zeros((rounds, 1 << depth)), np.zeros(features)
    if whole <= 0 or ones <= 0 or ones >= whole:
        return Booster(float(np.clip(prior, -20, 20)), feature[:0], left[:0], value[:0], gain)
    margin = np.full(len(codes), prior)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * p - positive, weight * p * (1 - p)
        ranks, orders = [], []
        for j in range(features):
            sums = [np.bincount(codes[:, j], x, categories[j]) for x in (g, h)]
            order = np.argsort(sums[0] / (sums[1] + l2), kind="stable")
            rank = np.empty(categories[j], np.int64)
            rank[order] = np.arange(categories[j])
            orders.append(order)
            ranks.append(rank[codes[:, j]])
        leaf = np.zeros(len(codes), np.int64)
        for level in range(depth):
            leaves, best = 1 << level, (1e-9, -1, -1)
            for j in range(features):
                k = categories[j]
                at = leaf * k + ranks[j]
                gs, hs, cs = (np.cumsum(np.bincount(at, x, leaves * k).reshape(leaves, k), axis=1) for x in (g, h, rows))
                gn, hn, cn = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gains = gs * gs / (hs + l2) + (gn - gs) ** 2 / (hn - hs + l2) - gn * gn / (hn + l2)
                gains[(cs < min_rows) | (cn - cs < min_rows)] = 0
                total = gains.sum(axis=0)
                cut = int(np.argmax(total))
                if total[cut] > best[0]:
                    best = float(total[cut]), j, cut
            won, j, cut = best
            if j < 0:
                leaf <<= depth - level
                break
            feature[t, level] = j
            left[t, level, orders[j][:cut + 1]] = True
            gain[j] += won
            leaf = 2 * leaf + (ranks[j] > cut)
        value[t] = -step * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + l2)
        margin += value[t][leaf]
    return Booster(prior, feature, left, value, gain)


def isotonic(score: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators curve as (scores, values) to interpolate between; equal scores are one point first."""
    x, place = np.unique(score, return_inverse=True)
    w, y = np.bincount(place, weight), np.bincount(place, positive)
    blocks: list[list[float]] = []  # weight, positives, first, last
    for i in range(len(x)):
        blocks.append([w[i], y[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a = blocks.pop()
            b = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], b[2], a[3]]
    points = [(end, b[1] / b[0]) for b in blocks for end in ((b[2],) if b[2] == b[3] else (b[2], b[3]))]
    return tuple(np.array(c, float) for c in zip(*points, strict=True)) if points else (np.zeros(1), np.zeros(1))


@dataclass(frozen=True)
class Encoding:
    """Categories of every feature in order."""

    names: tuple[str, ...]
    values: tuple[tuple[str, ...], ...]

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """Codes of rows; the number of categories stands for one that is not listed."""
        out = [pc.fill_null(pc.index_in(c.cast(pa.string()), value_set=pa.array(v, pa.string())), len(v)).to_numpy(zero_copy_only=False)
               for c, v in zip(columns, self.values, strict=True)]
        return np.stack(out, axis=1).astype(np.int64) if out else np.zeros((0, 0), np.int64)

    def columns(self) -> list[Column]:
        return [categorical_view(n) for n in self.names]


def combinations(df: DataFrame, categorical: list[str], label: Column, bound: int = FIT_COMBINATIONS, seed: int = 42) -> pd.DataFrame:
    """Distinct combinations with `label` and their number of rows `n`; pre-aggregated, at most `bound` combinations."""
    views = [categorical_view(c).alias(f"c{i}") for i, c in enumerate(categorical)]
    names = [f"c{i}" for i in range(len(categorical))]
    counted = df.select(*views, label.alias("label")).groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.groupBy(*names).agg(F.collect_list(F.struct("label", "n")).alias("of")) if names else None  # a list of classes
    if kept is None:
        return counted.toPandas()
    chosen = kept.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(bound)
    return chosen.select(*names, F.inline("of")).toPandas()


def encoding_of(found: pd.DataFrame, categorical: list[str]) -> Encoding:
    return Encoding(tuple(categorical), tuple(tuple(sorted(found[f"c{i}"].unique())) for i in range(len(categorical))))


def table_of(found: pd.DataFrame, encoding: Encoding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of distinct combinations, the line of each count, and the counts."""
    codes = encoding.codes([pa.array(found[f"c{i}"], pa.string()) for i in range(len(encoding.names))])
    distinct, line = np.unique(codes, axis=0, return_inverse=True)
    return distinct, line.ravel(), found["n"].to_numpy(float)


def fit_all(spark: SparkSession, found: pd.DataFrame, held: pd.DataFrame | None, encoding: Encoding, targets: list, weights: dict,
            rounds: int, depth: int, step: float, min_rows: int = 1) -> list[tuple[Booster, tuple[np.ndarray, np.ndarray] | None]]:
    """One booster for each target (label against the rest), with a curve over the held-out combinations; a task each."""
    ship_package(spark)
    sizes = [len(v) for v in encoding.values]

    def summed(table: pd.DataFrame, weigh: bool) -> tuple:
        codes, line, n = table_of(table, encoding)
        labels = table["label"].to_numpy()
        w = n * np.array([weights.get(x, 1.0) for x in labels]) if weigh else n
        rows = np.bincount(line, n, len(codes))
        ones = [np.bincount(line, w * (labels == t), len(codes)) for t in targets]
        return codes, np.bincount(line, w, len(codes)), rows, ones

    shared = spark.sparkContext.broadcast((summed(found, True), None if held is None else summed(held, False)))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                (codes, w, rows, ones), later = shared.value
                booster = grow(codes, ones[i], w, rows, sizes, rounds, depth, step, min_rows=min_rows)
                parts = booster.parts()
                if later is not None:
                    score = booster.probability(later[0])
                    parts["x"], parts["y"] = isotonic(score, later[1], later[3][i])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([to_bytes(parts)], pa.binary())], ["id", "model"])

    rows = spark.range(0, len(targets), 1, len(targets)).mapInArrow(fitted, "id long, model binary").collect()
    parts = [from_bytes(r["model"]) for r in sorted(rows, key=lambda r: r["id"])]
    return [(Booster.of(p), (p["x"], p["y"]) if held is not None else None) for p in parts]


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **parts)
    return out.getvalue()


def from_bytes(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def save(path: str, told: dict, models: list[dict[str, np.ndarray]]) -> None:
    """One row for each model, and one with what they share."""
    spark = SparkSession.active()
    rows = [(-1, json.dumps(told), None)] + [(i, None, to_bytes(m)) for i, m in enumerate(models)]
    spark.createDataFrame(rows, "id int, told string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(path: str) -> tuple[dict, list[dict[str, np.ndarray]]]:
    rows = SparkSession.active().read.parquet(path).orderBy("id").collect()
    return json.loads(rows[0]["told"]), [from_bytes(r["model"]) for r in rows[1:]]
