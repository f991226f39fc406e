"""Random-cut anomaly forest: bounded tree samples, tree building per group, blind scoring.

A tree keeps `size` rows; a new row takes the place of a random old one. Equivalently, row i claims slot
hash(i, tree) mod size and the newest claim stands, with the first `size` rows seated one per slot. Once
every slot of every tree is claimed within the newest rows, no older row can win one, so the search goes
back only as far as that takes, or to the first row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions.scores import inverted, normalise_score
from flowwarden.operators.ordered import exact_percentiles, hash_order, newest_rows
from flowwarden.session import materialise, ship_package

#: Rows per slot that the first look goes back.
REACH = 40
NODE_SCHEMA = ("tree int, node int, left int, right int, dim int, cut double, n int, "
               "low array<double>, high array<double>")
ANCHOR_SHARES = (0.01, 0.99, 0.999)


def tree_samples(points: DataFrame, trees: int = 80, size: int = 256, seed: int = 0, reach: int = REACH) -> DataFrame:
    """At most `size` rows per tree as tree, slot, x. `points` holds a unique seq and x (array of doubles).

    The first look goes `reach` rows per slot back, each further one four times as far, until all slots are
    claimed or the rows end. The result does not depend on it.
    """
    rows = points.select("seq", "x")
    total = rows.count()
    # `size` rows: one window over them numbers the seats.
    seats = rows.select("seq").orderBy("seq").limit(size).select(
        F.col("seq").alias("_seat_seq"), (F.row_number().over(W.orderBy("seq")) - 1).alias("_seat"))
    claimed = (F.conv(F.substring(hash_order(seed, "seq", "tree"), 1, 6), 16, 10).cast("long") % size).cast("int")
    back = size * reach
    while True:
        tail = newest_rows(rows, "seq", back) if back < total else rows
        claims = tail.join(F.broadcast(seats), F.col("seq") == F.col("_seat_seq"), "left").withColumn(
            "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("slot", F.coalesce("_seat", claimed))
        sample = materialise(claims.groupBy("tree", "slot").agg(F.max_by("x", "seq").alias("x")))
        if back >= total or sample.count() == trees * size:
            return sample
        back *= 4


def _grow(points: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """One random-cut tree over distinct points; node 0 is the root."""
    distinct, counts = np.unique(points, axis=0, return_counts=True)
    rows, todo = [], [(0, np.arange(len(distinct)))]
    free = 1
    while todo:
        node, members = todo.pop()
        own = distinct[members]
        low, high = own.min(axis=0), own.max(axis=0)
        entry = [node, -1, -1, -1, 0.0, int(counts[members].sum()), low.tolist(), high.tolist()]
        if len(members) > 1:
            span = high - low
            dim = int(rng.choice(len(span), p=span / span.sum()))
            cut = float(rng.uniform(low[dim], high[dim]))
            goes_left = own[:, dim] <= cut
            if goes_left.all():
                cut = float(np.nextafter(high[dim], low[dim]))
                goes_left = own[:, dim] <= cut
            entry[1:5] = [free, free + 1, dim, cut]
            todo += [(free, members[goes_left]), (free + 1, members[~goes_left])]
            free += 2
        rows.append(entry)
    return pd.DataFrame(rows, columns=["node", "left", "right", "dim", "cut", "n", "low", "high"])


def grow_forest(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Nodes of all trees; a group is one tree's bounded sample."""
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("slot")
        nodes = _grow(np.stack(ordered["x"].to_numpy()), np.random.default_rng([seed, tree]))
        return nodes.assign(tree=tree)[["tree", "node", "left", "right", "dim", "cut", "n", "low", "high"]]

    ship_package(samples.sparkSession)
    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _mix(state: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: repeatable uniform bits per (row, tree, depth)."""
    z = state + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _edges(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A tree's two edges for each node, with the child and the sibling-to-own size ratio of each.

    Behind the last node stands an empty one, where both edges of a leaf lead; `sizes` counts it too.
    """
    leaf, sizes = tree["left"] < 0, np.append(tree["n"], 0.0)
    child = np.where(leaf, len(leaf), np.stack([tree["left"], tree["right"]])).T.astype(np.intp)
    ratio = np.where(leaf[:, None], 0.0, sizes[child[:, ::-1]] / (sizes[child] + 1.0))
    return {"sizes": sizes, "axis": np.where(leaf, 0, tree["dim"]).astype(np.intp), "child": child.ravel(), "ratio": ratio.ravel()}


def _displacement(x: np.ndarray, key: np.ndarray, tree: dict[str, np.ndarray], number: int) -> np.ndarray:
    """Collusive displacement each row would have if it were inserted, all rows one level at a time.

    A random cut through a node's box, stretched to the row, parts the row from the node with the share
    that the stretch has in the stretched size; the walk then ends beside that subtree. Otherwise the
    row follows the node's own cut. The result is the largest sibling-to-own size ratio on the way up.

    No ratio below a node exceeds its size, so a walk also ends where its largest ratio has reached that.
    """
    width, worst = x.shape[1], np.zeros(len(x))
    live, at, most = np.arange(len(x)), np.zeros(len(x), np.intp), np.zeros(len(x))
    begins = np.arange(len(x)) * width
    depth = 0
    while len(live):
        beyond, above = tree["low"].take(at, axis=0), tree["high"].take(at, axis=0)
        beyond -= x
        np.subtract(x, above, out=above)
        np.maximum(np.maximum(beyond, above, out=beyond), 0.0, out=beyond)
        # Few columns are added one by one, in the same order as a sum over rows would.
        stretch = sum(beyond.T[1:], beyond[:, 0]) if 0 < width < 8 else beyond.sum(axis=1)
        outside = np.flatnonzero(stretch > 0)  # a row inside the box is never parted
        own, node = stretch.take(outside), at.take(outside)
        salt = _mix(np.array([(number * 1_000_003 + depth) & 0xFFFFFFFFFFFF], dtype=np.uint64))
        draw = (_mix(key.take(outside) ^ salt) >> np.uint64(11)) * 2.0 ** -53
        parted = np.flatnonzero(draw * (tree["span"].take(node) + own) < own)
        ends = outside.take(parted)
        most[ends] = np.maximum(most.take(ends), tree["sizes"].take(node.take(parted)))
        value = x.ravel().take(begins[:len(at)] + tree["axis"].take(at)) if width else np.zeros(len(at))
        edge = 2 * at + ~(value <= tree["cut"].take(at))
        # No ratio below a parted row is as large as the size it has, so this leaves it alone.
        most = np.maximum(most, tree["ratio"].take(edge))
        at = tree["child"].take(edge)
        worst[live] = most
        keep = np.flatnonzero(most < tree["sizes"].take(at))
        if len(keep) < len(live):
            live, at, most, key, x = live.take(keep), at.take(keep), most.take(keep), key.take(keep), x.take(keep, axis=0)
        depth += 1
    return worst


@dataclass(frozen=True)
class Forest:
    """Packed trees (bounded by trees * 2 * size nodes) and the score anchors."""

    trees: tuple[dict[str, np.ndarray], ...]
    nodes: pd.DataFrame
    anchors: tuple[float, float, float] | None = None

    @classmethod
    def pack(cls, nodes: DataFrame | pd.DataFrame, anchors=None) -> "Forest":
        pdf = nodes if isinstance(nodes, pd.DataFrame) else nodes.toPandas()
        pdf = pdf.sort_values(["tree", "node"]).reset_index(drop=True)
        packed = []
        for _, part in pdf.groupby("tree"):
            packed.append({
                **{c: part[c].to_numpy() for c in ("left", "right", "dim", "cut")},
                "n": part["n"].to_numpy(dtype=float),
                "low": np.stack(part["low"].to_numpy()), "high": np.stack(part["high"].to_numpy()),
            })
            packed[-1]["span"] = (packed[-1]["high"] - packed[-1]["low"]).sum(axis=1)
            packed[-1] |= _edges(packed[-1])
        return cls(tuple(packed), pdf, anchors)

    def raw_scores(self, df: DataFrame, row_id: str = "seq", x: str = "x", name: str = "codisp") -> DataFrame:
        """Add the mean displacement over all trees; the forest itself never changes.

        Only the point and a hash of the row's id go through Python, so scans stay pruned.
        """
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.arrow_udf(T.DoubleType())
        def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            trees = shared.value
            for own, hashed in batches:
                if not len(own):
                    yield pa.array([], pa.float64())
                    continue
                if own.null_count:
                    raise ValueError("a row has no point")
                key = hashed.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                points = own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                with np.errstate(over="ignore"):
                    total = sum(_displacement(points, key, t, i) for i, t in enumerate(trees))
                yield pa.array(total / len(trees))

        return df.withColumn(name, scan(F.col(x), F.xxhash64(row_id)))

    def anomaly_risk(self, df: DataFrame, row_id: str = "seq", x: str = "x", name: str = "anomaly_risk",
                     attack_trained: bool = True) -> DataFrame:
        """Normalised score in [0, 1], turned round for a forest grown on attacks."""
        low, _, high = self.anchors if self.anchors else (None, None, None)
        score = normalise_score(F.col("codisp"), low, high)
        return self.raw_scores(df, row_id, x).withColumn(name, inverted(score) if attack_trained else score).drop("codisp")

    def save(self, spark: SparkSession, path: str) -> None:
        if self.anchors is None:
            raise ValueError("forest has no anchors: it was not fitted")
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([self.anchors], "p1 double, p99 double, p999 double").write.mode("overwrite").parquet(f"{path}/anchors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        anchors = tuple(spark.read.parquet(f"{path}/anchors").first())
        return cls.pack(spark.read.parquet(f"{path}/nodes"), anchors)


def fit_forest(points: DataFrame, trees: int = 80, size: int = 256, seed: int = 0,
               anchors: tuple[float, float, float] | None = None) -> Forest:
    """Grow a forest and calibrate it on its own rows, or take over anchors of another forest."""
    forest = Forest.pack(grow_forest(tree_samples(points, trees, size, seed), seed))
    if anchors is None:
        scored = materialise(forest.raw_scores(points.select("seq", "x")).select("codisp"))
        row = exact_percentiles(scored, [], "codisp", list(ANCHOR_SHARES)).first()
        anchors = (row.p0, row.p1, row.p2)
    return Forest(forest.trees, forest.nodes, anchors)
