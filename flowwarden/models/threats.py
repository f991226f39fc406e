"""Binary risk and multi-class threat classifiers, calibration, importances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.functions.cases import let
from flowwarden.functions.scores import class_entropy, penalised_class, top2_margin, total
from flowwarden.models import boosting
from flowwarden.models.boosting import Booster, Encoding
from flowwarden.session import ship_package

ROUNDS, DEPTH, STEP = 500, 6, 0.05
#: Rows on either side of a split that counts in a threat model.
MIN_ROWS = 20
#: Combinations whose scores a task remembers.
REMEMBERED = 100_000


def _by_combination(batches: Iterator[pa.Array], encoding: Encoding, boosters: tuple[Booster, ...],
                    curves: tuple | None) -> Iterator[pa.Array]:
    """Probabilities of batches of category structs. Combinations are remembered, up to a bound, so that each is
    scored once in a task and not in every batch."""
    known: dict[bytes, int] = {}
    table = np.zeros((0, len(boosters)))
    for batch in batches:
        distinct, place = np.unique(encoding.codes(batch.flatten()), axis=0, return_inverse=True)
        if len(known) > REMEMBERED:
            known, table = {}, table[:0]
        rows = [row.tobytes() for row in distinct]
        fresh = np.array([i for i, row in enumerate(rows) if row not in known], np.intp)
        if len(fresh):
            found = [b.probability(distinct[fresh]) for b in boosters]
            if curves:
                found = [np.interp(f, *c) for f, c in zip(found, curves, strict=True)]
            known.update(zip([rows[i] for i in fresh], range(len(table), len(table) + len(fresh)), strict=True))
            table = np.concatenate([table, np.stack(found, axis=1)])
        flat = table[np.array([known[row] for row in rows], np.intp)[place.ravel()]]
        yield pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(boosters)).astype(np.int32), flat.ravel())


def _scores(encoding: Encoding, boosters: tuple[Booster, ...], curves: tuple | None = None):
    """Arrow UDF over the category columns → the models' probabilities, on their curves if there are any."""
    shared = SparkSession.active().sparkContext.broadcast((encoding, boosters, curves))

    @F.arrow_udf(from_arrow_type(pa.list_(pa.float64())))
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _by_combination(batches, *shared.value)

    ship_package(SparkSession.active())
    return scores(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(encoding.columns())]))


@dataclass(frozen=True)
class RiskModel:
    """P(attack) from boosted trees over categories."""

    encoding: Encoding
    trees: Booster

    def transform(self, df: DataFrame, name: str = "cat_risk") -> DataFrame:
        return df.withColumn(name, F.get(_scores(self.encoding, (self.trees,)), F.lit(0)))

    def importances(self, spark: SparkSession, k: int = 5) -> DataFrame:
        """The k features whose splits gained most, in percent of all gains."""
        whole = self.trees.gain.sum() or 1.0
        rows = [(c, float(w / whole) * 100.0) for c, w in zip(self.encoding.names, self.trees.gain, strict=True)]
        return spark.createDataFrame(rows, "feature string, influence double").orderBy(
            F.col("influence").desc(), "feature").limit(k)

    def save(self, path: str) -> None:
        boosting.save(path, {"names": self.encoding.names, "values": self.encoding.values}, [self.trees.parts()])

    @classmethod
    def load(cls, path: str, categorical: list[str]) -> "RiskModel":
        told, models = boosting.load(path)
        if told["names"] != list(categorical):
            raise ValueError(f"the model has the categories {told['names']}")
        return cls(Encoding(tuple(told["names"]), tuple(map(tuple, told["values"]))), Booster.of(models[0]))


def fit_risk(df: DataFrame, categorical: list[str], label: str = "label", rounds: int = ROUNDS,
             depth: int = DEPTH, step: float = STEP, seed: int = 42) -> RiskModel:
    """`seed` picks the combinations of a fit that has more than `boosting.FIT_COMBINATIONS`."""
    found = boosting.combinations(df, categorical, F.col(label).cast("int"), seed=seed)
    encoding = boosting.encoding_of(found, categorical)
    (trees, _), = boosting.fit_all(df.sparkSession, found, None, encoding, [1], {}, rounds, depth, step)
    return RiskModel(encoding, trees)


@dataclass(frozen=True)
class ThreatModel:
    """One boosted model per class, each with its own isotonic curve, shares normalised per row."""

    encoding: Encoding
    classes: tuple[str, ...]
    per_class: tuple[Booster, ...]
    curves: tuple[tuple[np.ndarray, np.ndarray], ...]

    def names(self) -> list[str]:
        return list(self.classes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add probability, classes, incident_entropy, top2_margin, threat and penalised_threat."""
        n = len(self.classes)
        scored = df.withColumn("_cal", _scores(self.encoding, self.per_class, self.curves))
        even = F.array(*[F.lit(1.0 / n)] * n)
        shares = let(total(F.col("_cal")), lambda whole: F.when(
            whole > 0, F.transform("_cal", lambda v: v / whole)).otherwise(even))
        names = F.array(*[F.lit(c) for c in self.names()])
        named = scored.withColumns({"probability": shares, "classes": names}).drop("_cal")
        p = F.col("probability")
        return named.withColumns({
            "incident_entropy": class_entropy(p), "top2_margin": top2_margin(p),
            "threat": penalised_class(p, F.col("classes"), 0.0),
            "penalised_threat": penalised_class(p, F.col("classes")),
        })

    def save(self, path: str) -> None:
        models = [b.parts() | {"x": x, "y": y} for b, (x, y) in zip(self.per_class, self.curves, strict=True)]
        boosting.save(path, {"names": self.encoding.names, "values": self.encoding.values, "classes": self.classes}, models)

    @classmethod
    def load(cls, path: str) -> "ThreatModel":
        told, models = boosting.load(path)
        return cls(Encoding(tuple(told["names"]), tuple(map(tuple, told["values"]))), tuple(told["classes"]),
                   tuple(map(Booster.of, models)), tuple((m["x"], m["y"]) for m in models))


def fit_threat(df: DataFrame, calibration: DataFrame, categorical: list[str], label: str = "attack_cat",
               rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, seed: int = 42) -> ThreatModel:
    """Fit every class of `df` against the rest, calibrate each on the held-out `calibration` rows.

    A row weighs sqrt(largest class / own class). All classes are fitted and calibrated in one job.
    """
    found, held = (boosting.combinations(d, categorical, F.col(label), seed=seed) for d in (df, calibration))
    encoding = boosting.encoding_of(found, categorical)
    sizes = found.groupby("label")["n"].sum()
    classes = sorted(sizes.index)
    weights = {c: float(np.sqrt(sizes.max() / sizes[c])) for c in classes}
    fits = boosting.fit_all(df.sparkSession, found, held, encoding, classes, weights, rounds, depth, step, MIN_ROWS)
    return ThreatModel(encoding, tuple(classes), tuple(b for b, _ in fits), tuple(c for _, c in fits))
