"""Toxicity by noisy-channel deobfuscation.

A word of any length that looks disguised (digits or symbols among letters, marks between letters, long runs of a letter) is a
lattice: each character stands for itself or for letters it imitates, a separator for nothing or a word boundary, a
run for one or two letters. A Viterbi search finds the likeliest letters under a character language model of the
corpus plus channel costs, and the restored words are scored, next to the word as it is shown. Plain words restore to themselves.

The character model counts n-grams of plain words of any length over all documents; the table has one row for each n-gram of a fixed alphabet, whatever the corpus.
The classifier is fitted on at most `FIT_ROWS` labelled rows, those with the smallest hashes of their ids, each distinct text once:
restored words and their character n-grams that are far more frequent in toxic documents get log-odds weights, and a
logistic curve over two figures of a document, the weights of its features and the average strongest weight of its words, gives the score. Only texts and the labels of rows outside the held-out fifth are read for it.

Defined results: null, empty and wordless texts have no evidence and get the score of such texts; repeated rows get equal scores; rows
without label or with null label are not fitted on; of several labels of one document the largest counts; without
any label, or with only one class, the score is the share of toxic labels (0 without labels); other columns are
passed through; an empty table stays empty.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.llm.common import held, python_tasks, raw_texts, release, stored

FIT_ROWS = 20_000
#: A weighted feature is in at least this share of toxic texts, and the lower bound of its log odds (so many standard
#: errors below the estimate) reaches the least one.
MIN_SHARE, MIN_LOG_ODDS, ERRORS = 0.02, 2.0, 1.64
#: Lengths of a word's n-grams that are features besides the word itself, word edges included.
FEATURE_GRAMS = (4, 5, 6)
#: The weights of a document's features count up to this sum; its words count as this many at least.
CAP, FEW_WORDS = 200.0, 10
ORDER, BEAM = 4, 48

# Letters that a character may stand for, besides itself.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
SEPARATORS = "._-~'/\\,:;^=&%?\"<>[]{})`"
EDGE, BREAK = "^", "#"
SWAP, WILD, DROP, SPLIT, SHORTEN = 0.5, 2.0, 0.4, 1.0, 0.3

_STRIP = b".,;:?\"'()[]{}<>%&*#$!|/\\~^`=+-_"
#: Marks around a word that imitate no letter; up to two that do may belong to the disguise.
_MARKS, _AT_ENDS = b".,;:?\"'()[]{}<>%&/\\~^`=_-", 2
_DISGUISED = re.compile(rb"(?=.*[a-z])(?:.*[0-9@$!|+(*#]|.*([a-z])\1\1|.*[a-z][" + re.escape(SEPARATORS).encode() + rb"]+[a-z])")
_SPACED = re.compile(rb"(?<![^\x20\x09-\x0D])[a-z0-9@$!*](?:[\x20\x09-\x0D]+[a-z0-9@$!*](?![^\x20\x09-\x0D])){2,}")
_PLAIN = re.compile(rb"[a-z]+")


def plain(word: bytes) -> bytes:
    return word.strip(_STRIP)


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    padded = EDGE * (order - 1) + word + EDGE
    for i in range(len(padded) - order + 1):
        yield padded[i:i + order]


class CharModel:
    """Interpolated character n-grams (Witten-Bell): log P(letter | up to three letters before it)."""

    def __init__(self, counts: dict[str, int], order: int = ORDER):
        self.order = order
        self.seen: dict[str, Counter] = {}
        for gram, n in counts.items():
            for k in range(order):
                self.seen.setdefault(gram[k:-1], Counter())[gram[-1]] += n
        self.totals = {h: sum(c.values()) for h, c in self.seen.items()}
        self.memory: dict[tuple[str, str], float] = {}

    def cost(self, history: str, letter: str) -> float:
        """Negative log probability."""
        key = history, letter
        if key not in self.memory:
            p = 1 / 28
            for k in range(len(history), -1, -1):
                h = history[k:]
                if h in self.seen:
                    kinds, total = len(self.seen[h]), self.totals[h]
                    p = (self.seen[h][letter] + kinds * p) / (total + kinds)
            self.memory[key] = -math.log(p)
        return self.memory[key]


def arcs(shown: str) -> list[list[tuple[str, float]]]:
    """Lattice of a disguised word: for each run of equal characters the strings it may stand for, with channel costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(shown):
        j = i
        while j < len(shown) and shown[j] == shown[i]:
            j += 1
        c, n = shown[i], j - i
        if c.isspace():
            out.append([("", DROP), (BREAK, SPLIT)])
        elif c in SEPARATORS:
            out.append([("", DROP), (BREAK, SPLIT)])
        else:
            letters = [(c, 0.0)] if c.isalpha() else []
            letters += [(x, WILD if len(LOOKALIKES[c]) > 2 else SWAP) for x in LOOKALIKES.get(c, "")]
            letters = letters or [("", DROP)]
            if n == 1:
                out.append(letters)
            else:
                lengths = (1, 2) if n > 2 else (2, 1)
                out.append([(x * k, cost * k + (SHORTEN * (n > 2 or k == 1))) for x, cost in letters for k in lengths])
        i = j
    return out


def restore(shown: str, model: CharModel) -> list[str]:
    """Likeliest words behind a disguised one (Viterbi with the last letters as state), in time linear in its length."""
    start = EDGE * (model.order - 1)
    # Texts are chains of (text before, letter), so that no step copies them.
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for options in [*arcs(shown), [(BREAK, 0.0)]]:
        new: dict[str, tuple[float, tuple | None]] = {}
        for history, (spent, text) in states.items():
            for letters, channel in options:
                h, total, said = history, spent + channel, text
                for c in letters:
                    if c == BREAK:
                        total += model.cost(h, EDGE)
                        h, said = start, (said, " ")
                    else:
                        total += model.cost(h, c)
                        h, said = (h + c)[1:], (said, c)
                if h not in new or total < new[h][0]:
                    new[h] = total, said
        states = dict(sorted(new.items(), key=lambda s: s[1][0])[:BEAM]) if len(new) > BEAM else new
    (_, said), letters = states[start], []  # the last arc ends all paths in one state
    while said:
        said, c = said
        letters.append(c)
    return "".join(reversed(letters)).split()


class Restorer:
    """Features of the restored words of texts; remembers what every word has shown, up to a bound.

    With `only`, features outside of it are left out, and words that share a feature share its string.
    """

    def __init__(self, model: CharModel, only: frozenset[str] | None = None, remembered: int = 20_000):
        self.model, self.remembered = model, remembered if only is None else 30 * remembered
        self.only = None if only is None else {f: f for f in only}
        self.known: dict[bytes, tuple[str, ...]] = {}

    def word(self, shown: bytes) -> tuple[str, ...]:
        """Restored words of one shown word, and the word without marks."""
        bare, dressed = plain(shown), shown.strip(_MARKS)
        if not bare:
            return ()
        out = []
        if _DISGUISED.match(dressed):
            if len(dressed) - len(bare) <= _AT_ENDS:
                out += restore(dressed.decode("utf-8", "replace"), self.model)
            if dressed != bare and _DISGUISED.match(bare):
                out += restore(bare.decode("utf-8", "replace"), self.model)
        return (*out, bare.decode("utf-8", "replace"))

    def _features(self, words: list[str] | tuple[str, ...]) -> tuple[str, ...]:
        found = set()
        for w in words:
            edged = EDGE + w + EDGE
            found.add(edged)
            for n in FEATURE_GRAMS:
                found.update([edged[i:i + n] for i in range(len(edged) - n + 1)])
        return tuple(found if self.only is None else filter(None, map(self.only.get, found)))

    def by_word(self, raw: bytes) -> list[tuple[str, ...]]:
        """Features of each distinct shown word of a whole text, and of each run of single letters."""
        low = raw.lower()
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        out = []
        for shown in set(low.split()):
            found = known.get(shown)
            if found is None:
                found = known[shown] = self._features(self.word(shown))
            out.append(found)
        for run in _SPACED.findall(low):
            out.append(self._features(restore(" ".join(run.decode().split()), self.model)))
        return out


def packed(model: object) -> bytes:
    """What is broadcast: workers keep broadcast values until they are told otherwise, and bytes are small."""
    return zlib.compress(pickle.dumps(model, 5), 1)


def unpacked(raw: bytes) -> object:
    return pickle.loads(zlib.decompress(raw))


def restorer_of(counts: bytes, only: bytes | None = None) -> Restorer:
    """The worker's restorer for these packed counts and features."""
    return held(("restorer", hash(counts), hash(only)), lambda: Restorer(CharModel(unpacked(counts)), only and unpacked(only)))


def scorer_of(model: bytes) -> tuple[Restorer, dict[str, float]]:
    """The worker's restorer and weights for this packed model."""
    def made() -> tuple[Restorer, dict[str, float]]:
        own = unpacked(model)
        return Restorer(CharModel(own.counts), frozenset(own.weights)), own.weights

    return held(("scorer", hash(model)), made)


@dataclass
class ToxicModel:
    """Character counts, feature weights, and the logistic curve: shift, slope of the sum, slope of the average."""

    counts: dict[str, int]
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None


#: Bytes of text after which a task settles the words it remembers.
HELD_BYTES = 64 << 20


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    words: Counter = Counter()
    found: Counter = Counter()

    def settle() -> None:
        for word, n in words.items():
            bare = plain(word)
            if _PLAIN.fullmatch(bare):
                for g in grams(bare.decode()):
                    found[g] += n
        words.clear()

    held_bytes = 0
    for batch in batches:
        for raw in raw_texts(batch.column(0)):
            words.update(raw.lower().split())
            held_bytes += len(raw)
            if len(words) > 300_000 or held_bytes > HELD_BYTES:
                settle()
                held_bytes = 0
    settle()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def char_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Character n-grams of the plain words of all documents; at most 27 to the power of `ORDER` rows reach the driver."""
    python_tasks(docs.sparkSession)
    counted = docs.select(text).mapInArrow(_count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that is never fitted on; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Features that a task counts before it passes its counts on.
COUNTED = 120_000


def _count_features(counts, only=None):
    """Tasks that count in how many texts and in how many of their words each feature is; the empty feature counts all."""

    def table(texts: Counter, words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.string()), pa.array([texts[f] for f in words], pa.int64()), pa.array(list(words.values()), pa.int64())],
            ["feature", "texts", "words"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(counts.value, only and only.value)
        texts, words = Counter(), Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                own = restorer.by_word(raw)
                for found in own:
                    words.update(found)
                texts.update({f for found in own for f in found})
                words[""] += len(own)
                texts[""] += 1
            if len(words) > COUNTED:
                yield table(texts, words)
                texts, words = Counter(), Counter()
        yield table(texts, words)

    return counted


def fit_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fifth, each distinct text once."""
    own = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).filter(
        F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = own.groupBy("_id").agg(F.max("_label").cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # Broadcast: `rows` rows of two numbers at most.
    met = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    return met.groupBy("_text").agg(F.max("_label").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = FIT_ROWS) -> ToxicModel:
    """Features frequent in toxic texts first, then their counts in the others, then the curve."""
    counts = char_counts(docs, text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(packed(counts))
    seen = stored(fit_rows(docs, labels, doc_id, text, label, rows), "toxic-fit")
    toxic = F.col("_label") == 1
    n, n1 = seen.agg(F.count(F.lit(1)), F.coalesce(F.count_if(toxic), F.lit(0))).first()
    if n1 in (0, n):
        return ToxicModel(counts, constant=n1 / n if n else 0.0)
    n0 = n - n1

    def feature_counts(texts: DataFrame, only=None) -> DataFrame:
        own = texts.select("_text").mapInArrow(_count_features(shared, only), "feature string, texts bigint, words bigint")
        return own.groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))

    # A text of m features leaves at most m / MIN_SHARE of them for this list.
    frequent = {r["feature"]: r["words"] for r in
                feature_counts(seen.filter(toxic)).filter(F.col("texts") >= MIN_SHARE * n1).collect()}
    listed = spark.sparkContext.broadcast(packed(frozenset(frequent)))
    others = {r["feature"]: r["words"] for r in feature_counts(seen.filter(~toxic), listed).collect()}
    all1, all0 = (max(1, c.pop("", 1)) for c in (frequent, others))
    weights = {}
    for feature, k in frequent.items():
        k1, k0 = k + 0.5, others.get(feature, 0) + 0.5
        odds = math.log(k1 / all1) - math.log(k0 / all0)
        if odds - ERRORS * math.sqrt(1 / k1 + 1 / k0) >= MIN_LOG_ODDS:
            weights[feature] = odds
    return ToxicModel(counts, weights, _curve(seen, ToxicModel(counts, weights), toxic))


def _curve(seen: DataFrame, model: ToxicModel, toxic: Column) -> tuple[float, float, float]:
    """Logistic regression of the label on the two figures, over the fitted rows (their number is the documented bound)."""
    evidence = _evidence(seen.sparkSession.sparkContext.broadcast(packed(model)))
    rows = seen.select(toxic.cast("int").alias("y"), evidence(F.col("_text")).alias("e")).select("y", "e.*").groupBy(
        "y", F.round("total", 1).alias("total"), F.round("average", 3).alias("average")).agg(F.count(F.lit(1)).alias("n")).collect()
    y, n, total, average = (np.array([r[k] for r in rows], float) for k in ("y", "n", "total", "average"))
    x = np.stack([np.ones_like(y), total / CAP, average], axis=1)
    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        grad = x.T @ (n * (y - p)) - 0.1 * beta
        beta = beta + 0.5 * np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), grad)
    return float(beta[0]), float(beta[1] / CAP), float(beta[2])


_EVIDENCE = pa.struct([("total", pa.float64()), ("average", pa.float64())])


def _evidence(shared):
    """Arrow UDF text → (sum of the weights of its features, average over its words of their strongest weight)."""

    @F.arrow_udf(from_arrow_type(_EVIDENCE))
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer, weight = scorer_of(shared.value)
        for texts in batches:
            totals, averages = [], []
            for raw in raw_texts(texts):
                found = restorer.by_word(raw)
                marked = [f for f in found if f]
                totals.append(min(CAP, math.fsum(weight[f] for f in sorted({f for fs in marked for f in fs}))))
                averages.append(math.fsum(max(weight[f] for f in fs) for fs in marked) / max(FEW_WORDS, len(found)))
            yield pa.StructArray.from_arrays([pa.array(totals, pa.float64()), pa.array(averages, pa.float64())], fields=list(_EVIDENCE))

    return evidence


def with_scores(docs: DataFrame, model: ToxicModel, into: str = "score", text: str = "text") -> DataFrame:
    """`docs` plus the score of every text: the logistic curve over its evidence."""
    python_tasks(docs.sparkSession)
    if model.constant is not None:
        return docs.withColumn(into, F.lit(model.constant))
    e = _evidence(docs.sparkSession.sparkContext.broadcast(packed(model)))(F.col(text))
    shift, total, average = model.curve
    return docs.withColumn(into, 1 / (1 + F.exp(-(F.lit(shift) + F.lit(total) * e["total"] + F.lit(average) * e["average"]))))
