"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the words on both sides.

A word's probability is that of its class beside its neighbours times its share of the class. The most frequent words are
classes of their own; the others are classed by their endings. Shares come from the counts of all words in all documents: every word
met at least `LEAST` times has its own, rarer words of a class, and one unseen word, divide what is left of it. The lexicon of shares
grows with the corpus. Up to `MOST_WORDS` words (12 bytes each) are broadcast at a time; a larger lexicon is stored and
cut by hash, and the texts pass its slices one after the other, each adding the shares of its own words.

The network adds one learned vector for each of the four neighbours of a
position, passes the sum through tanh, and a softmax over the classes gives the distribution of the masked
token's class. Texts are encoded once, a byte for each token's class and the sum of the log shares, and stored; training and scoring read the bytes. The network is trained in numpy inside Spark tasks, data-parallel: documents fall into rounds by a hash of their
text; in each round every task takes gradient steps over its documents from the shared weights, and Spark averages
the results, weighted by their tokens. Every document is used once. A document's score is the sum of its tokens' log probabilities.

Only the lexicon, about `MOST_WORDS` rows of numbers at a time, and the weights, of fixed size, reach the driver.

Defined results: a null, empty or wordless text has no tokens, sum 0 and a null mean; repeated rows get equal scores and count as
often as they stand there; an empty table trains nothing and returns no rows; other columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.llm.common import fresh, python_tasks, raw_texts, stored

#: Classes of one frequent word each, classes of word endings, one edge class, width of the vectors.
FREQUENT, ENDINGS, WIDTH = 191, 64, 16
EDGE = FREQUENT + ENDINGS
#: Occurrences that give a word a share of its own, such words that are broadcast at a time, bytes of an ending.
LEAST, MOST_WORDS, ENDING = 5, 4_000_000, 2
#: Seed of Spark's 64-bit hash, so that tasks find words by the hashes Spark has made.
HASH_SEED = 42
SIZE = EDGE + 1
OFFSETS = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 3, 1024, 0.1
SEED = 11


@dataclass
class Network:
    """Neighbour vectors (offset, token, width), output weights (width, token) and biases."""

    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = SEED) -> Network:
        """Small random vectors; biases at the smoothed token frequencies."""
        rng = np.random.default_rng(seed)
        share = (counts + 1.0) / (counts.sum() + len(counts))
        return cls((rng.standard_normal((len(OFFSETS), SIZE, WIDTH)) * 0.1).astype(np.float32),
                   (rng.standard_normal((WIDTH, SIZE)) * 0.1).astype(np.float32), np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.out.ravel(), self.bias]).astype(np.float64)

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        a, b = len(OFFSETS) * SIZE * WIDTH, WIDTH * SIZE
        f = flat.astype(np.float32)
        return cls(f[:a].reshape(len(OFFSETS), SIZE, WIDTH), f[a:a + b].reshape(WIDTH, SIZE), f[a + b:].copy())

    def hidden(self, sides: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.near[k][sides[k]] for k in range(len(OFFSETS))))

    def _logits(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden vectors with a 1 for the bias, and logits, shifted only where weights could take them out of range."""
        h = np.ones((sides.shape[1], WIDTH + 1), np.float32)
        h[:, :WIDTH] = self.hidden(sides)
        z = h @ np.vstack([self.out, self.bias])
        if (np.abs(self.out).sum(axis=0) + np.abs(self.bias)).max() > 60:
            z -= z.max(axis=1, keepdims=True)
        return h, z

    def log_probabilities(self, ids: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """log P(token | its neighbours) of every position."""
        found = np.empty(len(ids))
        for at in range(0, len(ids), BATCH):
            own = slice(at, at + BATCH)
            _, z = self._logits(sides[:, own])
            chosen = z[np.arange(len(z)), ids[own]]
            found[own] = chosen - np.log(np.exp(z, out=z).sum(axis=1))
        return found

    def gradient(self, ids: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the mean negative log probability of a batch, for each array of parameters."""
        h, e = self._logits(sides)
        np.exp(e, out=e)
        sums = e.sum(axis=1)
        e[np.arange(len(e)), ids] -= sums
        # Rows are divided by their sums on the narrow side of the products.
        each = (1 / (len(ids) * sums))[:, None]
        back = (e @ self.out.T) * (each - each * h[:, :WIDTH] ** 2)
        near = np.zeros_like(self.near)
        for k in range(len(OFFSETS)):
            order = np.argsort(sides[k].astype(np.int16), kind="stable")  # short integers sort by radix
            tokens = sides[k][order]
            firsts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            near[k][tokens[firsts]] = np.add.reduceat(back[order], firsts, axis=0)
        out = (e.T @ (h * each)).T
        return near, out[:WIDTH], out[WIDTH]


class Steps:
    """Gradient steps whose size falls for each parameter with the gradients it has seen (Adagrad)."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate = network, rate
        self.seen = [np.full_like(p, 1e-8) for p in (network.near, network.out, network.bias)]

    def take(self, ids: np.ndarray, sides: np.ndarray) -> None:
        net = self.network
        for p, seen, g in zip((net.near, net.out, net.bias), self.seen, net.gradient(ids, sides), strict=True):
            seen += g * g
            p -= self.rate * g / np.sqrt(seen)


@dataclass
class Lexicon:
    """Frequent words in class order, sorted hashes of the other listed words with their log shares, log share of an unlisted word by class.

    Of a lexicon too large to hold, `table` (hash, class, n) has the listed words and `hashes` none. A slice of it holds the words whose
    hash modulo `slices` is `own`, and gives all others the log share 0.
    """

    words: list[bytes]
    hashes: np.ndarray
    shares: np.ndarray
    unlisted: np.ndarray
    slices: int = 1
    own: int = 0
    table: DataFrame | None = None
    counts: np.ndarray | None = None

    def parts(self) -> Iterator[Lexicon]:
        """Slices that can be held; one at a time is collected."""
        if self.table is None:
            yield self
            return
        for own in range(self.slices):
            hashes, shares = _listed(self.table.filter(F.pmod("hash", F.lit(self.slices)) == own), self.counts)
            yield Lexicon(self.words, hashes, shares, self.unlisted, self.slices, own)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(classes, log shares in their classes) of words that are not frequent ones."""
        classes = np.fromiter((FREQUENT + xxhash.xxh64_intdigest(w[-ENDING:], HASH_SEED) % ENDINGS for w in words), np.uint8, len(words))
        shares = self.unlisted[classes]
        if len(self.hashes) or self.slices > 1:
            own = np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in words), np.uint64, len(words)).view(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            shares = np.where(self.hashes[at] == own, self.shares[at], shares)
        if self.slices > 1:
            shares = np.where(own % self.slices == self.own, shares, np.float32(0))
        return classes, shares


class Encoder:
    """Classes and log shares of the words of texts; remembers the words met so far, up to a bound."""

    def __init__(self, lexicon: Lexicon, remembered: int = 1_000_000):
        self.lexicon, self.remembered = lexicon, remembered
        self._restart()

    def _restart(self) -> None:
        self.numbers = {w: i for i, w in enumerate(self.lexicon.words)}
        self.classes = np.arange(len(self.numbers), dtype=np.uint8)
        self.shares = np.zeros(len(self.numbers), np.float32)

    def texts(self, raws: list[bytes]) -> Iterator[tuple[bytes, float]]:
        """(class of each word, a byte each, and the sum of the log shares) of each text."""
        if len(self.numbers) > self.remembered:
            self._restart()
        split = [raw.lower().split() for raw in raws]
        new = list(set().union(*split) - self.numbers.keys())
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        classes, shares = self.lexicon.look_up(new)
        self.classes, self.shares = np.concatenate([self.classes, classes]), np.concatenate([self.shares, shares])
        for words in split:
            at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            yield self.classes[at].tobytes(), float(self.shares[at].sum(dtype=np.float64))


def neighbours(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, neighbours of each by offset) of several texts laid end to end; edges separate them."""
    if not any(map(len, texts)):
        return np.zeros(0, np.int64), np.zeros((len(OFFSETS), 0), np.int64)
    gap = np.full(2, EDGE, np.int64)
    row = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    here = np.concatenate([[False, False], *[x for t in texts for x in (np.ones(len(t), bool), [False, False])]]).nonzero()[0]
    return row[here], np.stack([row[here + o] for o in OFFSETS])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for batch in batches:
        for raw in raw_texts(batch.column(0)):
            words.update(raw.lower().split())
        if len(words) > 300_000:
            yield done()
    yield done()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; every task adds up before the shuffle."""
    python_tasks(docs.sparkSession)
    return docs.select(text).mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    lexicon: Lexicon
    weights: np.ndarray


def _listed(found: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and their log shares of their classes."""
    table = found.toArrow()
    hashes, classes, n = (table.column(c).to_numpy() for c in ("hash", "class", "n"))
    order = np.argsort(hashes)
    return hashes[order], np.log(n / (counts[classes] + 1)).astype(np.float32)[order]


def vocabulary(docs: DataFrame, text: str = "text", least: int = LEAST, most: int | None = None,
               together: int = MOST_WORDS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon of the words of all documents, and how often each class occurs.

    Every word met `least` times is listed, whatever their number; of more than `together` words slices are made, which changes no
    share. A caller may ask for a smaller lexicon of at most `most` words: then the least count doubles until they are that few.
    """
    counted = stored(word_counts(docs, text), "lm-words")
    ranked = counted.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()
    # Broadcast: `FREQUENT` rows.
    top = F.broadcast(docs.sparkSession.createDataFrame([(r["word"],) for r in ranked], "word binary"))
    ending = F.xxhash64(F.substring("word", -ENDING, ENDING))
    rest = counted.join(top, "word", "left_anti").select(
        F.xxhash64("word").alias("hash"), (F.pmod(ending, F.lit(ENDINGS)) + FREQUENT).cast("int").alias("class"), "n")
    listed = rest.filter(F.col("n") >= least).count()
    while most is not None and listed > most:
        least *= 2
        listed = rest.filter(F.col("n") >= least).count()
    rare = F.col("n") < least
    counts, unlisted = np.zeros(SIZE), np.zeros(SIZE, np.float32)
    counts[:len(ranked)] = [r["n"] for r in ranked]
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("left"),
                                       F.count_if(rare).alias("words")).collect():
        counts[r["class"]] = r["n"]
        unlisted[r["class"]] = np.log((r["left"] + 1) / (r["n"] + 1) / (r["words"] + 1))
    words = [bytes(r["word"]) for r in ranked]
    if listed > together:
        none = np.zeros(0, np.int64), np.zeros(0, np.float32)
        return Lexicon(words, *none, unlisted, -(-listed // together), 0, stored(rest.filter(~rare), "lm-lexicon"), counts), counts
    return Lexicon(words, *_listed(rest.filter(~rare), counts), unlisted), counts


_CODED = pa.struct([("classes", pa.binary()), ("shares", pa.float64())])


def encode(docs: DataFrame, lexicon: Lexicon, into: str = "ids", text: str = "text") -> DataFrame:
    """`docs` plus the class of every word of its text, one byte each, and the sum of their log shares; later passes need no text."""
    python_tasks(docs.sparkSession)
    if lexicon.table is not None:
        sums = fresh(docs, "_shares")
        done = docs.withColumn(sums, F.lit(0.0))
        for part in lexicon.parts():  # stored, so that no task holds two slices
            done = stored(_encoded(done, part, into, text).withColumn(sums, F.col(sums) + F.col(into)["shares"]), "lm-slices")
        whole = F.when(F.col(into).isNotNull(), F.struct(F.col(into)["classes"].alias("classes"), F.col(sums).alias("shares")))
        return done.withColumn(into, whole).drop(sums)
    return _encoded(docs, lexicon, into, text)


def _encoded(docs: DataFrame, lexicon: Lexicon, into: str, text: str) -> DataFrame:
    # Broadcast: about `MOST_WORDS` words of 12 bytes.
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf(from_arrow_type(_CODED))
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value)
        for texts in batches:
            found = list(own.texts(list(raw_texts(texts))))
            yield pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.binary()), pa.array([s for _, s in found], pa.float64())],
                                             fields=list(_CODED))

    return docs.withColumn(into, coded(F.col(text)))


def _decoded(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.uint8).astype(np.int64) for raw in raw_texts(ids)]


def _trainer(weights, rate: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights.value
        network = Network.of(start)
        steps, seen = Steps(network, rate), 0
        for batch in batches:
            ids, sides = neighbours(_decoded(batch.column(0)))
            order = np.random.default_rng(SEED).permutation(len(ids))
            for at in range(0, len(ids), BATCH):
                own = order[at:at + BATCH]
                steps.take(ids[own], sides[:, own])
            seen += len(ids)
        if seen:
            change = network.flat() - start
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([change.tolist()], pa.list_(pa.float64()))], ["n", "change"])

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted sum of the changes of some tasks."""
    total, seen = None, 0
    for batch in batches:
        for n, change in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = n * change.values.to_numpy()
            total, seen = own if total is None else total + own, seen + n
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(total / seen).tolist()], pa.list_(pa.float64()))], ["n", "change"])


_CHANGE = "n bigint, change array<double>"


def train_encoded(encoded: DataFrame, lexicon: Lexicon, counts: np.ndarray, ids: str = "ids", rounds: int = ROUNDS,
                  rate: float = RATE) -> LanguageModel:
    """One pass over all encoded documents in `rounds` parts of averaged gradient steps."""
    spark = encoded.sparkSession
    python_tasks(spark)
    flat = Network.start(counts).flat()
    for part in range(rounds):
        own = encoded.select(F.col(ids)["classes"].alias("classes")).filter(F.pmod(F.xxhash64("classes"), F.lit(rounds)) == part)
        changes = own.mapInArrow(_trainer(spark.sparkContext.broadcast(flat), rate), _CHANGE)
        # Averages of some tasks first, so the last step sees few rows however many tasks there were.
        few = changes.repartition(8).mapInArrow(_average, _CHANGE).coalesce(1).mapInArrow(_average, _CHANGE).collect()
        for row in few:
            flat = flat + np.array(row["change"])
    return LanguageModel(lexicon, flat)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = RATE) -> LanguageModel:
    """Vocabulary from the word counts of all documents, then the network from all their tokens."""
    lexicon, counts = vocabulary(docs, text)
    encoded = stored(encode(docs.select(F.col(text).alias("text")), lexicon).select("ids"), "lm-ids")
    return train_encoded(encoded, lexicon, counts, rounds=rounds, rate=rate)


_SCORE = pa.struct([("n_tokens", pa.int64()), ("log_likelihood", pa.float64()), ("mean", pa.float64())])


def score_encoded(encoded: DataFrame, model: LanguageModel, into: str = "likelihood", ids: str = "ids") -> DataFrame:
    """`encoded` plus a struct of tokens, summed and mean conditional log probability."""
    python_tasks(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf(from_arrow_type(_SCORE))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = Network.of(shared.value)
        for found in batches:
            coded, within = _decoded(found.field("classes")), found.field("shares").to_numpy(zero_copy_only=False)
            own, sides = neighbours(coded)
            upto = np.concatenate([[0.0], np.cumsum(network.log_probabilities(own, sides))])
            ends = np.cumsum([len(c) for c in coded], dtype=np.int64)
            sums = ((n, float(upto[e] - upto[e - n] + s)) for n, e, s in zip(map(len, coded), ends.tolist(), within, strict=True))
            rows = [(n, total, total / n if n else None) for n, total in sums]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_SCORE)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORE, strict=True)], fields=list(_SCORE))

    return encoded.withColumn(into, score(F.col(ids)))


def with_likelihoods(docs: DataFrame, model: LanguageModel, into: str = "likelihood", text: str = "text") -> DataFrame:
    """`docs` plus a struct of tokens, summed and mean conditional log probability of every text."""
    ids = fresh(docs, "_ids")
    return score_encoded(encode(docs, model.lexicon, ids, text), model, into, ids).drop(ids)
