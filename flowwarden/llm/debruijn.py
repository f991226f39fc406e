"""Repeated long spans through a compacted de Bruijn graph of token k-mers.

Edges are k-mers of words. Of every `WINDOW`-word window only the k-mer with the smallest hash is an edge of the graph, so two
occurrences of one window have the same edge at the same place, and about one k-mer in ten is kept. One aggregation
over the edges counts them and tells whether all occurrences agree on the words up to the next edge and back to the
edge before; joined back to the occurrences, successive edges that agree compact into nonbranching
paths. All occurrences of a path carry the same words, so a path of repeated edges is one long repeated
span; windows at path ends and at branches that hold a repeated edge are candidates one by one. Spans
and windows are verified from their source coordinates: the words are read again from the documents,
hashed with 128 bits, and count only if the same words start at two places at least.

Nothing is gathered by edge: hot edges are pre-aggregated, and joins back meet one row for each edge. Only the edges,
paths and spans of one document are gathered, which its own length bounds.

Defined results: a null text has no words and no spans; texts shorter than a window have no window; repeated rows repeat each
other, also under one id or a null id; an empty table stays empty; extra columns are passed through by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.llm.common import fresh, has_unique_key, held, keyed_rows, python_tasks, raw_texts, stored

#: Words of a window and of an edge's k-mer.
WINDOW, EDGE_WORDS = 35, 16

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, n of each at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(4096, 2 * n)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(b)
            both.append(np.multiply.accumulate(out))
        _POWERS[base] = both[0], both[1]
    ups, downs = _POWERS[base]
    return ups[:n], downs[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of a hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Word hashes of one text, and hashes of any span of its words in constant time."""

    def __init__(self, raw: bytes, known: dict[bytes, int]):
        self.words = raw.split()
        ids = list(map(known.get, self.words))
        if None in ids:
            new = {w: xxhash.xxh64_intdigest(w, 7) | 1 for w, h in zip(self.words, ids, strict=True) if h is None}
            known.update(new)
            ids = list(map(known.__getitem__, self.words))
        self.ids = np.fromiter(ids, np.uint64, len(ids))
        self.sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.words)

    def spans(self, starts: np.ndarray, lengths, base: int) -> np.ndarray:
        """Hashes of the spans from `starts`, equal for equal words wherever they stand."""
        n = len(self.ids)
        ups, downs = _powers(base, n + 1)
        if base not in self.sums:
            self.sums[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.ids * ups[:n], dtype=np.uint64)])
        sums = self.sums[base]
        return _mixed((sums[starts + lengths] - sums[starts]) * downs[starts])


def _owners(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The position of every window's smallest k-mer, which never falls from one window to the next, and the hashes of all k-mers."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = words.spans(np.arange(n - k + 1), k, _BASES[0])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window - k + 1)
    return views.argmin(axis=1) + np.arange(len(views)), hashes


def _distinct(owners: np.ndarray) -> np.ndarray:
    return owners[np.concatenate([[True], owners[1:] != owners[:-1]])] if len(owners) else owners


def edges_of(words: Words, window: int = WINDOW, k: int = EDGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-mers that are the smallest of some window, in order."""
    owners, hashes = _owners(words, window, k)
    chosen = _distinct(owners)
    return chosen, hashes[chosen]


def _remembered() -> dict[bytes, int]:
    """Word hashes that the worker keeps."""
    known = held(("word hashes",), dict)
    if len(known) > 500_000:
        known.clear()
    return known


def _edge_arrays(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, edges, and hashes of what stands around them: the words to the edge before and to the next one."""
    at, hashes = edges_of(words, window, k)
    before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    if len(at) > 1:
        between = words.spans(at[:-1], at[1:] - at[:-1] + k, _BASES[1])
        before[1:], after[:-1] = between, between
    return at, hashes, _mixed(before * np.uint64(_BASES[0]) + after)


def _edge_rows(window: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, parts = [], []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                own = _edge_arrays(Words(raw, _remembered()), window, k)
                if len(own[0]):
                    index.append(np.full(len(own[0]), i))
                    parts.append(own)
            if parts:
                at, edge, around = (np.concatenate([p[j] for p in parts]) for j in range(3))
                keys = batch.column(0).take(pa.array(np.concatenate(index)))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(at.astype(np.int32)), pa.array(edge.view(np.int64)), pa.array(around.view(np.int64))],
                    ["key", "pos", "edge", "around"])

    return rows


_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))


def candidates(words: Words, at: np.ndarray, agree: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths): long spans of nonbranching paths, and the windows of repeated edges outside of them.

    `at` are the positions of the repeated edges; `agree` tells whether all occurrences of an edge have the same words
    around them. It is a property of the edge, so a path has the same extent at each of its occurrences.
    """
    n = len(words)
    owner, _ = _owners(words, window, k)
    every = _distinct(owner)
    repeated = np.isin(every, at)
    agreeing = np.zeros(len(every), bool)
    agreeing[np.searchsorted(every, at)] = agree
    joined = agreeing[:-1] & agreeing[1:]
    breaks = np.flatnonzero(~joined) + 1
    begins, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(every)]])
    path_start, path_end = every[begins], every[ends - 1] + k
    long = repeated[begins] & (path_end - path_start >= window)
    # Each window belongs to its smallest edge; it is open if that edge repeats and no long path holds the window.
    index = np.searchsorted(every, owner)
    path = np.searchsorted(begins, index, side="right") - 1
    starts = np.arange(n - window + 1)
    inside = long[path] & (starts >= path_start[path]) & (starts + window <= path_end[path])
    single = starts[repeated[index] & ~inside]
    return (np.concatenate([path_start[long], single]).astype(np.int64),
            np.concatenate([(path_end - path_start)[long], np.full(len(single), window)]).astype(np.int64))


@F.arrow_udf(from_arrow_type(_CANDIDATES))
def _candidate_spans(texts: pa.Array, found: pa.Array, window: pa.Array, k: pa.Array) -> pa.Array:
    sizes = (window[0].as_py(), k[0].as_py()) if len(texts) else (WINDOW, EDGE_WORDS)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
    rows = found.flatten()
    pos, agree = rows.field("pos").to_numpy().astype(np.int64), rows.field("agree").to_numpy(zero_copy_only=False)
    parts, counts = [], [0]
    for i, raw in enumerate(raw_texts(texts)):
        words, own = Words(raw, _remembered()), slice(ends[i], ends[i + 1])
        order = np.argsort(pos[own])
        starts, lengths = candidates(words, pos[own][order], agree[own][order], *sizes)
        parts.append((starts, lengths, *(words.spans(starts, lengths, base).view(np.int64) for base in _BASES)))
        counts.append(len(starts))
    columns = [np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in range(4)]
    kinds = _CANDIDATES.value_type
    values = pa.StructArray.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), values)


def repeated_spans(docs: DataFrame, key: str, text: str, window: int = WINDOW, k: int = EDGE_WORDS) -> DataFrame:
    """(key, spans): spans of words (start, length) that occur elsewhere too; only documents that have one."""
    python_tasks(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    edges = own.mapInArrow(_edge_rows(window, k), f"key {kind}, pos int, edge bigint, around bigint")
    told = edges.groupBy("edge").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("least"), F.max("around").alias("most")).filter("n > 1").select(
        "edge", (F.col("least") == F.col("most")).alias("agree"))
    repeated = edges.join(told, "edge").groupBy("key").agg(F.collect_list(F.struct("pos", "agree")).alias("edges"))
    spans = own.join(repeated, "key").select("key", F.explode(_candidate_spans(
        F.col("text"), F.col("edges"), F.lit(window), F.lit(k))).alias("s")).select("key", "s.*")
    spans = stored(spans, "spans")
    sure = spans.groupBy("high", "low", "length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high", "low", "length")
    return spans.join(sure, ["high", "low", "length"]).groupBy("key").agg(
        F.collect_list(F.struct("start", "length")).alias("spans"))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


_KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


@F.arrow_udf(from_arrow_type(_KEPT))
def _kept_words(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    ends, rows = np.cumsum(counts), found.flatten()
    start, length = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length"))
    for raw, n, end in zip(raw_texts(texts), counts.tolist(), ends.tolist(), strict=True):
        words = kept = raw.split()
        if n:
            own = slice(end - n, end)
            kept = list(compress(words, (~covered(len(words), start[own], length[own])).tolist()))
        whole = b" ".join(kept)
        out.append((len(words), len(words) - len(kept), whole.decode() if n else None, hashlib.sha256(whole).hexdigest()))
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KEPT, strict=True)] if out
                                      else [pa.array([], f.type) for f in _KEPT], fields=list(_KEPT))


def with_kept_words(docs: DataFrame, into: str = "kept", doc_id: str = "doc_id", text: str = "text",
                    window: int = WINDOW, k: int = EDGE_WORDS) -> DataFrame:
    """`docs` plus a struct: n_words, n_removed, kept words (null where nothing was removed), kept_sha256."""
    key, spans = fresh(docs, "_key"), fresh(docs, "_spans")
    keyed = docs.withColumn(key, F.col(f"`{doc_id}`")) if has_unique_key(docs, doc_id) else \
        stored(keyed_rows(docs, doc_id, text, key), "keyed")
    found = repeated_spans(keyed, key, text, window, k).select(F.col("key").alias("_found"), F.col("spans").alias(spans))
    met = keyed.join(found, F.col(key).eqNullSafe(F.col("_found")), "left")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], _kept_words(F.col(text), F.col(spans)).alias(into))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without their repeated words; texts that lose none stay unchanged."""
    into = fresh(docs, "_kept")
    kept = with_kept_words(docs, into, doc_id, text, **options)
    return kept.withColumn(text, F.coalesce(F.col(into)["kept"], F.col(text))).drop(into)
