"""Benchmark decontamination with a generalised suffix automaton.

The automaton over the normalised test items is built once and broadcast in parts of bounded size;
training tokens are streamed through it and the longest match ending at every word is tracked. A word is
hit when it lies inside an occurrence of a window: `window` consecutive item words, or a whole item
that is shorter.

Defined results: a null or wordless text has no words and no hits; null or wordless items have no
windows; equal windows of several items count for each of them; repeated rows get equal results; an
empty benchmark hits nothing; columns of `docs` other than the text are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.llm.common import TEXT, fresh, python_tasks, raw_texts, release

WINDOW = 13
#: Words of benchmark text in one broadcast automaton.
PART_WORDS = 1_000_000
#: A document is contaminated when hit words are at least this share (one in so many) of its words.
COVERAGE = 20

# Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased.
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for i in ids:
                    last = self._extend(last, i)
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=window)
        self._mark(coded, window)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, coded: list[tuple[str, list[int]]], window: int) -> None:
        """For every state the windows that are suffixes of its strings: (length, items), longest first."""
        ends: list[dict[int, set[str]]] = [{} for _ in self.length]
        for item, ids in coded:
            n = min(window, len(ids))
            for state, _, matched in self._walk(ids):
                if matched >= n:
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    ends[state].setdefault(n, set()).add(item)
        self.windows: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            own = tuple((n, tuple(sorted(found))) for n, found in sorted(ends[state].items(), reverse=True))
            self.windows[state] = own + (self.windows[self.link[state]] if state else ())

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(state, position, longest match ending there) along known words."""
        state = matched = 0
        following, link, length = self.next, self.link, self.length
        for at, c in enumerate(ids):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c in following[state]:
                state = following[state][c]
                matched += 1
            yield state, at, matched

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans of hit words and the items whose windows occur.

        A word outside the benchmark's vocabulary sets the automaton back to its root, so runs of known
        words shorter than the shortest window need no streaming.
        """
        find = self.vocabulary.get
        ids = [find(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        start, n = 0, len(ids)
        while start < n:
            try:
                stop = ids.index(-1, start)
            except ValueError:
                stop = n
            if stop - start >= self.shortest:
                for state, at, matched in self._walk(ids[start:stop]):
                    longest = 0
                    for size, found in self.windows[state]:
                        if size <= matched:
                            longest = longest or size
                            items.update(found)
                    if longest:
                        end = start + at + 1
                        begin = end - longest
                        while spans and spans[-1][1] >= begin:
                            begin = min(begin, spans.pop()[0])
                        spans.append((begin, end))
            start = stop + 1
        return spans, items


def benchmark_parts(benchmark: DataFrame, window: int, item: str, text: str,
                    part_words: int) -> Iterator[Automaton]:
    """Automata over consecutive parts of the benchmark, each of at most about `part_words` words."""
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        words = words_of((row[1] or "").encode())
        part.append((row[0] or "", words))
        size += len(words)
        if size >= part_words:
            yield Automaton(part, window)
            part, size = [], 0
    yield Automaton(part, window)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCH = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])


def _matcher(automaton) -> object:
    """Arrow UDF text → words, hit spans and items for one broadcast automaton."""

    @F.arrow_udf(from_arrow_type(_MATCH))
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        own = automaton.value
        for texts in batches:
            out = []
            for raw in raw_texts(texts):
                words = words_of(raw)
                spans, items = own.spans(words)
                out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans],
                            "items": sorted(items)})
            yield pa.array(out, _MATCH)

    return matched


def _summary(spans: Column) -> Column:
    """Hit words and longest span of the union of all parts' spans, in one pass over them by start.

    Without Python: a second Python step in a task is a second worker beside the matcher's, and both stay for later stages.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("n_hit", "longest", "begin", "end")])

    def more(so_far: Column, span: Column) -> Column:
        begin = F.when(span["start"] <= so_far["end"], so_far["begin"]).otherwise(span["start"])
        end = F.greatest(so_far["end"], span["end"])
        added = F.greatest(F.lit(0).cast("long"), span["end"] - F.greatest(span["start"], so_far["end"]))
        return F.struct((so_far["n_hit"] + added).alias("n_hit"), F.greatest(so_far["longest"], end - begin).alias("longest"),
                        begin.alias("begin"), end.alias("end"))

    return F.aggregate(F.array_sort(spans), zero, more)


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(found, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["end"])
        else:
            out.append((s["start"], s["end"]))
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, into: str = "matches", text: str = "text",
                 item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 part_words: int = PART_WORDS) -> DataFrame:
    """`docs` plus a struct column: n_words, n_hit, longest, n_items, items, items_sha256, spans, contaminated."""
    spark = docs.sparkSession
    python_tasks(spark)
    parts = []
    out = docs
    for automaton in benchmark_parts(benchmark, window, item, item_text, part_words):
        parts.append(fresh(out, f"_part{len(parts)}"))
        out = out.withColumn(parts[-1], _matcher(spark.sparkContext.broadcast(automaton))(F.col(text)))
    name, whole = fresh(out, "_whole"), fresh(out, "_summary")
    both = [F.flatten(F.array(*[F.col(p)[f] for p in parts])) if len(parts) > 1 else F.col(parts[0])[f]
            for f in ("spans", "items")]
    out = out.withColumn(name, F.struct(F.col(parts[0])["n_words"].alias("n_words"), both[0].alias("spans"),
                                        F.array_distinct(both[1]).alias("items")))
    out = out.withColumn(whole, _summary(F.col(name)["spans"]))
    n_words, n_hit = F.col(name)["n_words"], F.col(whole)["n_hit"]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), F.col(whole)["longest"].alias("longest"),
        F.size(F.col(name)["items"]).cast("long").alias("n_items"), F.col(name)["items"].alias("items"),
        F.sha2(F.array_join(F.array_sort(F.col(name)["items"]), ","), 256).alias("items_sha256"), F.col(name)["spans"].alias("spans"),
        ((n_hit > 0) & (COVERAGE * n_hit >= n_words)).alias("contaminated")).alias(into))


def over_limit(matches: Column, max_span: int | None = None) -> Column:
    """A document over its coverage limit, or with a hit span of more than `max_span` words."""
    over = matches["contaminated"]
    return over if max_span is None else over | (matches["longest"] > max_span)


@F.arrow_udf(TEXT)
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for raw, found in zip(raw_texts(texts), spans.to_pylist(), strict=True):
        kept, at = [], 0
        if found:
            places = [m.span() for m in _WORD.finditer(raw)]
            for a, b in _merged(found):
                kept.append(raw[at:places[a][0]])
                at = places[b - 1][1]
        out.append((b"".join(kept) + raw[at:]).decode())
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", max_span: int | None = None,
                  text: str = "text", **options) -> DataFrame:
    """Documents over the limits are dropped, or (`action="cut"`) lose their hit spans; others stay as they are.

    A cut null text becomes empty only if it was over a limit, which a text without words never is.
    """
    into = fresh(docs, "_matches")
    matched = with_matches(docs, benchmark, into, text, **options)
    over = over_limit(F.col(into), max_span)
    if action == "drop":
        return matched.filter(~over).drop(into)
    if action != "cut":
        raise ValueError(f"unknown action {action!r}")
    cut = F.when(over, _cut(F.col(text), F.col(into)["spans"])).otherwise(F.col(text))
    return matched.withColumn(text, cut).drop(into)
