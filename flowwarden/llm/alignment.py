"""Alignment of two tokenizers' tokens by interval coalescing.

A text, with a space before it, is cut by tokenizer A (byte-level pairs) and by tokenizer B (pieces that add the space
themselves). Every token is a byte interval. The intervals of both sides are sorted by start, the running maximum of their ends
is taken, and a group begins where a start reaches that maximum; inside a group the overlapping intervals of the two sides
are its links. Groups hold token ids, links hold id pairs, and a pair is known by the number of documents that hold it.

Both tokenizers cut at a single space between two other characters, so such parts of a text are encoded and coalesced once
and remembered; parts with other white space at their ends are joined to their neighbours first. Texts are handled in blocks of
bounded size. A block has each of its pairs once, and only those meet the corpus-wide counts in Spark joins; the
answers return to their block. No table of pairs is broadcast or gathered.

Defined results: a null or empty text, and one whose tokens' bytes do not spell it, has no tokens, zeros and an empty digest; every row
is a document of its own, rows of equal id included; null ids stay null; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import held, python_tasks, release, slices, spans, stored

#: Parts a worker remembers before it begins anew, bytes of text whose parts are learnt at a time, bytes of text in a block.
REMEMBERED, SLICE_BYTES, BLOCK_BYTES = 250_000, 1 << 20, 4 << 20
#: Writers and readers hold a row group, so each block is one: by default its size is first looked at after a hundred rows.
ONE_BLOCK = {"parquet.block.row.count.limit": "1"}
ODD, SIGNS = -1, ";|,"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_LISTS = {"doc_ids": pa.int64(), **{f: pa.int64() for f in FIGURES}, "digests": pa.string(), "pairs": pa.int64(), "holders": pa.int64(),
          "kinds": pa.int32(), "places": pa.int32(), "times": pa.int32()}
BLOCKS = "block bigint, " + ", ".join(f"{n} array<{ {pa.int64(): 'bigint', pa.int32(): 'int', pa.string(): 'string'}[t]}>" for n, t in _LISTS.items())


def byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group number of every A and every B interval, and the index pairs of overlapping A and B intervals.

    Each side is in ascending order without overlaps of its own.
    """
    starts, ends = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    first, past = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = past - first
    a = np.repeat(np.arange(len(a_start)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[:len(a_start)], group[len(a_start):], a, b


class Aligner:
    """Groups and links of parts, remembered by number; `texts` gives the parts of a text."""

    def __init__(self, a_file: str, b_file: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        letters, self.a_bytes = byte_letters(), [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        before = json.loads(a_file).get("pre_tokenizer") or {}
        #: Neither tokenizer has a token that reaches across a space behind another character.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any(
            "▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # ODD for parts that must be joined to their neighbours
        self.groups: list[bytes] = []
        self.figures = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.broken: set[int] = set()

    def joined(self, text: str) -> list[str]:
        """Parts behind a space each; only a part that holds the space itself may begin or end with white space."""
        found = text.split(" ")
        out: list[list[str]] = [[found[0]]]
        for left, right in zip(found, found[1:], strict=False):
            if not self.cuts or not left or not right or left[-1].isspace() or right[0].isspace():
                out[-1].append(right)
            else:
                out.append([right])
        return [" ".join(own) for own in out]

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the parts of each text."""
        if len(self.groups) > REMEMBERED:
            self.forget()
        found = [t.split(" ") if self.cuts else [t] for t in texts]
        self._learn(set().union(*found).difference(self.known))
        known = self.known
        out = [list(map(known.__getitem__, parts)) for parts in found]
        for i, own in enumerate(out):
            if min(own) == ODD:
                parts = [" " + p for p in self.joined(texts[i])]  # keys that no part of one word has
                self._learn(set(parts).difference(known), True)
                out[i] = list(map(known.__getitem__, parts))
        return out

    def _learn(self, new: set[str], joined: bool = False) -> None:
        if self.cuts and not joined:
            odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            self.known.update(dict.fromkeys(odd, ODD))
            new = new - odd
        if not new:
            return
        parts = list(new)
        shown = parts if joined else [" " + p for p in parts]
        a_ids = [e.ids for e in self.a.encode_batch_fast(shown, add_special_tokens=False)]
        b_ids = self.b.encode([p[1:] for p in shown], num_threads=1)
        begin = len(self.groups)
        for i, (text, xs, ys) in enumerate(zip(shown, a_ids, b_ids, strict=True)):
            raw = text.encode()
            if b"".join([self.a_bytes[x] for x in xs]) != raw or b"".join([self.b_bytes[y] for y in ys]) != raw:
                a_ids[i] = b_ids[i] = []
                self.broken.add(begin + i)
        a_len, b_len = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_group, b_group, left, right = coalesce(a_end - self.a_size[a], a_end, b_end - self.b_size[b], b_end)
        a_part, b_part = np.repeat(np.arange(len(parts)), a_len), np.repeat(np.arange(len(parts)), b_len)
        n_links = np.bincount(a_part[left], minlength=len(parts))
        n_groups = np.bincount(a_part[np.diff(a_group, prepend=-1) > 0], minlength=len(parts))
        self.ends = np.concatenate([self.ends, len(self.links) + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, a[left] << 32 | b[right]])
        self.figures = np.concatenate([self.figures, np.stack([a_len, b_len, n_groups], axis=1)])
        # Text of the groups: A's ids in front of B's within each, a sign before every id.
        group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side, ids = group[order], side[order], np.concatenate([a, b])[order].tolist()
        sign = np.where(np.diff(group, prepend=-1) > 0, 0, np.where(np.diff(side, prepend=0) > 0, 1, 2)).tolist()
        words = [SIGNS[s] + str(i) for s, i in zip(sign, ids, strict=True)]
        at = 0
        for end in np.cumsum(a_len + b_len).tolist():
            self.groups.append("".join(words[at:end])[1:].encode())
            at = end
        self.known.update(zip(parts, range(begin, begin + len(parts)), strict=True))

    def documents(self, texts: list[str | None]) -> list[tuple[tuple[int, ...], str, np.ndarray, np.ndarray]]:
        """For each text its figures, digest of the groups, distinct pairs and how often each is linked."""
        some = [i for i, t in enumerate(texts) if t]
        out = [((0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        for i, numbers in zip(some, self.numbers([texts[i] for i in some]) if some else [], strict=True):
            if self.broken and not self.broken.isdisjoint(numbers):
                continue
            digest = hashlib.sha256(b";".join(map(self.groups.__getitem__, numbers))).hexdigest()
            own, n = np.unique(np.array(numbers), return_counts=True)
            begin = np.where(own, self.ends[own - 1], 0)
            at, run = spans(self.ends[own] - begin, begin)
            links, n_links = self.links[at], n[run]
            order = np.argsort(links)
            first = np.flatnonzero(np.diff(links[order], prepend=-1))
            times = np.add.reduceat(n_links[order], first)
            out[i] = (*(n @ self.figures[own]).tolist(), int(n_links.sum())), digest, links[order[first]], times
        return out


def aligner(a_file: str, b_file: bytes) -> Aligner:
    """The worker's aligner for these two files."""
    return held(("aligner", hash(a_file), hash(b_file)), lambda: Aligner(a_file, b_file))


def _blocks(files):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        number, size = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            ids, figures, digests, pairs, times = zip(*rows, strict=True)
            distinct, places, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            columns = [ids, *zip(*figures, strict=True), digests, distinct, holders, [len(p) for p in pairs], places, np.concatenate(times)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c).cast(t))
                                       for c, t in zip(columns, _LISTS.values(), strict=True)]], ["block", *_LISTS])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, n in slices(texts, SLICE_BYTES):
                some = texts[at:at + n].to_pylist()
                rows += [(key, *found) for key, found in zip(keys[at:at + n].to_pylist(), own.documents(some), strict=True)]
                size += sum(len(t or "") + 200 for t in some)
                if size >= BLOCK_BYTES:
                    yield done()
                    number, size = number + 1, 0
                    rows.clear()
        if rows:
            yield done()

    return blocks


def _figures(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The figures of a block's documents, from the answers to its pairs in any order."""
    release()  # what the worker remembered of the blocks
    row = {n: block.column(n)[0].values for n in block.column_names if n != "block"}
    kinds, places, times = (row[n].to_numpy() for n in ("kinds", "places", "times"))
    doc = np.repeat(np.arange(len(kinds)), kinds)
    counts, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, bool)
    at = answers.column("place").to_numpy()
    counts[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
    count_sum, n_best = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    np.add.at(count_sum, doc, times * counts[places])
    np.add.at(n_best, doc, times * best[places])
    return pa.Table.from_arrays(
        [row["doc_ids"], *[row[f] for f in FIGURES], pa.array(n_best), pa.array(count_sum), row["digests"]],
        ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n documents, best): A's id times 2^32 plus B's; best if no other B id is linked to A's id in more documents."""
    met = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = met.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The files are a byte-level tokenizer's JSON and a sentencepiece model, read on the driver and broadcast (fixed size).
    """
    spark = docs.sparkSession
    python_tasks(spark)
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(files), BLOCKS), "aligned", **ONE_BLOCK)
    counts = stored(pair_counts(blocks), "pair-counts")
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("of", "place", "n", "best")
    # Both sides are sorted by block, which spills; a block at a time goes to Python.
    return blocks.drop("pairs", "holders").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        _figures, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FIGURES) + ", n_best bigint, count_sum bigint, groups_sha256 string")


def aligned_groups(text: str, a_file: str, b_file: str) -> list[tuple[list[int], list[int]]]:
    """Groups of one text as (A ids, B ids); empty if it has no tokens."""
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        own = Aligner(f.read(), g.read())
    numbers = own.numbers([text])[0] if text else []
    if not own.broken.isdisjoint(numbers):
        return []
    found = b";".join(own.groups[i] for i in numbers).decode()
    return [tuple([int(x) for x in side.split(",")] for side in g.split("|")) for g in found.split(";") if g]
