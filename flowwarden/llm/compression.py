"""Compression bands: zstandard ratios of whole documents and of fixed chunks, with limits by length.

The ratio is raw bytes over compressed bytes. Text that repeats itself has a high ratio, text without any
structure a low one. Short texts compress less, so limits stand in bands of length. A document is kept
if its whole ratio is inside its band and none of its chunks is too repetitive for the chunk limit on too large a share.

Base figures (words, symbols, repeated lines and windows) come in the same pass over the text.

Defined results: a null or empty text has no words and is rejected by the base rule; repeated rows give equal
results; an empty table stays empty; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from flowwarden.llm.common import python_tasks, raw_texts

LEVEL = 3
CHUNK = 2048
#: Bands: up to so many bytes, least and largest ratio of the whole text. Prose lies between 1.3 and 3 and rises
#: with length; repetition starts well above, base-64 or random bytes lie below.
BANDS = ((512, 1.05, 2.8), (2048, 1.25, 3.4), (8192, 1.5, 4.0), (32768, 1.6, 4.5), (1 << 62, 1.6, 5.0))
#: A chunk outside these limits is bad; at most this share of the chunks may be.
CHUNK_LOW, CHUNK_HIGH, BAD_SHARE = 1.25, 3.6, 0.3
MIN_WORDS, MAX_REPEATED = 50, 50

_SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(c for c in range(256) if c not in _SYMBOLS)
_FIGURES = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_LINE = re.compile(rb"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that occur at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes, base = ids[:n], len(number)
    for k in range(1, width):
        if base ** (k + 1) >= 1 << 62:  # renumber before codes get too large
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * base + ids[k:k + n]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    found = 0
    for line in raw.split(b"\n"):
        if line in seen:
            found += 1
        elif _LINE.search(line):
            seen.add(line)
    return found


def verdict(raw: bytes, press: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, bad chunks, kept)."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(raw) / len(press.compress(raw))
    low, high = next((a, b) for size, a, b in bands if len(raw) <= size)
    # A last piece under half a chunk says little and belongs to the chunk before it.
    n = max(1, (len(raw) + chunk // 2) // chunk)
    bad = 0
    if n > 1:
        for i in range(n):
            piece = raw[i * chunk:(i + 1) * chunk if i < n - 1 else len(raw)]
            bad += not CHUNK_LOW <= len(piece) / len(press.compress(piece)) <= CHUNK_HIGH
    return ratio, n, bad, low <= ratio <= high and bad <= BAD_SHARE * n


@F.arrow_udf(from_arrow_type(_FIGURES))
def figures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Base figures and verdict of every text."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    for texts in batches:
        rows = []
        for raw in raw_texts(texts):
            words = raw.split()
            joined = b"".join(words)
            repeated = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
            ratio, n, bad, inside = verdict(raw, press)
            rows.append((len(words), len(joined.decode()), len(raw.translate(None, _OTHERS)), duplicate_lines(raw),
                         repeated, ratio, n, bad, failed, inside and not failed))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIGURES)
        yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIGURES, strict=True)], fields=list(_FIGURES))


def with_figures(docs: DataFrame, into: str = "figures", text: str = "text") -> DataFrame:
    """`docs` plus a struct of figures and the verdict `kept`."""
    python_tasks(docs.sparkSession)
    return docs.withColumn(into, figures(F.col(text)))
