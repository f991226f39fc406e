"""Token ids in fixed-width bit packing.

A token file is a table of blocks, written by Spark in ascending document order. A block holds whole
documents: their ids, their lengths, and the ids of all their tokens packed in the fewest bits that number
the vocabulary, little end first. Token i of a block starts at bit i * bits, so a block unpacks in one
vectorised step and any token can be read alone. Blocks carry the part they belong to and their offset
in it; part totals, one row for each part, give global offsets.

Words between ASCII white space are encoded one by one and remembered, which gives the same ids as the whole
text because neither the normaliser nor the splitting rule reaches across white space; a test
holds both against each other.

Defined results: a null text is empty and has only the end token; rows of equal document id stand next to each
other in the order of their texts; null ids come first; an empty table gives no blocks; a text longer than
a block is a block of its own; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.llm.common import held, python_tasks, slices, spans
from flowwarden.session import scratch_path

END = 2
#: Tokens after which a block ends with its document, and words after which a worker's memory ages.
BLOCK_TOKENS, REMEMBERED = 1 << 17, 300_000
#: New words encoded in one line, and bytes of text whose words are split at a time.
LINE, SPLIT_BYTES = 24, 2 << 20
# Letters that no normalisation changes but for their case, and marks that are split off as one; the apostrophe joins endings.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
BLOCKS = ("part int, block int, start bigint, bits int, n bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that number a vocabulary of this size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 15):  # a multiple of 8 ids ends on a whole byte
        own = ids[at:at + (1 << 15)].astype("<u4")
        spread = np.unpackbits(own.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(spread.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """`n` ids from position `first` of a packed block; reads only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    out = []
    for at in range(first, first + n, 1 << 15):
        count = min(1 << 15, first + n - at)
        low, high = at * bits // 8, -(-(at + count) * bits // 8)
        flat = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
        own = np.zeros((count, 32), np.uint8)
        skip = at * bits - low * 8
        own[:, :bits] = flat[skip:skip + count * bits].reshape(count, bits)
        out.append(np.packbits(own, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, word by word from memory.

    New words of plain letters are encoded in lines of several words, which spares calls; where the tokenizer marks word ends,
    the ids of a line fall apart at the marks. ASCII marks behind a word are split off by the tokenizer. All other words, and
    lines whose ends do not add up, are encoded one by one. Memory has two ages: a full one becomes the old one, which words
    that are met again leave for the new one.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.marks = {"": b""}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_cores(self, cores: list[str]) -> None:
        lines = [cores[i:i + LINE] for i in range(0, len(cores), LINE)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for core, stop in zip(line, (4 * stops).tolist(), strict=True):
                    self.cores[core] = raw[at:stop]
                    at = stop
            else:
                self.cores.update(zip(line, self._alone(line), strict=True))

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        matches = list(map(_PLAIN.fullmatch, words))
        lowered = [m[1].lower() if m else None for m in matches]
        if new := list(set(lowered).difference(self.cores, (None,))):
            self._learn_cores(new)
        if new := list({m[2] for m in matches if m}.difference(self.marks)):
            self.marks.update(zip(new, self._alone(new), strict=True))
        known, cores, marks = self.known, self.cores, self.marks
        known.update((w, cores[core] + marks[m[2]]) for w, m, core in zip(words, matches, lowered, strict=True) if m)
        other = [w for w, m in zip(words, matches, strict=True) if m is None]
        known.update(zip(other, self._alone(other), strict=True))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > REMEMBERED:
            self.old, self.known, self.cores, self.marks = self.known, {"": b""}, {}, {"": b""}
        known, old = self.known, self.old
        out = list(map(known.get, words))
        if None in out:
            places = [i for i, ids in enumerate(out) if ids is None]
            missed = [words[i] for i in places]
            met = list(map(old.get, missed))
            known.update((w, ids) for w, ids in zip(missed, met, strict=True) if ids is not None)
            self._learn([w for w, ids in zip(missed, met, strict=True) if ids is None])
            for i, ids in zip(places, map(known.__getitem__, missed), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id behind each, and the number of ids of each text.

        Arrow splits the texts and numbers their words, so only distinct words pass through Python.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        found = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        found.append(np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n_words = pc.list_value_length(split).to_numpy()
        codes = np.insert(words.indices.to_numpy(), np.cumsum(n_words), len(found) - 1)
        each = sizes[codes]
        lengths = np.add.reduceat(each, np.cumsum(n_words + 1) - n_words - 1) if len(n_words) else n_words
        at, _ = spans(each, (np.cumsum(sizes) - sizes)[codes])
        return np.frombuffer(b"".join(found), "<u4").take(at), lengths


def encoder(content: str) -> Encoder:
    """The worker's encoder for this tokenizer file."""
    return held(("encoder", hash(content)), lambda: Encoder(content))


def _packer(content, bits: int, end: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of remembered words, and no cycles among them
        own = encoder(content.value)
        part = TaskContext.get().partitionId()
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        block = start = size = 0

        def done() -> pa.RecordBatch:
            columns = [[part], [block], [start], [bits], [size], [docs], [lengths], [pack(np.concatenate(ids), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "start", "bits", "n", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for at, n in slices(batch.column(1), SPLIT_BYTES):
                own_ids, own_lengths = own.encode(batch.column(1)[at:at + n], end)
                docs += batch.column(0)[at:at + n].to_pylist()
                lengths += own_lengths.tolist()
                ids.append(own_ids)
                size += len(own_ids)
                if size >= BLOCK_TOKENS:
                    yield done()
                    block, start, size = block + 1, start + size, 0
                    docs, lengths, ids = [], [], []
        if docs:
            yield done()
        gc.enable()

    return packed


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end: int = END, parts: int | None = None) -> None:
    """Encode every text, append the end id, and write blocks in ascending order of document id.

    The tokenizer's file is read on the driver and broadcast (a vocabulary of fixed size).
    """
    spark = docs.sparkSession
    python_tasks(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    bits = bits_for(max(Encoder(content).vocabulary, end + 1))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    blocks = ordered.mapInArrow(_packer(spark.sparkContext.broadcast(content), bits, end), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with `base`, the number of tokens in the parts before theirs.

    The running sum is over one row for each part, never over blocks, and that is what is broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "part")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], row["n"])
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            begins = ends - np.array(row["lengths"], np.int64)
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["start"] + begins, pa.int64()),
                 pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    python_tasks(spark)
    wanted = read_blocks(spark, path).select("base", "start", "bits", "n", "doc_ids", "lengths", "payload")
    return wanted.mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(blocks: DataFrame, first: int, n: int) -> list[int]:
    """Random access: the ids from global position `first`; opens only the blocks that hold them."""
    begin = F.col("base") + F.col("start")
    held = blocks.filter((begin < first + n) & (begin + F.col("n") > first)).orderBy(begin)
    out: list[int] = []
    for row in held.collect():
        own = row["base"] + row["start"]
        low, high = max(first, own) - own, min(first + n, own + row["n"]) - own
        out.extend(unpack(row["payload"], row["bits"], high - low, low).tolist())
    return out


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token file below the shared folder and read per-document figures back from it."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, doc_id, text)
    return read_documents(docs.sparkSession, path)
