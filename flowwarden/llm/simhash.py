"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. Its point in the embedding has one coordinate for each
segment, the number of set bits there. The Manhattan distance of two points is a lower bound of the
Hamming distance of their fingerprints, so links within `DISTANCE` bits are a range join over the points. The
coordinates fall into eight groups; a distance of four leaves at least four groups without any difference, so two
points in range share a unit grid cell in at least one of the 70 projections onto four groups. The lower bound over
all coordinates and then the exact distance are checked inside cells.

Cells hold distinct fingerprints only, never documents, and only cells with at least two of them are kept. A
cell above `CELL_ROWS` is cut into pairs of blocks, so no task holds more. From a cell leave only the links of a
spanning forest: a point takes all open points in range at once, so a cell of copies costs linear time and
gives as many links as it has members, never all pairs.

Defined results: fewer words than a shingle make one shingle of all words; a null or wordless text has
fingerprint zero and is linked like any other; repeated rows share a fingerprint; a null id never becomes a class id unless
all ids of its class are null; an empty table stays empty; extra columns are passed through by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import LONG, fresh, has_unique_key, python_tasks, raw_texts, release, stored
from flowwarden.llm.components import roots

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENT_BITS = 2
#: Segments of each group; four untouched groups of these eight are one projection.
GROUPS, UNTOUCHED = (4, 4, 4, 4, 4, 4, 4, 4), 4
CELL_ROWS = 512


def fingerprint(raw: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if more than half of the shingle hashes have it; unsigned."""
    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + width]), seed) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LONG)
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprint of every text as a signed 64-bit number."""
    release()
    for texts in batches:
        yield pa.array(np.array([fingerprint(raw) for raw in raw_texts(texts)], np.uint64).view(np.int64))
    release()


def _cells(points: DataFrame) -> DataFrame:
    """One row for each point and projection: (cell, point)."""
    first, codes = 0, []
    for size in GROUPS:
        code = F.lit(0).cast("long")
        for i in range(first, first + size):
            segment = F.bit_count(F.shiftrightunsigned("point", SEGMENT_BITS * i).bitwiseAND(2 ** SEGMENT_BITS - 1))
            code = code * (SEGMENT_BITS + 1) + segment
        codes.append(code.cast("long"))
        first += size
    side = (SEGMENT_BITS + 1) ** max(GROUPS)
    coded = points.select("point", *[c.alias(f"_g{i}") for i, c in enumerate(codes)])
    cells = []
    for k, chosen in enumerate(combinations(range(len(GROUPS)), UNTOUCHED)):
        cell = F.lit(k).cast("long")
        for g in chosen:
            cell = cell * side + F.col(f"_g{g}")
        cells.append(cell)
    return coded.select("point", F.explode(F.array(*cells)).alias("cell"))


def popcounts(points: np.ndarray) -> np.ndarray:
    """Embedding of fingerprints: set bits of each two-bit segment, four segments in a byte's base-4 digits."""
    low = np.uint64(0x5555555555555555)
    return (points & low) + ((points >> np.uint64(1)) & low)


def _bound(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Manhattan distance of embedded points to one of them.

    Two coordinates lie side by side in bytes after spreading, so differences are taken byte-wise.
    """
    four = np.uint64(0x0303030303030303)
    total = np.zeros(a.shape, np.int64)
    for shift in (0, 2, 4, 6):
        x = ((a >> np.uint64(shift)) & four).view(np.int8).reshape(-1, 8)
        y = np.array([(b >> np.uint64(shift)) & four], np.uint64).view(np.int8)
        total += np.abs(x - y).sum(axis=1, dtype=np.int64)
    return total


def forest(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points (unsigned, distinct) within `distance` bits."""
    out: list[tuple[int, int]] = []
    if len(points) == 2:
        if int(np.bitwise_count(points[0] ^ points[1])) <= distance:
            out.append((int(points[0]), int(points[1])))
        return out
    places = popcounts(points)
    left = np.arange(len(points))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        own = queue.pop()
        near = _bound(places[left], places[own]) <= distance
        near[near] = np.bitwise_count(points[left[near]] ^ points[own]) <= distance
        for other in left[near]:
            out.append((int(points[own]), int(points[other])))
            queue.append(int(other))
        left = left[~near]
    return out


def _links(distance: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def found(cells: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(cells)) + 1
            begins = np.concatenate([[0], edges]).astype(np.int64)
            ends = np.concatenate([edges, [len(cells)]]).astype(np.int64)
            sizes = ends - begins
            two = begins[sizes == 2]
            near = two[np.bitwise_count(points[two] ^ points[two + 1]) <= distance]
            links = [np.stack([points[near], points[near + 1]], axis=1)]
            for a, b in zip(begins[sizes > 2], ends[sizes > 2], strict=True):
                if own := forest(points[a:b], distance):
                    links.append(np.array(own, np.uint64))
            both = np.concatenate(links).astype(np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        kept_cells, kept_points = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([kept_cells, batch.column(0).to_numpy()])
            points = np.concatenate([kept_points, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cells):
                continue
            last = int(np.searchsorted(cells, cells[-1]))  # rows are sorted by cell; the last one may go on
            if last:
                yield found(cells[:last], points[:last])
            kept_cells, kept_points = cells[last:], points[last:]
        if len(kept_cells):
            yield found(kept_cells, kept_points)

    return linked


def links(points: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints (`point` bigint) within `distance` bits."""
    if distance > len(GROUPS) - UNTOUCHED:
        raise ValueError(f"the projections serve distances up to {len(GROUPS) - UNTOUCHED}")
    python_tasks(points.sparkSession)
    cells = _cells(points)
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("point"), blocks).cast("int")
    full = cells.join(counts, "cell").withColumn("_blocks", blocks).withColumn("_own", own)
    # A block meets every block of its cell, itself included, in a task of their own.
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: (
        F.least(F.col("_own"), o) * F.col("_blocks") + F.greatest(F.col("_own"), o)))
    small = full.filter(F.col("_blocks") == 1).select("cell", "point")
    large = full.filter(F.col("_blocks") > 1).select(
        F.explode(pairs).alias("_pair"), "cell", "point").select(F.xxhash64("cell", "_pair").alias("cell"), "point")
    met = small.union(large).repartition("cell").sortWithinPartitions("cell")
    return met.mapInArrow(_links(distance), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, point (signed fingerprint), component_id (smallest id of its class)."""
    python_tasks(docs.sparkSession)
    known = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("point")), "fingerprints")
    return known.join(_named(known, distance), "point").select("doc_id", "point", "component_id")


def _named(known: DataFrame, distance: int) -> DataFrame:
    """Per distinct fingerprint: point, root of its class, smallest document id of the class."""
    points = stored(known.groupBy("point").agg(F.min("doc_id").alias("least")), "points")
    found = roots(links(points.select("point"), distance))
    rooted = points.join(found, points["point"] == found["node"], "left").select(
        "point", "least", F.coalesce("root", "point").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("point", "root", "component_id")


def hex_of(point: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed fingerprint."""
    return F.lpad(F.lower(F.hex(point)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each class stays: the one with the smallest id, of repeated rows one."""
    python_tasks(docs.sparkSession)
    key, point = fresh(docs, "_key"), fresh(docs, "_point")
    if has_unique_key(docs, doc_id):
        gone = classes(docs, doc_id, text, distance).filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
        return docs.join(gone, F.col(f"`{doc_id}`") == F.col(key), "left_anti")
    marked = stored(docs.withColumn(point, fingerprints(F.col(text))), "marked")
    named = _named(marked.select(F.col(doc_id).alias("doc_id"), F.col(point).alias("point")), distance)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = marked.join(named, marked[point] == named["point"]).groupBy("root").agg(F.min_by(whole, first).alias("_row"))
    return kept.select("_row.*")
