"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowwarden.session import scratch_path, ship_package

#: Rows and bytes of one Arrow batch at most, so that very long texts never meet in one batch.
BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)


def python_tasks(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the batches they get."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: later stages do not repeat the work if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_rows(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Add a unique row key: the key itself where it is unique and never null, else numbered repeats.

    The key is a struct of the original key and the number of the row among its equals, so repeated rows
    and null keys stay apart.
    """
    repeats = W.partitionBy(key).orderBy(F.xxhash64(order))
    return df.withColumn(name, F.struct(F.col(key).alias("key"), F.row_number().over(repeats).alias("copy")))


def has_unique_key(df: DataFrame, key: str) -> bool:
    """True if no two rows share the key and none is null; reads only that column."""
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    return not found.limit(1).count()


def raw_texts(texts: pa.Array) -> Iterable[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for text in texts.cast(pa.large_binary()):
        yield text.as_py() or b""


_HELD: dict[tuple, object] = {}


def held(owner: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next.

    Workers outlive stages, so there is one place only: another owner's object goes before a new one is made.
    """
    if owner not in _HELD:
        release()
        _HELD[owner] = make()
    return _HELD[owner]


def release() -> None:
    """Let go of what the worker keeps, back to the system; tasks with tables of their own begin with it.

    Idle workers stand beside the next stage's memory, so tasks that keep nothing end with it too.
    """
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spans(lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions begin … begin + length of each of several runs, one after the other, and the run of each."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin, lengths), run


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of neighbours with about `size` bytes of text together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy())
    at = 0
    while at < len(ends):
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, past - at
        at = past


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first of `name_1`, `name_2`, … that the table does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in [name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))] if n.lower() not in taken)


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


LONG, TEXT = T.LongType(), T.StringType()
