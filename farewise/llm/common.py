"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; keeps the Python side bounded whatever the Arrow batch size.
SLICE_BYTES = 4 << 20
#: Seed of the byte and position tables of ``word_hashes`` (any fixed value gives the same results).
HASH_SEED = 20240607


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column starts with it (Spark takes no notice of case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text counts as the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffers(batch.column(column))[1][1:].astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else int(text_buffers(batch.column(column))[1][0])
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def tidy(*caches) -> None:
    """Give memory back that a Python worker would keep between tasks: the given caches, Arrow's pool, freed heap."""
    for cache in caches:
        cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run, *caches):
    """A ``mapInArrow`` function that leaves its worker tidy when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy(*caches)

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column, without copying the texts."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table() -> np.ndarray:
    """One random 64-bit value per byte value."""
    return np.random.default_rng(HASH_SEED).integers(1, 2**64, size=256, dtype=np.uint64, endpoint=False)


#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size:size + step] = out[:step] * np.uint64(pow(base, size, 2**64))
        size += step
    return out[:n]


#: Bits of a ``KeyFilter``; the bitmap sent to tasks is 1 MB whatever the number of keys.
FILTER_BITS = 23
_BLOCK_BITS = 13


def cell_of(*columns) -> "F.Column":
    """The bit a key falls on."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS).cast("int")


def bitmap(cells: DataFrame) -> np.ndarray:
    """Bits set for the ``cell`` column of a table, as an array of booleans; 1 MB reaches the driver at most."""
    size = 1 << _BLOCK_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            seen[batch.column("cell").to_numpy()] = True
        blocks = seen.reshape(-1, size)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch({"block": pa.array(used.tolist(), pa.int32()),
                               "bits": pa.array([np.packbits(blocks[b]).tobytes() for b in used], pa.binary())})

    def union(rows):
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]], axis=0)
        return rows.iloc[:1].assign(bits=[bits.tobytes()])

    parts = cells.select("cell").mapInArrow(partial, "block int, bits binary")
    out = np.zeros((1 << FILTER_BITS) >> _BLOCK_BITS, dtype=f"({size},)?")
    for r in parts.groupBy("block").applyInPandas(union, "block int, bits binary").collect():
        out[r.block] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return out.reshape(-1)


def may_hold(spark: SparkSession, bits: np.ndarray):
    """A column function: False for cells that no key has, True for all others (a few other cells among them)."""
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def test(cell: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series((shared.value[c >> 3] >> (7 - (c & 7))) & 1 == 1)

    return test


def keep_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` is in the one-column table ``keys`` (distinct): only rows that may match are shuffled."""
    test = may_hold(df.sparkSession, bitmap(keys.select(cell_of(name).alias("cell"))))
    return df.filter(test(cell_of(name))).join(keys, name, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` is not in ``keys``: rows that cannot match stay where they are."""
    test = may_hold(df.sparkSession, bitmap(keys.select(cell_of(name).alias("cell"))))
    suspect = test(cell_of(name))
    return df.filter(~suspect).unionByName(df.filter(suspect).join(keys, name, "left_anti"))
