"""Packed shuffles: postings travel as NumPy buffers, one row per hash range and flush.

A posting (token, owner) as a row costs the JVM more than its bytes: 10**8 of them are a heavy
shuffle, but the same postings in buffers are some thousand rows. A map task gathers arrays,
splits them by ``token`` into ``parts`` hash ranges and emits one row per non-empty range with
its columns as binary values; a reducer gets whole ranges. The number of ranges grows with the
input (``frames.parts_for``), so a range stays small whatever the size.

Answers to owners travel the same way, dealt by the owner's key, and ``with_answers`` joins them
to the owners' texts. Most texts have no answer; a bitmap of the owners that do (its size is
fixed) keeps the others out of that shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.frames import arrow_schema, release, slices, small_batches
from chronolith.llm.kernels import mix

#: Postings a map task holds before it emits them.
FLUSH = 500_000
#: Bits of the bitmap of owners with answers: 1 MB, however many owners there are.
BITS = 1 << 23


def part_of(token: np.ndarray, parts: int) -> np.ndarray:
    return (mix(token) % np.uint64(parts)).astype(np.uint32)


def split(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of every part that occurs."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        yield int(part[a]), [c[a:b] for c in columns]


def rows(schema: pa.Schema, table: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], type=f.type) for i, f in enumerate(schema)], schema=schema)


def deal(df: DataFrame, kernel: Callable, emit: Callable, schema: str, column: str = "text") -> DataFrame:
    """Run ``kernel(batch) -> list of arrays`` (first the size in postings), and ``emit(gathered)`` on each flush.

    ``emit`` turns the gathered kernel results of up to about ``FLUSH`` postings into rows.
    """
    target = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for piece in slices(batches, column):
            found = kernel(piece)
            gathered.append(found)
            size += len(found[0])
            if size >= FLUSH:
                for lot in _lots(emit(gathered)):
                    yield rows(target, lot)
                gathered, size = [], 0
                release()
        if gathered:
            for lot in _lots(emit(gathered)):
                yield rows(target, lot)
        gathered = None
        release()

    return df.mapInArrow(run, schema)


def _lots(table, most: int = 32) -> Iterator[list[tuple]]:
    lot = []
    for row in table:
        lot.append(row)
        if len(lot) == most:
            yield lot
            lot = []
    if lot:
        yield lot


def owners_of(index: np.ndarray, *tables: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Postings' owner numbers made local, and the rows of the owner tables that they use."""
    used, local = np.unique(index, return_inverse=True)
    return local.astype(np.uint32), [t[used] for t in tables]


def joined(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def with_key(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text): the key tells rows of one doc_id but other text apart."""
    small_batches(documents.sparkSession)
    two = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the hashed keys: at most 256 rows of 4 KB reach the driver."""
    bit = F.pmod(F.col("key"), F.lit(BITS)) + 1  # the bitmap functions number positions from 1
    found = (
        keys.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    out = np.zeros(BITS // 8, np.uint8)
    for r in found:
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set: all that were put in, and by chance few others."""
    bit = np.mod(keys, BITS)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def only_chosen(bitmap: np.ndarray, inside: bool, by: str = "key") -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Filter of a batch's rows whose key's bit is set (or is not); nulls have no bit."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(by)
        hit = in_bitmap(bitmap, column.fill_null(0).to_numpy()) & column.is_valid().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(hit if inside else ~hit))

    return run


def chosen(keyed: DataFrame, bitmap: np.ndarray, inside: bool, by: str = "key") -> DataFrame:
    """The rows that ``only_chosen`` leaves, as a frame; a kernel that follows at once takes the filter itself."""
    only = only_chosen(bitmap, inside, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(only, batches):
            if batch.num_rows:
                yield batch

    return keyed.mapInArrow(run, "key long, doc_id long, text string")
