"""Packing tokenized documents into fixed-length sequences by minimum bin slack.

Every document is its token ids and one closing id. Pieces of exactly ``window`` tokens are
sequences of their own; what is left of each document (one piece shorter than the window) is
packed whole. The planner sees only the histogram of remaining lengths, at most ``window - 1``
numbers whatever the corpus. For each window it seeds the longest length left and runs a bitset
subset-sum dynamic program over the multiset of the other lengths: bit s of an integer says that
some choice sums to s. The highest reachable bit is the least slack; walking the kept bitsets
backwards gives how often each length is used. The pattern is applied as often as the counts
allow, so the plan is a few thousand patterns at most. Ranks within a length (salted, then
offset by salt) map every piece to its pattern, instance and offset.

Defined results: null or empty text is the closing id alone; repeated rows are packed as separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.frames import durable, keyed_text, map_batches
from chronolith.llm.kernels import text_bytes, words_of

WINDOW = 2048
CLOSING_ID = 1
#: Distinct words whose ids a worker keeps between batches; beyond it the cache starts anew.
CACHED_WORDS = 1_500_000
#: Pieces of one length ranked by one window partition, at least; the square root of their number where that is more,
#: so that neither a group nor the list of groups outgrows a task.
RANKED_TOGETHER = 500


class WordEncoder:
    """Token ids word by word, each distinct word encoded once.

    The vocabulary drops white space and never merges across it, so a text's ids are its
    words' ids in a row (``tests/llm`` holds this against whole-text encoding).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
        """Add words (sorted by hash) and their ids."""
        raw = data.tobytes()
        coded = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)], add_special_tokens=False)
        lists = [x.ids for x in coded]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.known, value)
        self.ids = np.r_[self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))]
        self.known, self.begin, self.size = np.insert(self.known, place, value), np.insert(self.begin, place, begin), np.insert(self.size, place, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and where each text's ids begin (len + 1 offsets)."""
        w = words_of(data, offsets)
        distinct, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool) if not len(self.known) else self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > CACHED_WORDS:
                self._forget()
                new[:] = True
            self._learn(data, w.start[where[new]], w.end[where[new]], distinct[new])
            place = np.searchsorted(self.known, distinct)
        begin, size = self.begin[place][back], self.size[place][back]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(begin - (stop - size), size)]
        return ids, np.r_[0, stop][w.first]


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(path)


def pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole windows, then the rest of each document."""

    def kernel(batch: pa.RecordBatch) -> dict:
        encoder = encoder_for(tokenizer)
        ids, first = encoder.encode(*text_bytes(batch.column("text")))
        out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = np.append(ids[a:b], np.uint32(closing)).astype("<u4")
            for at in range(0, len(own), window):
                part = own[at : at + window]
                for name, value in (("doc_id", doc), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("doc_tokens", len(own))):
                    out[name].append(value)
        return out

    return map_batches(keyed_text(documents), kernel, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending) with the largest sum up to ``room``: {length: uses}."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            steps.append((reach, length, lot))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, lot in reversed(steps):
        if not before >> total & 1:  # only by this lot
            used[length] = used.get(length, 0) + lot
            total -= length * lot
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: uses})]: patterns, each filling one window as closely as its seed allows."""
    counts, out = {k: v for k, v in histogram.items() if v}, []
    if whole := counts.pop(window, 0):
        out.append((whole, {window: 1}))
    while counts:
        lengths = sorted(counts, reverse=True)
        seed = lengths[0]
        counts[seed] -= 1
        used = fill(lengths, counts, window - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        out.append((times, used))
    return out


def _layout(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, uses, times, first sequence, first offset), sorted by the first two."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken.get(length, 0), used[length], times, sequence, offset))
            taken[length] = taken.get(length, 0) + times * used[length]
            offset += used[length] * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, closing: int = CLOSING_ID) -> DataFrame:
    """Pieces with the sequence and the offset each one has there (gapless from 0)."""
    cut = durable(pieces(documents, tokenizer, window, closing), of=documents)
    sizes = cut.groupBy("length").count().collect()  # at most `window` rows
    layout = _layout(plan({r["length"]: r["count"] for r in sizes}, window))
    most = max([0, *(r["count"] for r in sizes)])
    salts = max(1, -(-most // max(RANKED_TOGETHER, math.isqrt(most))) * 2)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("place", F.row_number().over(group)).join(offsets, ["length", "salt"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place") - 1).alias("rank"))

    keys = layout[:, 0] * (1 << 48) + layout[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = layout[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            slot, instance = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 4] + instance), pa.array(row[:, 5] + slot * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
