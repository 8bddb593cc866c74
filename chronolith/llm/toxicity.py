"""Toxicity scores from a character n-gram linear classifier with naive Bayes scaled features.

A text is lower-cased (A-Z and the Latin-1 letters), runs of white space and punctuation become
one boundary mark, and every character 3-, 4- and 5-gram is hashed into ``2**18`` buckets; a
feature is a bucket's presence. Each feature is scaled by its naive Bayes log-count ratio
``r = log((a + p) / sum(a + p)) - log((a + q) / sum(a + q))``, p and q being the numbers of
toxic and other training texts that have it, and an L2-regularized logistic regression is fitted
on the scaled presence vectors of the features whose ratio stands out from chance. Labels, lang,
source and doc_id are never inputs of a score; the labels used are at most ``TRAINING_ROWS`` rows,
taken in the order of a hash of doc_id, and every text of the table is scored whole.

Defined results: null text counts as empty; a text without features has the intercept's score;
rows of ``labels`` without doc_id or label are ignored and of repeated ones the largest label holds;
with no training rows, or one class only, every score is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolith.llm.frames import durable, keyed_text, map_batches, slices, small_batches
from chronolith.llm.kernels import text_bytes

BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
#: Labelled rows the model is fitted on, at most; the sample's text is what the driver's plan broadcasts keys of.
TRAINING_ROWS = 10_000
SMOOTHING = 1.0
#: Standard errors by which a feature's log-count ratio must differ from 0.
STANDS_OUT = 4.0
PENALTY = 0.02
STEPS = 300


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[:48] = 32
    out[58:65] = out[91:97] = out[123:128] = 32
    return out


_FOLD = _fold()


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters as numbers, with one boundary mark around every run of letters and digits, and each one's text."""
    byte = _FOLD[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    upper = latin[(data[latin + 1] >= 0x80) & (data[latin + 1] <= 0x9E)] + 1
    byte[upper] += 0x20
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    value = byte[lead].astype(np.uint32)
    high = data[lead] >= 0xC0
    at = lead[high]
    extra = value[high]
    for step in (1, 2, 3):
        nxt = np.minimum(at + step, len(data) - 1)
        has = (data[lead[high]] >= (0xC0, 0xE0, 0xF0)[step - 1]) & (at + step < len(data))
        extra = np.where(has, extra << np.uint32(8) | byte[nxt], extra)
    value[high] = extra
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(lead, offsets)))
    keep = value != 32
    keep[1:] |= value[:-1] != 32
    if len(keep):
        keep[0] = True
    return value[keep], text[keep]


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For each order: bucket of every n-gram that lies within one text, and that text."""
    value, text = _characters(data, offsets)
    code = value * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            continue
        mixed = code[:size].copy()
        for i in range(1, n):
            mixed *= np.uint32(0x85EBCA6B)
            mixed += code[i : i + size]
        mixed ^= mixed >> np.uint32(16)
        mixed *= np.uint32(0xC2B2AE35 + 2 * n)
        inside = text[:size] == text[n - 1 :]
        yield (mixed >> np.uint32(14))[inside], text[:size][inside]


def presence(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with ``kept``, only of those buckets."""
    if kept is None and len(offsets) <= 257:  # a bit for each pair costs less than sorting all pairs
        seen = np.zeros((len(offsets) - 1) * BUCKETS, bool)
        for bucket, text in _grams(data, offsets):
            seen[text * BUCKETS + bucket] = True
        both = np.flatnonzero(seen)
        return both // BUCKETS, both % BUCKETS
    pairs = []
    for bucket, text in _grams(data, offsets):
        if kept is not None:
            chosen = kept[bucket]
            bucket, text = bucket[chosen], text[chosen]
        pairs.append(np.unique(text * BUCKETS + bucket))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // BUCKETS, both % BUCKETS


class Model(NamedTuple):
    """Weight of each bucket's presence (log-count ratio times fitted weight), and the intercept."""

    weight: np.ndarray
    intercept: float


def _constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))


def training_rows(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = keyed_text(documents).join(F.broadcast(chosen), "doc_id")  # at most `limit` rows of 12 bytes
    # rows that share a doc_id count once, by one of their texts
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("doc_id", "text", "label")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, stands_out: float = STANDS_OUT, penalty: float = PENALTY) -> Model:
    """A model from at most ``limit`` labelled rows that are not held out."""
    return _fitted(durable(training_rows(documents, labels, limit)), stands_out, penalty)


def cross_validate(documents: DataFrame, labels: DataFrame, settings: list[tuple[float, float]], folds: int = 4, limit: int = TRAINING_ROWS) -> DataFrame:
    """(stands_out, penalty, rows, log_loss, missed, wronged) of each setting over the training rows alone: every row is scored
    by a model fitted without its fold. Held-out rows take no part, so settings may be chosen by this."""
    rows = durable(training_rows(documents, labels, limit).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds))))
    spark, out = documents.sparkSession, []
    for stands_out, penalty in settings:
        parts = []
        for fold in range(folds):
            model = _fitted(rows.where(F.col("fold") != fold).drop("fold"), stands_out, penalty)
            tested = rows.where(F.col("fold") == fold)
            parts.append(score(tested, model).join(tested.select("doc_id", (F.col("label") > 0).alias("toxic")), "doc_id"))
        every = functools.reduce(DataFrame.unionByName, parts)
        likely = F.when(F.col("toxic"), F.col("score")).otherwise(1 - F.col("score"))
        missed, wronged = F.col("toxic") & (F.col("score") < 0.5), ~F.col("toxic") & (F.col("score") >= 0.5)
        got = every.agg(F.count("*"), F.avg(-F.log(F.greatest(likely, F.lit(1e-12)))), F.count_if(missed), F.count_if(wronged)).first()
        out.append((stands_out, penalty, *got))
    return spark.createDataFrame(out, "stands_out double, penalty double, rows long, log_loss double, missed long, wronged long")


def _fitted(sample: DataFrame, stands_out: float, penalty: float) -> Model:
    """Two passes over the bounded sample: presence counts by class, then the kept features of each row."""
    rows = sample.coalesce(8)  # a bounded sample: 8 tasks, so 8 vectors of counts

    def counts(batches):
        sums = np.zeros((2, BUCKETS), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy() > 0
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                text, bucket = presence(*text_bytes(part.column("text")))
                for c in (0, 1):
                    sums[c] += np.bincount(bucket[label[lo : lo + 200][text] == c], minlength=BUCKETS).astype(np.int32)
            n += [int((~label).sum()), int(label.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([sums.tobytes()])], names=["n", "sums"])

    got = rows.mapInArrow(counts, "n binary, sums binary").collect()  # one bounded row from each of 8 tasks
    n = np.sum([np.frombuffer(r["n"], np.int64) for r in got], axis=0) if got else np.zeros(2)
    if n.min() == 0:
        return _constant(float(n[1] / n.sum()) if n.sum() else 0.0)
    q, p = np.sum([np.frombuffer(r["sums"], np.int32).reshape(2, BUCKETS) for r in got], axis=0, dtype=np.float64)
    ratio = np.log((SMOOTHING + p) / (SMOOTHING + p).sum()) - np.log((SMOOTHING + q) / (SMOOTHING + q).sum())
    rate = (p + q) / n.sum()
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n[0] + 1 / n[1]))
    kept = (p + q >= 5) & (np.abs(p / n[1] - q / n[0]) >= stands_out * error)

    def vectors(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                text, bucket = presence(*text_bytes(part.column("text")), kept)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])], names=["label", "features"])

    found = rows.mapInArrow(vectors, "label int, features binary").collect()  # at most `limit` rows
    columns = [np.frombuffer(r["features"], np.int32) for r in found]
    return _logistic(columns, np.array([r["label"] > 0 for r in found], np.float64), ratio, kept, penalty)


def _logistic(columns: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, kept: np.ndarray, penalty: float = PENALTY) -> Model:
    """Nesterov gradient steps on the mean log loss plus an L2 penalty, on log-count scaled presence."""
    number = np.cumsum(kept) - 1
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    bucket = np.concatenate([*columns, np.zeros(0, np.int32)]).astype(np.int64)
    column, value = number[bucket], ratio[bucket]
    size = int(kept.sum())
    weight, intercept = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_b, before, before_b = weight.copy(), intercept, weight, intercept
    largest = np.bincount(row, value * value, len(y)).max(initial=0.0) + 1
    step = 1 / (0.25 * max(1.0, largest * 0.1) + penalty)
    loss_before = np.inf
    for k in range(1, STEPS + 1):
        margin = np.bincount(row, value * ahead[column], len(y)) + ahead_b
        miss = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        loss = float(np.mean(np.logaddexp(0, margin) - y * margin) + penalty / 2 * ahead @ ahead)
        if loss > loss_before + 1e-9:
            step *= 0.5
            ahead, ahead_b = before.copy(), before_b
            loss_before = np.inf
            continue
        loss_before = loss
        weight = ahead - step * (np.bincount(column, value * miss[row], size) / len(y) + penalty * ahead)
        intercept = ahead_b - step * miss.mean()
        momentum = k / (k + 3)
        ahead, ahead_b = weight + momentum * (weight - before), intercept + momentum * (intercept - before_b)
        before, before_b = weight, intercept
    out = np.zeros(BUCKETS, np.float32)
    out[kept] = weight * ratio[kept]
    return Model(out, intercept)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that a text is toxic, for every row."""
    weight, intercept = model
    kept = weight != 0

    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch.column("text"))
        text, bucket = presence(data, offsets, kept)
        margin = np.bincount(text, weight[bucket].astype(np.float64), batch.num_rows) + intercept
        return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(margin, -40, 40)))}

    return map_batches(keyed_text(documents), kernel, "doc_id long, score double")


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with all their columns and a score under ``name``, in one pass without a join."""
    small_batches(documents.sparkSession)
    weight, intercept = model
    kept = weight != 0
    at = documents.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            text, bucket = presence(*text_bytes(batch.column(at)), kept)
            margin = np.bincount(text, weight[bucket].astype(np.float64), batch.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
