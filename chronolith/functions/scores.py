"""Score formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
# Fixed values of the scoring contract.
SCORE_FLOOR = 0.05
SPREAD_DECAY = 0.5
IMPORTANCE_WEIGHT = 0.25
ACCESS_WEIGHT = 0.15
CORRECTION_BOOST = 1.3
CONFIDENCE_TOP_FLOOR = 0.45
CONFIDENCE_MARGIN_FLOOR = 0.005
K1, B = 1.2, 0.75


def decay(observed_at: Column, now: int, rate: float) -> Column:
    """exp(-rate * age in days), ages below 0 counting as 0."""
    return F.exp(-F.lit(rate) * F.greatest(F.lit(now) - observed_at, F.lit(0)) / F.lit(DAY))


def unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def ranked_score(raw: Column, observed_at: Column, confidence: Column, importance: Column, now: int, rate: float) -> Column:
    """raw * decay * confidence * (1 + 0.25 * importance), the last two within [0, 1]; an importance that is no finite number is 0."""
    finite = ~F.isnan(importance) & (F.abs(importance) < F.lit(float("inf")))
    weight = F.coalesce(F.when(finite, unit(importance)), F.lit(0.0))
    return raw * decay(observed_at, now, rate) * unit(confidence) * (F.lit(1.0) + F.lit(IMPORTANCE_WEIGHT) * weight)


def retention_score(now: int, rate: float) -> Column:
    """decay * (1 + 0.15 ln(1 + accesses)) * confidence * 1.3 for corrections."""
    boost = F.when(F.col("source").isin("correction", "cortex:correction"), CORRECTION_BOOST).otherwise(1.0)
    used = F.lit(1.0) + F.lit(ACCESS_WEIGHT) * F.log(F.lit(1.0) + F.greatest(F.col("access_count"), F.lit(0)))
    return decay(F.col("observed_at"), now, rate) * used * unit(F.col("confidence")) * boost


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for other lengths, empty or zero vectors."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_term(tf: Column, dl: Column, avg_dl: Column, weight: Column) -> Column:
    return weight * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avg_dl))
