"""Embedders and a content-addressed vector cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_vector(text: str, dims: int) -> list[float]:
    """The test embedder: byte i adds value / 255 to place i mod dims; the sum has length 1 (or is zero)."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.float64) / 255
    out = np.bincount(np.arange(len(raw)) % dims, raw, dims)
    size = float(np.sqrt(out @ out))
    return (out / size if size else out).tolist()


def embed(text: Column, embedder: Callable[[str], list[float]]) -> Column:
    """An embedder as an iterator UDF, so that a model is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: embedder(t) if t is not None else None)

    return run(text)


def with_cache(rows: DataFrame, cache: DataFrame, embedder: Callable[[str], list[float]]) -> tuple[DataFrame, DataFrame]:
    """(rows with vector, new cache rows): only texts whose digest the cache lacks are embedded, each once."""
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    missing = keyed.select("digest", "text").dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")
    new = missing.select("digest", embed(F.col("text"), embedder).alias("vector"))
    return keyed.join(cache.select("digest", "vector").unionByName(new), "digest", "left").drop("digest"), new
