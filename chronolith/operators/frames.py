"""Helpers that several operators need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast without asking the optimizer again.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the optimizer's estimate is below the bound; else the frame as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def dealt(union: DataFrame, *keys: str) -> DataFrame:
    """A union dealt by the keys of the aggregate that follows, in an exchange of its own: the planner may take a union of
    frames that are dealt alike for dealt already, which fails when they are coalesced differently at run time."""
    return union.repartition(*keys)


def top_k(df: DataFrame, by: list[Column], k: int, per: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows, of the frame or of each group, with their rank from 1.

    In a group, row_number under a filter becomes a window group limit: every partition keeps k
    rows of a group before the shuffle.
    """
    window = Window.partitionBy(*(per or [])).orderBy(*by)
    if per:
        return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return df.orderBy(*by).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*by)))


def runs(ordered: Column, same: Callable[[Column], Column] = lambda x: x) -> Column:
    """(start, end) of the runs of equal elements of a sorted array, from 0, ends exclusive.

    What a row holds is so counted within the row: an aggregate over exploded elements would hold or shuffle them all.
    """
    n = F.size(ordered)
    first = lambda i: (i == 0) | (same(F.get(ordered, i)) != same(F.get(ordered, i - 1)))
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), first)).otherwise(F.array().cast("array<int>"))
    return F.zip_with(starts, F.slice(starts, 2, n), lambda a, b: F.struct(a.alias("start"), F.coalesce(b, n).alias("end")))


def running_sums(df: DataFrame, order: str, columns: list[str], by: list[str] | None = None, pieces: int = 64) -> DataFrame:
    """Rows with ``<column>_before``: the sum over all rows of their group that come earlier in the order.

    A window over a whole frame, or over one hot group, is one task. Here the order's value range is cut at
    quantiles; windows run within a piece, and the pieces' sums (at most ``pieces`` + 1 a group) give what lies before.
    """
    by = by or []
    cuts = sorted(set(df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.01)))
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("__piece", piece)
    own = Window.partitionBy(*by, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "__piece").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    based = sums.select(*by, "__piece", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__base_{c}") for c in columns])
    inside = cut.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    joined = inside.join(small(based), [*by, "__piece"])
    return joined.select(*df.columns, *[(F.col(f"__base_{c}") + F.col(f"__in_{c}")).alias(f"{c}_before") for c in columns])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below the checkpoint folder, or on a local master a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    home = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="chronolith-")
    return f"{home}/{uuid.uuid4().hex}"
