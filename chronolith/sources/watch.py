"""File events: renames, bursts, and what is left to do for each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds within which later events of a path replace earlier ones.
DEBOUNCE = 200


def settled_events(events: DataFrame, debounce: int = DEBOUNCE) -> DataFrame:
    """(path, kind, at): events (path, kind, at in ms, to) without bursts.

    A rename is a removal of its path and a creation of where it goes. An event is dropped when the same path's
    next one follows within the debounce time; at one instant, creations and changes outlast removals.
    """
    moved = events.where("kind = 'rename' and to is not null")
    parts = events.where("kind in ('create', 'modify', 'remove')").select("path", "kind", "at")
    parts = parts.unionByName(moved.select("path", F.lit("remove").alias("kind"), "at")).unionByName(moved.select(F.col("to").alias("path"), F.lit("create").alias("kind"), "at"))
    order = Window.partitionBy("path").orderBy("at", (F.col("kind") != "remove").cast("int"), "kind")
    following = F.lead("at").over(order)
    return parts.withColumn("after", following).where(F.col("after").isNull() | (F.col("after") - F.col("at") >= debounce)).select("path", "kind", "at")


def pending(events: DataFrame, debounce: int = DEBOUNCE) -> DataFrame:
    """(path, action): index or drop, by the last settled event of each path."""
    last = settled_events(events, debounce).groupBy("path").agg(F.max_by("kind", F.struct("at", (F.col("kind") != "remove").cast("int"))).alias("kind"))
    return last.select("path", F.when(F.col("kind") == "remove", "drop").otherwise("index").alias("action"))
