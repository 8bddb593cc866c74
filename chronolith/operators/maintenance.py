"""Maintenance as an increment: only entities that a change log names since the last tick are worked on again.

A tick reads the log beyond its watermark, takes the touched entities' observations and relations, and appends what
follows from them: duplicates, retention without its age, and what keeps an entity from being an orphan. None of this
depends on the time of the tick, so stored results stay true while nobody writes; ``now`` comes in when they are read.
A reader takes each entity's latest tick. Ticks are numbered; one that is run again overwrites only its own
folders and starts from the watermark that earlier ticks left, and its ledger row, written last, makes it count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.scores import decay, retention_score
from chronolith.operators.frames import small
from chronolith.operators.lifecycle import Consolidation, duplicates

#: What a tick stores: duplicates cost a comparison of pairs, retention a row for each observation, facts one for each entity.
RESULTS = ("duplicates", "retention", "facts")
_LEDGER = "number int, upto long, entities long, scanned long, total long"


def _ledger(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _LEDGER)
    rows = spark.read.schema(_LEDGER + ", tick int").parquet(f"{folder}/ledger").drop("tick")
    return rows if before is None else rows.where(F.col("number") < before)


def tick(folder: str, number: int, changes: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame, settings: Consolidation = Consolidation(), results: tuple[str, ...] = RESULTS) -> dict[str, int]:
    """Bring the stored results up to the log (entity_id, version); returns the tick's ledger row.

    ``results`` are those that the store keeps, the same in all of its ticks. ``scanned`` of ``total`` observations were worked on. An observation that moves must be logged for both its entities.
    """
    spark = changes.sparkSession
    since = _ledger(spark, folder, number).agg(F.max("upto")).first()[0]
    fresh = changes if since is None else changes.where(F.col("version") > since)
    upto = fresh.agg(F.max("version")).first()[0]
    fresh.select("entity_id").distinct().write.mode("overwrite").parquet(f"{folder}/touched/tick={number}")
    touched = spark.read.schema(changes.select("entity_id").schema).parquet(f"{folder}/touched/tick={number}")
    mine = observations.join(small(touched), "entity_id", "left_semi")
    live = mine.where(~F.col("tombstoned"))
    kept = live.select("entity_id", "id", "observed_at", retention_score(0, 0.0).alias("base"))
    ends = relations.select(F.explode(F.array("from_entity", "to_entity")).alias("entity_id"), F.coalesce(F.col("valid_until"), F.lit((1 << 63) - 1)).alias("until")).join(small(touched), "entity_id", "left_semi")
    held = mine.groupBy("entity_id").agg(F.count("*").alias("observations"))
    tied = ends.groupBy("entity_id").agg(F.max("until").alias("tied_until"))
    there = entities.select(F.col("id").alias("entity_id")).join(small(touched), "entity_id", "left_semi")
    facts = there.join(held, "entity_id", "left").join(tied, "entity_id", "left").select("entity_id", F.coalesce("observations", F.lit(0)).alias("observations"), "tied_until")
    made = {"duplicates": lambda: duplicates(mine, settings.threshold), "retention": lambda: kept, "facts": lambda: facts}
    for name in results:
        made[name]().write.mode("overwrite").parquet(f"{folder}/{name}/tick={number}")
    row = (number, since if upto is None else upto, touched.count(), mine.count(), observations.count())
    spark.createDataFrame([row], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/tick={number}")
    return dict(zip(("number", "upto", "entities", "scanned", "total"), row, strict=True))


def _current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stored rows of each entity's latest counted tick."""
    done = _ledger(spark, folder).select(F.col("number").alias("tick"))
    latest = spark.read.parquet(f"{folder}/touched").join(small(done), "tick", "left_semi").groupBy("entity_id").agg(F.max("tick").alias("tick"))
    return spark.read.parquet(f"{folder}/{name}").join(latest, ["entity_id", "tick"], "left_semi").drop("tick")


def stored_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, survivor, loser) as ``lifecycle.duplicates`` gives for all observations."""
    return _current(spark, folder, "duplicates").select("entity_id", "survivor", "loser")


def stored_retention(spark: SparkSession, folder: str, now: int, rate: float) -> DataFrame:
    """(id, observed_at, retention) as ``lifecycle.retention`` gives."""
    return _current(spark, folder, "retention").select("id", "observed_at", F.round(decay(F.col("observed_at"), now, rate) * F.col("base"), 6).alias("retention"))


def stored_orphans(spark: SparkSession, folder: str, now: int) -> DataFrame:
    """(id) of entities without observations and without relations that last beyond now."""
    tied = F.coalesce(F.col("tied_until") > now, F.lit(False))
    return _current(spark, folder, "facts").where((F.col("observations") == 0) & ~tied).select(F.col("entity_id").alias("id"))
