"""Write-behind ingestion: micro-batches, a reject table, and exactly-once replay by batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.operators.frames import small
from chronolith.operators.remember import _PLACED, natural_id, resolve_in_order, valid_request

REQUEST_SCHEMA = "seq long, name string, entity_type string, observations array<string>, source string, at long"


def requests(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of JSON request files; the rate limit is the back pressure."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


_ENTITY = "id string, name string, entity_type string, created long, touched long, created_at long, updated_at long"


def known_entities(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """(id, name, entity_type, created, touched, created_at, updated_at) as the batches before ``before`` left them.

    A batch notes the entities it touched; an entity is what its notes say together.
    """
    ledger = f"{folder}/ledger"
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _ENTITY)
    done = spark.read.parquet(ledger).where(F.col("batch") < before).select("batch")
    notes = spark.read.schema(_ENTITY + ", batch int").parquet(f"{folder}/entities").join(small(done), "batch", "left_semi")
    return merged_notes(notes)


def merged_notes(notes: DataFrame) -> DataFrame:
    first, last = [F.min(c).alias(c) for c in ("created", "created_at")], [F.max(c).alias(c) for c in ("touched", "updated_at")]
    out = notes.groupBy("id").agg(F.min_by("name", "created").alias("name"), F.min_by("entity_type", "created").alias("entity_type"), *first, *last)
    return out.select("id", "name", "entity_type", "created", "touched", "created_at", "updated_at")


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer. Names are resolved in the order of ``seq`` against what earlier batches left, exactly or by
    likeness, so that any cut of a stream into batches, in that order, leaves the same store.

    Each batch overwrites only its own partition folder and reads only earlier batches, so a replayed batch
    leaves what it left before; ids come from natural keys, not from the run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_entities(spark, folder, batch_id)
        ok = batch.where(valid_request())
        # the resolution is read several times: kept as a table of this batch, not computed again
        resolve_in_order(ok, known).write.mode("overwrite").parquet(f"{folder}/homes/batch={batch_id}")
        homes = spark.read.schema(_PLACED).parquet(f"{folder}/homes/batch={batch_id}")
        placed = ok.join(homes.select("seq", "entity_id", "action", "same_as"), "seq")
        own = F.col("action").isin("new", "flag")
        touched = placed.groupBy(F.col("entity_id").alias("id")).agg(
            F.min_by("name", F.when(own, F.col("seq"))).alias("name"),
            F.min_by("entity_type", "seq").alias("entity_type"),
            F.min(F.when(own, F.col("seq"))).alias("created"),
            F.max("seq").alias("touched"),
            F.min(F.when(own, F.col("at"))).alias("created_at"),
            F.max("at").alias("updated_at"),
        )
        facts = placed.select("entity_id", "at", "source", F.explode("observations").alias("content"))
        observations = facts.withColumn("id", natural_id(F.col("entity_id"), F.col("content"), F.col("at").cast("string"))).dropDuplicates(["id"])
        same = placed.where("same_as is not null").select(F.col("entity_id").alias("from_entity"), F.lit("same_as").alias("relation_type"), F.col("same_as").alias("to_entity"))
        for name, df in (("entities", touched), ("observations", observations), ("relations", same), ("rejected", batch.where(~valid_request()))):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        # the ledger row is last: readers join on it and see whole batches only
        done = batch.agg(F.count("*").alias("rows"), F.max("seq").alias("last_seq")).withColumn("id", F.lit(batch_id))
        done.write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch_id}")

    return write


def start(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Drain what there is and stop; run it on a schedule or with a processing-time trigger instead."""
    return stream.writeStream.foreachBatch(write_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of batches that the ledger completes: entities as all their notes say together, else of rows with an id the latest batch's."""
    done = spark.read.parquet(f"{folder}/ledger").select("batch")
    if name == "entities":
        return merged_notes(spark.read.schema(_ENTITY + ", batch int").parquet(f"{folder}/entities").join(small(done), "batch", "left_semi"))
    rows = spark.read.parquet(f"{folder}/{name}").join(small(done), "batch", "left_semi")
    if "id" not in rows.columns:
        return rows
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("batch", *[c for c in rows.columns if c != "batch"])).alias("row"))
    return latest.select("row.*")


def durability(query: StreamingQuery) -> dict:
    """The last batch's id, input rows and duration."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "ms": (last.get("durationMs") or {}).get("triggerExecution")}


def fresh_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each within the watermark; later repeats are dropped with bounded state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def access_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, session start and end, events) by session windows."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy("user_id", window).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
