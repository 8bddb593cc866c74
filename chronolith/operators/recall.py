"""Filtered recall over observations, and one-hop spreading along relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.scores import SCORE_FLOOR, SPREAD_DECAY, ranked_score, unit
from chronolith.functions.time import unexpired, valid_at
from chronolith.operators import search
from chronolith.operators.frames import small, top_k

# The known entity types.
ENTITY_TYPES = ("person", "project", "concept", "tool", "preference", "fact", "event", "location", "organization")


@dataclass(frozen=True)
class Filters:
    """What a recalled observation must satisfy; ``as_of`` replaces now, for validity and for ages."""

    entity_type: str | None = None
    source: str | None = None
    min_confidence: float | None = None
    tier: str | None = None
    entity_names: tuple[str, ...] = field(default=())
    as_of: int | None = None


def instant(filters: Filters, now: int) -> int:
    """The time at which a recall looks at the store."""
    return filters.as_of if filters.as_of is not None else now


def keeps(filters: Filters, now: int) -> Column:
    """Whether an observation row with entity_name and entity_type passes the filters; never null."""
    fine = valid_at(instant(filters, now))
    if filters.entity_type:
        fine &= F.col("entity_type") == filters.entity_type
    if filters.source:
        fine &= F.col("source") == filters.source
    if filters.min_confidence is not None:
        fine &= F.col("confidence") >= filters.min_confidence
    if filters.tier:
        fine &= F.col("memory_tier") == filters.tier
    if filters.entity_names:
        fine &= F.lower("entity_name").isin([n.lower() for n in filters.entity_names])
    return F.coalesce(fine, F.lit(False))


def kept(rows: DataFrame, filters: Filters, now: int) -> DataFrame:
    """Observation rows with entity_name and entity_type that pass the filters."""
    return rows.where(keeps(filters, now))


def known_type(column: str = "entity_type"):
    """Unknown entity types read as concept."""
    return F.when(F.col(column).isin(*ENTITY_TYPES), F.col(column)).otherwise("concept")


def hydrate(hits: DataFrame, observations: DataFrame, entities: DataFrame) -> DataFrame:
    """Hits (query_id, id, raw) with their observation and entity: two equi-joins, the hits being the small side."""
    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), known_type().alias("entity_type"))
    return observations.join(small(hits), "id").join(named, "entity_id")


def recall(hits: DataFrame, observations: DataFrame, entities: DataFrame, k: int, now: int, filters: Filters = Filters(), rate: float = 0.0) -> DataFrame:
    """(query_id, rank, id, entity_id, raw, score): the k best observations at or above the floor.

    ``hits`` (query_id, id, raw) are all matches of the queries; where they come from a search, ``recalled`` filters within it.
    """
    return _ranked(kept(hydrate(hits, observations, entities), filters, now), k, instant(filters, now), rate)


def recalled(queries: DataFrame, observations: DataFrame, entities: DataFrame, k: int, now: int, filters: Filters = Filters(), rate: float = 0.0) -> DataFrame:
    """``recall`` of the queries (query_id, text) among all observations: filters, ages and confidences hold before the limit.

    Which observations may answer, and by what factor their score changes, goes into the scan of their texts, so
    that no answer is lost behind better matches that the filters refuse. An observation without an entity is no answer.
    """
    at = instant(filters, now)
    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), known_type().alias("entity_type"), F.lit(True).alias("known"))
    factor = ranked_score(F.lit(1.0), F.col("observed_at"), F.col("confidence"), F.col("importance"), at, rate)
    rows = observations.join(named, "entity_id", "left").withColumn("factor", F.when(F.col("known") & keeps(filters, now), factor))
    key = ("id", "entity_id", "observed_at", "confidence", "importance")
    best = search.best_matches(rows.select(*key, F.col("content").alias("text"), "factor"), queries, k, key, boost="factor")
    return _ranked(best.withColumnRenamed("score", "raw"), k, at, rate)


def _ranked(rows: DataFrame, k: int, at: int, rate: float) -> DataFrame:
    scored = rows.withColumn("score", F.round(ranked_score(F.col("raw"), F.col("observed_at"), F.col("confidence"), F.col("importance"), at, rate), 6))
    found = scored.where(F.col("score") >= SCORE_FLOOR).select("query_id", "id", "entity_id", "raw", "score")
    return top_k(found, [F.desc("score"), F.col("id")], k, ["query_id"])


def both_directions(relations: DataFrame, now: int) -> DataFrame:
    """(a, b, weight) for unexpired relations, seen from either end."""
    live = relations.where(unexpired(now))
    return live.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"), "weight").unionByName(live.select(F.col("to_entity").alias("a"), F.col("from_entity").alias("b"), "weight"))


def spread(seeds: DataFrame, relations: DataFrame, observations: DataFrame, entities: DataFrame, slots: int, now: int, filters: Filters = Filters(), rate: float = 0.0) -> DataFrame:
    """(query_id, place, id, entity_id, raw, score): up to ``slots`` observations of the seeds' neighbours.

    Neighbours that are seeds give nothing. Each neighbour offers its latest ``slots`` observations;
    the order is (seed score desc, seed, weight desc, neighbour, observed_at desc, id), and an
    observation counts once, at its first place.
    """
    at = instant(filters, now)
    best = seeds.groupBy("query_id", "entity_id").agg(F.max("score").alias("seed_score")).withColumnRenamed("entity_id", "seed")
    edges = both_directions(relations, at).withColumnRenamed("a", "seed")
    near = best.join(edges, "seed")
    own = best.select("query_id", F.col("seed").alias("b"))
    near = near.join(own, ["query_id", "b"], "left_anti")

    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), known_type().alias("entity_type"))
    pool = observations.join(small(near.select(F.col("b").alias("entity_id")).distinct()), "entity_id", "left_semi").join(named, "entity_id")
    live = pool.where(~F.col("tombstoned") & unexpired(at))
    if filters.tier:
        live = live.where(F.col("memory_tier") == filters.tier)
    latest = top_k(live, [F.desc("observed_at"), F.col("id")], slots, ["entity_id"], "nth")
    latest = kept(latest, filters, now)

    met = near.join(latest, F.col("b") == F.col("entity_id")).drop("b")
    raw = F.lit(SPREAD_DECAY) * unit(F.col("weight")) * F.col("seed_score")
    scored = met.withColumn("raw", F.round(raw, 6)).withColumn("score", F.round(ranked_score(raw, F.col("observed_at"), F.col("confidence"), F.col("importance"), at, rate), 6))
    fine = scored.where(F.col("score") >= SCORE_FLOOR / 2).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = [F.desc("seed_score"), F.col("seed"), F.desc("weight"), F.col("entity_id"), F.desc("observed_at"), F.col("id")]
    once = fine.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*order))).where("first = 1")
    return top_k(once, order, slots, ["query_id"], "place").select("query_id", "place", "id", "entity_id", "raw", "score")


def recall_with_spread(queries: DataFrame, observations: DataFrame, entities: DataFrame, relations: DataFrame, k: int, now: int, filters: Filters = Filters(), rate: float = 0.0) -> DataFrame:
    """Direct hits, and where they are fewer than k, spread rows appended behind them (never re-sorted)."""
    direct = recalled(queries, observations, entities, k, now, filters, rate)
    extra = spread(direct, relations, observations, entities, k, now, filters, rate)
    count = direct.groupBy("query_id").agg(F.count("*").alias("n"))
    fill = extra.join(count, "query_id").where(F.col("place") <= F.lit(k) - F.col("n"))
    columns = ["query_id", "rank", "id", "entity_id", "raw", "score"]
    return direct.select(*columns).unionByName(fill.select("query_id", (F.col("n") + F.col("place")).cast("int").alias("rank"), "id", "entity_id", "raw", "score"))


def require_repaired(outbox: DataFrame, applied: int) -> None:
    """Refuse to recall while the index lacks committed work: any entry of the outbox beyond the applied generation."""
    if outbox.where(F.col("generation") > applied).limit(1).count():
        raise RuntimeError("the search index is behind the store: repair it before recalling")


def access_events(hits: DataFrame, now: int) -> DataFrame:
    """The access log that a recall leaves: an explicit write, never a side effect of reading."""
    return hits.select("id", F.lit(now).cast("long").alias("accessed_at"))


def folded_access(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Observations with the log's accesses added to their counts."""
    added = events.groupBy("id").agg(F.count("*").alias("added"))
    return observations.join(added, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("added", F.lit(0))).drop("added")
