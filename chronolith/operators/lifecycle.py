"""Retention: near-duplicate observations, decay pruning, tombstone sweeps, orphans, forgetting, superseding."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.scores import retention_score
from chronolith.functions.text import set_jaccard, word_set
from chronolith.functions.time import unexpired
from chronolith.operators.frames import small

TOMBSTONE_TTL = 14 * 86_400


@dataclass(frozen=True)
class Consolidation:
    """Settings of a consolidation run."""

    threshold: float = 0.95
    min_age: int = 86_400
    decay_rate: float = 0.01
    prune_floor: float = 0.05
    ttl: int = TOMBSTONE_TTL


def word_classes(observations: DataFrame) -> DataFrame:
    """(entity_id, id, observed_at, words, leader): live observations; those of one entity with equal word sets share as
    leader the freshest of them, of several the smallest id."""
    live = observations.where(~F.col("tombstoned")).select("entity_id", "id", "observed_at", F.array_sort(word_set(F.col("content"))).alias("words"))
    live = live.withColumn("same", F.sha2(F.array_join("words", "\n"), 256))
    first = live.groupBy("entity_id", "same").agg(F.min(F.struct((-F.col("observed_at")).alias("age"), "id"))["id"].alias("leader"))
    return live.join(first, ["entity_id", "same"]).drop("same")


def similar_pairs(observations: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, a, b, similarity) of live observations of one entity, a being the fresher, between different word sets.

    Equal word sets are one class, represented by its leader (``word_classes`` has the members), so copies make
    no pairs. Exact prefix filter: two word sets of Jaccard t share one of their rarest ``n - ceil(t n) + 1``
    words within the entity, so candidates meet on (entity, word) and not in all pairs of an entity; sets are
    compared only where sizes allow t.
    """
    live = word_classes(observations).where("id = leader").drop("leader")
    words = live.select("entity_id", "id", F.explode("words").alias("word"))
    df = words.groupBy("entity_id", "word").agg(F.count("*").alias("df"))
    ranked = words.join(df, ["entity_id", "word"]).groupBy("entity_id", "id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    n = F.size("ranked")
    length = (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")
    prefix = ranked.select("entity_id", "id", n.alias("n"), F.explode(F.slice("ranked", F.lit(1), length)).alias("r")).select("entity_id", "id", "n", "r.word")
    other = prefix.select("entity_id", "word", F.col("id").alias("other"), F.col("n").alias("m"))
    fits = F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9
    near = prefix.join(other, ["entity_id", "word"]).where((F.col("id") < F.col("other")) & fits).select("entity_id", "id", "other").distinct()
    left = live.select("entity_id", "id", F.col("words").alias("w1"), F.col("observed_at").alias("t1"))
    right = live.select("entity_id", F.col("id").alias("other"), F.col("words").alias("w2"), F.col("observed_at").alias("t2"))
    met = near.join(left, ["entity_id", "id"]).join(right, ["entity_id", "other"])
    measured = met.withColumn("similarity", set_jaccard(F.col("w1"), F.col("w2"))).where(F.col("similarity") >= threshold)
    fresher = (F.col("t1") > F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("id") < F.col("other")))
    a, b = F.when(fresher, F.col("id")).otherwise(F.col("other")), F.when(fresher, F.col("other")).otherwise(F.col("id"))
    return measured.select("entity_id", a.alias("a"), b.alias("b"), F.round("similarity", 6).alias("similarity"))


def duplicates(observations: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, survivor, loser): the greedy leader pass, freshest first.

    Only candidate pairs of different word sets enter the sequential kernel, one group per entity: a leader
    takes every later row that is similar to it and not yet taken. Copies of a row go where its class goes:
    to the class's own leader, or to the survivor that took it.
    """
    order = observations.select(F.col("id").alias("a"), "observed_at")
    pairs = similar_pairs(observations, threshold).join(order, "a")

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        group = group.sort_values(["observed_at", "a", "b"], ascending=[False, True, True])
        for leader, rows in group.groupby("a", sort=False):
            if leader in taken:
                continue
            for loser in rows["b"]:
                if loser not in taken:
                    taken.add(loser)
                    out.append((rows["entity_id"].iloc[0], leader, loser))
        return pd.DataFrame(out, columns=["entity_id", "survivor", "loser"])

    kinds = dict(observations.dtypes)
    led = pairs.groupBy("entity_id").applyInPandas(lead, f"entity_id {kinds['entity_id']}, survivor {kinds['id']}, loser {kinds['id']}")
    copies = word_classes(observations).where("id <> leader").select("entity_id", "id", "leader")
    gone = copies.join(led.withColumnRenamed("loser", "leader"), ["entity_id", "leader"], "left")
    return led.unionByName(gone.select("entity_id", F.coalesce("survivor", "leader").alias("survivor"), F.col("id").alias("loser")))


def access_rollup(observations: DataFrame, losers: DataFrame) -> DataFrame:
    """(id, access_count): survivors with their losers' accesses added."""
    lost = losers.join(observations.select(F.col("id").alias("loser"), "access_count"), "loser").groupBy(F.col("survivor").alias("id")).agg(F.sum("access_count").alias("gained"))
    return observations.select("id", "access_count").join(small(lost), "id").select("id", (F.col("access_count") + F.col("gained")).alias("access_count"))


def retention(observations: DataFrame, now: int, rate: float) -> DataFrame:
    return observations.where(~F.col("tombstoned")).select("id", "observed_at", F.round(retention_score(now, rate), 6).alias("retention"))


def prune_candidates(observations: DataFrame, now: int, settings: Consolidation = Consolidation()) -> DataFrame:
    """Live observations that are old enough and retain less than the floor."""
    scored = retention(observations, now, settings.decay_rate)
    return scored.where((F.lit(now) - F.col("observed_at") >= settings.min_age) & (F.col("retention") < settings.prune_floor)).select("id", "retention")


def stale_tombstones(observations: DataFrame, now: int, ttl: int = TOMBSTONE_TTL) -> DataFrame:
    """Tombstoned rows whose valid_until, else observed_at, lies ttl or more back."""
    return observations.where(F.col("tombstoned") & (F.coalesce("valid_until", "observed_at") <= now - max(ttl, 0)))


def orphans(entities: DataFrame, observations: DataFrame, relations: DataFrame, now: int) -> DataFrame:
    """Entities without observations (tombstoned ones count) and without unexpired relations at either end."""
    ends = relations.where(unexpired(now)).select(F.explode(F.array("from_entity", "to_entity")).alias("id"))
    return entities.join(observations.select(F.col("entity_id").alias("id")), "id", "left_anti").join(ends, "id", "left_anti")


def consolidate(observations: DataFrame, now: int, settings: Consolidation = Consolidation()) -> DataFrame:
    """(id, duplicate, pruned): rows to retire; one row can be in both counts."""
    lost = duplicates(observations, settings.threshold).select(F.col("loser").alias("id"), F.lit(True).alias("duplicate")).distinct()
    old = prune_candidates(observations, now, settings).select("id", F.lit(True).alias("pruned"))
    return lost.join(old, "id", "full_outer").select("id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.coalesce("pruned", F.lit(False)).alias("pruned"))


def forget(observations: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Observations with the given ones tombstoned and closed at now."""
    gone = observations.join(small(ids.select("id").distinct().withColumn("hit", F.lit(True))), "id", "left")
    closed = F.when(F.col("hit"), F.least(F.coalesce("valid_until", F.lit(now)), F.lit(now))).otherwise(F.col("valid_until"))
    return gone.withColumn("valid_until", closed.cast("long")).withColumn("tombstoned", F.col("tombstoned") | F.coalesce("hit", F.lit(False))).select(*observations.columns)


def forget_entities(entities: DataFrame, observations: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given entities and all that hangs on them."""
    gone = small(ids.select("id").distinct())
    return (
        entities.join(gone, "id", "left_anti"),
        observations.join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti"),
        relations.join(gone.withColumnRenamed("id", "from_entity"), "from_entity", "left_anti").join(gone.withColumnRenamed("id", "to_entity"), "to_entity", "left_anti"),
    )


def prune(entities: DataFrame, observations: DataFrame, relations: DataFrame, now: int, ttl: int = TOMBSTONE_TTL) -> tuple[DataFrame, DataFrame]:
    """(entities, observations) after the sweep of stale tombstones and then of orphans."""
    left = observations.join(stale_tombstones(observations, now, ttl).select("id"), "id", "left_anti")
    return entities.join(orphans(entities, left, relations, now).select("id"), "id", "left_anti"), left


def set_tier(observations: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations with new tiers from (id, memory_tier); unknown tiers are refused and change nothing."""
    fine = changes.where(F.col("memory_tier").isin("episodic", "semantic", "procedural")).groupBy("id").agg(F.max("memory_tier").alias("new_tier"))
    return observations.join(small(fine), "id", "left").withColumn("memory_tier", F.coalesce("new_tier", "memory_tier")).select(*observations.columns)


def add_relations(relations: DataFrame, new: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, refused): new relations (id, from_entity, to_entity, ...) whose ends exist are appended, the others refused."""
    ids = entities.select("id").distinct()
    ends = new.join(ids.withColumnRenamed("id", "from_entity"), "from_entity", "left_semi").join(ids.withColumnRenamed("id", "to_entity"), "to_entity", "left_semi")
    return relations.unionByName(ends.select(*new.columns), allowMissingColumns=True), new.join(ends.select("id"), "id", "left_anti")


def destruction_preview(observations: DataFrame, relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, observations, relations, digest): what destroying each entity would take, and a digest that
    a confirmation must repeat, so that nothing is destroyed that was not shown."""
    wanted = small(ids.select(F.col("id").alias("entity_id")).distinct())
    obs = observations.join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("observations"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    ends = relations.select("id", F.explode(F.array_distinct(F.array("from_entity", "to_entity"))).alias("entity_id")).join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("relations"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("rel_mark"))
    rows = wanted.join(obs, "entity_id", "left").join(ends, "entity_id", "left")
    digest = F.sha2(F.concat_ws("\0", F.col("entity_id").cast("string"), F.coalesce("mark", F.lit(0)).cast("string"), F.coalesce("rel_mark", F.lit(0)).cast("string")), 256)
    return rows.select("entity_id", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("relations", F.lit(0)).alias("relations"), digest.alias("digest"))


def confirmed(preview: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Entities whose confirmation (entity_id, digest) repeats what the preview shows now."""
    return preview.join(confirmations, ["entity_id", "digest"], "left_semi").select(F.col("entity_id").alias("id"))


def supersede(observations: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(observations, links): each change (id, new_id, content) closes a live row and adds its successor.

    The old row ends and is tombstoned at now; the new one starts then, with the old one's other
    columns and no accesses. Changes to rows that are not live are ignored.
    """
    old = observations.where(~F.col("tombstoned")).join(small(changes.select("id", "new_id", F.col("content").alias("new_content"))), "id")
    new = old.withColumns({"id": F.col("new_id"), "content": F.col("new_content"), "observed_at": F.lit(now).cast("long"), "valid_from": F.lit(now).cast("long"), "valid_until": F.lit(None).cast("long"), "access_count": F.lit(0).cast("long")}).select(*observations.columns)
    links = old.select(F.col("new_id").alias("newer"), F.col("id").alias("older"))
    return forget(observations, old.select("id"), now).unionByName(new), links
