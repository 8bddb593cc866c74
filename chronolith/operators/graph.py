"""Typed traversal, supersession chains and routed retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.time import unexpired
from chronolith.operators.frames import dealt, top_k

MAX_HOPS = 8
#: Seeds whose neighbours a traversal shows.
EXPANDED = 4
#: Observations below which routing stays off.
ENGAGE_AT = 200


def traverse(seeds: DataFrame, relations: DataFrame, now: int, expand: int = EXPANDED, neighbours: int = 6, shown: int = 8) -> DataFrame:
    """(query_id, place, entity_id): the first ``shown`` seeds, then up to ``neighbours`` neighbours of the first ``expand``.

    ``seeds`` are (query_id, rank, entity_id). The neighbours of all expanded seeds are one list, each where it is
    met first (by seed, then heavier relations first); those met by part_of come after the others. Neighbours
    that are shown as seeds already use up their place.
    """
    top = seeds.groupBy("query_id", "entity_id").agg(F.min("rank").alias("rank"))
    first = top_k(top, [F.col("rank"), F.col("entity_id")], shown, ["query_id"], "seed_no")
    live = relations.where(unexpired(now))
    there = live.select(F.col("from_entity").alias("entity_id"), F.col("to_entity").alias("near"), "relation_type", "weight")
    back = live.select(F.col("to_entity").alias("entity_id"), F.col("from_entity").alias("near"), "relation_type", "weight")
    met = first.where(F.col("seed_no") <= expand).join(there.unionByName(back), "entity_id")
    once = met.groupBy("query_id", "near").agg(F.min(F.struct("seed_no", (-F.col("weight")).alias("lighter"), "relation_type")).alias("first"))
    last = (F.col("first.relation_type") == "part_of").cast("int")
    some = top_k(once, [last, F.col("first"), F.col("near")], neighbours, ["query_id"], "near_no")
    waves = first.select("query_id", "entity_id", F.lit(0).alias("wave"), F.col("seed_no").alias("nth")).unionByName(some.select("query_id", F.col("near").alias("entity_id"), F.lit(1).alias("wave"), F.col("near_no").alias("nth")))
    every = dealt(waves, "query_id", "entity_id").groupBy("query_id", "entity_id").agg(F.min(F.struct("wave", "nth")).alias("at"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "entity_id"))).select("query_id", "place", "entity_id")


def supersession_chain(links: DataFrame, starts: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(start, hop, id): follow successors from each start for at most ``hops`` steps, stopping at a cycle.

    ``links`` are (newer, older); a row with several successors follows the smallest. The steps are
    unrolled equi-joins on a frontier that only shrinks; each carries its visited ids.
    """
    step = links.groupBy(F.col("older").alias("id")).agg(F.min("newer").alias("next"))
    front = starts.select(F.col("id").alias("start"), "id", F.array("id").alias("seen"))
    out = front.select("start", F.lit(0).alias("hop"), "id")
    for hop in range(1, hops + 1):
        front = front.join(step, "id").where(~F.array_contains("seen", F.col("next"))).select("start", F.col("next").alias("id"), F.array_append("seen", F.col("next")).alias("seen"))
        out = out.unionByName(front.select("start", F.lit(hop).alias("hop"), "id"))
    return out


def append_dedup(routes: DataFrame, k: int) -> DataFrame:
    """(query_id, place, item): items of several routes (query_id, route, rank, item), primary first, each item once."""
    once = dealt(routes, "query_id", "item").groupBy("query_id", "item").agg(F.min(F.struct("route", "rank")).alias("at"))
    return top_k(once, [F.col("at"), F.col("item")], k, ["query_id"], "place").select("query_id", "place", "item")


def interleave(lists: DataFrame, k: int) -> DataFrame:
    """(query_id, place, space, item): round robin by rank over (query_id, space_pos, space, rank, item)."""
    return top_k(lists, [F.col("rank"), F.col("space_pos"), F.col("item")], k, ["query_id"], "place").select("query_id", "place", "space", "item")


def promote_successors(hits: DataFrame, chain: DataFrame, k: int) -> DataFrame:
    """(query_id, place, item): a superseded hit gives its rank to the last of its chain and follows it.

    ``hits`` are (query_id, rank, item), ``chain`` (start, hop, id) as above. Each item stays once, at
    its best place.
    """
    last = chain.groupBy("start").agg(F.max_by("id", "hop").alias("head"))
    headed = hits.join(last, hits["item"] == last["start"], "left")
    first = headed.select("query_id", "rank", F.lit(0).alias("behind"), F.coalesce("head", "item").alias("item"))
    then = headed.where("head is not null and head <> item").select("query_id", "rank", F.lit(1).alias("behind"), "item")
    once = dealt(first.unionByName(then), "query_id", "item").groupBy("query_id", "item").agg(F.min(F.struct("rank", "behind")).alias("at"))
    return top_k(once, [F.col("at"), F.col("item")], k, ["query_id"], "place").select("query_id", "place", "item")


def routed(queries: DataFrame, gloss: DataFrame, content: DataFrame, relational: DataFrame, k: int, engaged: bool = True, pinned: bool = False) -> DataFrame:
    """Routed retrieval: the query's intent names its first route; the others are appended, never interleaved.

    The routes are (query_id, rank, item); ``queries`` has query_id and intent. Behind the first route
    come content and then gloss. Content has no validity, so queries pinned to an instant leave it out
    and a content question becomes a lookup; a store too small to engage answers from content only.
    """
    if pinned:
        plan = [("lookup", gloss, 0), ("content", gloss, 0), ("relational", relational, 0), ("relational", gloss, 2)]
    elif not engaged:
        plan = [(intent, content, 0) for intent in ("lookup", "content", "relational")]
    else:
        plan = [("lookup", gloss, 0), ("lookup", content, 1), ("content", content, 0), ("content", gloss, 2), ("relational", relational, 0), ("relational", content, 1), ("relational", gloss, 2)]
    parts = None
    for intent, route, place in plan:
        part = route.join(queries.where(F.col("intent") == intent).select("query_id"), "query_id", "left_semi").select("query_id", F.lit(place).alias("route"), "rank", "item")
        parts = part if parts is None else parts.unionByName(part)
    return append_dedup(parts, k)
