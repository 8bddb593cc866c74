"""Routed retrieval as one operator: classify, search every arm, promote successors, fill, and tell how sure it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.scores import CONFIDENCE_MARGIN_FLOOR, CONFIDENCE_TOP_FLOOR
from chronolith.functions.text import intent
from chronolith.operators import graph, recall, search

ENTITY_PREFIX = "entity://"


def retrieve(queries: DataFrame, chunks: DataFrame, observations: DataFrame, entities: DataFrame, relations: DataFrame, links: DataFrame, k: int, now: int, rate: float = 0.0, as_of: int | None = None) -> DataFrame:
    """(query_id, place, item, intent, low): up to ``k`` items for each of the queries (query_id, text, vector or not).

    Items are chunk uris and ``entity://`` ids. The content arm is a hybrid search of ``chunks``; the gloss arm recalls
    observations, puts the successors of superseded ones (``links``: newer, older) in their place and shows their
    entities; the relational arm walks from those entities along ``relations``. The intent names the arm that comes
    first and the others fill up. With fewer than ``ENGAGE_AT`` observations only content answers. ``low`` tells that
    the best vector match is weak or not clearly the best; it is null for queries without a vector. ``as_of`` pins
    observations and relations to an instant; what was superseded since then stands for itself.
    """
    k = search.clamped(k)
    asked = queries.select("query_id", "text", intent(F.col("text")).alias("intent"))
    content = search.hybrid_search(chunks.withColumn("item", F.col("uri")), None, None, queries, 3 * k, key=("item",)).select("query_id", "rank", "item")

    found = recall.recalled(queries, observations, entities, 3 * k, now, recall.Filters(as_of=as_of), rate)
    chain = graph.supersession_chain(links, found.select("id").distinct())
    hits = found.select("query_id", "rank", F.col("id").alias("item"))
    current = graph.promote_successors(hits, chain, 3 * k) if as_of is None else hits.withColumnRenamed("rank", "place")
    named = current.join(observations.select(F.col("id").alias("item"), "entity_id"), "item")
    gloss = named.groupBy("query_id", "entity_id").agg(F.min("place").alias("rank"))

    walked = graph.traverse(gloss.select("query_id", "rank", "entity_id"), relations, now if as_of is None else as_of)
    relational = walked.select("query_id", F.col("place").alias("rank"), F.concat(F.lit(ENTITY_PREFIX), "entity_id").alias("item"))
    shown = gloss.select("query_id", "rank", F.concat(F.lit(ENTITY_PREFIX), "entity_id").alias("item"))
    engaged = observations.limit(graph.ENGAGE_AT).count() >= graph.ENGAGE_AT
    placed = graph.routed(asked, shown, content, relational, k, engaged).join(asked.select("query_id", "intent"), "query_id")
    if "vector" not in queries.columns:
        return placed.withColumn("low", F.lit(None).cast("boolean"))
    best = search.vector_topk(chunks.withColumn("item", F.col("uri")), queries, 2, ("item",))
    sure = search.dense_confidence(best, CONFIDENCE_TOP_FLOOR, CONFIDENCE_MARGIN_FLOOR).select("query_id", "low")
    return placed.join(sure, "query_id", "left")
