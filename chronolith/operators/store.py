"""Status, listings, paging, ambiguity and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.time import live_now, no_stub, unexpired
from chronolith.operators.frames import top_k


def status(entities: DataFrame, observations: DataFrame, relations: DataFrame, chunks: DataFrame, now: int) -> DataFrame:
    """One row of totals; each table is scanned once and only one-row frames are joined."""
    obs = observations.agg(
        F.count("*").alias("observations"),
        F.count_if(live_now(now)).alias("live"),
        F.count_if("tombstoned").alias("tombstoned"),
        F.min("observed_at").alias("oldest"),
        F.max("observed_at").alias("newest"),
    )
    ent = entities.where(no_stub()).agg(F.count("*").alias("entities"))
    rel = relations.agg(F.count("*").alias("relations"))
    vec = chunks.agg(F.count("vector").alias("vectors"))
    return obs.crossJoin(ent).crossJoin(rel).crossJoin(vec)


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def type_counts_by_source(entities: DataFrame) -> DataFrame:
    return entities.where(no_stub()).groupBy("source", "entity_type").agg(F.count("*").alias("n"))


def relation_counts_by_source(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations counted under the source of the entity they start from."""
    return relations.select(F.col("from_entity").alias("id")).join(entities.select("id", "source"), "id").groupBy("source").agg(F.count("*").alias("n"))


def list_entities(entities: DataFrame, observations: DataFrame, now: int, limit: int, offset: int = 0, entity_type: str | None = None) -> DataFrame:
    """A page by updated_at desc, id, with live observation counts: the page is cut before the count join."""
    some = entities.where(no_stub())
    if entity_type:
        some = some.where(F.col("entity_type") == entity_type)
    page = some.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    live = observations.where(live_now(now)).groupBy("entity_id").agg(F.count("*").alias("n"))
    return page.join(live, page["id"] == live["entity_id"], "left").select("id", "name", "entity_type", "updated_at", F.coalesce("n", F.lit(0)).alias("observations"))


def keyset_page(rows: DataFrame, order: tuple[str, str], after: tuple | None, limit: int) -> DataFrame:
    """Rows behind a cursor in (time, id) order, with a flag on all of them whether more follow."""
    a, b = order
    rest = rows if after is None else rows.where((F.col(a) > after[0]) | ((F.col(a) == after[0]) & (F.col(b) > after[1])))
    page = top_k(rest, [F.col(a), F.col(b)], limit + 1)
    more = F.count("*").over(Window.partitionBy()) > limit  # over limit + 1 rows at most
    return page.withColumn("has_more", more).where(F.col("rank") <= limit)


def resolve(entities: DataFrame, names: DataFrame, most: int = 64) -> DataFrame:
    """(name, outcome, id, candidates, truncated) by exact name: not_found, unique or ambiguous; of several the oldest is
    named, and ``candidates`` are the ids of the first ``most``, oldest first."""
    asked = names.select("name").distinct()
    found = asked.join(entities.select("name", "id", "created_at"), "name")
    first = top_k(found, [F.col("created_at"), F.col("id")], most + 1, ["name"], "nth")
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("few"))
    outcome = F.when(F.col("few").isNull(), "not_found").when(F.size("few") == 1, "unique").otherwise("ambiguous")
    ids = F.coalesce(F.slice(F.col("few.id"), 1, most), F.array().cast(f"array<{dict(entities.dtypes)['id']}>"))
    return asked.join(listed, "name", "left").select("name", outcome.alias("outcome"), F.get("few.id", F.lit(0)).alias("id"), ids.alias("candidates"), F.coalesce(F.size("few") > most, F.lit(False)).alias("truncated"))


def entity_records(resolved: DataFrame, observations: DataFrame, relations: DataFrame, now: int, latest: int = 10) -> DataFrame:
    """(name, outcome, id, observations, outgoing, incoming): each resolved name's record, with its latest live
    observations as an array bounded by ``latest``."""
    wanted = resolved.where("id is not null").select("id").distinct()
    live = observations.where(live_now(now)).join(wanted.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
    newest = top_k(live.select("entity_id", "id", "observed_at"), [F.desc("observed_at"), F.col("id")], latest, ["entity_id"], "nth")
    facts = newest.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("facts")).select(F.col("entity_id").alias("id"), F.col("facts.id").alias("observations"))
    current = relations.where(unexpired(now))
    out = current.groupBy(F.col("from_entity").alias("id")).agg(F.count("*").alias("outgoing"))
    into = current.groupBy(F.col("to_entity").alias("id")).agg(F.count("*").alias("incoming"))
    rows = resolved.join(facts, "id", "left").join(out, "id", "left").join(into, "id", "left")
    return rows.select("name", "outcome", "id", "observations", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def upsert_sources(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest row per uri, keeping the first created_at; of several at one time the largest in column order."""
    every = sources.unionByName(updates)
    rest = [c for c in sources.columns if c not in ("uri", "created_at")]
    latest = every.groupBy("uri").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *rest)).alias("row"), F.min("created_at").alias("created_at"))
    return latest.select("uri", "row.*", "created_at").select(*sources.columns)


def source_stats(sources: DataFrame) -> DataFrame:
    """Number, chunks and bytes by kind."""
    return sources.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def get_sources(sources: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, found, ...): the asked sources, with nulls for those that are not known."""
    asked = uris.select("uri").distinct()
    return asked.join(sources.withColumn("found", F.lit(True)), "uri", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_sources(sources: DataFrame, uris: DataFrame) -> DataFrame:
    return sources.join(uris.select("uri").distinct(), "uri", "left_anti")


def list_sources(sources: DataFrame, kind: str | None = None) -> DataFrame:
    return (sources.where(F.col("kind") == kind) if kind else sources).orderBy("uri")


def changes(stored: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """(uri, change): inserted, updated, unchanged, removed or skipped, by content digest.

    ``stored`` are (uri, digest), ``files`` (uri, content text or null when not UTF-8). Empty, too
    large and unreadable files are skipped.
    """
    read = files.select("uri", F.sha2(F.col("content"), 256).alias("now"), F.octet_length("content").alias("size"))
    both = stored.join(read.withColumn("seen", F.lit(True)), "uri", "full_outer")
    skipped = F.col("now").isNull() | (F.col("size") == 0) | (F.col("size") > max_bytes)
    change = F.when(F.col("seen").isNull(), "removed").when(skipped, "skipped").when(F.col("digest").isNull(), "inserted").when(F.col("digest") == F.col("now"), "unchanged").otherwise("updated")
    return both.select("uri", change.alias("change"))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of which an end does not exist: the ends are rows, so both tests are one hash join."""
    ends = relations.select("id", F.explode(F.array("from_entity", "to_entity")).alias("end"))
    return ends.join(entities.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct()


def domain_of(entities: DataFrame, domains: int, key: str = "name") -> DataFrame:
    """Stable hash domain of each entity, by the case-folded key."""
    return entities.withColumn("domain", F.pmod(F.xxhash64(F.lower(key)), F.lit(domains)).cast("int"))


def domain_report(entities: DataFrame, relations: DataFrame, domains: int) -> DataFrame:
    """(domain, entities, local, crossing): how a K-way partition would spread entities and cut relations."""
    placed = domain_of(entities, domains).select("id", "domain")
    ends = relations.join(placed.withColumnRenamed("domain", "a"), relations["from_entity"] == placed["id"]).drop("id").select("to_entity", "a")
    ends = ends.join(placed.withColumnRenamed("domain", "b"), ends["to_entity"] == placed["id"]).select("a", "b")
    cut = ends.groupBy(F.col("a").alias("domain")).agg(F.count_if(F.col("a") == F.col("b")).alias("local"), F.count_if(F.col("a") != F.col("b")).alias("crossing"))
    return placed.groupBy("domain").agg(F.count("*").alias("entities")).join(cut, "domain", "left").na.fill(0, ["local", "crossing"])
