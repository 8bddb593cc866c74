"""The whole plan of a merge, entities before observations before relations, and a Merkle digest that pins it.

Reviewed pairs decide where a source entity goes: into a target entity, or beside it under a qualified id. What
follows depends on that: an observation belongs to its entity's result, a relation runs between its ends' results. Equal
keys (result entity, lifecycle, content; or result ends, predicate, lifecycle) are one row of the result: the
target's if it has one, else that of the first source row in id order, and the others only add their origin.
Keys are digests, so contents don't travel, and the first of a key is a partial minimum, so a hot key costs what others do.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import framed_digest, qualified_id


class Snapshot(NamedTuple):
    """entities (id), observations (id, entity_id, lifecycle, content), relations (id, from_entity, relation_type, to_entity, lifecycle)."""

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame


def entity_results(source: Snapshot, same: DataFrame, space: str) -> DataFrame:
    """(id, action, result_id) of every source entity. ``same`` are reviewed pairs (source_id, target_id); the smallest target counts."""
    reviewed = same.groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("target_id"))
    rows = source.entities.select("id").join(reviewed, "id", "left")
    action = F.when(F.col("target_id").isNotNull(), "coalesce").otherwise("add")
    return rows.select("id", action.alias("action"), F.coalesce("target_id", qualified_id(F.lit(space), F.col("id").cast("string"))).alias("result_id"))


def _relations(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Relations with both ends' results; those with an end that has none are left out (``cascade_problems`` tells them)."""
    ends = results.select("id", "result_id")
    first = rows.join(ends.select(F.col("id").alias("from_entity"), F.col("result_id").alias("a")), "from_entity")
    return first.join(ends.select(F.col("id").alias("to_entity"), F.col("result_id").alias("b")), "to_entity")


def _looped(loops: tuple[str, ...]) -> Column:
    """Ends that became one, for a predicate that does not allow it."""
    return (F.col("a") == F.col("b")) & ~F.coalesce(F.col("relation_type").isin(*loops), F.lit(False))


def _first_by_key(kind: str, keyed: DataFrame, space: str) -> DataFrame:
    """Actions of rows (side, id, key): 0 is the target's side."""
    first = keyed.groupBy("key").agg(F.min(F.struct("side", "id")).alias("first"))
    own = qualified_id(F.lit(space), F.col("first.id"))
    result = F.when(F.col("side") == 0, F.col("id")).when(F.col("first.side") == 0, F.col("first.id")).otherwise(own)
    action = F.when(F.col("side") == 0, "keep").when(F.col("first") == F.struct("side", "id"), "add").otherwise("merge origin")
    return keyed.join(first, "key").select(F.lit(kind).alias("kind"), "side", action.alias("action"), "id", result.alias("result_id"), "key")


def cascade(target: Snapshot, source: Snapshot, same: DataFrame, space: str, loops: tuple[str, ...] = ()) -> DataFrame:
    """(kind, side, action, id, result_id, key): one action for every row of either snapshot.

    Source rows that a problem keeps out (``cascade_problems``) have none.
    """
    results = entity_results(source, same, space)
    theirs = target.entities.select("id", F.col("id").alias("result_id"))

    def observed(rows: DataFrame, ends: DataFrame, side: int) -> DataFrame:
        met = rows.select("id", "entity_id", "lifecycle", "content").join(ends.select(F.col("id").alias("entity_id"), "result_id"), "entity_id")
        return met.select(F.lit(side).alias("side"), F.col("id").cast("string").alias("id"), framed_digest(F.col("result_id").cast("string"), F.col("lifecycle"), F.col("content")).alias("key"))

    def related(rows: DataFrame, ends: DataFrame, side: int) -> DataFrame:
        met = _relations(rows, ends)
        fine = met if side == 0 else met.where(~_looped(loops))
        return fine.select(F.lit(side).alias("side"), F.col("id").cast("string").alias("id"), framed_digest(F.col("a").cast("string"), F.col("relation_type"), F.col("b").cast("string"), F.col("lifecycle")).alias("key"))

    no_key, text = F.lit(None).cast("string").alias("key"), [F.col(c).cast("string").alias(c) for c in ("id", "result_id")]
    kept = theirs.select(F.lit("entity").alias("kind"), F.lit(0).alias("side"), F.lit("keep").alias("action"), *text, no_key)
    placed = results.select(F.lit("entity").alias("kind"), F.lit(1).alias("side"), "action", *text, no_key)
    observations = _first_by_key("observation", observed(target.observations, theirs, 0).unionByName(observed(source.observations, results, 1)), space)
    relations = _first_by_key("relation", related(target.relations, theirs, 0).unionByName(related(source.relations, results, 1)), space)
    return kept.unionByName(placed).unionByName(observations).unionByName(relations)


def cascade_problems(target: Snapshot, source: Snapshot, same: DataFrame, space: str, loops: tuple[str, ...] = ()) -> DataFrame:
    """(problem, id): what must be settled before the plan is carried out."""
    results, theirs = entity_results(source, same, space), target.entities.select("id", F.col("id").alias("result_id"))

    def found(df: DataFrame, problem: str, column: str = "id") -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(column).cast("string").alias("id"))

    def loose(rows: DataFrame, ends: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return rows.select("id", F.explode(F.array(*columns)).alias("ref")).join(ends.select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()

    here = target.entities.select(F.col("id").alias("result_id"))
    mapped = _relations(target.relations, theirs).groupBy("a", "relation_type", "b", "lifecycle")
    parts = [
        found(results.where("action = 'coalesce'").join(here, "result_id", "left_anti"), "target is gone"),
        found(results.where("action = 'add'").join(here, "result_id"), "qualified id is taken"),
        found(same.select(F.col("source_id").alias("id")).distinct().join(source.entities.select("id"), "id", "left_anti"), "reviewed source is gone"),
        found(loose(target.observations, theirs, ("entity_id",)), "target observation without entity"),
        found(loose(source.observations, results, ("entity_id",)), "source observation without entity"),
        found(loose(target.relations, theirs, ("from_entity", "to_entity")), "target relation without end"),
        found(loose(source.relations, results, ("from_entity", "to_entity")), "source relation without end"),
        found(mapped.agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1"), "target relation twice"),
        found(_relations(source.relations, results).where(_looped(loops)), "self-loop"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Actions that a bucket of the digest's tree holds on average, at most.
BUCKET = 256


def _leaves(actions: DataFrame) -> DataFrame:
    """(place, leaf, times): an action's place among all hashes, what it says, and how often it is there."""
    place = framed_digest(F.col("kind"), F.col("side").cast("string"), F.col("id"))
    leaf = framed_digest(*[F.col(c).cast("string") for c in ("kind", "side", "action", "id", "result_id", "key")])
    return actions.select(place.alias("place"), leaf.alias("leaf")).groupBy("place", "leaf").agg(F.count("*").alias("times"))


def buckets(leaves: DataFrame, depth: int) -> DataFrame:
    """(bucket, digest): the range of hashes is cut into 16 ** depth buckets; each is the digest of its leaves in hash order."""
    said = F.concat_ws(":", "place", "leaf", F.col("times").cast("string"))
    return leaves.groupBy(F.substring("place", 1, depth).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(said)), "\n"), 256).alias("digest"))


def tree_digest(leaves: DataFrame, rows: int) -> DataFrame:
    """One row (rows, depth, digest): a Merkle tree over (place, leaf, times) in the order of places, which are hashes in hex.

    Buckets of hashes are range-sorted leaves; a node is the digest of its sixteen children, level by level to the
    root. The tree's depth follows from the number of rows, so one set of rows has one digest, wherever they lie. No
    task holds more than some buckets.
    """
    depth = 1
    while BUCKET * 16**depth < rows:
        depth += 1
    level = buckets(leaves, depth)
    node = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest"))), "\n"), 256).alias("digest")
    for d in range(depth - 1, 0, -1):
        level = level.groupBy(F.substring("bucket", 1, d).alias("up")).agg(node).withColumnRenamed("up", "bucket")
    return level.agg(node).select(F.lit(rows).cast("long").alias("rows"), F.lit(depth).alias("depth"), "digest")


def plan_digest(actions: DataFrame) -> DataFrame:
    """``tree_digest`` of a plan: a swapped, dropped, changed or doubled action makes another."""
    return tree_digest(_leaves(actions), actions.count())


def table_digest(rows: DataFrame) -> DataFrame:
    """``tree_digest`` of any table, over its columns by name; the order of rows and columns does not matter."""
    said = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    return tree_digest(rows.select(said.alias("place")).groupBy("place").agg(F.count("*").alias("times")).withColumn("leaf", F.lit("")), rows.count())


def plan_differences(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """(problem, kind, side, id): where a stored plan differs from the one that the snapshots give now."""
    fields = ["kind", "side", "action", "id", "result_id", "key"]
    said = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("action", "result_id", "key")]

    def told(df: DataFrame, name: str) -> DataFrame:
        return df.select(*fields).groupBy("kind", "side", "id").agg(F.array_sort(F.collect_set(F.concat_ws("\0", *said))).alias(name), F.count("*").alias(f"{name}_n"))

    both = told(plan, "planned").join(told(actual, "now"), ["kind", "side", "id"], "full_outer")
    problem = F.when(F.col("planned").isNull(), "not planned").when(F.col("now").isNull(), "no longer there").when(F.col("planned") != F.col("now"), "changed").when(F.col("planned_n") != F.col("now_n"), "repeated")
    return both.select(problem.alias("problem"), "kind", "side", "id").where("problem is not null")


def verify_cascade(plan: DataFrame, digest: str, target: Snapshot, source: Snapshot, same: DataFrame, space: str, loops: tuple[str, ...] = ()) -> DataFrame:
    """(problem, kind, side, id): empty where the plan has this digest and is what the snapshots give; actions are compared only if the digest isn't."""
    actual = cascade(target, source, same, space, loops)
    if plan_digest(plan).first()["digest"] == digest == plan_digest(actual).first()["digest"]:
        return plan.sparkSession.createDataFrame([], "problem string, kind string, side int, id string")
    wrong = plan_differences(plan, actual)
    if wrong.head(1):
        return wrong
    return plan.sparkSession.createDataFrame([("another digest", None, None, None)], "problem string, kind string, side int, id string")
