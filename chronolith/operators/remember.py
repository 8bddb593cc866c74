"""Upserting entity groups with name normalization: exact, fuzzy (merge or flag), new."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.names import closest, name_similarity, similarity_bound
from chronolith.functions.text import stripped
from chronolith.functions.time import no_stub
from chronolith.operators.frames import running_sums, small, top_k

MERGE_AT, FLAG_AT, RECENT = 0.95, 0.85, 100


def valid_request() -> Column:
    """A request needs a name, a type and, where it has observations, non-empty ones; nulls count as missing."""
    empty = F.exists("observations", lambda o: F.coalesce(stripped(o), F.lit("")) == "")
    named = (F.coalesce(stripped(F.col("name")), F.lit("")) != "") & (F.coalesce(stripped(F.col("entity_type")), F.lit("")) != "")
    return named & ~F.coalesce(empty, F.lit(False))


def natural_id(*parts: Column) -> Column:
    """An id that a retried batch makes again: the digest of the row's natural key."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def fuzzy_matches(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_type, id, score, action): each name's best match among the ``RECENT`` latest of its type, if it
    reaches ``FLAG_AT``; else the name is new, and id and score are null.

    Pairs whose edit measure, an upper bound that the engine computes, is below that never reach Python. Names meet candidates of one type only; the candidate side is bounded to 100 per type. Ties go to
    the most recently updated, then the smallest id. Structural placeholders are no candidates.
    """
    real = entities.where(no_stub()) if "source" in entities.columns else entities
    recent = top_k(real, [F.desc("updated_at"), F.col("id")], RECENT, ["entity_type"], "nth").select("entity_type", "id", F.col("name").alias("known"), "nth")
    near = names.join(small(recent), "entity_type").where(similarity_bound(F.col("name"), F.col("known")) >= FLAG_AT - 1e-9)
    met = near.withColumn("score", name_similarity(F.col("name"), F.col("known"))).where(F.col("score") >= FLAG_AT)
    best = met.groupBy("name", "entity_type").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("nth"))).alias("best")).select("name", "entity_type", "best.*")
    action = F.when(F.col("score") >= MERGE_AT, "merge").when(F.col("score") >= FLAG_AT, "flag").otherwise("new")
    return names.select("name", "entity_type").distinct().join(best, ["name", "entity_type"], "left").select("name", "entity_type", "id", F.round("score", 6).alias("score"), action.alias("action"))


def resolve_requests(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_type, entity_id, action, same_as): where each distinct requested name goes.

    Exact name and type first; else the best fuzzy match merges or is flagged with a same-as edge; else
    a new entity. New names of one batch that are equal get one id.
    """
    asked = requests.where(valid_request()).select("name", "entity_type").distinct()
    age = "created_at" if "created_at" in entities.columns else "id"
    oldest = entities.groupBy("name", "entity_type").agg(F.min_by("id", F.struct(age, "id")).alias("exact"))  # names may be shared
    exact = asked.join(oldest, ["name", "entity_type"], "left")
    open_names = exact.where("exact is null").select("name", "entity_type")
    fuzzy = fuzzy_matches(open_names, entities).withColumnRenamed("id", "near")
    new = natural_id(F.col("name"), F.col("entity_type"))
    done = exact.where("exact is not null").select("name", "entity_type", F.col("exact").cast("string").alias("entity_id"), F.lit("exact").alias("action"), F.lit(None).cast("string").alias("same_as"))
    rest = open_names.join(fuzzy, ["name", "entity_type"], "left").select(
        "name",
        "entity_type",
        F.when(F.col("action") == "merge", F.col("near").cast("string")).otherwise(new).alias("entity_id"),
        F.coalesce("action", F.lit("new")).alias("action"),
        F.when(F.col("action") == "flag", F.col("near").cast("string")).alias("same_as"),
    )
    return done.unionByName(rest)


def resolve_batch(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """``resolve_requests`` for requests with a ``seq``, one after the other: a name may also match one that an earlier
    request of the batch has created or touched, which counts as most recent.

    A type's distinct new names of one batch are a sequence by their nature; types are independent.
    """
    asked = requests.where(valid_request()).groupBy("name", "entity_type").agg(F.min("seq").alias("seq"))
    age = "created_at" if "created_at" in entities.columns else "id"
    oldest = entities.groupBy("name", "entity_type").agg(F.min_by("id", F.struct(age, "id")).cast("string").alias("exact"))
    asked = asked.join(oldest, ["name", "entity_type"], "left").select("entity_type", "seq", "name", "exact")
    real = entities.where(no_stub()) if "source" in entities.columns else entities
    recent = top_k(real, [F.desc("updated_at"), F.col("id")], RECENT, ["entity_type"], "nth").select("entity_type", F.col("id").cast("string").alias("id"), F.col("name").alias("known"), "nth")
    return _one_by_one(asked, recent).drop("seq")


class _Letters:
    """Letter counts of the recent names: what bounds their likeness to another name from above, for all at once.

    An edit changes one letter, so names that differ in many letters can't be alike enough; names without letters or digits are
    never ruled out. Letters share bins, which only loosens the bound.
    """

    def __init__(self):
        self.row, self.free = {}, list(range(RECENT + 1))
        self.bins, self.size = np.zeros((RECENT + 1, 128), np.int16), np.zeros(RECENT + 1)
        self.size[:] = -1

    @staticmethod
    def counts(name: str) -> tuple[np.ndarray, int]:
        letters = [ord(c) % 128 for c in name.lower() if c.isalnum()]
        return np.bincount(letters, minlength=128).astype(np.int16), len(letters)

    def keep(self, ident: str, name: str) -> None:
        if ident not in self.row:
            self.row[ident] = at = self.free.pop()
            self.bins[at], self.size[at] = self.counts(name)

    def drop(self, ident: str) -> None:
        at = self.row.pop(ident)
        self.size[at] = -1
        self.free.append(at)

    def bounds(self, name: str) -> list[float]:
        """For each place, what the likeness of its name to this one can be at most; -1 for free places."""
        bins, size = self.counts(name)
        apart = self.bins - bins
        least = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        bound = 1 - least / np.maximum(np.maximum(self.size, size), 1) + 1e-9
        bound[(self.size == 0) | (size == 0)] = 1.0
        bound[self.size < 0] = -1.0
        return bound.tolist()


_PLACED = "seq long, name string, entity_type string, entity_id string, action string, same_as string"


def resolve_in_order(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(seq, name, entity_type, entity_id, action, same_as): where every single valid request goes, one after the other.

    Every request makes its entity its type's most recent one, and the next request sees that; so a sequence of requests
    has one result, however it is cut into batches, if ``entities`` (id, name, entity_type, touched) tell by
    ``touched``, a request's ``seq``, when each was last asked for. Exact names are found by a join beforehand; what passes
    through a type's one task, by nature a sequence, are the names without a home and what lies just before them. ``seq`` is unique.
    """
    asked = requests.where(valid_request()).select("seq", "name", "entity_type")
    oldest = entities.groupBy("name", "entity_type").agg(F.min_by("id", F.struct("created", "id")).alias("exact"))
    asked = asked.join(oldest, ["name", "entity_type"], "left").select("entity_type", F.col("seq").cast("long").alias("seq"), "name", F.col("exact").cast("string").alias("exact"))
    recent = top_k(entities, [F.desc("touched"), F.col("id")], RECENT, ["entity_type"], "nth").select("entity_type", F.col("id").cast("string").alias("id"), F.col("name").alias("known"), "nth")
    return _one_by_one(asked, recent)


def _one_by_one(asked: DataFrame, recent: DataFrame) -> DataFrame:
    """Homes of requests (entity_type, seq, name, exact) that see each other, after the latest entities (entity_type, id, known, nth).

    A request with an exact home needs no sequence. A name without one does: its type's names go through one task in
    order, as a stream of which the ``RECENT`` latest and the names made are held. Between two of them only each
    entity's last touch matters, and of those the ``RECENT`` last, so no more exact requests go along.
    """
    exact, unknown = asked.where("exact is not null"), asked.where("exact is null")
    done = exact.select("seq", "name", "entity_type", F.col("exact").alias("entity_id"), F.lit("exact").alias("action"), F.lit(None).cast("string").alias("same_as"))
    types = small(unknown.select("entity_type").distinct())
    mixed = asked.join(types, "entity_type", "left_semi").withColumn("unknown", F.col("exact").isNull().cast("long"))
    gaps = running_sums(mixed, "seq", ["unknown"], ["entity_type"]).where("exact is not null")
    last = gaps.groupBy("entity_type", "unknown_before", "exact").agg(F.max(F.struct("seq", "name")).alias("last"))
    touched = top_k(last, [F.desc("last.seq"), F.col("exact")], RECENT, ["entity_type", "unknown_before"], "nth")
    stream = (
        recent.join(types, "entity_type", "left_semi")
        .select("entity_type", F.lit(0).alias("part"), (-F.col("nth")).cast("long").alias("seq"), F.col("known").alias("name"), F.col("id").alias("exact"))
        .unionByName(touched.select("entity_type", F.lit(1).alias("part"), "last.seq", "last.name", "exact"))
        .unionByName(unknown.select("entity_type", F.lit(1).alias("part"), "seq", "name", "exact"))
    )
    in_order = stream.repartition(int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_type").sortWithinPartitions("entity_type", "part", "seq", "name")
    return done.unionByName(in_order.mapInArrow(_resolved, _PLACED))


class _Front:
    """The latest names of one type, newest first, and the names that were made."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.made: dict[str, str] = {}
        self.letters = _Letters()

    def touch(self, place: str, label: str) -> None:
        self.rows = [(place, label), *((i, n) for i, n in self.rows if i != place)]
        self.letters.keep(place, label)
        if len(self.rows) > RECENT:
            self.letters.drop(self.rows.pop()[0])

    def resolve(self, name: str, entity_type: str) -> tuple[str, str, str | None]:
        """(entity_id, action, same_as) of a name without a known home."""
        if name in self.made:
            self.touch(self.made[name], name)
            return self.made[name], "exact", None
        bounds, row = self.letters.bounds(name), self.letters.row
        score, at = closest(name, [(b, i, other) for i, (ident, other) in enumerate(self.rows) if (b := bounds[row[ident]]) >= FLAG_AT], FLAG_AT)
        if score >= MERGE_AT:
            place, label = self.rows[at]
            self.touch(place, label)
            return place, "merge", None
        place = self.made[name] = hashlib.sha256(f"{name}\0{entity_type}".encode()).hexdigest()[:32]
        same_as = self.rows[at][0] if score >= FLAG_AT else None
        self.touch(place, name)
        return place, "new" if same_as is None else "flag", same_as


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PLACED`` for the stream's names without a home; the stream is sorted by type and order."""
    front, now = _Front(), None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "part", "seq", "name", "exact")), strict=True):
            entity_type, _, seq, name, exact = row
            if entity_type != now:
                front, now = _Front(), entity_type
            if exact is not None:
                front.touch(exact, name)
            else:
                out.append((seq, name, entity_type, *front.resolve(name, entity_type)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.int64()] + [pa.string()] * 5)], names=["seq", "name", "entity_type", "entity_id", "action", "same_as"])


def remember_batch(requests: DataFrame, entities: DataFrame, now: int) -> dict[str, DataFrame]:
    """``remember`` with names resolved in the order of the requests' ``seq``."""
    return _written(requests, resolve_batch(requests, entities), now)


def remember(requests: DataFrame, entities: DataFrame, now: int) -> dict[str, DataFrame]:
    """New rows of a batch of requests (name, entity_type, observations, source): entities, observations, relations, rejected."""
    return _written(requests, resolve_requests(requests, entities), now)


def _written(requests: DataFrame, homes: DataFrame, now: int) -> dict[str, DataFrame]:
    placed = requests.where(valid_request()).join(homes, ["name", "entity_type"])
    created = homes.where("action in ('new', 'flag')").select(F.col("entity_id").alias("id"), "name", "entity_type", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    facts = placed.select("entity_id", "source", "name", F.posexplode("observations").alias("pos", "content"))
    observations = facts.select(natural_id(F.col("entity_id"), F.col("content"), F.lit(str(now))).alias("id"), "entity_id", "content", F.lit(now).cast("long").alias("observed_at"), "source", F.concat_ws(": ", "name", "content").alias("indexed")).dropDuplicates(["id"])
    same = homes.where("same_as is not null").select(F.col("entity_id").alias("from_entity"), F.lit("same_as").alias("relation_type"), F.col("same_as").alias("to_entity"))
    return {"entities": created, "observations": observations, "relations": same, "rejected": requests.where(~valid_request())}
