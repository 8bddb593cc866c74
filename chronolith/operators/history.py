"""Revisions, field diffs and reviewed changesets over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.store import keyset_page

# The fields that a revision holds.
REVISION_FIELDS = ("entity_id", "content", "title", "summary", "concepts", "source_files", "observed_at", "valid_from", "valid_until", "confidence", "source", "source_kind", "importance", "memory_tier", "lifecycle")
MAX_OPERATIONS = 256
MAX_CONTENT_BYTES = 1 << 20


def history(revisions: DataFrame, changesets: DataFrame, observation_id, space: str | None = None, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """One observation's revisions with their changesets, oldest first, paged by (created_at, revision_id)."""
    own = revisions.where(F.col("observation_id") == observation_id)
    who = changesets if space is None else changesets.where(F.col("space_id") == space)
    rows = own.join(who.select(F.col("id").alias("changeset_id"), "actor_kind", "actor_id", "reason"), "changeset_id")
    return keyset_page(rows, ("created_at", "revision_id"), after, limit)


def revision_diff(revisions: DataFrame, pairs: DataFrame, fields: tuple[str, ...] = REVISION_FIELDS) -> DataFrame:
    """(from_revision, to_revision, field, before, after) of the fields that differ, nulls being values.

    Pairs of revisions of different observations are left out.
    """
    present = [f for f in fields if f in revisions.columns]

    def side(name: str, prefix: str) -> DataFrame:
        return revisions.select(F.col("revision_id").alias(name), F.col("observation_id").alias(f"{prefix}_of"), *[F.col(f).cast("string").alias(f"{prefix}_{f}") for f in present])

    both = pairs.join(side("from_revision", "old"), "from_revision").join(side("to_revision", "new"), "to_revision").where("old_of = new_of")
    changes = F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.col(f"new_{f}").alias("after"))) for f in present])
    return both.select("from_revision", "to_revision", F.explode(F.array_compact(changes)).alias("change")).select("from_revision", "to_revision", "change.*")


def check_changesets(operations: DataFrame) -> DataFrame:
    """(changeset_id, problem): changesets beyond the bounds, or with non-finite numbers."""
    sums = operations.groupBy("changeset_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"), F.max((F.isnan("confidence") | (F.abs("confidence") == float("inf"))).cast("int")).alias("odd"))
    problem = F.when(F.col("n") > MAX_OPERATIONS, "too many operations").when(F.col("bytes") > MAX_CONTENT_BYTES, "too much content").when(F.col("odd") == 1, "number not finite")
    return sums.select("changeset_id", problem.alias("problem")).where("problem is not null")


def folded_changesets(events: DataFrame) -> DataFrame:
    """(changeset_id, state, row_version) from the log (changeset_id, row_version, event, actor).

    submit opens, approve and reject close; only the first closing event at the version the
    submitter wrote counts, and a submitter's own approval does not.
    """
    opened = events.where("event = 'submit'").groupBy("changeset_id").agg(F.min_by(F.struct("row_version", "actor"), "row_version").alias("open"))
    closing = events.where("event in ('approve', 'reject')").join(opened, "changeset_id")
    fair = closing.where((F.col("row_version") == F.col("open.row_version")) & (F.col("actor") != F.col("open.actor")))
    done = fair.groupBy("changeset_id").agg(F.min(F.struct("seq", "event")).alias("first"))
    state = F.when(F.col("first.event") == "approve", "applied").when(F.col("first.event") == "reject", "rejected").otherwise("proposed")
    return opened.join(done, "changeset_id", "left").select("changeset_id", state.alias("state"), (F.col("open.row_version") + F.col("first").isNotNull().cast("int")).alias("row_version"))


def apply_changesets(observations: DataFrame, operations: DataFrame, approved: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(observations, outcomes): approved changesets applied whole or not at all.

    ``operations`` are (changeset_id, op, id, expected_version, content), op being create, revise or retire;
    ``approved`` are (changeset_id, seq). A create needs a free id, the others a live row of the expected
    version; of several changesets that touch one row the first by seq claims it and the others conflict. One failing
    operation makes its changeset a conflict. Outcomes are (changeset_id, outcome, failing).
    """
    asked = operations.join(approved.select("changeset_id", "seq"), "changeset_id")
    state = observations.select("id", F.col("row_version").alias("version"), F.col("tombstoned").alias("gone"))
    claim = asked.groupBy("id").agg(F.min("seq").alias("claimed"), F.count("*").alias("n"))
    met = asked.join(claim, "id").join(state, "id", "left")
    live = F.col("version").isNotNull() & ~F.col("gone") & F.col("version").eqNullSafe(F.col("expected_version"))
    fine = F.when(F.col("op") == "create", F.col("version").isNull()).when(F.col("op").isin("revise", "retire"), live).otherwise(F.lit(False))
    checked = met.withColumn("fine", fine & (F.col("seq") == F.col("claimed")))
    outcomes = checked.groupBy("changeset_id").agg(F.count_if(~F.col("fine")).alias("failing"))
    outcomes = outcomes.select("changeset_id", F.when(F.col("failing") == 0, "applied").otherwise("conflict").alias("outcome"), "failing")
    work = asked.join(outcomes.where("outcome = 'applied'").select("changeset_id"), "changeset_id", "left_semi")
    last = work.groupBy("id").agg(F.max_by(F.struct("op", "content"), F.struct("seq", "op")).alias("change"))
    both = observations.join(last, "id", "full_outer")
    op = F.col("change.op")
    changed = {
        "content": F.when(op.isin("create", "revise"), F.col("change.content")).otherwise(F.col("content")),
        "row_version": F.when(op.isNotNull(), F.coalesce("row_version", F.lit(0)) + 1).otherwise(F.col("row_version")),
        "tombstoned": F.coalesce(F.col("tombstoned"), F.lit(False)) | F.coalesce(op == "retire", F.lit(False)),
        "observed_at": F.coalesce("observed_at", F.lit(now).cast("long")),
    }
    return both.withColumns(changed).select(*observations.columns), outcomes


def once_by_key(requests: DataFrame) -> DataFrame:
    """The first of the requests that share an idempotency key; requests without a key all stay."""
    keyed = requests.where("idempotency_key is not null")
    first = keyed.groupBy("idempotency_key").agg(F.min("seq").alias("seq"))
    return requests.where("idempotency_key is null").unionByName(keyed.join(first, ["idempotency_key", "seq"], "left_semi").select(*requests.columns))


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows after a change feed (key, row_version, deleted, ...): the highest version of each key (of equal
    versions the largest row), unless deleted."""
    marked = state.withColumn("deleted", F.lit(False)) if "deleted" not in state.columns else state
    every = marked.unionByName(changes)
    rest = [c for c in marked.columns if c != key]
    last = every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("row_version", *rest)).alias("row")).select(key, "row.*")
    return last.where("not deleted").select(*state.columns)


def without_revision(observations: DataFrame, revisions: DataFrame, limit: int = 1024) -> DataFrame:
    """Observations that the audit log does not know, a bounded batch by id (a backfill step's work list)."""
    return observations.join(revisions.select(F.col("observation_id").alias("id")), "id", "left_anti").orderBy("id").limit(max(1, min(limit, 1024)))


def repair_outbox(outbox: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks after replaying pending index work (uri, generation, op, text): the last operation of each uri holds."""
    last = outbox.groupBy("uri").agg(F.max_by(F.struct("op", "text"), "generation").alias("last")).select("uri", "last.*")
    kept = chunks.join(last.select("uri"), "uri", "left_anti")
    put = last.where("op = 'put'").select("uri", F.lit(0).alias("chunk_index"), "text")
    return kept.unionByName(put, allowMissingColumns=True)


def rejected_with_requests(changesets: DataFrame, requests: DataFrame) -> DataFrame:
    """Rejected proposals that still have a request behind them (what compaction may drop)."""
    return changesets.where("state = 'rejected'").join(requests.select(F.col("changeset_id").alias("id")), "id", "left_semi")
