"""Spaces and who may do what in them; jobs and events.

Spaces are (id, profile, owner_kind, owner_id, state), principals (id, state), teams (id, state), memberships
(team_id, principal_id, role, expires_at). Each is a table; a space's data is a partition of the
engine's tables by space id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.frames import small

LAYERS = 4


def active_spaces(spaces: DataFrame, profile: str, after: str | None = None, limit: int = 256) -> DataFrame:
    """A page of a profile's active spaces by id."""
    rows = spaces.where((F.col("profile") == profile) & (F.col("state") == "active"))
    return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(max(1, min(limit, 256)))


def effective_roles(spaces: DataFrame, principals: DataFrame, teams: DataFrame, memberships: DataFrame, now: int) -> DataFrame:
    """(principal_id, space_id, role): owners maintain their own spaces, members have their team's role.

    Inactive principals and teams and expired memberships give nothing.
    """
    people = principals.where("state = 'active'").select(F.col("id").alias("principal_id"))
    own = spaces.where("owner_kind = 'user'").select(F.col("owner_id").alias("principal_id"), F.col("id").alias("space_id"), F.lit("maintainer").alias("role")).join(people, "principal_id", "left_semi")
    live = memberships.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).join(teams.where("state = 'active'").select(F.col("id").alias("team_id")), "team_id", "left_semi").join(people, "principal_id", "left_semi")
    shared = spaces.where("owner_kind = 'team'").select(F.col("owner_id").alias("team_id"), F.col("id").alias("space_id"))
    return own.unionByName(_shared_roles(live, shared))


#: Roles that a task writes, about; and tasks, beyond which each writes more of them, since the driver keeps figures of every task.
ROLES_A_TASK = 2_000_000
MOST_TASKS = 2_000


def _shared_roles(members: DataFrame, shared: DataFrame) -> DataFrame:
    """Every member's role in every space of the team. Few teams may have most members and spaces, so a large team's members and
    spaces are both cut in pieces of about the root of a task's roles, and each two pieces meet: a row is dealt out once
    for each piece of the other side, and no side is broadcast, however small the planner takes it for."""
    sizes = members.groupBy("team_id").agg(F.count("*").alias("members")).join(shared.groupBy("team_id").agg(F.count("*").alias("spaces")), "team_id")
    roles = sizes.select(F.sum(F.col("members") * F.col("spaces"))).first()[0] or 0
    if roles <= ROLES_A_TASK:
        return members.join(shared, "team_id").select("principal_id", "space_id", "role")
    side, tasks = math.isqrt(ROLES_A_TASK), min(-(-2 * roles // ROLES_A_TASK), MOST_TASKS)
    large = sizes.where(F.col("members") * F.col("spaces") > ROLES_A_TASK)  # no more teams than tasks were asked for
    cut = F.broadcast(large.select("team_id", *[F.ceil(F.col(c) / side).cast("int").alias(c) for c in ("members", "spaces")]))

    def pieces(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        numbered = rows.join(cut, "team_id", "left").fillna(1, ["members", "spaces"]).withColumn(f"{own}_piece", F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
        met = numbered.withColumn(f"{other}_piece", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        # one key, so that the join asks for the same dealing even where the planner knows one of the parts
        return met.withColumn("cell", F.concat("members_piece", F.lit("/"), "spaces_piece", F.lit("/"), "team_id")).repartition(tasks, "cell")

    dealt = pieces(members, "principal_id", "members", "spaces").select("cell", "principal_id", "role")
    return dealt.hint("merge").join(pieces(shared, "space_id", "spaces", "members").select("cell", "space_id"), "cell").select("principal_id", "space_id", "role")


def authority_digest(roles: DataFrame) -> DataFrame:
    """(principal_id, digest): one digest of all that a principal may do; it changes when any role does."""
    marks = F.array_sort(F.collect_set(F.concat_ws("\0", "space_id", "role")))
    return roles.groupBy("principal_id").agg(F.sha2(F.array_join(marks, "\n"), 256).alias("digest"))


def readable(rows: DataFrame, roles: DataFrame, principal: str, spaces: list[str]) -> DataFrame:
    """Rows of the asked spaces that the principal may read; at most ``LAYERS`` spaces are layered."""
    if len(spaces) > LAYERS:
        raise ValueError(f"at most {LAYERS} spaces can be read together")
    allowed = roles.where((F.col("principal_id") == principal) & F.col("space_id").isin(spaces)).select("space_id").distinct()
    return rows.join(small(allowed), "space_id", "left_semi")


def upsert_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest state of each job, by updated_at; created_at is the first one's."""
    rest = [c for c in jobs.columns if c not in ("id", "created_at")]
    every = jobs.unionByName(updates).groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *rest)).alias("row"), F.min("created_at").alias("created_at"))
    return every.select("id", "row.*", "created_at").select(*jobs.columns)


def events_after(events: DataFrame, sequence: int, limit: int) -> DataFrame:
    return events.where(F.col("sequence") > sequence).orderBy("sequence").limit(limit)
