"""The merge cascade and its digest against a plain loop and against tampering."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import merge_plan as mp

OBS, REL = "id string, entity_id string, lifecycle string, content string", "id string, from_entity string, relation_type string, to_entity string, lifecycle string"


def rows_of(seed=1):
    rng = random.Random(seed)

    def side(mark, n):
        entities = [f"{mark}{i}" for i in range(n)]
        seen, relations = set(), []
        for i in range(40):
            rel = (rng.choice(entities), rng.choice(["knows", "near"]), rng.choice(entities), "live")
            if mark == "s" or rel not in seen:
                relations.append((f"{mark}r{i:02}", *rel))
            seen.add(rel)
        observations = [(f"{mark}o{i:02}", rng.choice(entities), rng.choice(["live", "gone", None]), rng.choice(["x", "y", None])) for i in range(60)]
        return [(e,) for e in entities], observations, relations

    return side("t", 8), side("s", 9), [("s0", "t1"), ("s0", "t3"), ("s1", "t1"), ("s2", "t2"), ("s5", "t5")]


@pytest.fixture(scope="module")
def given(spark):
    target, source, same = rows_of()
    frames = [mp.Snapshot(spark.createDataFrame(e, "id string"), spark.createDataFrame(o, OBS).repartition(3), spark.createDataFrame(r, REL)) for e, o, r in (target, source)]
    return (*frames, spark.createDataFrame(same, "source_id string, target_id string"))


def brute(qualified):
    (te, to, tr), (se, so, sr), same = rows_of()
    home = {}
    for s, t in same:
        home[s] = min(t, home.get(s, t))
    results = {e: home.get(e) or qualified[e] for (e,) in se}
    out = [("entity", 0, "keep", e, e) for (e,) in te] + [("entity", 1, "coalesce" if e in home else "add", e, results[e]) for (e,) in se]
    for kind, mine, theirs, key in (
        ("observation", to, so, lambda r, m: (m[r[1]], r[2], r[3])),
        ("relation", tr, sr, lambda r, m: (m[r[1]], r[2], m[r[3]], r[4])),
    ):
        index, same_ids = {}, {e: e for (e,) in te}
        for r in sorted(mine):
            index.setdefault(key(r, same_ids), r[0])
            out.append((kind, 0, "keep", r[0], r[0]))
        for r in sorted(theirs):
            k = key(r, results)
            if kind == "relation" and k[0] == k[2] and r[2] != "near":
                continue
            action = "merge origin" if k in index else "add"
            out.append((kind, 1, action, r[0], index.setdefault(k, qualified[r[0]])))
    return sorted(out)


def test_cascade(spark, given):
    target, source, same = given
    got = mp.cascade(target, source, same, "sp", ("near",))
    ids = [e for (e,) in rows_of()[1][0]] + [r[0] for part in rows_of()[1][1:] for r in part]
    from chronolith.functions.text import qualified_id

    qualified = dict(tuple(r) for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", qualified_id(F.lit("sp"), F.col("id"))).collect())
    assert sorted((r["kind"], r["side"], r["action"], r["id"], r["result_id"]) for r in got.collect()) == brute(qualified)


def test_problems(spark, given):
    target, source, same = given
    found = {tuple(r) for r in mp.cascade_problems(target, source, same, "sp", ("near",)).collect()}
    loops = {p for p in found if p[0] == "self-loop"}
    assert loops and found == loops
    broken = mp.Snapshot(target.entities.where("id <> 't1'"), target.observations, target.relations.unionByName(target.relations.limit(1).withColumn("id", F.lit("again"))))
    more = {r["problem"] for r in mp.cascade_problems(broken, source, same.unionByName(same.limit(1).withColumn("source_id", F.lit("s99"))), "sp").collect()}
    assert {"target is gone", "target observation without entity", "target relation without end", "reviewed source is gone", "self-loop"} <= more


def test_digest_refuses_every_change(spark, given, monkeypatch):
    monkeypatch.setattr(mp, "BUCKET", 2)
    target, source, same = given
    plan = mp.cascade(target, source, same, "sp").cache()
    root = mp.plan_digest(plan).first()
    assert root["rows"] == plan.count() and root["depth"] >= 2
    assert mp.plan_digest(plan.repartition(7)).first() == root
    assert mp.verify_cascade(plan, root["digest"], target, source, same, "sp").count() == 0
    one = plan.where("kind = 'observation' and side = 1").orderBy("id").first()
    mine = (F.col("kind") == one["kind"]) & (F.col("side") == 1) & (F.col("id") == one["id"])
    changes = {
        "changed": plan.withColumn("result_id", F.when(mine, F.lit("elsewhere")).otherwise(F.col("result_id"))),
        "not planned": plan.where(~mine),
        "repeated": plan.unionByName(plan.where(mine)),
        "no longer there": plan.unionByName(plan.where(mine).withColumn("id", F.lit("new"))),
    }
    for problem, wrong in changes.items():
        assert mp.plan_digest(wrong).first()["digest"] != root["digest"]
        assert [r["problem"] for r in mp.verify_cascade(wrong, root["digest"], target, source, same, "sp").collect()] == [problem]
    assert [r["problem"] for r in mp.verify_cascade(plan, "0" * 64, target, source, same, "sp").collect()] == ["another digest"]


def test_empty_plan(spark, given):
    none = mp.Snapshot(*[f.limit(0) for f in given[0]])
    assert mp.cascade(none, none, given[2].limit(0), "sp").count() == 0 == mp.cascade_problems(none, none, given[2].limit(0), "sp").count()
    empty = mp.cascade(none, none, given[2].limit(0), "sp")
    assert mp.verify_cascade(empty, mp.plan_digest(empty).first()["digest"], none, none, given[2].limit(0), "sp").count() == 0
