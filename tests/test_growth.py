"""What a query holds, deals out or compares must not grow faster than its input."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.operators import maintenance, merge, phrases, search, spaces, vector_index
from chronolith.plans import ledger_queries, memory_queries, queries  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_that_share_a_url_are_looked_up_each(spark, tmp_path):
    duckdb.sql("select i::bigint as page_id, 'http://a/' || i // 2 as url, 'x' as html from range(12) r(i)").write_parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet'")
    want = duckdb.sql(f"select uri, found, chunk_count from ({queries.ORACLE_SQL['source_lookup']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in queries.QUERIES["source_lookup"](spark, str(tmp_path)).collect())


def test_places_are_gathered_within_a_document(spark):
    docs = spark.createDataFrame([(1, "b a, b-a b"), (2, ""), (3, None), (4, "é")], "doc_id long, text string")
    found = phrases.positions(docs, ("doc_id",))
    assert "Exchange" not in plan(found) and "Aggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 5.0, [1, 3]), ("b", 1, 5.0, [0, 2, 4]), ("é", 4, 1.0, [0])]


def test_terms_are_counted_within_a_document(spark):
    docs = spark.createDataFrame([(1, "bb aa, bb-aa bb c"), (2, ""), (3, None), (4, "é")], "doc_id long, text string")
    found = search.postings(docs, key=("doc_id",))
    assert "Exchange" not in plan(found) and "Aggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("aa", 1, 5.0, 2.0), ("bb", 1, 5.0, 3.0), ("é", 4, 1.0, 1.0)]


def test_a_large_team_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spaces, "ROLES_A_TASK", 500)
    sp = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("team").alias("owner_kind"), F.lit("t").alias("owner_id"))
    people = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("active").alias("state"))
    members = people.select(F.lit("t").alias("team_id"), F.col("id").alias("principal_id"), F.lit("reader").alias("role"), F.lit(None).cast("long").alias("expires_at"))
    roles = spaces.effective_roles(sp, people, spark.createDataFrame([("t", "active")], "id string, state string"), members, 1)
    sizes = roles.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert roles.distinct().count() == roles.count() == 5000 and max(r["count"] for r in sizes) <= 2500


def test_spaces_are_not_broadcast_once_for_each_piece(spark, monkeypatch):
    """A large team's spaces and members meet piece by piece; a small team's rows are dealt once."""
    monkeypatch.setattr(spaces, "ROLES_A_TASK", 100)
    monkeypatch.setattr(spaces, "MOST_TASKS", 7)
    team = F.when(F.col("id") < 90, "t").otherwise("u").alias("team_id")
    members = spark.range(100).select(team, F.concat(F.lit("p"), "id").alias("principal_id"), F.lit("reader").alias("role"))
    shared = spark.range(60, 95).select(team, F.concat(F.lit("s"), "id").alias("space_id"))
    met = spaces._shared_roles(members, shared)
    joins = [line for line in plan(met).split("\n") if "cell" in line and "Join" in line]
    assert met.rdd.getNumPartitions() <= 7 and joins and all("SortMergeJoin" in line for line in joins)
    assert met.distinct().count() == met.count() == 90 * 30 + 10 * 5


def test_alike_records_meet_as_classes(spark):
    def rows(side, n):
        return [(side * 1000 + i, f"Name {i % 3}", "k" if i % 7 else None, [f"name {i % 4}"], f"L{i % 5}" if i % 2 else None, [("crm", f"v{i % 3}", i % 4 == 0)]) for i in range(n)]

    schema = "id long, label string, kind string, aliases array<string>, lineage string, identifiers array<struct<namespace string, value string, verified boolean>>"
    target, source = rows(0, 60), rows(1, 40)

    def keys(r, wants):
        out = {(0, "", r[4])} if r[4] else set()
        out |= {(1, s, v) for s, v, ok in r[5] if ok} | {(2, r[2], r[1].lower())} | {(3, r[2], a.lower()) for a in r[3]}
        return out if wants else out | {(3, r[2], r[1].lower())}

    want = []
    for s in source:
        met = sorted((sorted({k[0] for k in keys(s, True) & keys(t, False)}), t[0]) for t in target if keys(s, True) & keys(t, False))
        met.sort(key=lambda m: (m[0][0], m[1]))
        want += [(s[0], i, t, ",".join(merge.SIGNALS[c] for c in codes), codes[0], len(met), len(met) > 4) for i, (codes, t) in enumerate(met[:4], 1)]
    got = merge.identity_candidates(spark.createDataFrame(target, schema), spark.createDataFrame(source, schema), 4)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[4] for w in want} >= {0, 1, 2}
    sets = spark.createDataFrame([(i, i % 3) for i in range(90)], "id long, k long")
    ids, classes = merge._classes(sets, "id", "c")
    assert ids.count() == 90 and classes.count() == 3


@pytest.mark.parametrize("name, results", [("maintained_retention", ["retention"]), ("maintained_orphans", ["facts"])])
def test_a_tick_stores_what_is_read(spark, tables, tmp_path, monkeypatch, name, results):
    monkeypatch.setattr(ledger_queries, "shared_folder", lambda _: str(tmp_path))
    queries.QUERIES[name](spark, tables).count()
    assert sorted(os.listdir(tmp_path)) == sorted(["ledger", "touched", *results])


def test_matches_are_worked_out_a_few_rows_at_a_time(spark, monkeypatch):
    """Expanded (row, term, query) entries of a piece are bounded; the scores do not depend on it."""
    import numpy as np

    sizes = np.array([3, 9, 2, 2, 0, 7])
    assert list(search._cuts(sizes, 5)) == [(0, 1), (1, 2), (2, 5), (5, 6)] and list(search._cuts(sizes[:0], 5)) == []
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 7}x" for j in range(i, i * 3 % 17 + i + 2)), 1.0 if i % 3 else None) for i in range(60)], "doc_id long, text string, f double").coalesce(1)
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")

    def rows():
        return sorted(map(tuple, search.top_k(search.best_matches(docs, asked, 5, ("doc_id",), boost="f"), [F.desc("score"), F.col("doc_id")], 5, ["query_id"]).collect()))

    whole, held = rows(), search._Counts.cells
    assert whole and all(r[1] % 3 for r in whole)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"words_0": [["a", "b", "a"], [], ["b"]] * 50})
    counts = search._Counts(__import__("pyarrow").array(["a", "b"]), ["text"], [1.0])
    full = [x.tolist() for x in held(counts, batch)]
    monkeypatch.setattr(search, "HELD_WORDS", 4)
    assert [x.tolist() for x in held(counts, batch)] == full


def test_codes_rule_nothing_out_that_may_be_among_the_best(spark, tmp_path):
    """Vectors closer to each other than codes can tell, and more copies than candidates."""
    near = [(i, [1.0, 0.5 + (i * 37 % 400) * 1e-5, 0.2]) for i in range(400)]
    far = [(1000 + i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3) - 1.5]) for i in range(100)]
    rows = spark.createDataFrame(near + far + [(2000 + i, [0.0, 1.0, 0.0]) for i in range(60)], "vec_id long, vector array<double>")
    asked = rows.where("vec_id in (0, 100, 2059)").select(F.col("vec_id").alias("query_id"), "vector")
    index = vector_index.build(rows, str(tmp_path), ("vec_id",), cells=4)
    got = vector_index.index_topk(index, asked, 10, probes=4, rerank=1)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(map(tuple, search.vector_topk(rows, asked, 10, ("vec_id",)).select("query_id", "rank", "vec_id", "score").collect()))


def test_texts_are_not_dealt_out_to_meet_vectors(spark, tables, monkeypatch):
    """Both fused searches scan the texts themselves, not a join with vectors, also where vectors are too many for a broadcast."""
    scans, block = [], search._block_matches
    monkeypatch.setattr(search, "_block_matches", lambda words, *rest: (scans.append(plan(words)), block(words, *rest))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("hybrid_rrf", "search_prefix"):
            queries.QUERIES[name](spark, tables)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(scans) == 2 and not any("Exchange" in s for s in scans)


def test_a_task_passes_on_its_best_rows_only(spark, monkeypatch):
    """Each row is better than the one before, so each batch's best were passed on; words that many share as dense matrices or not."""
    docs = spark.createDataFrame([(i, "aa bb " + "aa " * i + ("cc" if i % 9 else "dd")) for i in range(300)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "aa cc"), (2, "dd bb bb"), (3, "zz")], "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = []
        for share in (0.005, 0.0, 2.0):
            monkeypatch.setattr(search, "DENSE_SHARE", share)
            found.append(sorted((r["query_id"], r["doc_id"], r["score"]) for r in search.best_matches(docs, asked, 5, ("doc_id",)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = sorted((r["query_id"], r["doc_id"], r["score"]) for r in search.keyword_topk(search.postings(docs, key=("doc_id",)), search.document_stats(docs), asked, 5, ("doc_id",)).collect())
    assert found[0] == found[1] == found[2] and len(found[0]) <= 12 and set(best) <= set(found[0])
