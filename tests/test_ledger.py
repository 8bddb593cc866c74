"""Write paths and corrected readings, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions.names import similarity
from chronolith.functions.scores import ranked_score
from chronolith.functions.text import answer_leaks, folded_tokens
from chronolith.operators import graph, history, lifecycle, recall, remember, retrieve, search, store
from chronolith.sources import kept_index, watch


def test_neighbours_are_one_list(spark):
    """Six neighbours in all, not of each seed; part_of last; first seen counts; shown seeds use up places."""
    seeds = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, entity_id string")
    links = [("a", f"x{i}", "uses", 1.0 - i / 10) for i in range(4)] + [("a", "b", "uses", 0.1), ("a", "top", "part_of", 1.0), ("b", "y", "uses", 0.5), ("b", "x1", "part_of", 0.5), ("z", "b", "uses", 0.4)]
    rows = spark.createDataFrame([(*r, None) for r in links], "from_entity string, to_entity string, relation_type string, weight double, valid_until long")
    got = [r["entity_id"] for r in graph.traverse(seeds, rows, 0).orderBy("place").collect()]
    assert got == ["a", "b", "x0", "x1", "x2", "x3", "y"]  # b fills the fifth place
    assert [r["entity_id"] for r in graph.traverse(seeds, rows, 0, neighbours=9).orderBy("place").collect()] == ["a", "b", "x0", "x1", "x2", "x3", "y", "z", "top"]


def test_leaks_look_at_the_last_path_part(spark):
    rows = [("open notes.md now", "a/notes.md#3", True), ("open 3", "a/notes.md#3", False), ("the abc", "x/abc", False), ("see mod:thing", "crate/mod:thing", True), ("see thing", "crate/mod:thing", False), ("X FILE", "d/ file #9#x", True)]
    got = spark.createDataFrame(rows, "q string, k string, want boolean").select("want", answer_leaks(F.col("q"), F.col("k")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_infinite_importance_counts_nothing(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("nan"),), (float("-inf"),), (None,), (2.0,), (-1.0,)], "i double")
    got = [r[0] for r in rows.select(ranked_score(F.lit(1.0), F.lit(0), F.lit(1.0), F.col("i"), 0, 0.0)).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.25, 1.0]


def test_as_of_ages_and_spreads_at_that_instant(spark):
    day = 86_400
    obs = spark.createDataFrame([(1, "a", 0, None, None, 1.0, "s", False, "semantic", None), (2, "b", 0, None, 5 * day, 1.0, "s", False, "semantic", None)], "id long, entity_id string, observed_at long, valid_from long, valid_until long, confidence double, source string, tombstoned boolean, memory_tier string, importance double")
    ents = spark.createDataFrame([("a", "A", "person"), ("b", "B", "person")], "id string, name string, entity_type string")
    rels = spark.createDataFrame([("a", "b", 1.0, 3 * day)], "from_entity string, to_entity string, weight double, valid_until long")
    hits = spark.createDataFrame([(7, 1, 1.0)], "query_id int, id long, raw double")
    past = recall.Filters(as_of=2 * day)
    direct = recall.recall(hits, obs, ents, 5, 100 * day, past, 0.1)
    assert [round(r["score"], 6) for r in direct.collect()] == [round(2.718281828459045 ** -0.2, 6)]
    assert [r["id"] for r in recall.spread(direct, rels, obs, ents, 5, 100 * day, past, 0.1).collect()] == [2]
    assert recall.spread(recall.recall(hits, obs, ents, 5, 100 * day), rels, obs, ents, 5, 100 * day).count() == 0


def test_requests_with_nulls_shared_names_and_stubs(spark):
    ents = spark.createDataFrame([("e2", "Ann", "person", 9, 9, "crm"), ("e1", "Ann", "person", 5, 5, "crm"), ("s", "Annabel Poe", "person", 1, 1, "partition:stub")], "id string, name string, entity_type string, created_at long, updated_at long, source string")
    asked = spark.createDataFrame([("Ann", "person", ["likes tea"], "x"), (None, "person", ["lost"], "x"), ("Bo", None, ["lost"], "x"), ("Cy", "person", [None], "x"), ("Annabel Po", "person", ["new"], "x"), ("Di", "person", None, "x")], "name string, entity_type string, observations array<string>, source string")
    out = remember.remember(asked, ents, 100)
    assert sorted((r["entity_id"] == "e1", r["content"]) for r in out["observations"].collect()) == [(False, "new"), (True, "likes tea")]
    assert out["rejected"].count() == 3 and sorted(r["name"] for r in out["entities"].collect()) == ["Annabel Po", "Di"] and out["relations"].count() == 0


def test_batches_resolve_in_order(spark):
    known = [("k1", "Alexander Smith", "person", 5), ("k2", "Zoe", "person", 9)]
    names = ["Alexander Smithe", "Maria Gonzalez", "Maria Gonzales", "Gonzalez Maria", "Zoe", "Alexander Smith", "maria gonzalez"]
    asked = spark.createDataFrame([(i, n, "person", ["x"], "s") for i, n in enumerate(names)], "seq long, name string, entity_type string, observations array<string>, source string")
    got = {r["name"]: r for r in remember.resolve_batch(asked, spark.createDataFrame(known, "id string, name string, entity_type string, updated_at long")).collect()}
    front, want = [("k2", "Zoe"), ("k1", "Alexander Smith")], {}
    exact = {"Zoe": "k2", "Alexander Smith": "k1"}
    for n in names:
        best = max(front, key=lambda x, n=n: similarity(n, x[1]))
        score = similarity(n, best[1])
        action = "exact" if n in exact else "merge" if score >= 0.95 else "flag" if score >= 0.85 else "new"
        place = exact.get(n) or (best[0] if action == "merge" else n)
        want[n] = (action, place, best[0] if action == "flag" else None)
        front = [(place, next((b for a, b in front if a == place), n)), *[x for x in front if x[0] != place]]
    ids = {got[n]["entity_id"]: n for n in names if want[n][0] in ("new", "flag")}
    assert {n: (r["action"], ids.get(r["entity_id"], r["entity_id"]), ids.get(r["same_as"], r["same_as"])) for n, r in got.items()} == want
    assert want["Gonzalez Maria"][0] == "merge" and want["Maria Gonzales"][0] == "flag"


def test_changesets_apply_whole_or_not(spark):
    obs = spark.createDataFrame([(1, "a", 1, False, 5), (2, "b", 3, False, 5), (3, "c", 1, True, 5)], "id long, content string, row_version int, tombstoned boolean, observed_at long")
    ops = [(10, "revise", 1, 1, "a2"), (10, "create", 9, None, "n"), (20, "retire", 2, 2, None), (30, "revise", 1, 1, "late"), (40, "revise", 3, 1, "dead"), (50, "create", 2, None, "taken"), (60, "burn", 2, 3, None), (70, "retire", 2, 3, None)]
    operations = spark.createDataFrame(ops, "changeset_id int, op string, id long, expected_version int, content string")
    approved = spark.createDataFrame([(c, c) for c in (10, 20, 30, 40, 50)], "changeset_id int, seq int")
    rows, outcomes = history.apply_changesets(obs, operations, approved, 77)
    assert {r["changeset_id"]: r["outcome"] for r in outcomes.collect()} == {10: "applied", 20: "conflict", 30: "conflict", 40: "conflict", 50: "conflict"}
    assert sorted(map(tuple, rows.collect())) == [(1, "a2", 2, False, 5), (2, "b", 3, False, 5), (3, "c", 1, True, 5), (9, "n", 1, False, 77)]


def test_equal_observations_make_no_pairs(spark):
    rows = [(i, "e", i, "the same words here", False) for i in range(400)] + [(500 + i, "e", 500 + i, "", False) for i in range(50)] + [(900, "e", 900, "the same words there", False)]
    obs = spark.createDataFrame(rows, "id long, entity_id string, observed_at long, content string, tombstoned boolean")
    assert [(r["a"], r["b"]) for r in lifecycle.similar_pairs(obs, 0.6).collect()] == [(900, 399)]
    gone = {r["loser"]: r["survivor"] for r in lifecycle.duplicates(obs, 0.6).collect()}
    assert gone == {**dict.fromkeys(range(400), 900), **{500 + i: 549 for i in range(49)}}


def test_names_resolve_exactly_with_candidates(spark):
    ents = spark.createDataFrame([(f"e{i}", "Sam", 100 - i) for i in range(5)] + [("x", "sam", 1)], "id string, name string, created_at long")
    got = {r["name"]: r for r in store.resolve(ents, spark.createDataFrame([("Sam",), ("sam",), ("SAM",)], "name string"), most=3).collect()}
    assert (got["Sam"]["outcome"], got["Sam"]["id"], got["Sam"]["candidates"], got["Sam"]["truncated"]) == ("ambiguous", "e4", ["e4", "e3", "e2"], True)
    assert (got["sam"]["outcome"], got["sam"]["candidates"]) == ("unique", ["x"]) and (got["SAM"]["outcome"], got["SAM"]["id"], got["SAM"]["candidates"]) == ("not_found", None, [])


def test_kept_index_equals_texts(spark, tmp_path):
    def chunks(rows):
        return spark.createDataFrame(rows, "uri string, chunk_index int, text string")

    folder = str(tmp_path / "index")
    kept_index.add(chunks([("a", 0, "red fox"), ("b", 0, "blue fox fox"), ("c", 0, "red bird")]), folder, 1)
    kept_index.add(chunks([("b", 0, "green fox"), ("d", 0, "fox and hound")]), folder, 2)
    kept_index.add(chunks([("b", 0, "green fox"), ("d", 0, "fox and hound")]), folder, 2)  # a retried batch
    asked = spark.createDataFrame([(1, "red fox"), (2, "green hound")], "query_id int, text string")

    def same(live):
        posted, stats = kept_index.read(spark, folder)
        return sorted(search.keyword_topk(posted, stats, asked, 5).collect()) == sorted(search.text_topk(chunks(live), asked, 5).collect())

    live = [("a", 0, "red fox"), ("b", 0, "green fox"), ("c", 0, "red bird"), ("d", 0, "fox and hound")]
    assert same(live)
    kept_index.remove(chunks([("b", 0, ""), ("a", 0, "")]), folder, 2)
    assert same(live[2:])
    kept_index.add(chunks([("a", 0, "red again")]), folder, 3)
    assert same([("a", 0, "red again"), *live[2:]])
    kept_index.compact(spark, folder, str(tmp_path / "small"))
    assert kept_index.read(spark, str(tmp_path / "small"))[0].count() == kept_index.read(spark, folder)[0].count()


def test_text_search_in_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([("a", 0, "red fox"), ("b", 0, "blue fox fox"), ("c", 0, None), ("d", 0, "")], "uri string, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "fox"), (3, ""), (4, "absent")], "query_id int, text string")
    whole = sorted(map(tuple, search.text_topk(docs, asked, 1).collect()))
    assert [(r[0], r[1]) for r in whole] == [(1, "a"), (2, "b")]
    monkeypatch.setattr(search, "HELD_TERMS", 1)
    assert sorted((r["query_id"], r["uri"], r["chunk_index"], r["score"], r["rank"]) for r in search.text_topk(docs, asked, 1).collect()) == whole
    assert search.text_topk(docs.where("false"), asked, 1).count() == 0


def test_bursts_and_renames(spark):
    events = [("a", "create", 0, None), ("a", "modify", 100, None), ("a", "modify", 400, None), ("b", "create", 0, None), ("b", "rename", 50, "c"), ("d", "remove", 10, None), ("d", "create", 10, None), ("e", "create", 5, None), ("e", "remove", 900, None), ("f", "touch", 1, None)]
    rows = spark.createDataFrame(events, "path string, kind string, at long, to string")
    assert sorted(map(tuple, watch.settled_events(rows).collect())) == [("a", "modify", 100), ("a", "modify", 400), ("b", "remove", 50), ("c", "create", 50), ("d", "create", 10), ("e", "create", 5), ("e", "remove", 900)]
    assert {r["path"]: r["action"] for r in watch.pending(rows).collect()} == {"a": "index", "b": "drop", "c": "index", "d": "index", "e": "drop"}


def test_recall_refuses_a_stale_index(spark):
    outbox = spark.createDataFrame([("u", 4)], "uri string, generation long")
    recall.require_repaired(outbox, 4)
    with pytest.raises(RuntimeError, match="repair"):
        recall.require_repaired(outbox, 3)


def test_limits_are_clamped():
    assert [search.clamped(x) for x in (None, 0, -3, 7, 500)] == [10, 1, 1, 7, 50] and search.clamped(999, 256, 50) == 256


def test_retrieval_takes_the_arm_that_the_question_names(spark, monkeypatch):
    chunks = spark.createDataFrame([("doc://1", 0, "parser notes", [1.0, 0.0]), ("doc://2", 0, "parser tests", [0.9, 0.1]), ("doc://3", 0, "bread", [0.0, 1.0])], "uri string, chunk_index int, text string, vector array<float>")
    obs = spark.createDataFrame([(1, "p", "the parser is slow", 0), (2, "q", "parser is fast now", 0), (3, "r", "bread is good", 0)], "id long, entity_id string, content string, observed_at long").selectExpr("*", "cast(null as bigint) valid_from", "cast(null as bigint) valid_until", "1.0d confidence", "'s' source", "false tombstoned", "'semantic' memory_tier", "cast(null as double) importance")
    ents = spark.createDataFrame([(i, i.upper(), "project") for i in "pqrz"], "id string, name string, entity_type string")
    rels = spark.createDataFrame([("p", "z", "uses", 1.0, None)], "from_entity string, to_entity string, relation_type string, weight double, valid_until long")
    links = spark.createDataFrame([(2, 1)], "newer long, older long")
    asked = spark.createDataFrame([(1, "parser", [1.0, 0.0]), (2, "what does parser use", [1.0, 0.0]), (3, "find my_parser parser", None)], "query_id long, text string, vector array<float>")
    monkeypatch.setattr(graph, "ENGAGE_AT", 3)
    got = {}
    for r in retrieve.retrieve(asked, chunks, obs, ents, rels, links, 6, 100).orderBy("query_id", "place").collect():
        got.setdefault((r["query_id"], r["intent"], r["low"]), []).append(r["item"])
    assert got[1, "content", False][:2] == ["doc://1", "doc://2"] and set(got[1, "content", False][-2:]) == {"entity://p", "entity://q"}
    assert got[2, "relational", False][:3] == ["entity://q", "entity://p", "entity://z"] and got[2, "relational", False][3] == "doc://1"
    assert got[3, "lookup", None][:2] == ["entity://q", "entity://p"] and set(got[3, "lookup", None][2:]) == {"doc://1", "doc://2"}
    monkeypatch.setattr(graph, "ENGAGE_AT", 4)
    assert not [r for r in retrieve.retrieve(asked, chunks, obs, ents, rels, links, 6, 100).collect() if r["item"].startswith("entity")]


def test_accents_fold_by_rule(spark):
    rows = spark.createDataFrame([("Ångström ŽIŽEK Đukić ſ ệ naïve cafe\u0301 ά ё",)], "t string")
    assert rows.select(folded_tokens(F.col("t"))).first()[0] == ["angstrom", "zizek", "đukic", "ſ", "naive", "cafe", "α", "е"]


def test_names_without_a_home_see_what_came_before_them(spark):
    """Exact requests are left out of the sequence but for what the next name without a home can see; against the plain loop."""
    words = ("Smith", "Jones", "Miller", "Adams", "Baker", "Clark", "Davis")
    known = [(f"{t}{i}", f"Person {i * 37:04d} {words[i % 7]}", t, i, i) for t in ("a", "b") for i in range(130)]
    asked = []
    for n in range(1, 600):
        _, name, kind, _, _ = known[n * 53 % 260]
        if n % 11 == 0:
            name = name.replace(" ", "" if n % 2 else "  ") + "x" * (n % 4)
        asked.append((n, name, kind))
    got = remember.resolve_in_order(
        spark.createDataFrame([(*r, ["x"]) for r in asked], "seq long, name string, entity_type string, observations array<string>"),
        spark.createDataFrame(known, "id string, name string, entity_type string, created long, touched long"),
    )
    want = []
    for kind in ("a", "b"):
        front = [(i, n) for i, n, t, _, at in sorted(known, key=lambda r: -r[4]) if t == kind][:100]
        exact = {n: i for i, n, t, _, _ in known if t == kind}
        for seq, name, _ in (r for r in asked if r[2] == kind):
            place, label, action, same = exact.get(name), name, "exact", None
            if place is None:
                score, at = max((similarity(name, n), -i) for i, (_, n) in enumerate(front))
                action = "merge" if score >= 0.95 else "flag" if score >= 0.85 else "new"
                place, label, same = (*front[-at], None) if action == "merge" else (name, name, front[-at][0] if action == "flag" else None)
                if action != "merge":
                    exact[name] = name
            front = [(place, label), *[x for x in front if x[0] != place]][:100]
            want.append((seq, name, action, place, same))
    rows = {r["seq"]: r for r in got.collect()}
    made = {rows[s]["entity_id"]: n for s, n, a, *_ in want if a in ("new", "flag")}
    assert {a for *_, a, _, _ in want} == {"exact", "merge", "flag", "new"}
    assert [(s, rows[s]["name"], rows[s]["action"], made.get(rows[s]["entity_id"], rows[s]["entity_id"]), made.get(rows[s]["same_as"], rows[s]["same_as"])) for s, *_ in sorted(want)] == sorted(want, key=lambda r: r[0])


def test_a_batch_is_no_group_in_memory(spark):
    """Requests with exact homes do not go through Python, and names without one are a stream."""
    known = spark.createDataFrame([("k", "Ann", "person", 1, 1)], "id string, name string, entity_type string, created long, touched long")
    asked = spark.createDataFrame([(1, "Ann", "person", ["x"]), (2, "Bo", "person", ["x"])], "seq long, name string, entity_type string, observations array<string>")
    plan = remember.resolve_in_order(asked, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan


def test_closest_is_the_best_of_all():
    from chronolith.functions.names import closest

    names = [f"Customer{'# '[i % 2]}{i * 7919 % 3000:06d}" for i in range(300)] + ["", "--", "Customer"]
    for name in names[::7]:
        best = max((s, -i) for i, n in enumerate(names) if n != name and (s := similarity(name, n)) >= 0.85 or i == 0 and (s := 0.0) == 0.0)
        assert closest(name, [(1.0, i, n) for i, n in enumerate(names) if n != name], 0.85) == (best[0], -best[1])
