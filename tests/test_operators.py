"""Hand values and properties of the core's operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import names
from chronolith.functions.scores import ranked_score, retention_score
from chronolith.functions.time import valid_at
from chronolith.operators.frames import running_sums
from chronolith.operators import evaluation, graph, history, lifecycle, merge, recall, remember, search, store


def test_fusion_hand_values(spark):
    both = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, uri string, rank int")
    one = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "query_id int, uri string, rank int")
    got = {r["uri"]: r["score"] for r in search.rrf_fuse(both, one, 5, alpha=0.5, rrf_k=60.0, key=("uri",)).collect()}
    assert got == {"x": 1.0, "y": round(0.5 / 62 * 61, 6), "z": round(0.5 / 62 * 61, 6)}


def test_tokens_by_bytes(spark):
    row = spark.createDataFrame([("É a bc, d-ef x1",)], "t string").select(search.tokens(F.col("t")).alias("w")).first()
    assert row["w"] == ["é", "bc", "ef", "x1"]


def test_bm25_formula_and_repeats(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None)], "doc_id int, text string")
    posted = search.postings(docs, key=("doc_id",))
    asked = spark.createDataFrame([(7, "red red")], "query_id int, text string")
    got = search.keyword_topk(posted, search.corpus_stats(posted, ("doc_id",)), asked, 5, ("doc_id",)).collect()
    idf, tf, dl, avg = math.log((2 - 1 + 0.5) / 1.5 + 1), 2, 3, 2.5
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, round(2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), 6))]


def test_hybrid_without_vectors_is_keyword(spark):
    docs = spark.createDataFrame([("a", 0, "red fox", None), ("b", 0, "blue", [1.0, 0.0])], "uri string, chunk_index int, text string, vector array<float>")
    posted = search.postings(docs)
    asked = spark.createDataFrame([(1, "fox")], "query_id int, text string")
    assert [r["uri"] for r in search.hybrid_search(docs, posted, search.corpus_stats(posted), asked, 3).collect()] == ["a"]
    vector = spark.createDataFrame([(1, "fox", [0.0, 0.0])], "query_id int, text string, vector array<float>")
    assert [r["score"] for r in search.vector_topk(docs, vector, 3).collect()] == [0.0]


def test_validity_is_half_open(spark):
    rows = spark.createDataFrame([(1, 10, None, 20, False), (2, 10, 15, None, False), (3, 10, None, None, True)], "id int, observed_at long, valid_from long, valid_until long, tombstoned boolean")
    at = lambda t: {r["id"] for r in rows.where(valid_at(t)).collect()}
    assert (at(9), at(10), at(15), at(20)) == (set(), {1}, {1, 2}, {2})


def test_scores_clamp(spark):
    row = spark.range(1).select(
        ranked_score(F.lit(1.0), F.lit(200), F.lit(2.0), F.lit(float("nan")), 100, 0.5).alias("future"),
        ranked_score(F.lit(1.0), F.lit(0), F.lit(0.5), F.lit(3.0), 86400, 0.5).alias("aged"),
    ).first()
    assert row["future"] == 1.0 and row["aged"] == pytest.approx(math.exp(-0.5) * 0.5 * 1.25)
    kept = spark.createDataFrame([(0, 3, 1.0, "correction")], "observed_at long, access_count long, confidence double, source string").select(retention_score(0, 0.01).alias("r")).first()
    assert kept["r"] == pytest.approx((1 + 0.15 * math.log(4)) * 1.3)


def test_greedy_leaders_are_not_transitive(spark):
    rows = [(1, "e", "a b c d", 3, False, 0), (2, "e", "a b c x", 2, False, 0), (3, "e", "a b x y", 1, False, 0)]
    obs = spark.createDataFrame(rows, "id long, entity_id string, content string, observed_at long, tombstoned boolean, access_count long")
    got = {(r["survivor"], r["loser"]) for r in lifecycle.duplicates(obs, 0.6).collect()}
    assert got == {(1, 2)}  # 3 is like 2, which is gone


def test_jaccard_prefix_filter_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, f"e{i % 3}", " ".join(rng.choices("abcdefg", k=rng.randint(0, 6))), i, False) for i in range(60)]
    obs = spark.createDataFrame(rows, "id long, entity_id string, content string, observed_at long, tombstoned boolean")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = set()
        for i, e, c, *_ in rows:
            for j, f, d, *_ in rows:
                a, b = set(c.split()), set(d.split())
                if e == f and i > j and (1.0 if not a and not b else len(a & b) / len(a | b)) >= t:
                    want.add((i, j))
        # pairs of classes and their members together hold every pair, copies included
        members = {}
        for r in lifecycle.word_classes(obs).collect():
            members.setdefault(r["leader"], []).append(r["id"])
        near = [(r["a"], r["b"]) for r in lifecycle.similar_pairs(obs, t).collect()]
        got = {(max(x, y), min(x, y)) for a, b in near for x in members[a] for y in members[b]}
        got |= {(x, y) for own in members.values() for x in own for y in own if x > y}
        assert got == want and all(a == max(members[a]) and b == max(members[b]) for a, b in near)


def test_name_similarity_golden():
    assert names.similarity("Ada Lovelace", "lovelace, ada".replace(",", "")) == 1.0
    assert names.similarity("O'Neil", "oneil") == 1.0
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.similarity("Topic1", "Topic10") < 0.95
    assert names.similarity("", "abc") == 0.0
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcÉ -1", k=rng.randint(0, 8))) for _ in range(2))
        assert 0 <= names.similarity(a, b) <= 1 and names.similarity(a, b) == pytest.approx(names.similarity(b, a))


def test_remember_merges_flags_and_creates(spark):
    known = spark.createDataFrame([("k1", "Ada Lovelace", "person", 5)], "id string, name string, entity_type string, updated_at long")
    asked = spark.createDataFrame([("ada  lovelace.", "person", ["x"], "s"), ("Ada Lovelaces", "person", ["y"], "s"), ("Zed", "person", [], "s"), ("", "person", [], "s"), ("Ada Lovelace", "person", ["z"], "s")], "name string, entity_type string, observations array<string>, source string")
    out = remember.remember(asked, known, 9)
    homes = {r["name"]: (r["action"], r["same_as"]) for r in remember.resolve_requests(asked, known).collect()}
    assert homes["ada  lovelace."] == ("merge", None) and homes["Ada Lovelace"] == ("exact", None) and homes["Zed"] == ("new", None)
    assert homes["Ada Lovelaces"][0] in ("flag", "merge")
    assert out["rejected"].count() == 1 and out["observations"].count() == 3
    again = remember.remember(asked, known, 9)
    assert {r["id"] for r in again["observations"].collect()} == {r["id"] for r in out["observations"].collect()}


def test_chain_stops_at_cycles(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "newer int, older int")
    got = graph.supersession_chain(links, spark.createDataFrame([(1,)], "id int")).orderBy("hop").collect()
    assert [r["id"] for r in got] == [1, 2, 3]


def test_metrics_by_brute_force(spark):
    ranked = spark.createDataFrame([(1, r, k, 0.0) for r, k in enumerate("abac", 1)] + [(2, 1, "z", 0.0)], "query_id int, rank int, key string, score double")
    judged = spark.createDataFrame([(1, "c", 3), (1, "b", 1), (1, "b", 1), (1, "q", 2), (2, "y", 1)], "query_id int, key string, relevance int")
    got = {r["query_id"]: r for r in evaluation.score_queries(ranked, judged, 3).collect()}
    one = got[1]  # closed up: a b c
    dcg, ideal = 1 / math.log2(3) + 7 / math.log2(4), 7 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert (one["recall"], one["capacity_recall"], one["mrr"], one["ndcg"]) == (0.75, round(2 / 3, 6), 0.5, round(dcg / ideal, 6))
    assert (got[2]["recall"], got[2]["mrr"], got[2]["ndcg"]) == (0.0, 0.0, 0.0)


def test_auc_counts_ties_half(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, float(rng.randint(0, 6))) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluation.auc(spark.createDataFrame(rows, "label boolean, score double")).first()["auc"]
    assert got == pytest.approx(want, abs=1e-6)


def test_gates_and_bootstrap():
    assert evaluation.evaluate_gates({"mrr": 0.5, "p95": 9.0}, {"mrr": ("min", 0.4), "p95": ("max", 8.0), "ndcg": ("min", 0.1)}) == {"mrr": "pass", "p95": "fail", "ndcg": "indeterminate"}
    low, high = evaluation.bootstrap_interval([0.0, 1.0, 1.0, 0.0, 1.0])
    assert 0 <= low < 0.6 < high <= 1 and evaluation.bootstrap_interval([0.0, 1.0, 1.0, 0.0, 1.0]) == (low, high)
    assert evaluation.query_set_digest([(1, "a"), (2, "b")]) == evaluation.query_set_digest([(2, "b"), (1, "a")]) != evaluation.query_set_digest([(1, "ab"), (2, "")])


def test_three_way_with_nulls(spark):
    rows = spark.createDataFrame([("a", "a", "a"), ("a", "b", "a"), ("a", "a", None), ("a", "c", "c"), ("a", "b", "c"), (None, "x", None)], "b string, s string, t string")
    got = [(r["m"]["value"], r["m"]["origin"]) for r in rows.select(merge.three_way(F.col("b"), F.col("s"), F.col("t")).alias("m")).collect()]
    assert got == [("a", "base"), ("b", "source"), (None, "target"), ("c", "identical"), (None, "conflict"), ("x", "source")]


def test_evidence_and_kinds(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id int, right_id int")
    ids = spark.createDataFrame([(1, "m", "x", True), (2, "m", "x", True), (3, "m", "y", True), (3, "w", "z", False)], "id int, namespace string, value string, verified boolean")
    assert {(r["right_id"], r["supports"], r["contradicts"]) for r in merge.pair_evidence(pairs, ids).collect()} == {(2, 1, 0), (3, 0, 1)}
    kinds = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), (None, "c")], "left_kind string, right_kind string")
    policy = spark.createDataFrame([("b", "a")], "a string, b string")
    assert [r["compatible"] for r in merge.kind_compatible(kinds, policy).orderBy(F.col("left_kind").desc_nulls_last(), "right_kind").collect()] == [True, True, False, True]


def test_plan_relations_and_digest(spark):
    plan = spark.createDataFrame([("s1", "merge", "t1"), ("s2", "add", "s2")], "source_id string, action string, target_id string")
    have = spark.createDataFrame([("t1", "knows", "s9")], "from_entity string, relation_type string, to_entity string")
    new = spark.createDataFrame([("s1", "knows", "s2"), ("s1", "knows", "s2")], "from_entity string, relation_type string, to_entity string")
    assert [tuple(r) for r in merge.plan_relations(plan, have, new).collect()] == [("t1", "knows", "s2")]
    assert merge.plan_digest(plan).first() == merge.plan_digest(plan.repartition(3)).first()


def test_paging_walks_everything(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(10)], "created_at int, revision_id int")
    seen, after = [], None
    while True:
        page = store.keyset_page(rows, ("created_at", "revision_id"), after, 4).orderBy("rank").collect()
        seen += [r["revision_id"] for r in page]
        if not page or not page[-1]["has_more"]:
            break
        after = (page[-1]["created_at"], page[-1]["revision_id"])
    assert seen == list(range(10))


def test_reviews_and_idempotency(spark):
    log = spark.createDataFrame([(1, 1, 1, "submit", "a"), (1, 2, 1, "approve", "a"), (1, 3, 2, "approve", "b"), (1, 4, 1, "reject", "b"), (2, 5, 1, "submit", "a")], "changeset_id int, seq int, row_version int, event string, actor string")
    assert {r["changeset_id"]: (r["state"], r["row_version"]) for r in history.folded_changesets(log).collect()} == {1: ("rejected", 2), 2: ("proposed", 1)}
    requests = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "seq int, idempotency_key string")
    assert {r["seq"] for r in history.once_by_key(requests).collect()} == {1, 3, 4}


def test_forget_cascades_and_prune(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    obs = spark.createDataFrame([(1, "a", 0, None, False), (2, "b", 0, None, True)], "id long, entity_id string, observed_at long, valid_until long, tombstoned boolean")
    rels = spark.createDataFrame([("r", "a", "c", None)], "id string, from_entity string, to_entity string, valid_until long")
    e, o, r = lifecycle.forget_entities(ents, obs, rels, spark.createDataFrame([("c",)], "id string"))
    assert (e.count(), o.count(), r.count()) == (2, 2, 0)
    e, o = lifecycle.prune(ents, obs, rels, 10**9)
    assert {x["id"] for x in e.collect()} == {"a", "c"} and [x["id"] for x in o.collect()] == [1]


def test_domain_report_adds_up(spark):
    ents = spark.createDataFrame([(str(i), f"N{i}") for i in range(50)], "id string, name string")
    rels = spark.createDataFrame([(str(i), str(i + 1)) for i in range(49)], "from_entity string, to_entity string")
    got = store.domain_report(ents, rels, 4).agg(F.sum("entities"), F.sum(F.col("local") + F.col("crossing"))).first()
    assert tuple(got) == (50, 49)


def test_vector_paths_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(70)] + [(90, [0.0] * 6), (91, None), (92, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id int, vector array<float>").repartition(3)
    asked = vectors.where("id % 10 = 0 and id <= 90").withColumnRenamed("id", "query_id")
    one = {tuple(r) for r in search.vector_topk(vectors, asked, 5, ("id",)).collect()}
    monkeypatch.setattr(search, "HELD_QUERIES", 2)
    assert {tuple(r) for r in search.vector_topk(vectors, asked, 5, ("id",)).collect()} == one and len(one) == 40
    mixed = asked.unionByName(spark.createDataFrame([(500, [1.0, 2.0]), (501, [])], "query_id int, v array<float>").withColumnRenamed("v", "vector"))
    got = {tuple(r) for r in search.vector_topk(vectors, mixed, 5, ("id",)).collect()}
    assert {r for r in got if r[0] < 500} == one and [r[1] for r in sorted(got) if r[0] == 500 and r[3] == 1] == [92]
    assert {r[2] for r in got if r[0] == 501} == {0.0} and search.vector_topk(vectors, asked.where("false"), 5, ("id",)).count() == 0


def test_running_sums_cut_at_quantiles(spark):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.9 else "b", rng.randrange(4000) / 7, rng.randrange(9)) for _ in range(3000)]
    once = {(g, v): n for g, v, n in rows}
    frame = spark.createDataFrame([(g, v, n) for (g, v), n in once.items()], "g string, v double, n long").repartition(5)
    got = {(r["g"], r["v"]): r["n_before"] for r in running_sums(frame, "v", ["n"], ["g"]).collect()}
    assert got == {(g, v): sum(n for (h, w), n in once.items() if h == g and w < v) for g, v in once}
    assert sum(r["n_before"] for r in running_sums(frame.where("g = 'b'").drop("g"), "v", ["n"]).collect()) == sum(x for (g, _), x in got.items() if g == "b")
    assert running_sums(frame.where("false"), "v", ["n"]).count() == 0


def test_gate_verdicts(spark):
    from chronolith.operators import gates

    def report(rows):
        return spark.createDataFrame([(c, v, v, v, 5, whole) for c, v, whole in rows], "category string, recall double, mrr double, ndcg double, n int, judgments_complete boolean")

    base = report([(None, 0.8, True), ("a", 0.8, True), ("b", 0.8, False), ("c", 0.5, True)])
    now = report([(None, 0.795, True), ("a", 0.7, True), ("b", 0.7, True)])
    got = {r["gate"]: r["verdict"] for r in gates.category_gates(now, base).unionByName(gates.aggregate_gate(now, base)).unionByName(gates.coverage_gate(now, base)).collect()}
    assert got == {"category:a": "fail", "category:b": "indeterminate", "category_coverage": "fail", "aggregate:recall": "pass", "aggregate:mrr": "pass", "aggregate:ndcg": "pass"}
    ceiling = spark.createDataFrame([(None, 0.9, None, 0)], "category string, mean_ceiling double, min_ceiling double, capped int")
    assert [r["verdict"] for r in gates.ceiling_gates(ceiling).collect()] == ["fail", "indeterminate", "pass"]
    both = gates.comparability_gate({"k": "1"}, {"k": "2"}, spark).unionByName(gates.comparability_gate({}, {"k": "2"}, spark))
    assert gates.overall(both).first()[:] == ("fail", 1, 1)


def test_layers_and_authority(spark):
    from chronolith.operators import spaces

    roles = spark.createDataFrame([("p", "s1", "reader"), ("p", "s2", "writer")], "principal_id string, space_id string, role string")
    rows = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "id int, space_id string")
    assert {r["id"] for r in spaces.readable(rows, roles, "p", ["s1", "s3"]).collect()} == {1}
    with pytest.raises(ValueError, match="at most"):
        spaces.readable(rows, roles, "p", list("abcde"))
    assert spaces.authority_digest(roles).first()["digest"] != spaces.authority_digest(roles.where("space_id = 's1'")).first()["digest"]


def test_destruction_needs_the_shown_digest(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "a")], "id int, entity_id string")
    rels = spark.createDataFrame([("r", "a", "b")], "id string, from_entity string, to_entity string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    shown = lifecycle.destruction_preview(obs, rels, ids)
    assert {(r["entity_id"], r["observations"], r["relations"]) for r in shown.collect()} == {("a", 2, 1), ("b", 0, 1)}
    signed = shown.select("entity_id", "digest")
    later = lifecycle.destruction_preview(obs.unionByName(spark.createDataFrame([(3, "a")], obs.schema)), rels, ids)
    assert {r["id"] for r in lifecycle.confirmed(later, signed).collect()} == {"b"}


def test_recall_filters_before_the_limit(spark):
    """Hundreds of better matches that the filters refuse hide no answer, and priors hold before the limit."""
    rows = [(i, "e1" if i % 2 else "e2", "fox " * (1 + i % 5) + f"w{i}", 100, None, None, 0.9, "chat", False, "episodic", None) for i in range(600)]
    rows += [(3000 + i, "e1", f"hare {i}", 100, None, None, 0.9, "chat", False, "episodic", None) for i in range(3000)]
    rows += [(1000 + i, "e3", "a fox among " + "many other words " * 9, 100 - i, None, None, 0.5 + i / 100, "note", False, "semantic", 0.5) for i in range(12)]
    rows += [(2000, "nobody", "fox", 100, None, None, 1.0, "note", False, "semantic", None), (2001, "e3", "fox", 100, None, None, 1.0, "note", True, "semantic", None), (2002, "e3", None, 100, None, None, 1.0, "note", False, "semantic", None)]
    schema = "id long, entity_id string, content string, observed_at long, valid_from long, valid_until long, confidence double, source string, tombstoned boolean, memory_tier string, importance double"
    observations = spark.createDataFrame(rows, schema).repartition(4)
    entities = spark.createDataFrame([("e1", "A", "person"), ("e2", "B", "person"), ("e3", "C", "project")], "id string, name string, entity_type string")
    asked = spark.createDataFrame([(1, "fox"), (2, "absent"), (3, None)], "query_id int, text string")
    filters = recall.Filters(entity_type="project", source="note", min_confidence=0.55)
    got = recall.recalled(asked, observations, entities, 4, 10_000_000, filters, 1.0).collect()
    assert [r["query_id"] for r in got] == []  # so old that all are below the floor
    got = recall.recalled(asked, observations, entities, 4, 100, filters, 0.0).orderBy("rank").collect()
    every = search.text_topk(observations.select("id", F.col("content").alias("text")), asked, 10_000, ("id",)).select("query_id", "id", F.col("score").alias("raw"))
    assert got == recall.recall(every, observations, entities, 4, 100, filters, 0.0).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1011, 1010, 1009, 1008]
