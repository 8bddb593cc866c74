"""Sources, sinks and streaming, over temporary folders."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from chronolith.sources import adapters, embeddings, pull, snapshot
from chronolith.streaming import ingest


def test_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Kick off\n\nAttendees: Ann, @Bo ,\nBefore it all\n## Goals\nShip it\n# Not a name\nsoon\n## Empty\n")
    (tmp_path / "plan.v2.md").write_text("no title\n## x\n")
    (tmp_path / "blank.md").write_text("# Only a name\n\n")
    ents, obs, rels = adapters.parse_notes(adapters.notes(spark, str(tmp_path)))
    assert sorted(r["name"] for r in ents.collect()) == ["Kick off", "plan.v2"]
    got = sorted((r["entity"], r["place"], r["section"], r["content"]) for r in obs.collect())
    assert got == [("Kick off", 0, None, "Before it all"), ("Kick off", 1, "Goals", "Ship it\nsoon"), ("plan.v2", 0, None, "no title")]
    assert sorted(r["to_entity"] for r in rels.collect()) == ["Ann", "Bo"]


def test_chat_strict_and_lenient(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"channel":"dev","user":"ann","ts":5,"text":"hi"}\n{broken\n')
    obs, rels = adapters.parse_chat(adapters.chat(spark, str(tmp_path), strict=False))
    assert [(r["entity"], r["valid_from"]) for r in obs.collect()] == [("#dev", 5)] and rels.count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        adapters.chat(spark, str(tmp_path)).collect()


def test_files_and_dataset(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.RS").write_text("fn")
    (tmp_path / "src" / "b.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / "c.txt").write_text("x")
    (tmp_path / "target" / "d.rs").write_text("x")
    got = {r["uri"].rsplit("/", 1)[1]: r["content"] for r in adapters.files(spark, str(tmp_path), ["rs"]).collect()}
    assert got == {"a.RS": "fn", "b.rs": None}
    for name, row in (("corpus", {"uri": "u", "text": "t"}), ("queries", {"id": "1", "text": "t"}), ("judgments", {"query_id": "1", "uri": "u", "relevance": 5})):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(row))
    with pytest.raises(Exception, match="relevance"):
        adapters.dataset(spark, str(tmp_path))[2].collect()


def test_query_set(spark):
    lines = ["# comment", "", json.dumps({"id": "q1", "text": "t", "category": "c", "relevant": [{"key": "k"}, {"key": "m", "relevance": 3}]})]
    queries, judged = adapters.query_set(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert queries.count() == 1 and {(r["key"], r["relevance"]) for r in judged.collect()} == {("k", 1), ("m", 3)}
    twice = spark.createDataFrame([(lines[2],), (lines[2],)], "value string")
    with pytest.raises(Exception, match="repeated"):
        adapters.query_set(twice)[0].collect()


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id int, text string")
    empty = spark.createDataFrame([], "digest string, vector array<float>")
    done, new = embeddings.with_cache(rows, empty, lambda t: embeddings.byte_vector(t, 4))
    assert new.where("digest is not null").count() == 1
    vectors = {r["id"]: r["vector"] for r in done.collect()}
    assert vectors[1] == vectors[2] and sum(x * x for x in vectors[1]) == pytest.approx(1, abs=1e-5)


def test_snapshot_and_pull(spark, tmp_path):
    counts = snapshot.save({"t": spark.range(5).toDF("id")}, str(tmp_path), 1)
    snapshot.save({"t": spark.range(7).toDF("id")}, str(tmp_path), 2)
    assert snapshot.latest(spark, str(tmp_path))["t"].count() == 7 and counts == {"t": 5}
    assert snapshot.verify(snapshot.latest(spark, str(tmp_path)), {"t": 8}) == ["t"]
    spark.dataSource.register(pull.RequestSource)
    got = spark.read.format("requests").option("batches", 3).option("size", 10).load()
    assert got.agg(F.count("*"), F.count_distinct("seq")).first()[:] == (30, 30)


def test_stream_replays_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"seq": 1, "name": "A", "entity_type": "t", "observations": ["x", "y"], "source": "s", "at": 1}, {"seq": 2, "name": "", "entity_type": "t", "observations": [], "source": "s", "at": 2}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    ingest.start(ingest.requests(spark, str(tmp_path / "in")), out, marks).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(json.dumps(rows[0] | {"seq": 3, "name": "B"}))
    query = ingest.start(ingest.requests(spark, str(tmp_path / "in")), out, marks)
    query.awaitTermination()
    writer = ingest.write_batch(out)
    writer(spark.read.schema(ingest.REQUEST_SCHEMA).json(str(tmp_path / "in" / "2.json")), 1)  # a replay of batch 1
    assert ingest.committed(spark, out, "observations").count() == 4
    assert ingest.committed(spark, out, "rejected").count() == 1
    assert spark.read.parquet(f"{out}/ledger").agg(F.max("last_seq")).first()[0] == 3


def test_stream_windows(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:10:00"), (3, 7, "2024-01-01 02:00:00")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    ingest.fresh_events(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("fresh").count() == 3
    got = ingest.access_sessions(events).collect()
    assert sorted(r["events"] for r in got) == [1, 3]


def _spelled(rng, n):
    """Requests whose names recur, in several spellings, and push each other out of the recent ones."""
    base = ["Alice Johnson", "Bob Miller", "Carla Gómez", "Northwind Traders", "Zürich Office"]
    out = []
    for seq in range(n):
        name = rng.choice(base) if rng.random() < 0.4 else f"Person {rng.randrange(40)} of {rng.choice(['Ulm', 'Rome', 'Oslo'])}"
        change = rng.random()
        name = name.upper() if change < 0.15 else name.replace("o", "0", 1) if change < 0.3 else name + "." if change < 0.4 else name
        out.append((seq, name, rng.choice(["person", "person", "project"]), [f"fact {rng.randrange(20)}"], "chat", 1000 + seq // 3))
    return out + [(n, None, "person", ["x"], "chat", 5), (n + 1, "Bob", "", ["x"], "chat", 5)]


def _one_by_one(requests):
    """(entity ids with names and last touch, same-as edges) by the plain loop over requests."""
    from chronolith.functions.names import similarity

    entities, front, edges, homes = {}, {}, set(), {}
    for seq, name, kind, *_ in requests:
        if not name or not kind:
            continue
        recent = front.setdefault(kind, [])
        home = next((i for i, (n, k) in entities.items() if n == name and k == kind), None)
        if home is None:
            best = max(((similarity(name, entities[i][0]), -p) for p, i in enumerate(recent[:100])), default=(0, 0))
            if best[0] >= 0.95:
                home = recent[-best[1]]
            else:
                home = hashlib.sha256(f"{name}\0{kind}".encode()).hexdigest()[:32]
                entities[home] = (name, kind)
                if best[0] >= 0.85:
                    edges.add((home, recent[-best[1]]))
        front[kind] = [home, *(i for i in recent if i != home)]
        homes[seq] = home
    return entities, edges, homes


@pytest.mark.parametrize("cuts", [[0, 90], [0, 1, 2, 30, 31, 60, 90]])
def test_any_cut_of_a_stream_leaves_the_same_store(spark, tmp_path, monkeypatch, cuts):
    monkeypatch.setattr("chronolith.operators.remember.RECENT", 100)
    requests = _spelled(random.Random(8), 88)
    write = ingest.write_batch(str(tmp_path))
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        write(spark.createDataFrame(requests[a:b], ingest.REQUEST_SCHEMA), number)
    write(spark.createDataFrame(requests[cuts[-2] : cuts[-1]], ingest.REQUEST_SCHEMA), len(cuts) - 2)  # a replay
    entities, edges, homes = _one_by_one(requests)
    got = {r["id"]: (r["name"], r["entity_type"]) for r in ingest.committed(spark, str(tmp_path), "entities").collect()}
    assert got == entities and len(edges) > 0
    assert {(r["from_entity"], r["to_entity"]) for r in ingest.committed(spark, str(tmp_path), "relations").collect()} == edges
    facts = {(r["entity_id"], r["content"], r["at"]) for r in ingest.committed(spark, str(tmp_path), "observations").collect()}
    assert facts == {(homes[seq], obs[0], at) for seq, _, _, obs, _, at in requests if seq in homes}
    assert ingest.committed(spark, str(tmp_path), "rejected").count() == 2
