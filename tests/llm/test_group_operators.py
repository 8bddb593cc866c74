"""Joins, dedup and decontamination against brute force, with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import contamination, dealing, debruijn, jaccard, kernels, suffixes
from chronolith.llm.components import components

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed):
    """Near copies, copies, shared passages, repeated passages inside one text, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(400)]
    texts = [None, "", " \n", "One", "one", "two words", "Two Words"]
    passage = " ".join(rng.choices(vocabulary, k=45))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                new.insert(rng.randrange(len(new)), passage)
            texts.append(" ".join(new))
    texts += [passage + " x " + passage, "y " + passage, "Z" * 3000, "ab " * 700, "ab " * 699 + "c"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return corpus(request.param)


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    return frame.repartition(5)


def linked(sets, percent):
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_similarity_groups(docs, rows, width, percent):
    sets = {}
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    pairs = linked(sets, percent)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in jaccard.similarity_groups(docs, width, percent).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["n_links"]) == (len(sets[i]), root[i], sum(i in p for p in pairs))


def test_similarity_with_small_blocks(docs, rows, monkeypatch):
    whole = {r["doc_id"]: tuple(r) for r in jaccard.similarity_groups(docs).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)
    assert {r["doc_id"]: tuple(r) for r in jaccard.similarity_groups(docs).collect()} == whole


def test_similarity_edges(spark, docs):
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "A B C D"), (None, "q"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.similarity_groups(odd).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (3, 3), (4, 3)]
    assert jaccard.similarity_groups(docs.where("false")).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_removed_windows(docs, rows):
    width = 13
    words = {i: SPLIT.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    got = {r["doc_id"]: r for r in debruijn.remove_repeats(docs).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest())


def test_windows_of_repeated_and_nameless_rows(spark, docs):
    text = " ".join(f"w{i}" for i in range(20))
    odd = spark.createDataFrame([(5, text), (5, text), (5, "pre " + text), (9, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in debruijn.remove_repeats(odd).collect())
    assert got == [(-1, 20, 0), (5, 20, 0), (5, 20, 0), (5, 21, 0), (9, 20, 20)]
    other = " ".join(f"v{i}" for i in range(20))
    split = spark.createDataFrame([(5, text), (5, other), (9, text + " x " + other)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.remove_repeats(split).collect()) == [(5, 20, 0), (5, 20, 0), (9, 41, 40)]
    assert debruijn.remove_repeats(docs.where("false")).count() == 0


def test_paths_are_compacted(spark):
    rows = [("a", 1, 2), ("b", 2, 3), ("c", 3, 4), ("d", 3, 5), ("e", 7, 8)]
    found = spark.createDataFrame([(n.encode(), h, t) for n, h, t in rows], "piece binary, head long, tail long")
    got = {bytes(r["piece"]): (bytes(r["path"]), r["place"]) for r in debruijn.paths(found).collect()}
    assert got == {b"a": (b"a", 0), b"b": (b"a", 1), b"c": (b"c", 0), b"d": (b"d", 0), b"e": (b"e", 0)}


@pytest.mark.parametrize("ring", [2, 3, 4])
def test_closed_chains_stay_single_pieces(spark, ring):
    rows = [(b"r%d" % i, i, (i + 1) % ring) for i in range(ring)] + [(b"s%03d" % i, 100 + i, 101 + i) for i in range(40)]
    began = time.monotonic()
    got = {bytes(r["piece"]): (bytes(r["path"]), r["place"]) for r in debruijn.paths(spark.createDataFrame(rows, "piece binary, head long, tail long")).collect()}
    assert time.monotonic() - began < 60
    assert all(got[b"r%d" % i] == (b"r%d" % i, 0) for i in range(ring)) and all(got[b"s%03d" % i] == (b"s000", i) for i in range(40))


def test_ten_thousand_pieces_in_a_row(spark):
    began = time.monotonic()
    rows = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 6, "0").cast("binary").alias("piece"), F.col("id").alias("head"), (F.col("id") + 1).alias("tail"))
    got = debruijn.paths(rows).groupBy("path").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()
    assert [(bytes(r["path"]), r["n"], r["last"]) for r in got] == [(b"000000", 10_000, 9_999)] and time.monotonic() - began < 60


def test_unitigs_of_branches_and_rings():
    #       0-1-2-3, 2-4, ring 7-8-9-7, loop 5-5, 3 alone
    head, tail = np.array([0, 1, 2, 2, 7, 8, 9, 5]), np.array([1, 2, 3, 4, 8, 9, 7, 5])
    first, place = debruijn.unitigs(head.astype(np.uint64), tail.astype(np.uint64), np.array([5, 6, 7, 8, 30, 10, 20, 9], np.uint64), np.zeros(8, bool))
    assert first.tolist() == [0, 0, 2, 3, 5, 5, 5, 7] and place.tolist() == [0, 1, 0, 0, 2, 0, 1, 0]


def test_long_spans_follow_compacted_paths(spark):
    """A passage of which a third document holds the middle is one span, although its pieces differ in colour."""
    words = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(["a", *words, "b"])), (2, " ".join(["c", *words, "d"])), (3, " ".join(["e", *words[30:50], "f"]))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["words"]) for r in debruijn.long_spans(docs).collect())
    assert got == [(2, 1, 80)]
    assert sorted((r["doc_id"], r["start"], r["words"]) for r in debruijn.long_spans(docs, words=13).collect()) == [(2, 1, 80), (3, 1, 20)]


def test_colliding_windows_remove_nothing(spark, monkeypatch):
    """With window hashes of a few bits, only words that are equal at their source go."""
    monkeypatch.setattr(debruijn, "shingles", lambda value, width: value[: max(0, len(value) - width + 1)] % np.uint64(7))
    docs = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(60))) for i in range(6)], "doc_id long, text string").coalesce(1)
    keyed = dealing.with_key(docs)
    batch = pa.RecordBatch.from_pandas(keyed.toPandas())
    assert batch.num_rows == 6  # the kernels run here, where the weak hash is in force
    table = pa.Table.from_batches([dealing.rows(pa.schema([("part", pa.int32()), ("windows", pa.binary()), ("owner", pa.binary()), ("owner_size", pa.int32()), ("docs", pa.binary())]), list(debruijn._emit_windows(1)([debruijn._windows(batch, 13)])))])
    answers = debruijn._by_owner(debruijn._repeated(1, np.zeros(dealing.BITS // 8, np.uint8))(table)).to_pandas()
    both = pa.RecordBatch.from_pandas(keyed.toPandas().merge(answers, on="doc_id"))
    out = debruijn._pieces(13)(both)
    assert len(out["piece"]) and len(set(out["piece"])) == len(out["piece"])


@pytest.mark.parametrize("keep_first", [False, True])
def test_removed_bytes(docs, rows, keep_first):
    length = 60
    raw = {i: (t or "").encode() for i, t in rows}
    places = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            places.setdefault(raw[i][k : k + length], []).append((i, k))
    got = {r["doc_id"]: r for r in suffixes.remove_matches(docs, length, keep_first).collect()}
    assert len(got) == len(rows)
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            all_places = places[b[k : k + length]]
            if (all_places[0] != (i, k)) if keep_first else len(all_places) > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), spans)
        assert got[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_bytes_of_repeated_rows(spark, docs):
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    odd = spark.createDataFrame([(1, text), (1, text), (None, "x" * 150), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.remove_matches(odd).collect())
    assert got == [(-1, 0), (1, 300), (1, 300), (2, 0)]
    assert suffixes.remove_matches(docs.where("false")).count() == 0


def test_contained_items(spark, docs, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[5 : 5 + 8 + 3 * k])) for k, t in enumerate(texts[:8])] + [(90, "two words"), (91, ""), (92, None), (None, "one"), (93, texts[0]), (93, texts[0])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = SPLIT.findall((t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {("whole", *w)} if w else set()

    want = set()
    for item, t in items:
        g = grams(t)
        for i, text in rows:
            if item is not None and g and 100 * len(g & grams(text)) >= 80 * len(g):
                want.add((i, item, len(g), len(g & grams(text))))
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in contamination.contained_items(docs, benchmark).collect()}
    assert got == want and any(item == 90 for _, item, _, _ in got)
    clean = contamination.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    assert contamination.contained_items(docs.where("false"), benchmark).count() == 0 and contamination.contained_items(docs, benchmark.where("false")).count() == 0


def test_sketches_hold_few_hashes(spark):
    """One item of a single shingle, or many items, leave the documents' sketches short."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"v{k}" for k in range(3000)], k=400)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(k, " ".join(t.split()[9 : 9 + 12 + k])) for k, t in enumerate(texts[:20])] + [(99, "zz yy xx ww vv")]
    report = contamination.sketch_report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r["items"] for r in report) == 21 and {r["part"] for r in report} == {0, 3, 4}
    assert report[0]["sketched"] < 0.05 * report[0]["shingles"] and all(r["held"] > 0 for r in report if r["part"])


def test_sketches_never_miss():
    for largest in (1, 3, 7, 15, 31, 63, 127):
        for n in range(largest // 2 + 1, largest + 1):
            assert contamination.sketch_size(largest) > n - -(-80 * n // 100)


def test_frequent_tokens_are_never_missed(monkeypatch):
    """A token in a share of the sets that is spread evenly is told by its task, however little room there is."""
    monkeypatch.setattr(jaccard, "COUNTED", 600)
    rng = np.random.default_rng(3)
    counts, often, total = jaccard._Counts(), np.uint64(42), 0
    for _ in range(30):
        sets = []
        for i in range(100):
            own = rng.integers(1 << 40, 1 << 60, 20).astype(np.uint64)
            sets.append(np.sort(np.r_[own, often] if i % 10 == 0 else own))
            total += i % 10 == 0
        counts.add(sets)
    token, number = counts.often(0.1)
    assert counts.lost <= 3000 * 21 // 600 + 30 and number[token.index(42)] >= total


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab é\n", k=rng.randint(0, 3000))) for _ in range(6)] + ["x" * 700, "", "q r"]
    data, offsets = kernels.text_bytes(pa.array(texts))
    whole, anchored = kernels.words_of(data, offsets), suffixes.anchors(data, offsets, 60)
    monkeypatch.setattr(kernels, "CHUNK", 97)
    monkeypatch.setattr(suffixes, "PIECE", 131)
    assert all((a == b).all() for a, b in zip(whole, kernels.words_of(data, offsets), strict=True))

    def windows(found):
        return sorted((int(r), int(f) + i, int(v)) for r, v, _, f, n in zip(*found, strict=True) for i in range(int(n)))

    assert windows(anchored) == windows(suffixes.anchors(data, offsets, 60))


def test_operators_with_cut_texts(docs, rows, monkeypatch):
    whole = {r["doc_id"]: tuple(r) for r in suffixes.remove_matches(docs, 60).collect()}
    batch = pa.RecordBatch.from_pandas(dealing.with_key(docs).toPandas())
    monkeypatch.setattr(suffixes, "PIECE", 100)
    row, value, digest, at, windows = suffixes.anchors(*kernels.text_bytes(batch.column("text")), 60)
    body = batch.column("text").to_pylist()
    assert len(whole) == len(rows) and all(a + n - 1 + 60 <= len((body[r] or "").encode()) for r, a, n in zip(row.tolist(), at.tolist(), windows.tolist(), strict=True))
