"""The manifest, the filter audit and MinHash dedup against brute force, with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import audit, manifest, minhash

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string"


def frame(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCUMENTS).repartition(partitions)


# the manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc, _, lang, source, chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)))


def tree_of(nodes):
    """Levels of a tree, and for each node the siblings on its way up as (left, right)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    ways = []
    for i in range(len(nodes)):
        way, at = [], i
        for level in levels[:-1]:
            start = at - at % 3
            way.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
            at //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, ways = {}, {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        subroots[s], each = tree_of([leaf_of(r, r[1]) for r in own])
        ways[s] = list(zip(own, each, strict=True))
    root, tops = tree_of([subroots[s] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, way in ways[s]:
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(r, text)
            for left, right in way + top:
                node = sha(left + node + right)
            out.append((r[0], leaf_of(r, r[1]), subroots[s], root, sha("".join(a + b for a, b in way + top)), node, node == root))
    return Counter(out)


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rng = random.Random(3)
    texts = [None, "", "a\nb\n", "é\n" * 3, "plain", "x\n" * 40_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(["big"] * 8 + ["b2", "", None, "é", "z"]), rng.choice([3, None])) for i in range(400)]
    rows += [(7, "same id", "en", "big", 1), (7, "same id", "en", "big", 1), (None, "no id\n", "en", "big", 1), (None, None, None, None, None), (900, "alone", "en", "alone", 5)]
    rows += [rows[10]] * 30
    got = Counter(tuple(r) for r in manifest.manifest(frame(spark, rows)).collect())
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_small_manifests(spark):
    assert manifest.manifest(frame(spark, [])).collect() == []
    one = [(5, "t", "en", "s", 1)]
    assert Counter(tuple(r) for r in manifest.manifest(frame(spark, one)).collect()) == brute_manifest(one)
    by_place = [(i, str(i), "en", f"s{i % 30}", i) for i in range(90)]
    assert Counter(tuple(r) for r in manifest.manifest(frame(spark, by_place)).collect()) == brute_manifest(by_place)


def test_levels_for_every_size(spark):
    sizes = spark.range(1, 800).select(F.col("id"), manifest.levels_of(F.col("id")).alias("n")).collect()
    assert all(3 ** r["n"] >= r["id"] and (r["n"] == 0 or 3 ** (r["n"] - 1) < r["id"]) for r in sizes)


# the audit


def brute_audit(rows, labels):
    least, masks = {}, []
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for doc, text, lang, *_ in rows:
        text = text or ""
        words, capitals = SPLIT.findall(text), len(re.findall("[A-Z]", text))
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), re.search("[#$%&*|]", text), doc is not None and doc > least[text]), strict=True) if x}
        masks.append((lang or "", fails, doc))
    out = []
    for part in {m[0] for m in masks}:
        own, total, rows_ = [m for m in masks if m[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [m for m in own if f in m[1] and not m[1] & before]
                total[f] += len(removed)
                rows_.append((f, (part, order, k + 1, sum(not m[1] & (before | {f}) for m in own), len(removed), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] in good for m in removed), sum(m[2] in toxic for m in removed))))
        out += [(*r, total[f]) for f, r in rows_]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "short", "SHOUT", long, long.upper(), "a b " * 150, long + " #", "c%"] + [f"text {i} {long}" for i in range(20)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", "", None]), "s", 1) for i in range(160)]
    rows += [(i, "hot text", "de", "s", 1) for i in range(200, 420)]
    rows += [(200, "hot text", "de", "s", 1)] * 3 + [(None, "hot text", "de", "s", 1), (None, None, None, None, None), (500, "y" * 200_000, "en", "s", 1), (501, "y" * 200_000, "en", "s", 1)]
    return rows


LABELS = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 430, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]


@pytest.mark.parametrize("batch", [3, 1000])
def test_audit(spark, batch):
    rows = audit_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that boundaries cut the hot text
    try:
        got = audit.filter_interactions(frame(spark, rows), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
        assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, LABELS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audit_boundaries(spark, monkeypatch):
    """Equal fingerprints of different texts, cut at any place."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") % 2)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["ab", "cd", "a", "b", "ab", "cd", "cd", "ab", "zz", "a", "ab"] * 6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.failure_masks(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = {}
    for doc, text, *_ in rows:
        first.setdefault(text, doc)
    assert {r["doc_id"]: bool(r["mask"] & 16) for r in got} == {r[0]: r[0] > first[r[1]] for r in rows}


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(frame(spark, []), empty).collect() == []
    rows = [(1, "x", "en", "s", 1)]
    assert sorted(tuple(r) for r in audit.filter_interactions(frame(spark, rows), empty).collect()) == brute_audit(rows, [])


# MinHash dedup


def set_of(text, width=3):
    words = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        sets.setdefault(frozenset(set_of(text)), set()).add(doc)
    every = [s for s in sets if s]
    root = {d: d for docs in sets.values() for d in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i, a in enumerate(every):
        docs = sorted(d for d in sets[a] if d is not None)
        for d in docs[1:]:
            union(docs[0], d)
        for b in every[i + 1 :]:
            if 100 * len(a & b) >= 85 * len(a | b):
                others = [d for d in sets[b] if d is not None]
                if docs and others:
                    union(docs[0], others[0])
    out = []
    for doc, text, *_ in rows:
        own = set_of(text)
        docs = sorted(d for d in sets[frozenset(own)] if d is not None) if own else []
        component = find(docs[0]) if docs else doc
        out.append((doc, len(own), component, doc == component))
    return Counter(out)


def near_copies(rng, n, edits):
    vocabulary = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=200)
    for _ in range(n):
        new = list(base)
        for _ in range(edits):
            new[rng.randrange(len(new))] = rng.choice(vocabulary)
        yield " ".join(new)


def minhash_rows():
    rng = random.Random(11)
    texts = [None, "", " \n", "One", "one", "two words", "Two Words", "three little words", "Z" * 3000, "ab " * 700, "ab " * 699 + "c"]
    for edits, n in ((1, 60), (2, 60), (3, 60), (5, 60), (8, 40)):
        texts += near_copies(rng, n, edits)
    texts += [texts[20]] * 40 + [texts[20].upper()] + [" ".join(rng.choices("abcdefgh", k=k)) for k in range(3, 40) for _ in range(3)]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 1), (None, "nobody else has this", "en", "s", 1)]


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    monkeypatch.setattr(minhash, "STAR_SETS", 16)
    rows = minhash_rows()
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    got = minhash.near_duplicates(frame(spark, [(3, None, None, None, None), (2, "", "", "", 0)])).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 2, True), (3, 0, 3, True)]


def test_one_repeated_row(spark):
    rows = [(9, "a b c d e", "en", "s", 1)] * 200 + [(4, "a b c d e", "en", "s", 1)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == {(9, 3, 4, False): 200, (4, 3, 4, True): 1}


def test_odd_sketches_estimate():
    """Few pairs far below the threshold pass the sift, none above it fails, and parity counts follow the similarity."""
    rng = np.random.default_rng(1)
    most = minhash.most_differing_bits(85)
    seen = {}
    for similarity in (0.3, 0.5, 0.86, 0.95):
        bits = []
        for _ in range(40):
            shared, own = int(600 * similarity), (600 - int(600 * similarity)) // 2
            every = np.unique(rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64))
            rng.shuffle(every)
            a, b = np.sort(every[: shared + own]), np.sort(np.r_[every[:shared], every[shared + own :]])
            x, y = minhash.sketches_of(minhash.samples_of([a, b])).view(np.uint64)
            bits.append(int(np.bitwise_count(x ^ y).sum()))
        seen[similarity] = bits
    assert max(seen[0.86]) <= most and max(seen[0.95]) <= most and min(seen[0.3]) > most
    assert np.mean(seen[0.95]) < np.mean(seen[0.86]) < np.mean(seen[0.5]) < np.mean(seen[0.3])
    assert minhash.missed_by_bands(0.85) < 1e-12


def test_bands_without_sketches_would_confirm_more(spark):
    """The sift keeps pairs that share a band by chance from being confirmed."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(near_copies(random.Random(2), 60, 22))]
    keyed = minhash.with_key(frame(spark, rows))
    known = minhash._summaries(keyed, 3).where("n > 0")
    pairs = known.select("key", F.explode("bands").alias("band")).alias("a").join(known.select(F.col("key").alias("other"), F.explode("bands").alias("band")), "band").where("key < other")
    pairs = pairs.select(F.col("key").alias("u"), F.col("other").alias("v")).distinct()
    assert minhash._sifted(pairs, known.select("key", "doc_id", "n", "sketch"), 85).count() < pairs.count() / 2
