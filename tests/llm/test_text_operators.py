"""Media, packing, toxicity, secrets, licenses and personal data against exact round trips and brute force."""

import base64
import hashlib
import random
import struct
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm import licenses, media, packing, pii, secrets, suffixes, toxicity
from chronolith.llm.kernels import shingles, text_bytes, words_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "é" * 70, "same text", "same text", "x" * 5000, "tab\tline\nfeed\x0b\x0c\r end", "naïve 東京 😀 café"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeats, long words, and columns whose names clash with the operators' own."""
    rows = [(i if i else None, t, "en", "s", 0, "clash") for i, t in enumerate(ODD)] + [(5, "same text", "en", "s", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_words_equal_regular_expression():
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é\t\n\x0b\x0c\r東 ", k=rng.randint(0, 40))) for _ in range(300)]
    data, offsets = text_bytes(pa.array(texts))
    w = words_of(data, offsets)
    raw = data.tobytes()
    by_word = {}
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == re.findall("[^\x20\x09-\x0d]+", t)
        for word, h in zip(got, w.hash[w.first[i] : w.first[i + 1]], strict=True):
            assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert len(shingles(w.hash[:3], 4)) == 0


def test_media_round_trip(odd, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_features(odd).collect()}
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i if i else None, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_features(empty).count() == 0
    stored = media.jpeg_columns(media.store_media(odd))
    assert stored.where("width is null").count() == 0 and stored.count() == len(ODD) + 1


def _jpeg(components, width, height, blocks, restart=0):
    """A baseline file with a table of two codes: DC category 0 or 3, AC end of block or (0, 1)."""
    out = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([16] * 64)) + media._segment(0xC4, bytes([0]) + bytes([0, 2] + [0] * 14) + bytes([0, 3])) + media._segment(0xC4, bytes([16]) + bytes([0, 2] + [0] * 14) + bytes([0, 1]))
    out += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in components))
    if restart:
        out += media._segment(0xDD, struct.pack(">H", restart))
    out += media._segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, 0]) for i, _, _ in components) + bytes([0, 63, 0]))
    for number, part in enumerate(blocks):
        bits = "".join(part)
        bits += "1" * (-len(bits) % 8)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        if number < len(blocks) - 1:
            out += bytes([0xFF, 0xD0 + number])
    return out + b"\xff\xd9"


def test_general_jpeg_scan():
    plus, zero = "01" + "101" + "00", "00" + "00"  # DC +5 then end of block; DC 0
    grey = media.parse(_jpeg([(1, 1, 1)], 24, 8, [[plus, zero], [plus]], restart=2))
    coef = media.coefficients(grey)
    assert coef[:, 0].tolist() == [5, 5, 5] and media.thumbnail(grey, coef).tolist() == [[138, 138, 138]]
    colour = media.parse(_jpeg([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 16, 16, [[plus, zero, plus, zero, zero, zero]]))
    assert media.thumbnail(colour, media.coefficients(colour)).tolist() == [[138, 138], [148, 148]]
    for broken in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8" + media._segment(0xC2, bytes(9)), b"\xff\xd8\xff"):
        with pytest.raises(ValueError):
            media.parse(broken)


def _separate(width, height, parts):
    """Three components (2x2, 1x1, 1x1), each in a scan of its own, in the order given."""
    whole = _jpeg([(1, 2, 2), (2, 1, 1), (3, 1, 1)], width, height, [])
    out = whole[: whole.index(b"\xff\xda")]
    for ident, blocks in parts:
        bits = "".join(blocks)
        bits += "1" * (-len(bits) % 8)
        out += media._segment(0xDA, bytes([1, ident, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    return out + b"\xff\xd9"


def test_scans_of_single_components():
    plus, zero = "01" + "101" + "00", "00" + "00"
    jpeg = media.parse(_separate(16, 16, [(2, [zero]), (1, [plus, zero, plus, zero]), (3, [zero])]))
    assert media.thumbnail(jpeg, media.coefficients(jpeg)).tolist() == [[138, 138], [148, 148]]


@pytest.mark.parametrize("few", [0, 12, 10**9])
def test_one_decoder_for_many_and_few_segments(monkeypatch, few):
    """Random tables and values with runs, read back together and one by one."""
    monkeypatch.setattr(media, "FEW", few)
    rng = random.Random(6)
    payload = np.array(rng.choices(range(256), k=64 * 90), np.uint8)
    blocks = np.array([1, 40, 7, 42])
    files = [media.parse(x) for x in media.encode_payloads(payload, blocks)]
    found = [media.payload_of(j, c) for j, c in zip(files, media.decode(files), strict=True)]
    assert b"".join(found) == payload.tobytes() and [len(f) for f in found] == (64 * blocks).tolist()
    # DC categories 0..5 and AC (run, size) symbols in codes of mixed length
    dc, ac = [(2, 3), (2, 1), (3, 0), (3, 2), (4, 4), (4, 5)], [(1, 0x00), (3, 0x11), (3, 0x02), (4, 0xF0), (4, 0x23), (5, 0x01), (5, 0x45)]

    def codes(table):
        code, last, out = 0, 0, {}
        for length, symbol in table:
            code <<= length - last
            last = length
            out[symbol] = format(code, f"0{length}b")
            code += 1
        return out

    def number(value, size):
        return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    dcs, acs, bits, want, before = codes(dc), codes(ac), "", [], 0
    for _ in range(60):
        block, k = [0] * 64, 1
        size = rng.choice([s for _, s in dc])
        diff = rng.choice([-1, 1]) * rng.randint(1 << (size - 1), (1 << size) - 1) if size else 0
        before += diff
        block[0] = before
        bits += dcs[size] + number(diff, size)
        while k < 64:
            symbol = rng.choice([s for _, s in ac])
            run, size = divmod(symbol, 16)
            if k + run > 63 or symbol == 0:
                bits += acs[0]
                break
            bits += acs[symbol]
            k += run
            if size:
                block[k] = rng.choice([-1, 1]) * rng.randint(1 << (size - 1), (1 << size) - 1)
                bits += number(block[k], size)
            k += 1
        want.append(block)
    bits += "1" * (-len(bits) % 8)
    raw = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([1] * 64)) + media._dht(0, dc) + media._dht(16, ac) + media._segment(0xC0, struct.pack(">BHHB3B", 8, 80, 48, 1, 1, 0x11, 0)) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
    jpeg = media.parse(raw)
    assert [c.tolist() for c in media.decode([jpeg] * 3)] == [want] * 3
    assert media.coefficients(jpeg, full=False)[:, 0].tolist() == [b[0] for b in want]
    assert isinstance(media.decode([jpeg._replace(data=jpeg.data[:-9])])[0], ValueError) and isinstance(media.decode([jpeg._replace(huffman={})])[0], ValueError)


def test_broken_files_give_errors(spark):
    good = media.encode_payloads(np.zeros(64 * 3, np.uint8), np.array([3]))[0]
    rows = [(1, good), (2, good[:-40]), (3, b"GIF89a"), (4, None), (5, b""), (6, good[:300]), (7, good.replace(b"\xff\xdb", b"\xff\xfe")), (8, b"\xff\xd8" + bytes(50))]
    got = {r["doc_id"]: r for r in media.jpeg_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["width"] == 24 and got[1]["error"] is None and got[4]["error"] is None and got[4]["width"] is None
    assert all(got[i]["width"] is None and got[i]["error"] for i in (2, 3, 5, 6, 7, 8))


def test_packing_tiles_every_document(odd, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(odd, TOKENIZER, window=64).collect()
    for i, text in enumerate(ODD):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == (i if i else None)})
        at = 0
        for start, length, crc, total in own:
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_words_encode_like_texts():
    rng = random.Random(4)
    texts = ["It's  don't", "<|endoftext|>x <|startoftext|>", "ΣΑΣ ΟΔΟΣ. ́x"] + ["".join(rng.choices("aA'sS \t\n<|>e1é́Σ東　 !?", k=50)) for _ in range(500)]
    encoder = packing.WordEncoder(TOKENIZER)
    ids, first = encoder.encode(*text_bytes(pa.array(texts)))
    assert all(ids[first[i] : first[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_bin_slack_is_least():
    rng = random.Random(6)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(5, 60)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1)}
        used = packing.fill(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used.items())
    plan = packing.plan({5: 7, 64: 2, 33: 3}, 64)
    assert sum(t * u.get(5, 0) for t, u in plan) == 7 and sum(t * u.get(33, 0) for t, u in plan) == 3 and all(sum(n * k for n, k in u.items()) <= 64 for _, u in plan)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = spark.read.parquet(f"{tables.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{tables.replace('0.001', '0.1')}/labels.parquet")
    labels = labels.orderBy("doc_id").limit(2500)
    scored = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out")
    row = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count_if(F.expr("predicted = 1 and toxic = 0")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.95 and row[1] <= 2 and 0 <= row[2] <= row[3] <= 1


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, none).collect()
    assert len(got) == len(ODD) + 1 and all(r["predicted"] == 0 for r in got)
    both = spark.createDataFrame([(i, 0, int(i < 4)) for i in range(1, 10)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, both).count() == len(ODD) + 1 and toxicity.toxicity(empty, both).count() == 0


def test_secrets_base_and_layers(odd, empty):
    token = 'token = "abcdef123456"'
    wrapped = base64.b64encode(zlib.compress(("zz " + token).encode())).decode()
    twice = urllib.parse.quote(base64.b64encode(f"q {wrapped} w".encode()).decode(), safe="")
    for text in (f"hello {twice} tail", f"x {wrapped} y", "".join(f"\\u{ord(c):04x}" for c in token), token.replace("=", "%3D")):
        base, every = secrets.find_secrets(text)
        assert not base and len(every) == 1
    base, every = secrets.find_secrets("PassWord:abcdef AKIA" + "Z9" * 8 + " " + "0a" * 12 + " token=ab ſecret=abcdefgh AKIAX")
    assert [k for _, k, _ in base] == [0, 1, 2] and base == every
    assert secrets.find_secrets("secret=token: abcdefgh")[0] == []
    nested = token
    for _ in range(20):
        nested = base64.b64encode(nested.encode()).decode()
    assert len(secrets.find_secrets(nested)[1]) == 1
    got = secrets.secret_spans(odd)
    assert got.count() == len(ODD) + 1 and got.where("spans <> ''").count() == 0 and secrets.secret_spans(empty).count() == 0
    assert secrets.secret_rows(odd).count() == 0


def test_license_alignment(spark, odd, empty):
    text = "the of " * 40 + licenses.TEMPLATES["MIT"].replace("hereby", "").upper() + " and " * 30 + "Released under the MIT License. x Released under the MIT License."
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [m.split(":")[0] for m in row["licenses"].split(",")] == ["MIT", "MIT-notice", "MIT-notice"]
    name, start, end = row["licenses"].split(",")[1].split(":")
    assert text[int(start) : int(end)] == "Released under the MIT License"
    assert licenses.license_scan(odd).where("n_licenses > 0").count() == 0 and licenses.license_scan(empty).count() == 0
    rng = random.Random(1)
    for _ in range(100):
        a, b = (rng.choices("abcdefg", k=rng.randint(0, 12)) for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    values = rng.sample(range(40), 20)
    assert len(licenses.longest_increasing(values)) == max(len([1 for k in _longest(values)]), 1)


def _longest(values):
    best = [[v] for v in values]
    for i, v in enumerate(values):
        best[i] = max(([*best[j], v] for j in range(i) if values[j] < v), key=len, default=[v])
    return max(best, key=len)


def test_surrogates(spark, odd, empty):
    texts = ["Mail Ann.Lee@Example.org or ann.lee@example.org, call +1 (555) 123-4567.", "Card 4111-1111-1111-1111 and 4952935900253052, host 10.1.2.3 or 8.8.8.8.", "Dr. Anna Poe met Mrs. Poe and Mr. Иван Петров.", "clean text 12 and v1.2.3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(docs, "k").collect()}
    first = got[0]["text"]
    for secret in ("Ann.Lee", "ann.lee", "123-4567"):
        assert secret not in first
    a, b = [m.entity for m in pii.find_mentions(first) if m.kind == "email"]
    assert a == b and first.startswith("Mail ") and "+1 (" in first
    cards = [m for m in pii.find_mentions(got[1]["text"]) if m.kind == "card"]
    assert [pii._luhn(m.entity) == 0 for m in cards] == [True, pii._luhn("4952935900253052") == 0] and "10." in got[1]["text"]
    names = [m for m in pii.find_mentions(got[2]["text"]) if m.kind in ("surname", "given_f", "given_m")]
    assert [m.kind for m in names] == ["given_f", "surname", "surname", "given_m", "surname"] and names[1].entity == names[2].entity and "Poe" not in got[2]["text"]
    assert "а" <= names[3].entity[0] <= "я"
    assert got[3]["text"] == texts[3] and got[3]["n_entities"] == 0
    assert [r["text"] for r in pii.pseudonymize(odd, "k").where("n_entities = 0").orderBy("doc_id").collect()][1:3] == ["", " "]
    assert pii.pseudonymize(empty, "k").count() == 0
    kept = pii.pseudonymized_documents(odd, "k")
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert pii.pseudonymize(docs, key="other").where("doc_id = 0").first()["text"] != first


def test_surrogates_stay_distinct(spark):
    mails = spark.createDataFrame([(i, f"{a}@{b}.co") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "stuvwx")], "doc_id long, text string")
    found = pii.mentions(pii.with_key(mails))
    table = pii.surrogates(found, "k").collect()
    new = [r["surrogate"] for r in table]
    assert len(set(new)) == len(new) == 48 and not set(new) & {r["entity"] for r in table}


def test_longest_factors_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choices(b"abc"[: rng.randint(1, 3)], k=rng.randint(0, 40)))
        order = np.array(sorted(range(len(data)), key=lambda i: data[i:]), np.int64)
        common = np.zeros(len(data), np.int64)
        for i in range(1, len(data)):
            a, b = data[order[i - 1] :], data[order[i] :]
            common[i] = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        want = np.array([max((k for j in range(i) for k in range(len(data) - i + 1) if data[j : j + k] == data[i : i + k]), default=0) for i in range(len(data))], np.int64)
        got = np.zeros(len(data), np.int64)
        for least in (1, 4):
            got[order] = suffixes.longest_factors(order, common, least)
            assert got.tolist() == np.where(want >= least, want, 0).tolist()


def test_common_bytes():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=400)), np.uint8)
    a, b = (np.array(rng.choices(range(380), k=300)) for _ in range(2))
    want = [next((k for k in range(20) if data[i + k] != data[j + k]), 20) for i, j in zip(a, b, strict=True)]
    assert suffixes.common_bytes(data, a, b, 20).tolist() == want


def test_matches_come_from_longest_factors(spark, monkeypatch):
    """Passages that only part of two documents share are found by the factors and by nothing else."""
    rng = random.Random(5)
    passage, noise = ("".join(rng.choices("abcdefghij ", k=n)) for n in (700, 3000))
    docs = spark.createDataFrame([(1, noise[:400] + passage + noise[400:900]), (2, noise[1000:1300] + passage + noise[1300:1700])], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_matches(docs).collect()}
    assert got[1] == got[2] and got[1] >= 700
    monkeypatch.setattr(suffixes, "longest_factors", lambda position, common, least=1: np.zeros(len(position), np.int64))
    reduce = suffixes._match_contexts(200, False, 1)
    data = np.frombuffer(passage.encode(), np.uint8)
    table = pa.table({"anchors": [np.zeros(2, np.uint64).tobytes()], "data": [np.r_[data, data].tobytes()], "sizes": [np.array([700, 700], np.uint32).tobytes()], "starts": [np.zeros(2, np.int64).tobytes()], "flags": [np.full(2, suffixes._SEND, np.uint8).tobytes()], "keys": [np.array([1, 2]).tobytes()], "docs": [np.array([1, 2]).tobytes()]})
    assert reduce(table).num_rows == 0
    monkeypatch.undo()
    assert reduce(table).num_rows == 1


def test_suffix_ranks():
    rng = random.Random(8)
    data = bytes(rng.choices(b"ab", k=3000))
    starts, rank = suffixes.suffix_ranks(np.frombuffer(data, np.uint8), np.array([1000, 0, 2000]), 12)
    strings = [data[s : s + 12] for s in starts]
    assert sorted(range(len(strings)), key=lambda i: strings[i]) == np.lexsort((np.arange(len(rank)), rank)).tolist()


