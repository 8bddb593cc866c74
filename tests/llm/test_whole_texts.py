"""Names, numbers, layers, licenses and rows that operators once left out."""

import base64
import gzip
import random
import re
import textwrap
import urllib.parse
import zlib
from collections import Counter

import corpus_pipeline
from chronolith.llm import contamination, licenses, pii, secrets


def named(text):
    return [(m.kind, text[m.start : m.end]) for m in pii.find_mentions(text)]


def test_whole_names():
    assert named("Mr Juan Carlos Garcia Lopez came") == [("given_m", "Juan"), ("given_m", "Carlos"), ("given_m", "Garcia"), ("surname", "Lopez")]
    assert named("Dr. J. Poe and Dr. J.R. Poe") == [("initial", "J"), ("surname", "Poe"), ("initial", "J"), ("initial", "R"), ("surname", "Poe")]
    assert named("Dr. 王小明, Mr יוסי כהן.") == [("surname", "王小明"), ("given_m", "יוסי"), ("surname", "כהן")]
    assert named("Dr. Ann Poe wrote. Later Ann Poe, POE and Poe's friend; a poe, Poetry.")[2:] == [("given_m", "Ann"), ("surname", "Poe"), ("surname", "POE"), ("surname", "Poe")]
    assert named("Dr. Ann Poe I think. The Ann") == [("given_m", "Ann"), ("surname", "Poe"), ("given_m", "Ann")]


def test_two_series_cards():
    for card, found in (("2221 0000 0000 0009", True), ("2720-9999-9999-9996", True), ("2220 9999 9999 9999", False), ("2721 0000 0000 0000", False)):
        assert [m.kind for m in pii.find_mentions(f"card {card}.")] == ["card"] * found
        if found:
            assert 2221 <= int(pii.surrogate("card", card.replace(" ", "").replace("-", ""), 0, "k")[:4]) <= 2720


def test_more_forms_of_numbers_and_addresses():
    text = "to jürgen@bücher.example, 2001:db8::8a2e:370:7334 or fe80::1, id 123 45 6789, call 555 123 4567; std::vec a::b 12:30:45"
    got = named(text)
    assert got == [("email", "jürgen@bücher.example"), ("ipv6", "2001:db8::8a2e:370:7334"), ("ipv6", "fe80::1"), ("national", "123 45 6789"), ("phone", "555 123 4567")]
    new = pii.surrogate("ipv6", "fe80::1", 0, "k")
    assert new.startswith("fe80:") and new != "fe80::1" and len({pii.surrogate("ipv6", "::1", a, "k") for a in range(40)}) > 30
    assert named("x" * 300_000) == []


def test_a_full_space_of_addresses(spark):
    """All hundred addresses of one shape occur: none of them may stand for another."""
    every = [("email", f"{v}@{c}.co") for v in "aeiou" for c in "bcdfghjklmnpqrstvwxz"]
    got = pii.surrogates(spark.createDataFrame(every, "kind string, entity string"), "k").collect()
    assert len({r["surrogate"] for r in got}) == len(every) and not {r["surrogate"] for r in got} & {e for _, e in every}


def test_full_surrogate_spaces_widen(spark):
    short = [("email", f"{a}@x.co") for a in "abcdefghijklmnopqrstuvwxyz"]
    arabic = [("surname", c) for c in "ابتثجح"] + [("surname", c) for c in map(chr, range(0x10D0, 0x10F1))]
    rows = pii.surrogates(spark.createDataFrame(short + arabic, "kind string, entity string"), "k").collect()
    assert len({(r["kind"], r["surrogate"]) for r in rows}) == len(rows) == len(short + arabic)
    assert not {(r["kind"], r["surrogate"]) for r in rows} & {(r["kind"], r["entity"]) for r in rows}
    assert [pii.surrogate("ip", "192.168.1.1", attempt, "k").split(".")[0] for attempt in (0, pii.WIDER)] == ["192", "10"]


def spans(text):
    base, every = secrets.find_secrets(text)
    return {(secrets.KINDS[kind], text[a:b]) for a, kind, b in every} - {(secrets.KINDS[kind], text[a:b]) for a, kind, b in base}


def test_wrapped_base64():
    plain = "".join(f"line {i} of {i * 7919} and more words\n" for i in range(40)) + "password=hunter2secret"
    for width in (64, 76):
        for raw in (zlib.compress(plain.encode()), plain.encode()):
            lines = "\n".join(textwrap.wrap(base64.b64encode(raw).decode(), width))
            assert any(kind == "assign" and lines.startswith(run) and len(run) > len(lines) - 4 for kind, run in spans(f"see\n{lines}\nend"))
            assert any(kind == "assign" for kind, _ in spans(f"-----BEGIN CERTIFICATE-----\n{lines}\n-----END CERTIFICATE-----"))
            assert any(kind == "assign" for kind, _ in spans("data: " + lines.replace("\n", "\r\n ")))


def test_layers_of_any_characters():
    for raw in ("\ufeffpassword=hunter2secret\u00a0\u200b\f".encode(), "password=hunter2secret".encode("utf-16-le"), "password=hunter2secret".encode("utf-16"), "café password=hunter2secret".encode("latin-1")):
        run = base64.b64encode(raw).decode()
        assert ("assign", run) in spans(f"x {run} y")


def test_compressed_data_behind_escapes():
    plain = ("many words " * 30 + "password=hunter2secret").encode()
    for pack in (zlib.compress, gzip.compress):
        raw = pack(plain)
        assert any(kind == "assign" for kind, _ in spans(f"see ?q={urllib.parse.quote(raw)}&r=1"))
        assert any(kind == "assign" for kind, _ in spans(f"see {urllib.parse.quote_plus(raw)} end"))
        assert any(kind == "assign" for kind, _ in spans("see " + "".join(f"%{b:02X}" for b in raw) + " end"))
        assert any(kind == "assign" for kind, _ in spans("see " + "".join(f"\\u{b:04x}" for b in raw) + " end"))
        assert any(kind == "assign" for kind, _ in spans("see " + base64.b64encode(pack(pack(raw))).decode()))


def test_words_glued_to_base64():
    run = base64.b64encode(b"password=hunter2secret").decode().rstrip("=")
    for glued in (f"x/{run}", f"path/to/{run}", f"a-b_{run}", f"key+{run}"):
        assert ("assign", glued) in spans(f"see {glued} end")


def test_unpacked_in_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "UNPACKED", 5000)
    plain = b"words " * 3000 + b"password=hunter2secret " + b"words " * 3000
    assert any(kind == "assign" for kind, _ in spans(base64.b64encode(zlib.compress(plain)).decode()))


def test_random_nesting_against_its_recipe():
    """A secret under random layers is found, and its span covers the outermost of them."""
    rng = random.Random(9)
    for _ in range(120):
        inner, steps = "token: " + "".join(rng.choices("abcdefgh0123456789", k=rng.randint(6, 30))), rng.randint(1, 4)
        for _ in range(steps):
            inner = rng.choice(
                [
                    lambda t: urllib.parse.quote(t, safe="").replace("-", "%2D"),
                    lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
                    lambda t: base64.b64encode(t.encode()).decode(),
                    lambda t: base64.urlsafe_b64encode(zlib.compress(t.encode())).decode(),
                    lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
                ]
            )(inner)
        text = f"before {inner} after"
        _, every = secrets.find_secrets(text)
        assert any(kind == 0 and 0 <= a < b <= len(text) and a >= 6 and b <= 8 + len(inner) for a, kind, b in every), inner


def test_nesting_has_no_last_level():
    text = "password%" + "25" * 150 + "3Dhunter2secret"
    assert ("assign", text) in spans(text)


def test_licenses_with_other_words():
    for template in licenses.templates():
        if template.name in ("MIT", "Apache-2.0", "GPL-3.0"):
            words, often = list(template.words), Counter(template.words)
            once = [i for i, w in enumerate(words) if often[w] == 1 and w not in licenses.KEY_WORDS]
            room = int(len(words) * (1 - licenses.COVERAGE) * 0.7)  # neighbours of changed words may be lost too
            for i in once[:: max(1, len(once) // room)][:room]:
                words[i] = f"other{i}"
            found = licenses.find_licenses(words, [template])
            aligned = len(licenses.patience(words, template.words))
            assert aligned >= licenses.COVERAGE * len(words) and [m.aligned for m in found] == [aligned], template.name


def test_a_part_of_a_license_before_the_whole():
    known = licenses.templates()
    for name in ("MIT", "Apache-2.0", "GPL-3.0"):
        whole = next(list(t.words) for t in known if t.name == name)
        for part in (p for p in (1, 20, 60, 100, 130) if p < licenses.COVERAGE * len(whole)):  # more would be a match of its own
            head = whole[:part]
            for between in ([], ["and", "then"]):
                first = len(head) + len(between)
                found = licenses.find_licenses(head + between + whole + ["end"] * 5, known)
                assert (name, 1.0, first, first + len(whole) - 1) in {(m.name, m.coverage, m.first, m.last) for m in found}, (name, part)
                changed = whole[: len(whole) // 2] + ["other"] + whole[len(whole) // 2 + 1 :]
                found = licenses.find_licenses(head + between + changed, known)
                best = next(m for m in found if m.name == name and m.last == first + len(whole) - 1)
                assert best.first == first and best.aligned >= len(whole) - 3, (name, part, best)


def test_every_place_of_a_license_by_brute_force():
    """Changed, cut and repeated templates in noise: each place that aligns well enough, tried at every word, is found."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    body = [rng.choice(words) for _ in range(70)]
    for i in (3, 30, 55):
        body[i] = sorted(licenses.KEY_WORDS)[i % len(licenses.KEY_WORDS)]
    template = licenses.Template("made-up", tuple(body))
    for _ in range(60):
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [f"noise{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
            copy = list(body)
            for _ in range(rng.randint(0, 22)):
                copy[rng.randrange(len(copy))] = f"other{rng.randrange(50)}"
            text += copy[rng.randint(0, 6) : len(copy) - rng.randint(0, 6)]
        text += [f"noise{rng.randrange(400)}" for _ in range(rng.randint(0, 30))]
        found = licenses.find_licenses(text, [template])
        assert all(m.aligned >= licenses.COVERAGE * len(body) and m.last - m.first + 1 <= licenses.SPREAD * len(body) for m in found)
        covered = {i for m in found for i in range(m.first, m.last + 1)}
        for at in range(len(text)):
            window = text[at : at + len(body)]
            same = sum(a == b for a, b in zip(window, body, strict=False))
            if same >= 0.9 * len(body):  # aligned word by word, so patience cannot do much worse
                assert any(at <= i < at + len(body) for i in covered), (at, same)


def test_rows_not_ids_decide(spark):
    one, two, item = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "item"))
    rows = [(1, one), (1, one), (2, two), (2, one + " tail"), (None, one), (None, "lone words of a row without id"), (None, "lone words of a row without id"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, one), (2, two), (None, "lone words of a row without id"), (4, None), (4, None)], key=repr)
    held = spark.createDataFrame([(1, item), (1, one), (None, item), (None, two)], "doc_id long, text string")
    clean = contamination.clean_documents(held, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted([(1, one), (None, two)], key=repr)


def test_nested_escapes_against_one_level_at_a_time():
    """Every layer of single steps is a layer, and spans point at what was escaped."""

    def step(text):
        text = re.sub(r"\\u([0-9a-fA-F]{4})|%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), text)
        return text

    rng = random.Random(8)
    for _ in range(200):
        text = "x y=" + "".join(rng.choice("aZ%\\u 25") for _ in range(6)) + "password=hunter2secret"
        for _ in range(rng.randrange(1, 4)):
            text = "".join(
                c if rng.random() < 0.7 else f"%{ord(c):02x}" if rng.random() < 0.5 else f"\\u{ord(c):04X}" for c in text
            )
        wanted, now = set(), text
        while now != step(now):
            now = step(now)
            wanted.add(now)
        got = {layer.text for layer in secrets.layers(text)}
        assert wanted <= got, (text, wanted - got)
        at = now.index("password=")
        assert any(secrets.KINDS[k] == "assign" and b - a >= 22 for a, k, b in secrets.find_secrets(text)[1]), (text, at)


def test_deep_nests_take_linear_time():
    import time

    began = time.process_time()
    for text in ("%" + "25" * 50_000 + "41KIA" + "Z" * 20, "\\" + "u005c" * 20_000 + "u0041KIA" + "Z" * 20, "%" + "5Cu0025" * 10_000 + "41KIA" + "Z" * 20):
        base, every = secrets.find_secrets(text)
        assert (0, 1, len(text)) in every and (0, 1, len(text)) not in base
    assert time.process_time() - began < 30


def test_large_unpacked_layers_are_not_held():
    import tracemalloc

    packer, parts = zlib.compressobj(6), []
    for i in range(40):
        parts.append(packer.compress(b"".join(b"%d words of a longer text\n" % (i * 40_000 + j) for j in range(40_000))))
    raw = b"".join([*parts, packer.compress(b"password=hunter2secret"), packer.flush()])
    text = "data " + base64.b64encode(raw).decode()
    tracemalloc.start()
    try:
        _, every = secrets.find_secrets(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (5, 0, len(text)) in every or any(k == 0 for _, k, _ in every)
    assert peak < 250 << 20


def test_one_surrogate_for_a_word_of_a_name(spark):
    letters = " ".join(f"Dr. {chr(65 + i)}. Poe saw." for i in range(26))
    rows = [(1, "Ms. Ann met Dr. Ann Poe. Ann left."), (2, letters), (3, "Mr. Poe Ann and Ms. Ann Poe.")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    words = re.findall(r"[A-Za-z]+", got[1])
    assert words[1] == words[4] == words[6] != "Ann" and words[5] != words[1], got[1]
    initials = re.findall(r"Dr\. ([A-Z])\. [A-Z][a-z]+ saw\.", got[2])
    assert sorted(initials) == [chr(65 + i) for i in range(26)] and all(a != chr(65 + i) for i, a in enumerate(initials))
    third = re.findall(r"[A-Za-z]+", got[3])
    assert third[1] == third[6] and third[2] == third[5] and third[1] != third[2], got[3]


def test_surrogates_against_brute_force(spark):
    """All collisions are settled as a plain loop over a sorted list says: distinct, apart from what occurs, the same everywhere."""
    rng = random.Random(4)
    given, last = ["Ann", "Bob", "Al", "Bo", "Eve"], ["Poe", "Ash", "Fox", "Bo", "Ann"]
    rows = [(i, f"{rng.choice(['Mr.', 'Ms.', 'Dr.'])} {rng.choice(given)} {rng.choice(last)} at 555-{rng.randrange(100, 130)}-0001, 10.0.0.{i % 7}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(i, m) for i, text in rows for m in pii.find_mentions(text)]
    entities = sorted({(m.kind, m.entity) for _, m in found})

    def among(kind):
        return "surname" if kind.startswith("given_") else kind

    occurs = {(among(k), e) for k, e in entities}
    now = {(k, e): (0, pii.surrogate(k, e, 0, "key")) for k, e in entities}
    while True:
        keeper = {}
        for (k, e), (attempt, new) in now.items():
            keeper[among(k), new] = min(keeper.get((among(k), new), (1, "", "")), (-attempt, e, k))
        clash = [(k, e) for (k, e), (_, new) in now.items() if keeper[among(k), new][1:] != (e, k) or (among(k), new) in occurs]
        if not clash:
            break
        for k, e in clash:
            now[k, e] = (now[k, e][0] + 1, pii.surrogate(k, e, now[k, e][0] + 1, "key"))
    assert len({(among(k), new) for (k, _), (_, new) in now.items()}) == len(now)
    wanted = {}
    for i, text in rows:
        out, at = [], 0
        for m in pii.find_mentions(text):
            out += [text[at : m.start], pii._written(m.kind, text[m.start : m.end], now[m.kind, m.entity][1])]
            at = m.end
        wanted[i] = "".join([*out, text[at:]])
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, "key").collect()} == wanted
