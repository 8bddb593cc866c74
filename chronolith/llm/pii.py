"""Personal data: detection, and keyed surrogates of the same type, gender, script and format.

Detected are e-mail addresses (of any script), telephone numbers, payment card numbers, IPv4 and IPv6
addresses, national identity numbers written 123-45-6789 or 123 45 6789, account numbers (IBAN), names
after a form of address, however many words and initials they have, and every other place of the
text where a word of such a name stands alone. In scripts without case nothing marks a name's end but
the first sign other than a letter or a space. Every mention is reduced to entities (a name to its given name and its
surname), so "Dr. Ann Poe" and "Ms. Poe" share a surname's surrogate. Within a text a word of a name has one surrogate,
that of a given name where it is one anywhere. A surrogate is made from an
HMAC of (type, entity, attempt) under a secret key:

* letters become letters of the same script and case, digits digits, all else stays; card numbers keep
  length, grouping, first digit and the truth of their check digit, addresses stay valid and private
  ones private, account numbers get valid check digits;
* given names follow the gender that the form of address or the name's ending tells.

Initials are mapped one to one within their alphabet, in an order that the key decides, and stay initials.

Collision checks run over all other distinct entities of the corpus: where two entities of a type would
share a surrogate, or a surrogate equals an entity that occurs, the entity gets the next attempt,
until all are distinct. Later attempts draw from wider spaces, so none is ever full: names and e-mail
addresses grow, numbers take letters (cards, another first digit), and private addresses other private ranges, then public ones. Equal entities have equal surrogates everywhere.

Defined results: null text stays null and has no entities; a document without entities is returned
unchanged; repeated rows are repeated; without doc_id rows are treated like any other.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.dealing import chosen, key_bitmap, with_key
from chronolith.llm.frames import durable, map_batches

#: The session's setting that holds the secret key of registered queries.
KEY_SETTING = "spark.chronolith.surrogates.key"

# Forms of address and the gender they tell (f, m or n).
FORMS = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Doña": "f", "Dr": "n", "Prof": "n", "Professor": "n"}

# Countries whose account numbers are taken even with wrong check digits.
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())

# Begins only where a run of its characters does, so that a long word without @ is read once.
_EMAIL = re.compile(r"(?<![\w.%+-])[._%+-]*+([^\W_][\w.%+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)")
_GROUP = r"[0-9A-Fa-f]{1,4}"
_IPV6 = re.compile(rf"(?<![\w:.])(?:{_GROUP}(?::{_GROUP}){{7}}|(?=[0-9A-Fa-f:]*::)(?:{_GROUP}(?::{_GROUP}){{0,5}})?::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\w:]|\.\d)")
_CARD = re.compile(r"(?<![0-9A-Za-z+])(?:[3-6]|2(?=[ -]?(?:2[ -]?(?:2[ -]?[1-9]|[3-9][ -]?\d)|[3-6][ -]?\d[ -]?\d|7[ -]?(?:[01][ -]?\d|2[ -]?0))))(?:[ -]?\d){12,18}(?![0-9A-Za-z])")
_PHONE = re.compile(r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4})(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(FORMS, key=len, reverse=True)) + r")\.?[ ](?=[^\W\d_])")
# A letter, or a mark that follows one: combining, Hebrew, Arabic, Indic.
_MARK = r"\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f"
_NAME_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARK}]|['’-](?=[^\W\d_])(?![sS](?!\w)))*")
# Words that begin a sentence after a name and are no part of it.
_BEGINNERS = frozenset("The They This That It I We And But".split())
_DIGIT_OR_AT = re.compile(r"[0-9@]|::")
_PATTERNS = (("email", _EMAIL), ("iban", _IBAN), ("ip", _IP), ("ipv6", _IPV6), ("card", _CARD), ("national", _NATIONAL), ("phone", _PHONE))


class Mention(NamedTuple):
    """A range of the text that one surrogate replaces, and the entity behind it."""

    start: int
    end: int
    kind: str
    entity: str


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 == len(digits) % 2 else int(d) for i, d in enumerate(digits)) % 10


def _gender(form: str, given: str) -> str:
    told = FORMS[form]
    return told if told != "n" else "f" if given[-1:].lower() in ("a", "e", "я", "а") else "m"


def _uncased(word: str) -> bool:
    return word.lower() == word.upper()


def _name_words(text: str, at: int) -> list[re.Match]:
    """The words of the name that begins at a place: capital or uncased, with initials."""
    words: list[re.Match] = []
    while (w := _NAME_WORD.match(text, at)) and (w.group()[0].isupper() or _uncased(w.group()[0])) and w.group() not in FORMS:
        initial = len(w.group()) == 1 and text[w.end() : w.end() + 1] == "."
        if w.group() in _BEGINNERS and not initial:
            break
        words.append(w)
        at = w.end() + initial
        if text[at : at + 1] == " ":
            at += 1
        elif not initial:
            break
    return words


def _bare(text: str, named: dict[str, str]) -> list[Mention]:
    """All places of the names (folded word to kind): whole words with a capital, uncased ones anywhere."""
    out = []
    cased, uncased = ([w for w in sorted(named, key=len, reverse=True) if _uncased(w) == flag] for flag in (False, True))
    if cased:
        pattern = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, cased))})(?![^\W\d_]|[{_MARK}])", re.IGNORECASE)
        # longer matches of other folded length (ß and ss) are not names found here
        out += [(m, m.group().casefold()) for m in pattern.finditer(text) if m.group()[0].isupper()]
    if uncased:
        out += [(m, m.group()) for m in re.finditer("|".join(map(re.escape, uncased)), text)]
    return [Mention(m.start(), m.end(), named[entity], entity) for m, entity in out if entity in named]


def find_mentions(text: str) -> list[Mention]:
    """Non-overlapping mentions, leftmost first; at one place the earlier type of the list above wins."""
    found: list[Mention] = []
    if _DIGIT_OR_AT.search(text):
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(text):
                value, start = (m[1], m.start(1)) if kind == "email" else (m.group(), m.start())
                entity = value.lower() if kind in ("email", "ipv6") else value if kind == "ip" else re.sub(r"[^0-9A-Z]", "", value)
                if kind == "ipv6" and not any(c.isdigit() for c in value):  # a::b in code
                    continue
                if kind != "iban" or _iban_ok(entity) or entity[:2] in IBAN_COUNTRIES and sum(c.isdigit() for c in entity) >= 10:
                    found.append(Mention(start, m.end(), kind, entity))
    named: dict[str, str] = {}
    names: list[Mention] = []
    for m in _NAME.finditer(text):
        words = _name_words(text, m.end())
        for i, w in enumerate(words):
            word = w.group().casefold()
            initial = len(word) == 1 and not _uncased(word)
            kind = "initial" if initial else "surname" if i == len(words) - 1 else "given_" + _gender(m.group(1), words[0].group())
            names.append(Mention(w.start(), w.end(), kind, word))
            if not initial and named.get(word, "surname") == "surname":  # a given name wherever it is one once
                named[word] = kind
    # a word of a name is one entity in its text, whatever part of a name it is at one place
    found += [m._replace(kind=named.get(m.entity, m.kind)) for m in names]
    if named:
        found += _bare(text, named)
    rank = {kind: i for i, (kind, _) in enumerate(_PATTERNS)}
    out: list[Mention] = []
    taken: list[tuple[int, int]] = []
    for mention in sorted(found, key=lambda x: (rank.get(x.kind, 9), x.start)):
        i = bisect_left(taken, (mention.start, mention.end))
        if (i == 0 or taken[i - 1][1] <= mention.start) and (i == len(taken) or mention.end <= taken[i][0]):
            taken.insert(i, (mention.start, mention.end))
            out.append(mention)
    return sorted(out)


def session_key(spark: SparkSession) -> str:
    """The key of registered queries and the pipeline: the session's setting. Without one a fixed key stands in,
    with which surrogates are consistent but no secret."""
    return spark.conf.get(KEY_SETTING, None) or "no secret"


class _Stream:
    """Keyed pseudo-random numbers for one (type, entity, attempt)."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key.encode(), f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxz"
# Alphabets of other scripts, as ranges of lower-case letters.
_SCRIPTS = (("α", "ω"), ("а", "я"), ("ա", "ֆ"), ("א", "ת"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "鿋"), ("ء", "غ"), ("ف", "ي"), ("가", "힣"), ("अ", "ह"), ("ก", "ฮ"), ("ა", "ჰ"))
#: Attempts from which a surrogate is drawn from a wider space, and from the widest.
WIDER, WIDEST = 8, 24
_DIGITS, _WIDE_DIGITS = "0123456789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letter(char: str, stream: _Stream) -> str:
    low = unicodedata.normalize("NFD", char.lower())[0]
    if "a" <= low <= "z":
        pool = _VOWELS if low in _VOWELS + "y" else _CONSONANTS
        new = pool[stream.below(len(pool))]
    else:
        first, last = next(((a, b) for a, b in _SCRIPTS if a <= char.lower() <= b), ("", ""))
        if first:
            new = chr(ord(first) + stream.below(ord(last) - ord(first) + 1))
        else:  # letters of the neighbourhood, which is of the same script
            near = [c for c in map(chr, range(ord(char.lower()) & ~63, (ord(char.lower()) | 63) + 1)) if c.isalpha() and c == c.lower()]
            new = near[stream.below(len(near))] if near else char
    return new.upper() if char.isupper() and len(new.upper()) == 1 else new


def _same_shape(value: str, stream: _Stream, digits: str = _DIGITS) -> str:
    return "".join(digits[stream.below(len(digits))] if c.isdigit() else _letter(c, stream) if c.isalpha() else c for c in value)


def _grown(like: str, attempt: int, stream: _Stream) -> str:
    """Letters of the same script that later attempts add."""
    last = next((c for c in reversed(like) if c.isalpha() and not c.isascii()), "")
    return "".join(_letter("ba"[i % 2] if like.isascii() else last or "a", stream) for i in range(max(0, attempt - 3)))


@lru_cache(maxsize=256)
def _initials(first: str, last: str, key: str) -> dict[str, str]:
    """Each letter of a range to the next in an order that the key decides, so that letters and surrogates are one to one."""
    letters = [c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha() and c == c.lower() and len(c.upper()) == 1]
    letters.sort(key=lambda c: hmac.new(key.encode(), f"initial\0{c}".encode(), hashlib.sha256).digest())
    return dict(zip(letters, [*letters[1:], *letters[:1]], strict=True))


def surrogate(kind: str, entity: str, attempt: int, key: str) -> str:
    """The canonical surrogate of an entity at one attempt; later attempts of names may grow longer."""
    if kind == "initial":
        near = (chr(ord(entity) & ~63), chr(ord(entity) | 63))
        return _initials(*next(((a, b) for a, b in (("a", "z"), *_SCRIPTS) if a <= entity <= b), near), key).get(entity, entity)
    stream = _Stream(key, kind, entity, attempt)
    if kind == "email":
        name, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_same_shape(name, stream)}{_grown(name, attempt, stream)}@{_same_shape(host, stream)}.{top}"
    if kind == "ip":
        parts = entity.split(".")
        public = [i for i in range(1, 224) if i not in (10, 127, 169, 172, 192, 198, 203)]
        private = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        if private and attempt >= WIDER:  # the largest private range, then any
            parts, private = ["10", *parts[1:]], 1 if attempt < WIDEST else 0
        return ".".join([*parts[:private], *(str(public[stream.below(len(public))] if i == 0 else 1 + stream.below(254)) for i in range(private, 4))])
    if kind == "ipv6":  # loopback, link-local, private and multicast prefixes stay; later attempts fill all eight groups
        groups = entity.split(":")
        keep = 1 if groups[0][:2] in ("fc", "fd", "fe", "ff") and attempt < WIDEST else 0
        if attempt >= WIDER or "::" in entity and sum(map(bool, groups)) < 3:
            groups = [*groups[:keep], *["0000"] * (8 - keep)]
        return ":".join(g if i < keep or not g else f"{(1 if len(g) == 1 else 16 ** (len(g) - 1)) + stream.below(15 * 16 ** (len(g) - 1)):x}" for i, g in enumerate(groups))
    if kind == "card":
        head = str(2221 + stream.below(500)) if entity[0] == "2" else entity[0]
        if attempt >= WIDEST:
            head = str(3 + stream.below(4))
        body = head + "".join(str(stream.below(10)) for _ in entity[len(head) + 1 :])
        check = next(d for d in "0123456789" if _luhn(body + d) == 0)
        return body + (check if _luhn(entity) == 0 else str((int(check) + 1 + stream.below(9)) % 10))
    if kind == "iban":
        body = _same_shape(entity[4:], stream, _DIGITS if attempt < WIDEST else _WIDE_DIGITS)
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind in ("phone", "national"):
        code = max(0, len(entity) - 10)  # a country code stays
        return entity[:code] + _same_shape(entity[code:], stream, _DIGITS if attempt < WIDER else _WIDE_DIGITS)
    new = _same_shape(entity, stream) + _grown(entity, attempt, stream)
    if kind.startswith("given_") and entity[-1:] < "ɐ":
        new = new[:-1] + ("a" if kind == "given_f" else "o" if kind == "given_m" else new[-1])
    return new


def _written(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's own format: its separators and its case."""
    if kind in ("card", "phone", "national", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    if kind in ("ip", "ipv6"):
        return new.upper() if kind == "ipv6" and mention != mention.lower() else new
    if mention.isupper() and len(mention) > 1:
        return new.upper()
    return "".join(n.upper() if i < len(mention) and mention[i].isupper() else n for i, n in enumerate(new))


def mentions(keyed: DataFrame) -> DataFrame:
    """(key, start, end, kind, entity) of every mention in every text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("key", "start", "end", "kind", "entity")}
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for m in find_mentions(text or ""):
                for name, value in zip(out, (key, *m), strict=True):
                    out[name].append(value)
        return out

    return map_batches(keyed, kernel, "key long, start int, end int, kind string, entity string")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate), distinct within each kind (all names count as one) and apart from all entities of the kind.
    Initials are permuted: they are distinct as they are, and may stand for letters that occur."""
    among = F.when(F.col("kind").startswith("given_"), "surname").otherwise(F.col("kind"))

    def propose(entities: DataFrame) -> DataFrame:
        def kernel(batches):
            for batch in batches:
                rows = zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist(), batch.column("attempt").to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, e, a, key) for k, e, a in rows], pa.string())], names=["kind", "entity", "attempt", "surrogate"])

        return entities.select("kind", "entity", "attempt").mapInArrow(kernel, "kind string, entity string, attempt int, surrogate string")

    entities = found.groupBy("kind", "entity").agg(F.lit(0).alias("attempt"))
    most = found.count()  # of all frames below
    now = durable(propose(entities), rows=most)
    real = now.select(among.alias("among"), F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
    while True:
        each = now.withColumn("among", among)
        first = each.groupBy("among", "surrogate").agg(F.min(F.struct(F.col("attempt") * -1, "entity", "kind")).alias("keeper"))
        checked = each.join(first, ["among", "surrogate"]).join(real, ["among", "surrogate"], "left")
        other = (F.col("entity") != F.col("keeper.entity")) | (F.col("kind") != F.col("keeper.kind"))
        clash = (F.col("kind") != "initial") & (other | F.coalesce("real", F.lit(False)))
        marked = durable(checked.select("kind", "entity", "attempt", "surrogate", clash.alias("clash")), rows=most)
        if not marked.where("clash").limit(1).count():
            return marked.select("kind", "entity", "surrogate")
        fine = marked.where("not clash").select("kind", "entity", "attempt", "surrogate")
        again = propose(marked.where("clash").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        now = durable(fine.unionByName(again), rows=most)


_RESULT = "key long, doc_id long, text string, n_entities int, spans string"


def _replace(batch: pa.RecordBatch) -> dict:
    texts, counts, spans = [], [], []
    for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
        out, last = [], 0
        items = sorted(items or [], key=lambda x: x["start"])
        for x in items:
            out += [text[last : x["start"]], _written(x["kind"], text[x["start"] : x["end"]], x["surrogate"])]
            last = x["end"]
        texts.append("".join([*out, text[last:]]) if text is not None else None)
        counts.append(len(items))
        spans.append(",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in items))
    return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "text": texts, "n_entities": counts, "spans": spans}


def pseudonymize(documents: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, text, n_entities, spans) of every row: spans are kind:start:end in the original text."""
    keyed = with_key(documents)
    found = durable(mentions(keyed).dropDuplicates(["key", "start"]), of=keyed)
    table = surrogates(found, key)
    items = durable(found.join(table, ["kind", "entity"]).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("items")), of=keyed)
    members = key_bitmap(items.select("key"))
    plain = chosen(keyed, members, False).withColumns({"n_entities": F.lit(0), "spans": F.lit("")})
    changed = map_batches(chosen(keyed, members, True).join(items.hint("shuffle_hash"), "key", "left"), _replace, _RESULT)
    return plain.unionByName(changed)


def pseudonymized_documents(documents: DataFrame, key: str) -> DataFrame:
    """The documents with surrogates in place and n_chars counted anew where the text changed; other columns as they were."""
    new = pseudonymize(documents, key).where("n_entities > 0").select(F.col("key").alias("__key"), F.col("text").alias("__text")).dropDuplicates(["__key"])
    keyed = documents.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    out = keyed.join(new.hint("shuffle_hash"), "__key", "left").withColumn("text", F.coalesce("__text", "text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__text").isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
