"""Text functions as columns; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a question about relations.
RELATIONAL_CUES = ("depends on", "depend on", "relies on", "what does", "which crate", "which project", "which component", "which module", "who maintains", "part of", "supersedes", "superseded")


def stripped(text: Column) -> Column:
    """Without (Unicode) white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits of at least two UTF-8 bytes."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: F.octet_length(w) >= 2)


def _accented() -> tuple[str, str]:
    """All accented small letters of the Latin, Greek and Cyrillic blocks, and what they are without marks."""
    pairs = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and chr(code).islower() and all(unicodedata.combining(c) for c in plain[1:]):
            pairs[chr(code)] = plain[0]
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _accented()


def folded_tokens(text: Column) -> Column:
    """Search tokens without accents, written as one letter or as a letter and combining marks."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\u0300-\u036f]", "")
    return tokens(F.translate(bare, _ACCENTED, _PLAIN))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words between (Unicode) white space."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; two empty ones are alike, one empty one shares nothing."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def normalized_label(text: Column) -> Column:
    """Lower-cased with single spaces, for comparing labels and aliases."""
    return F.lower(F.regexp_replace(stripped(text), r"(?U)\s+", " "))


def snippet(text: Column, length: int = 240) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def round2(value: Column) -> Column:
    return F.round(value, 2)


def looks_like_identifier(query: Column) -> Column:
    """snake_case, an inner change from lower to upper case, a path, ``::``, ``!`` or a backtick."""
    return query.rlike(r"::|!|`|[A-Za-z0-9]_[A-Za-z0-9]|[a-z][A-Z]|[A-Za-z0-9]/")


def looks_relational(query: Column) -> Column:
    return F.lower(query).rlike("|".join(RELATIONAL_CUES))


def intent(query: Column) -> Column:
    return F.when(looks_like_identifier(query), "lookup").when(looks_relational(query), "relational").otherwise("content")


def answer_leaks(query: Column, key: Column) -> Column:
    """The query names its answer: it holds the key's last path part before any ``#``, when that has four bytes or more."""
    tail = F.lower(F.trim(F.substring_index(F.substring_index(key, "/", -1), "#", 1)))
    return (F.octet_length(tail) >= 4) & F.contains(F.lower(query), tail)


def json_preview(value: Column, length: int = 120) -> Column:
    """(digest, bytes, preview) of a value's JSON or text."""
    text = value.cast("string")
    return F.struct(F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("bytes"), F.substring(text, 1, length).alias("preview"))


def framed_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each framed by its length in bytes, so that no two lists of parts run together; null is a part of its own."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def qualified_id(space: Column, logical: Column) -> Column:
    """One id for a logical id within a space."""
    return F.substring(framed_digest(space, logical), 1, 32)


def path_allowed(path: Column, extensions: list[str], ignored_dirs: list[str], max_bytes: int | None = None, size: Column | None = None) -> Column:
    """A file belongs to a scan: its extension is listed (any case), no folder on its path is ignored, it is not too large."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    fine = end.isin([e.lower().lstrip(".") for e in extensions])
    for folder in ignored_dirs:
        fine &= ~F.contains(path, F.lit(f"/{folder}/"))
    return fine & (size <= max_bytes) if max_bytes is not None and size is not None else fine
