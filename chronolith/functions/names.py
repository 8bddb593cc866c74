"""Name similarity: Jaro-Winkler and edit distance must agree. Spark has no Jaro-Winkler, so it is an Arrow UDF."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for j, c in enumerate(b) if used[j]]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return base + 0.1 * common * (1 - base) if base > 0.7 else base


def edit_similarity(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    longest = max(len(a), len(b))
    first, most = 0, min(len(a), len(b))  # what both begin or end with costs no edit
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / longest


@functools.lru_cache(4096)
def _forms(name: str) -> tuple[str, str, str]:
    """A name in small letters, its letters and digits alone, and its words in order."""
    low = name.lower()
    return low, "".join(c for c in low if c.isalnum()), " ".join(sorted(low.split()))


def similarity(a: str, b: str) -> float:
    """1 for names equal but for punctuation, spaces or word order; else the lesser of the two measures."""
    edit = _edit_bound(a, b)
    (a, bare_a, sorted_a), (b, bare_b, sorted_b) = _forms(a), _forms(b)
    if not bare_a or not bare_b:
        return min(jaro_winkler(a, b), edit)
    if bare_a == bare_b or sorted_a == sorted_b:
        return 1.0
    return min(max(jaro_winkler(sorted_a, sorted_b), jaro_winkler(bare_a, bare_b)), edit)


def _edit_bound(a: str, b: str) -> float:
    """At least ``similarity``: its edit measure."""
    (a, bare_a, sorted_a), (b, bare_b, sorted_b) = _forms(a), _forms(b)
    if not bare_a or not bare_b:
        return edit_similarity(a, b)
    return 1.0 if bare_a == bare_b or sorted_a == sorted_b else edit_similarity(bare_a, bare_b)


def closest(name: str, others: list[tuple[float, int, str]], least: float) -> tuple[float, int]:
    """(score, number) of the most similar of the names, given as (bound of the score, number, name); of equal ones the
    lowest number, and (0, 0) where none reaches ``least``.

    Names are tried in the order of their bounds, and no further than one can still be better.
    """
    best = (0.0, 0)
    for bound, number, other in sorted(others, key=lambda x: -x[0]):
        if bound < max(best[0], least):
            break
        edit = (_edit_bound(name, other), -number)
        if edit[0] >= least and edit > best:
            score = similarity(name, other)
            if score >= least:
                best = max(best, (score, -number))
    return best[0], -best[1]


def similarity_bound(a: Column, b: Column) -> Column:
    """At least ``similarity``, in the engine: the edit measure, or 1 for names that are equal but for punctuation, spaces
    or word order."""
    a, b = F.lower(a), F.lower(b)
    bare_a, bare_b = (F.regexp_replace(s, r"[^\p{L}\p{N}]", "") for s in (a, b))
    words_a, words_b = (F.array_sort(F.split(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")) for s in (a, b))

    def edit(x: Column, y: Column) -> Column:
        return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))

    return F.when((bare_a == "") | (bare_b == ""), edit(a, b)).when((bare_a == bare_b) | (words_a == words_b), F.lit(1.0)).otherwise(edit(bare_a, bare_b))


def name_similarity(a: Column, b: Column) -> Column:
    """``similarity`` as a column."""

    @F.pandas_udf("double")
    def measure(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return measure(a, b)
