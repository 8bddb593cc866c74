"""Byte-level substring dedup with suffix order and longest-previous-factor arrays.

A byte goes when a ``length``-byte string that covers it also starts anywhere else (or, with
``keep_first``, starts anywhere before). Suffix order over the whole corpus is not sortable in one
place, so suffixes meet only where equal strings can be:

1. *Anchors.* In every ``length``-byte window the 32-byte gram of least hash (the leftmost of equal
   ones) is its anchor, so equal windows have equal anchors at equal offsets; anchors are about 2
   in 170 of the positions. An anchor's context is the bytes of the windows that it stands for.
   Anchors are dealt by hash with a digest of their context; those that occur once are dropped.
2. *Pre-aggregation.* Equal contexts are counted, not gathered: all their windows are repeats,
   however many thousand copies there are, and one of them stands for all.
3. *Suffix order.* Anchors with more than one distinct context send each distinct context once.
   Contexts of some anchors together are one string with ends; ranks of short prefixes, combined
   into ranks of prefixes several times as long, order its suffixes by their first ``length`` bytes.
   In suffix order the previous and the next smaller position in the corpus of a suffix give its
   longest previous factor; a factor of ``length`` is an earlier match, and the same array over the
   reversed positions (the longest next factor) a later one.
4. *Cut.* Matched windows go back to their documents, whose covered bytes are removed.

Memory: a reducer holds one hash range of anchors, or of distinct contexts; ranges grow in number
with the input. Defined results: null text is empty; strings never cross rows; repeated rows match
each other; texts shorter than ``length`` stay whole; rows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.dealing import chosen, deal, joined, key_bitmap, only_chosen, owners_of, part_of, split, with_key
from chronolith.llm.frames import durable, map_batches, parts_for
from chronolith.llm.kernels import _CODES, U64, mix, powers, text_bytes

LENGTH = 200
GRAM = 32
RANGE_BYTES = 4 << 20
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def sliding(value: np.ndarray, width: int, pick: np.ufunc, neutral) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by block-wise running extremes."""
    n = len(value) - width + 1
    if n <= 0:
        return value[:0]
    rows = -(-len(value) // width)
    grid = np.full(rows * width, neutral, value.dtype)
    grid[: len(value)] = value
    grid = grid.reshape(rows, width)
    ahead = pick.accumulate(grid, axis=1).reshape(-1)
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


_PLACE_BITS = 24


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, hash, context digest, first window, windows) of every anchor of the batch.

    A longer buffer is worked on in overlapping pieces. Where one ends, an anchor's windows become two contexts,
    which changes nothing: every window is in one context with all its bytes. Windows are numbered within their text. A sliding minimum over (hash, place) packed into 64 bits
    finds every window's anchor at once; equal consecutive minima are one anchor's windows.
    """
    if len(data) <= PIECE + length:
        return _anchors(data, offsets, length)
    parts = []
    for lo in range(0, len(data) - length + 1, PIECE):  # windows that start in [lo, lo + PIECE)
        hi = min(len(data), lo + PIECE + length - 1)
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        row, value, digest, at, windows = _anchors(data[lo:hi], np.r_[0, inner, hi - lo], length)
        # texts of the piece are counted from the one that holds its first byte; empty ones count too
        begin = np.r_[lo, inner + lo][row]
        whole = np.searchsorted(offsets, begin, side="right") - 1
        parts.append((whole, value, digest, at + begin - offsets[whole], windows))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


#: Bytes whose windows are anchored at once: the arrays take some 60 bytes for each.
PIECE = 4 << 20


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    n, many = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(U64), none.view(U64), none, none
    up, down = powers(n + 1)
    bits = U64(max(_PLACE_BITS, n.bit_length()))
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, U64)
        np.cumsum(_CODES[data] * up[:n], out=run[1:])
        value = mix((run[GRAM:] - run[:-GRAM]) * down[: n - GRAM + 1])
        packed = (value >> bits << bits) | np.arange(len(value), dtype=U64)
        least = sliding(packed, many, np.minimum, _TOP)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        whole = np.arange(len(least)) + length <= ends[: len(least)]  # windows within one text
        opens = whole.copy()
        opens[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        first = np.flatnonzero(opens)
        last = np.flatnonzero(whole & np.r_[(least[1:] != least[:-1]) | ~whole[1:], True])
        at = (least[first] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        row = np.searchsorted(offsets, first, side="right") - 1
        end = last + length
        digest = mix((run[end] - run[first]) * down[first] + mix((at - first).astype(U64) * U64(1 << 20) + (end - first).astype(U64)))
    return row, value[at], digest, first - offsets[row], last - first + 1


def _place(first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First window and number of windows (below 256) in one number."""
    return first.astype(np.uint64) << U64(8) | windows.astype(np.uint64)


def _windows_at(places: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(places, np.uint64)
    return (both >> U64(8)).astype(np.int64), (both & U64(255)).astype(np.int64)


def _anchor_kernel(length: int):
    def kernel(batch: pa.RecordBatch) -> list:
        row, value, digest, at, windows = anchors(*text_bytes(batch.column("text")), length)
        return [value, digest, _place(at, windows), row, batch.column("key").to_numpy(), batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()]

    return kernel


def _emit_anchors(parts: int):
    def emit(gathered: list[list]):
        base = np.cumsum([0, *(len(g[4]) for g in gathered)])
        value, digest, at = (joined([g[i] for g in gathered], kind) for i, kind in ((0, U64), (1, U64), (2, U64)))
        owner = joined([g[3] + b for g, b in zip(gathered, base, strict=False)], np.int64)
        key, doc = joined([g[4] for g in gathered], np.int64), joined([g[5] for g in gathered], np.int64)
        for part, (v, d, p, o) in split(part_of(value, parts), [value, digest, at, owner]):
            local, (keys, docs) = owners_of(o, key, doc)
            yield part, v.tobytes(), d.tobytes(), p.tobytes(), local.tobytes(), keys.tobytes(), docs.tobytes()

    return emit


_ANCHOR_ROWS = "part int, anchors binary, digests binary, places binary, owner binary, keys binary, docs binary"
_FULL, _SEND, _FIRST = 1, 2, 4
_ANSWER_ROWS = "part int, anchors binary, places binary, flags binary, keys binary"


def _table(schema: str, out: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.table({n: pa.array([r[i] for r in out], kinds[k]) for i, (n, k) in enumerate(fields)})


def _repeated_anchors(parts: int):
    """Reducer of one hash range: what became of each repeated anchor's occurrence, dealt to its text.

    FULL: its context occurs elsewhere too. SEND: its anchor has other contexts, and it stands for
    its own. FIRST: it is the first occurrence of its context.
    """

    def reduce(table: pa.Table) -> pa.Table:
        value, digest, at, key, doc = [], [], [], [], []
        for v, d, p, o, k, i in zip(*(table.column(n).to_pylist() for n in ("anchors", "digests", "places", "owner", "keys", "docs")), strict=True):
            own = np.frombuffer(o, np.uint32)
            value.append(np.frombuffer(v, U64))
            digest.append(np.frombuffer(d, U64))
            at.append(np.frombuffer(p, U64))
            key.append(np.frombuffer(k, np.int64)[own])
            doc.append(np.frombuffer(i, np.int64)[own])
        value, digest, at, key, doc = joined(value, U64), joined(digest, U64), joined(at, U64), joined(key, np.int64), joined(doc, np.int64)
        order = np.argsort(value)
        head = np.r_[True, value[order][1:] != value[order][:-1]] if len(value) else np.zeros(0, bool)
        run = np.cumsum(head) - 1
        order = order[np.bincount(run)[run] > 1] if len(run) else order
        value, digest, at, key, doc = value[order], digest[order], at[order], key[order], doc[order]
        if not len(value):
            return _table(_ANSWER_ROWS, [])
        order = np.lexsort((at, key, doc, digest, value))
        value, digest, at, key, doc = value[order], digest[order], at[order], key[order], doc[order]
        group = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1
        first = np.r_[True, (value[1:] != value[:-1]) | (digest[1:] != digest[:-1])]
        context = np.cumsum(first) - 1
        flags = (np.bincount(context)[context] > 1) * _FULL + (first & (np.bincount(group, first)[group] > 1)) * _SEND + first * _FIRST
        keep = flags & (_FULL | _SEND) > 0
        return _table(_ANSWER_ROWS, [(part, v.tobytes(), a.tobytes(), f.tobytes(), k.tobytes()) for part, (v, a, f, k) in split(part_of(key[keep].view(U64), parts), [value[keep], at[keep], flags[keep].astype(np.uint8), key[keep]])])

    return reduce


def _by_key(names: list[tuple[str, type]], schema: str):
    """Gather one range's packed rows into one row for each key."""

    def reduce(table: pa.Table) -> pa.Table:
        key = joined([np.frombuffer(v, np.int64) for v in table.column("keys").to_pylist()], np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        columns = [joined([np.frombuffer(v, kind) for v in table.column(n).to_pylist()], kind)[order] for n, kind in names]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=False))
        return _table(schema, [(int(key[a]), *(c[a:b].tobytes() for c in columns)) for a, b in cuts])

    return reduce


def _send_contexts(length: int, parts: int):
    """The contexts that stand for their equals, cut from the texts and dealt by their anchor."""

    def kernel(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for i, (places, flags, values) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("places", "flags", "anchors")), strict=True)):
            flag = np.frombuffer(flags, np.uint8)
            chosen_ones = np.flatnonzero(flag & _SEND)
            if not len(chosen_ones):
                continue
            value = np.frombuffer(values, U64)[chosen_ones]
            start, windows = (x[chosen_ones] for x in _windows_at(places))
            end = start + windows - 1 + length
            key, doc = batch.column("key")[i].as_py(), batch.column("doc_id")[i].as_py()
            body = data[offsets[i] : offsets[i + 1]]
            for v, s, e, f in zip(value.tolist(), start.tolist(), end.tolist(), flag[chosen_ones].tolist(), strict=True):
                out.append((v, body[s:e].tobytes(), s, f, key, -(1 << 63) if doc is None else doc))
        return [np.zeros(sum(len(r[1]) for r in out) // 16, np.uint8), out]

    def emit(gathered: list[list]):
        every = [r for g in gathered for r in g[1]]
        value = np.array([r[0] for r in every], U64)
        for part, (index,) in split(part_of(value, parts), [np.arange(len(every))]):
            own = [every[i] for i in index.tolist()]
            yield part, value[index].tobytes(), b"".join(r[1] for r in own), np.array([len(r[1]) for r in own], np.uint32).tobytes(), np.array([r[2] for r in own], np.int64).tobytes(), np.array([r[3] for r in own], np.uint8).tobytes(), np.array([r[4] for r in own], np.int64).tobytes(), np.array([r[5] for r in own], np.int64).tobytes()

    return kernel, emit


_CONTEXT_ROWS = "part int, anchors binary, data binary, sizes binary, starts binary, flags binary, keys binary, docs binary"


def suffix_ranks(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes with ``length`` bytes left in their string, and their rank by these bytes.

    Equal ranks mean equal bytes; the order of ranks is the order of the suffixes. The first prefix is
    as many bytes as fit in 63 bits; each step packs the ranks of as many consecutive prefixes as
    fit, and sorts once.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(len(data))
    letters, letter = np.unique(data, return_inverse=True)
    bits = int(len(letters)).bit_length()
    depth = min(length, 63 // bits)
    wide = np.zeros(len(data) + depth, np.int64)
    wide[: len(data)] = letter + 1
    rank = np.zeros(len(data), np.int64)
    for i in range(depth):
        rank = rank << bits | np.where(left > i, wide[i : i + len(data)], 0)
    rank = _dense(rank)
    while True:
        bits = int(rank.max(initial=0) + 1).bit_length()
        times = max(2, 63 // bits)
        if 2 * bits > 63:
            raise ValueError("too many suffixes at once")
        if times * depth >= length:
            break
        more = rank + 1
        for i in range(1, times):
            more = more << bits | _shifted(rank, left, i * depth)
        rank, depth = _dense(more), times * depth
    starts = np.flatnonzero(left >= length)
    out = rank[starts] + 1
    at = 0
    while at + depth < length:  # the last prefix may overlap the one before
        at = min(at + depth, length - depth)
        out = out << bits | (rank[starts + at] + 1)
    return starts, _dense(out)


def _shifted(rank: np.ndarray, left: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(rank), np.int64)
    inside = np.flatnonzero(left > by)
    out[inside] = rank[inside + by] + 1
    return out


def _dense(value: np.ndarray) -> np.ndarray:
    order = np.argsort(value)
    ranked = value[order]
    out = np.empty(len(value), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]) if len(value) else 0
    return out


def common_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many of the first ``most`` bytes from a[i] on equal those from b[i] on; both places have that many."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for step in range(most):
        live = live[data[a[live] + step] == data[b[live] + step]]
        if not len(live):
            break
        out[live] = step + 1
    return out


def longest_factors(position: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of every suffix: the most bytes that it shares with a suffix of smaller position.

    The suffixes come in suffix order; ``common[i]`` is what i shares with the one before. The longest previous
    factor is shared with the nearest smaller position on either side, and is the least ``common`` on the way
    there. All suffixes walk at once: one whose neighbour has a larger position goes on to where that
    neighbour has got to. Factors shorter than ``least`` count as 0, so walks end where less is shared.
    """
    back = _to_smaller(position, common, least)
    ahead = _to_smaller(position[::-1], np.r_[common[:0], 0, common[:0:-1]][: len(common)], least)[::-1]
    return np.maximum(back, ahead)


def _to_smaller(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Bytes shared with the previous smaller position."""
    near, shared = np.arange(-1, len(position) - 1), common.copy()
    shared[:1] = 0
    live = np.flatnonzero(shared >= least)
    live = live[position[near[live]] > position[live]]
    while len(live):
        at = near[live]
        further, both = near[at], np.minimum(shared[live], shared[at])
        near[live], shared[live] = further, both
        live = live[both >= least]
        live = live[position[near[live]] > position[live]]
    return np.where(shared >= least, shared, 0)


_SPAN_ROWS = "part int, starts binary, counts binary, keys binary"


#: Bytes of contexts whose suffixes are sorted together; an anchor's contexts stay together beyond it.
SORTED_BYTES = 1 << 20


def _match_contexts(length: int, keep_first: bool, parts: int):
    """Reducer of one range of distinct contexts: runs of matched windows, dealt to their texts."""

    def some(data, sizes, begin, flags, key, doc):
        starts, rank = suffix_ranks(data, sizes, length)
        owner = np.repeat(np.arange(len(sizes)), sizes)[starts]
        place = begin[owner] + starts - (np.cumsum(sizes) - sizes)[owner]
        order = np.lexsort((place, key[owner], doc[owner]))
        position = np.empty(len(order), np.int64)
        fresh = np.ones(len(order), bool)
        for column in (place, key[owner]):
            fresh[1:] &= column[order][1:] == column[order][:-1]
        fresh[1:] = ~fresh[1:]
        position[order] = np.cumsum(fresh) - 1  # repeated rows send their windows twice: they count once
        rest = order[fresh]
        rest = rest[np.argsort(rank[rest])]
        # only whole windows matter, so neighbours of other rank (who share less) end a walk
        common = np.r_[np.zeros(min(1, len(rest)), np.int64), np.where(rank[rest][1:] == rank[rest][:-1], length, 0)]
        hit = longest_factors(position[rest], common, length) >= length
        if not keep_first:
            hit |= longest_factors(-position[rest], common, length) >= length
            hit &= flags[owner[rest]] & _FULL == 0
        return key[owner[rest[hit]]], place[rest[hit]]

    def reduce(table: pa.Table) -> pa.Table:
        names = (("anchors", U64), ("data", np.uint8), ("sizes", np.uint32), ("starts", np.int64), ("flags", np.uint8), ("keys", np.int64), ("docs", np.int64))
        value, data, sizes, begin, flags, key, doc = (joined([np.frombuffer(v, kind) for v in table.column(n).to_pylist()], kind) for n, kind in names)
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        order = np.argsort(value, kind="stable")
        upto = np.cumsum(sizes[order])
        fresh = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        lots, lot_start = [], 0
        for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(order)], strict=False):
            if a > lot_start and upto[b - 1] - (upto[lot_start - 1] if lot_start else 0) > SORTED_BYTES:
                lots.append((lot_start, a))
                lot_start = a
        if len(order):
            lots.append((lot_start, len(order)))
        keys, places = [], []
        for a, b in lots:
            own = order[a:b]
            index = np.repeat(ends[own] - sizes[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            k, p = some(data[index], sizes[own], begin[own], flags[own], key[own], doc[own])
            keys.append(k)
            places.append(p)
        k, p = joined(keys, np.int64), joined(places, np.int64)
        if not len(p):
            return _table(_SPAN_ROWS, [])
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)])
        count = np.diff(np.r_[cut, len(p)])
        return _table(_SPAN_ROWS, [(part, s.tobytes(), c.tobytes(), o.tobytes()) for part, (s, c, o) in split(part_of(k[cut].view(U64), parts), [p[cut], count, k[cut]])])

    return reduce


def matched_spans(keyed: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(key, places, flags, starts, counts): packed spans of each text with matched windows."""
    parts = parts_for(keyed, RANGE_BYTES)
    dealt = deal(keyed, _anchor_kernel(length), _emit_anchors(parts), _ANCHOR_ROWS)
    answers = dealt.groupBy("part").applyInArrow(_repeated_anchors(parts), _ANSWER_ROWS)
    answers = durable(answers.groupBy("part").applyInArrow(_by_key([("places", U64), ("flags", np.uint8), ("anchors", U64)], "key long, places binary, flags binary, anchors binary"), "key long, places binary, flags binary, anchors binary"), of=keyed)
    texts = chosen(keyed, key_bitmap(answers.select("key")), True).join(answers.hint("shuffle_hash"), "key")
    contexts = deal(texts, *_send_contexts(length, parts), _CONTEXT_ROWS)
    spans = contexts.groupBy("part").applyInArrow(_match_contexts(length, keep_first, parts), _SPAN_ROWS)
    spans = spans.groupBy("part").applyInArrow(_by_key([("starts", np.int64), ("counts", np.int64)], "key long, starts binary, counts binary"), "key long, starts binary, counts binary")
    return durable(answers.select("key", "places", "flags").join(spans, "key", "left"), of=keyed)


def covered(size: int, length: int, places: bytes, flags: bytes, starts: bytes | None, counts: bytes | None, keep_first: bool) -> np.ndarray:
    """Which of a text's bytes its matched windows cover."""
    edge = np.zeros(size + 1, np.int64)
    first, windows = _windows_at(places)
    flag = np.frombuffer(flags, np.uint8)
    whole = flag & _FULL > 0
    if keep_first:
        whole &= flag & _FIRST == 0
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, (first + windows - 1 + length)[whole], -1)
    if starts:
        first, many = np.frombuffer(starts, np.int64), np.frombuffer(counts, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + many - 1 + length, -1)
    return np.cumsum(edge)[:-1] > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, keep_first: bool, matched: bool):
    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch.column("text"))
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        spans = zip(*(batch.column(n).to_pylist() for n in ("places", "flags", "starts", "counts")), strict=True) if matched else None
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            body = data[a:b]
            gone = np.zeros(b - a, bool)
            if spans is not None:
                places, flags, starts, counts = next(spans)
                if places is not None:
                    gone = covered(b - a, length, places, flags, starts, counts, keep_first)
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
        return {"doc_id": batch.column("doc_id"), **out}

    return kernel


def remove_matches(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    keyed = with_key(documents)
    spans = matched_spans(keyed, length, keep_first)
    members = key_bitmap(spans.select("key"))
    plain = map_batches(keyed, _cut(length, keep_first, False), _RESULT, only=only_chosen(members, False))
    cut = map_batches(chosen(keyed, members, True).join(spans.hint("shuffle_hash"), "key", "left"), _cut(length, keep_first, True), _RESULT)
    return plain.unionByName(cut)
