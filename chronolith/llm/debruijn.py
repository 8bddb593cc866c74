"""Cross-document removal of repeated word windows by a compacted de Bruijn graph.

A window of ``width`` consecutive words is an edge from the node of its first ``width - 1`` words
to the node of its last ``width - 1``; an edge is repeated when at least two doc_ids have it.

1. *Edges.* Every document's distinct windows are dealt by hash range; a range's reducer finds the
   repeated edges and the colour of each (a digest of its set of doc_ids), and answers the documents
   that have them.
2. *Pieces.* Every document of a colour has all edges of that colour, so each finds the same
   nonbranching paths among them (a node with one edge in and one out, counted within the colour).
   A piece is such a path, named by a 128-bit digest of the very words that it spells at its place in
   the document; with it go its end nodes, its coordinates and all runs of the text along it.
3. *Compaction.* Spark groups equal pieces, the smallest (doc_id, place) becoming their source, and joins
   the pieces' end nodes: where exactly one distinct piece ends and exactly one begins, they are chained,
   and pointer doubling names every chain (``paths``). A closed chain stays single pieces.
4. *Verification and cut.* A document's runs along one path are merged to long spans. Only pieces whose words
   equal the words at the source's coordinates share a source, so a chance collision of window hashes
   removes nothing. Words covered by spans whose source has a smaller doc_id go.

Defined results: null text has no words; a text shorter than a window keeps all words; rows of one
doc_id are one document (neither removes words of the other; where such rows have different texts, the
edges of their colours are pieces of their own) and rows without doc_id are never a source nor lose
words; windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.dealing import chosen, deal, in_bitmap, joined, key_bitmap, only_chosen, owners_of, part_of, split, with_key
from chronolith.llm.frames import durable, map_batches, parts_for
from chronolith.llm.kernels import U64, mix, shingles, text_bytes, words_of

WIDTH = 13
#: Bytes of input files for each hash range.
RANGE_BYTES = 2 << 20


def _windows(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """[window hash, row of the batch, doc_id of each row] of all windows of texts with a doc_id."""
    w = words_of(*text_bytes(batch.column("text")))
    value = shingles(w.hash, width)
    count = np.diff(w.first)
    inside = np.maximum(count - width + 1, 0)
    row = np.repeat(np.arange(batch.num_rows), inside)
    at = np.arange(int(inside.sum())) + np.repeat(w.first[:-1] - (np.cumsum(inside) - inside), inside)
    doc = batch.column("doc_id")
    known = np.asarray(doc.is_valid())
    keep = known[row]
    return [value[at][keep], row[keep], doc.fill_null(0).to_numpy()]


def _emit_windows(parts: int):
    def emit(gathered: list[list[np.ndarray]]):
        base = np.cumsum([0, *(len(g[2]) for g in gathered)])
        value = joined([g[0] for g in gathered], U64)
        owner = joined([g[1] + b for g, b in zip(gathered, base, strict=False)], np.int64)
        doc = joined([g[2] for g in gathered], np.int64)
        for part, (v, o) in split(part_of(value, parts), [value, owner]):
            local, (docs,) = owners_of(o, doc)
            small = local.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)
            # the range is known, so seven of eight bytes name a window in it
            yield part, v.view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), small.tobytes(), small.itemsize, docs.tobytes()

    return emit


def _repeated(parts: int, several: np.ndarray):
    """Reducer of one hash range: repeated windows and their colours, dealt to their owners.

    The lowest bit of a colour is set where a doc_id of it may have several texts (``several``, a bitmap).
    """

    def reduce(table: pa.Table) -> pa.Table:
        values, owners, docs, base = [], [], [], 0
        for v, o, size, d in zip(*(table.column(n).to_pylist() for n in ("windows", "owner", "owner_size", "docs")), strict=True):
            wide = np.zeros((len(v) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(v, np.uint8).reshape(-1, 7)
            values.append(wide.view(U64).reshape(-1))
            owners.append(np.frombuffer(o, np.uint16 if size == 2 else np.uint32).astype(np.int64) + base)
            docs.append(np.frombuffer(d, np.int64))
            base += len(docs[-1])
        value, owner, doc = joined(values, U64), joined(owners, np.int64), joined(docs, np.int64)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        head = np.r_[True, value[1:] != value[:-1]]
        run = np.cumsum(head) - 1
        many = np.bincount(run)[run] > 1
        value, owner, run = value[many], owner[many], run[many]
        order = np.lexsort((doc[owner], run))
        value, owner, run = value[order], owner[order], run[order]
        ids = doc[owner]
        head = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
        fresh = head.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        group = np.cumsum(head) - 1
        start = np.flatnonzero(head)
        with np.errstate(over="ignore"):
            sums = np.r_[U64(0), np.cumsum(np.where(fresh, mix(ids.view(U64)), U64(0)))]
            colour = mix(sums[np.r_[start[1:], len(ids)]] - sums[start])
        loose = np.logical_or.reduceat(in_bitmap(several, ids), start) if len(start) else np.zeros(0, bool)
        colour = ((colour >> U64(1) << U64(1)) | loose.astype(U64))[group]
        # a document is answered once for each of its windows
        shared = fresh & (np.bincount(group, fresh)[group] > 1) if len(group) else np.zeros(0, bool)
        out = []
        for part, (v, o, c) in split(part_of(ids[shared].view(U64), parts), [value[shared], ids[shared], colour[shared]]):
            used, local = np.unique(o, return_inverse=True)
            by = np.argsort(local, kind="stable")
            colours, which = np.unique(c[by], return_inverse=True)
            out.append((part, _seven(v[by]), which.astype(np.uint32).tobytes(), colours.tobytes(), np.bincount(local).astype(np.uint32).tobytes(), used.tobytes()))
        return _arrow(_FOUND, out)

    return reduce


def _seven(value: np.ndarray) -> bytes:
    """Seven of eight bytes name a window in its range."""
    return value.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _arrow(schema: str, out: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.table({n: pa.array([r[i] for r in out], kinds[k]) for i, (n, k) in enumerate(fields)})


_FOUND = "part int, windows binary, which binary, colours binary, sizes binary, keys binary"
_ANSWERS = "doc_id long, windows binary, which binary, colours binary"


def _by_owner(table: pa.Table) -> pa.Table:
    """All answers to each owner of one range, as one row: windows (7 of 8 bytes), and for each the number
    of its colour among the owner's distinct colours."""
    keys, windows, colours = [], [], []
    for v, w, c, s, k in zip(*(table.column(n).to_pylist() for n in ("windows", "which", "colours", "sizes", "keys")), strict=True):
        keys.append(np.repeat(np.frombuffer(k, np.int64), np.frombuffer(s, np.uint32)))
        windows.append(np.frombuffer(v, np.uint8).reshape(-1, 7))
        colours.append(np.frombuffer(c, U64)[np.frombuffer(w, np.uint32)])
    key, window = joined(keys, np.int64), np.concatenate(windows) if windows else np.zeros((0, 7), np.uint8)
    order = np.argsort(key, kind="stable")
    key, window, colour = key[order], window[order], joined(colours, U64)[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=False):
        distinct, which = np.unique(colour[a:b], return_inverse=True)
        out.append((int(key[a]), window[a:b].tobytes(), which.astype(np.uint16 if len(distinct) < 1 << 16 else np.uint32).tobytes(), distinct.tobytes()))
    return _arrow(_ANSWERS, out)


def repeated_windows(keyed: DataFrame, width: int) -> DataFrame:
    """(doc_id, windows, which, colours): for each document with repeated windows, which they are and their colours.

    Texts of one doc_id share their answers: a text looks up only the windows that it has.
    """
    parts = parts_for(keyed, RANGE_BYTES)
    texts = keyed.where("doc_id is not null").groupBy(F.col("doc_id").alias("owner")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    several = key_bitmap(texts.where("lo < hi").select(F.col("owner").alias("key")))
    dealt = deal(keyed, lambda batch: _windows(batch, width), _emit_windows(parts), "part int, windows binary, owner binary, owner_size int, docs binary")
    found = dealt.groupBy("part").applyInArrow(_repeated(parts, several), _FOUND)
    return found.groupBy("part").applyInArrow(_by_owner, _ANSWERS)


_PIECES = "key long, doc_id long, piece binary, head long, tail long, edges long, start long, runs binary"


def _answered(windows: bytes, which: bytes, colours: bytes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a text's edges are repeated, and the colours of those."""
    raw = np.frombuffer(windows, np.uint8).reshape(-1, 7)
    known = np.zeros((len(raw), 8), np.uint8)
    known[:, :7] = raw
    known = known.view(U64).reshape(-1)
    order = np.argsort(known)
    known = known[order]
    short = edge & U64((1 << 56) - 1)
    place = np.minimum(np.searchsorted(known, short), len(known) - 1)
    hit = np.flatnonzero(known[place] == short)
    number = np.frombuffer(which, np.uint16 if len(which) == 2 * len(raw) else np.uint32)
    return hit, np.frombuffer(colours, U64)[number[order[place[hit]]]]


def unitigs(head: np.ndarray, tail: np.ndarray, edge: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first edge, place) of each edge on its maximal nonbranching path; a closed path begins at its least edge.

    ``head`` and ``tail`` are the nodes of distinct edges, ``alone`` the edges that stay paths of their own.
    """
    n = len(head)
    by_head, by_tail = np.argsort(head), np.sort(tail)
    sorted_head = head[by_head]
    left = np.searchsorted(sorted_head, tail)
    out = np.searchsorted(sorted_head, tail, side="right") - left
    into = np.searchsorted(by_tail, tail, side="right") - np.searchsorted(by_tail, tail)
    after = by_head[np.minimum(left, n - 1)] if n else left
    chained = np.flatnonzero((out == 1) & (into == 1) & (after != np.arange(n)) & ~alone)
    chained = chained[~alone[after[chained]]]
    up = np.arange(n)
    up[after[chained]] = chained

    def doubled() -> tuple[np.ndarray, np.ndarray]:
        above, place = up.copy(), (up != np.arange(n)).astype(np.int64)
        for _ in range(max(1, n).bit_length()):
            further = above[above]
            if (further == above).all():
                break
            place += place[above]
            above = further
        return above, place

    first, place = doubled()
    closed = np.flatnonzero(up[first] != first)
    if len(closed):
        least, ahead = edge.copy(), up.copy()
        for _ in range(n.bit_length()):
            least = np.minimum(least, least[ahead])
            ahead = ahead[ahead]
        cut = closed[edge[closed] == least[closed]]
        up[cut] = cut
        first, place = doubled()
    return first, place


def _pieces(width: int):
    """The pieces of every text, with their runs in it."""

    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch.column("text"))
        w = words_of(data, offsets)
        edges, nodes = shingles(w.hash, width), shingles(w.hash, width - 1)
        at, rows, colours = [], [], []
        for i, answer in enumerate(zip(*(batch.column(n).to_pylist() for n in ("windows", "which", "colours")), strict=True)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= width:
                hit, colour = _answered(*answer, edges[a : b - width + 1])
                at.append(hit + a)
                rows.append(np.full(len(hit), i))
                colours.append(colour)
        at, row, colour = joined(at, np.int64), joined(rows, np.int64), joined(colours, U64)
        order = np.lexsort((at, edges[at], row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (row[order][1:] != row[order][:-1]) | (edges[at[order]][1:] != edges[at[order]][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1  # of each occurrence: its distinct edge
        one = order[fresh]  # its first occurrence
        where = at[one]
        with np.errstate(over="ignore"):
            inside = mix(colour[one] + mix(row[one].astype(U64)))
            first, place = unitigs(mix(nodes[where] ^ inside), mix(nodes[where + 1] ^ inside), edges[where], (colour[one] & U64(1)).astype(bool))
        by = np.lexsort((place, first))
        cut = np.flatnonzero(np.r_[True, first[by][1:] != first[by][:-1]]) if len(by) else np.zeros(0, np.int64)
        stop = np.r_[cut[1:], len(by)]
        spelled = where[by]
        # runs: occurrences in text order that go on along one piece
        opens = np.ones(len(at), bool)
        opens[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (first[number[1:]] != first[number[:-1]]) | (place[number[1:]] != place[number[:-1]] + 1)
        begin = np.flatnonzero(opens)
        length = np.diff(np.r_[begin, len(at)])
        owner = first[number[begin]]
        by_owner = np.argsort(owner, kind="stable")
        spans = np.stack([at[begin] - w.first[row[begin]], length], axis=1)[by_owner]
        heads = first[by][cut]
        lo, hi = np.searchsorted(owner[by_owner], heads), np.searchsorted(owner[by_owner], heads, side="right")
        raw = data.tobytes()
        names = []
        for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
            s, e = int(spelled[a]), int(spelled[b - 1])
            if e - s == b - a - 1 and (spelled[a:b] == np.arange(s, e + 1)).all():
                text = b" ".join(raw[w.start[s] : w.end[e + width - 1]].split())
            else:
                words = [*range(s, s + width), *(spelled[a + 1 : b] + width - 1).tolist()]
                text = b" ".join([raw[w.start[x] : w.end[x]] for x in words])
            names.append(hashlib.blake2b(text, digest_size=16).digest())
        of = row[one][by][cut]
        return {
            "key": batch.column("key").to_numpy()[of],
            "doc_id": batch.column("doc_id").to_numpy()[of],
            "piece": names,
            "head": nodes[spelled[cut]].view(np.int64) if len(cut) else [],
            "tail": nodes[spelled[stop - 1] + 1].view(np.int64) if len(cut) else [],
            "edges": stop - cut,
            "start": [int(spans[a][0]) for a in lo.tolist()],
            "runs": [spans[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)],
        }

    return kernel


def pieces(keyed: DataFrame, answers: DataFrame, members: np.ndarray, width: int) -> DataFrame:
    """(key, doc_id, piece, head, tail, edges, start, runs) of every piece in every text."""
    texts = chosen(keyed, members, True, "doc_id").join(answers.hint("shuffle_hash"), "doc_id")
    return map_batches(texts, _pieces(width), _PIECES)


def paths(distinct: DataFrame) -> DataFrame:
    """(piece, path, place): compacted nonbranching paths of distinct pieces (piece, head, tail).

    A node where one distinct piece ends and one begins joins the two. Pointer doubling along these links
    names each path by its first piece. Every round settles some pieces of each open chain; when no
    more settle, the rest are closed chains, which are left as single pieces.
    """
    leaving = distinct.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("out"), F.min("piece").alias("next"))
    entering = distinct.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("into"), F.min("piece").alias("before"))
    links = leaving.join(entering, "node").where("out = 1 and into = 1 and next <> before").select(F.col("next").alias("piece"), F.col("before").alias("up"))
    n = distinct.count()
    linked = distinct.select("piece").join(links, "piece", "left")
    state = durable(linked.select("piece", F.coalesce("up", "piece").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.lit(True).alias("open")), rows=n)
    before = None
    while True:
        above = state.select(F.col("piece").alias("up"), F.col("up").alias("upper"), F.col("place").alias("more"))
        state = durable(state.join(above, "up").select("piece", F.col("upper").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("open")), rows=n)
        moving = state.where("open").count()
        if moving in (0, before):
            break
        before = moving
    return state.select("piece", F.when(F.col("open"), F.col("piece")).otherwise(F.col("up")).alias("path"), F.when(F.col("open"), 0).otherwise(F.col("place")).alias("place"))


def repeated_spans(found: DataFrame) -> DataFrame:
    """(key, doc_id, path, place, source, runs): the pieces of every text that stand earlier in another document,
    by the compacted path they lie on. source is (doc_id, key, start), where the same words stand first."""
    distinct = found.groupBy("piece").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.min(F.struct("doc_id", "key", "start")).alias("source"))
    distinct = durable(distinct, rows=found.count())
    known = distinct.select("piece", "source").join(paths(distinct), "piece")
    return found.select("key", "doc_id", "piece", "runs").join(known, "piece").where("source.doc_id < doc_id").select("key", "doc_id", "path", "place", "source", "runs")


def _merged(items: list[dict]) -> np.ndarray:
    """Rows (start, edges) of a text's long spans: runs that go on along one path are one span."""
    paths_of = {p: i for i, p in enumerate(dict.fromkeys(x["path"] for x in items))}
    runs = [np.frombuffer(x["runs"], np.int64).reshape(-1, 2) for x in items]
    path = np.repeat([paths_of[x["path"]] for x in items], [len(r) for r in runs])
    runs = np.concatenate(runs)
    order = np.argsort(runs[:, 0], kind="stable")
    runs, path = runs[order], path[order]
    opens = np.r_[True, (runs[1:, 0] != runs[:-1].sum(axis=1)) | (path[1:] != path[:-1])]
    first = np.flatnonzero(opens)
    return np.stack([runs[first, 0], np.add.reduceat(runs[:, 1], first)], axis=1)


def long_spans(documents: DataFrame, width: int = WIDTH, words: int = 50) -> DataFrame:
    """(key, doc_id, start, words) of every span of at least ``words`` words of a text that smaller doc_ids hold along one path."""
    keyed = with_key(documents)
    by_path = repeated_spans(_found(keyed, width)).groupBy("key", "doc_id", "path").agg(F.collect_list(F.struct("path", "runs")).alias("items"))

    def run(batches):
        for batch in batches:
            for key, doc, items in zip(*(batch.column(n).to_pylist() for n in ("key", "doc_id", "items")), strict=True):
                spans = _merged(items) + [0, width - 1]
                spans = spans[spans[:, 1] >= words]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(spans), pa.int64()) for v in (key, doc)] + [pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["key", "doc_id", "start", "words"])

    return by_path.mapInArrow(run, "key long, doc_id long, start long, words long")


def _result_columns() -> str:
    return "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(width: int, covered: bool):
    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch.column("text"))
        w = words_of(data, offsets)
        raw = data.tobytes()
        out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept_sha256")}
        for i in range(batch.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            keep = np.ones(b - a, bool)
            if covered and (items := batch.column("items")[i].as_py()):
                spans = _merged(items)
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans.sum(axis=1) + width - 1, -1)
                keep = np.cumsum(edge)[:-1] == 0
            kept = b" ".join([raw[s:e] for s, e in zip(w.start[a:b][keep].tolist(), w.end[a:b][keep].tolist(), strict=True)])
            out["n_words"].append(b - a)
            out["n_removed"].append(int((~keep).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return {"doc_id": batch.column("doc_id"), **out}

    return kernel


def _found(keyed: DataFrame, width: int) -> DataFrame:
    answers = durable(repeated_windows(keyed, width), of=keyed)
    return durable(pieces(keyed, answers, key_bitmap(answers.select(F.col("doc_id").alias("key"))), width), of=keyed)


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    keyed = with_key(documents)
    found = _found(keyed, width)
    removed = durable(repeated_spans(found).groupBy("key").agg(F.collect_list(F.struct("path", "runs")).alias("items")), of=keyed)
    members = key_bitmap(removed.select("key"))
    plain = map_batches(keyed, _kept(width, False), _result_columns(), only=only_chosen(members, False))
    cut = map_batches(chosen(keyed, members, True).join(removed.hint("shuffle_hash"), "key", "left"), _kept(width, True), _result_columns())
    return plain.unionByName(cut)
