"""N-gram Jaccard self-join with filters from several global token orders.

A document is the set of its distinct word shingles. Two sets with Jaccard similarity of at least
t share a token among the first ``n - ceil(t n) + 1`` of each, under *every* global order of the
tokens. Candidates must pass that test under several orders:

* the *frequency order*, in a packed shuffle over the whole corpus: tokens by hash class, then by
  how many distinct sets have them, then by hash. Only the hash classes that a set's prefix can
  reach are dealt; tokens that no other set has come first and are dropped, so a set whose prefix
  is all its own has no candidates and never travels further;
* two *hash orders*, where the sets themselves meet: prefixes under independent permutations are
  intersected with the length filter before the exact verification.

Equal sets are one set with a count from the start, so a group of copies costs as much as one
document. Sets that share prefix tokens meet in pairs of bounded blocks: a candidate group of any
size is cut into blocks, and a pair of blocks is one task's work, verified there without emitting
pairs; what leaves is a spanning forest and each document's number of links. Tokens held by a
large share of all sets are recognised in a first pass (every task counts, none samples) and rank behind
the others of their class, so their posting lists are never gathered.

Defined results: null or empty text has the empty set, is linked with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one shingle; rows without
doc_id take their component from rows of equal sets (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.components import components
from chronolith.llm.dealing import FLUSH, chosen, deal, joined, key_bitmap, owners_of, part_of, rows, split, with_key
from chronolith.llm.frames import arrow_schema, durable, map_batches, parts_for, release, slices
from chronolith.llm.kernels import U64, mix, shingles, text_bytes, whole_sequence, words_of

#: Bytes of input files for each hash range.
RANGE_BYTES = 4 << 20
#: Hash classes of the frequency order, by the top three bits of a token: the first holds 3/8 of all tokens,
#: so it holds the whole prefix of nearly every set (0.15 n + 1 tokens), and unshared tokens come first in it.
_CLASS_OF = np.array([0, 0, 0, 1, 1, 1, 2, 2])
CLASSES = 3
BLOCK_DOCS = 256
BLOCK_TOKENS = 1 << 19
#: A token in more than this share of all distinct sets is frequent; at most mean set size / share of them exist.
FREQUENT = 0.001
_FREQUENT_DF = 1 << 40
_ORDER_SEEDS = (U64(0x8CB92BA72F3D8DD7), U64(0xD6E8FEB86659FD93))


def _required(n: np.ndarray | int, percent: int):
    """Fewest shared tokens that a partner of a set of n tokens has."""
    return -(-percent * n // 100)


def sets_of(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = words_of(*text_bytes(batch.column("text")), lower=True)
    value, out = shingles(w.hash, width), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(value[a : b - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            out.append(whole_sequence(w.hash[a:b]) if b > a else np.zeros(0, U64))
    return out


def _set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens).sum(dtype=U64) + U64(len(tokens))]))[0].view(np.int64))


def _class_ends(tokens: np.ndarray) -> np.ndarray:
    """How many tokens lie in the first 1, 2, ... hash classes."""
    return np.searchsorted(_CLASS_OF[tokens >> U64(61)], np.arange(1, CLASSES + 1), side="left").astype(np.int32)


def _reach(tokens: np.ndarray, percent: int) -> int:
    """Tokens in the classes that the prefix can reach."""
    prefix = len(tokens) - _required(len(tokens), percent) + 1
    ends = _class_ends(tokens)
    return int(ends[np.searchsorted(ends, prefix)])


_SUMMARY = "kind int, key long, doc_id long, sid long, n long, ends binary"
#: Tokens that a task counts at a time (2 MB). Those with the least counts make room for others.
COUNTED = 1 << 17


class _Counts:
    """Counts of the most frequent tokens of a task's sets, each too low by ``lost`` at most.

    When there are more tokens than room, the count of the first one beyond it is taken off all; what is left by then
    is dropped. So a token in more than ``lost`` sets is always kept.
    """

    def __init__(self):
        self.token, self.count, self.lost, self.sets = np.zeros(0, U64), np.zeros(0, np.int64), 0, 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.sets += len(sets)
        token, place = np.unique(np.concatenate([self.token, *sets]), return_inverse=True)
        count = np.bincount(place, np.r_[self.count, np.ones(len(place) - len(self.count), np.int64)]).astype(np.int64)
        if len(token) > COUNTED:
            least = int(np.partition(count, len(count) - COUNTED - 1)[len(count) - COUNTED - 1])
            token, count, self.lost = token[count > least], count[count > least] - least, self.lost + least
        self.token, self.count = token, count

    def often(self, share: float) -> tuple[list[int], list[int]]:
        """Tokens that may be in this share of the sets, and their counts."""
        mine = self.count + self.lost >= max(2, share * self.sets)
        return self.token[mine].view(np.int64).tolist(), (self.count[mine] + self.lost).tolist()


def _summaries(keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """kind 0: each row's set (id, size, class ends); kind 1: tokens in many of one task's sets, with that number.

    A token in a share ``FREQUENT`` of all sets has at least half of its sets in tasks where its share is at least half of
    that; so the sums of what tasks tell reach half of its number.
    """
    target = arrow_schema(keyed, _SUMMARY)

    def run(batches):
        counts, once, size = _Counts(), {}, 0
        for batch in slices(batches):
            out = []
            for own, key, doc in zip(sets_of(batch, width), batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                sid = _set_id(own) if len(own) else None
                out.append((0, key, doc, sid, len(own), _class_ends(own).tobytes()))
                if len(own) and sid not in once:
                    once[sid] = own[: _reach(own, percent)]
                    size += len(once[sid])
            yield rows(target, out)
            if size >= FLUSH:
                counts.add(list(once.values()))
                once, size = {}, 0
        if once:
            counts.add(list(once.values()))
        token, number = counts.often(FREQUENT / 2)
        if token:
            yield rows(target, [(1, None, None, t, n, None) for t, n in zip(token, number, strict=True)])
        release()

    return keyed.mapInArrow(run, _SUMMARY)


def _deal_tokens(keyed: DataFrame, width: int, percent: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Reachable tokens of every distinct set of a flush, by hash range; frequent ones go to the set's own range."""

    def kernel(batch: pa.RecordBatch) -> list:
        full = sets_of(batch, width)
        sets = [s[: _reach(s, percent)] if len(s) else s for s in full]
        return [joined(sets, U64), sets, [_set_id(s) if len(s) else 0 for s in full]]

    def emit(gathered: list[list]):
        once = {sid: own for _, sets, sids in gathered for own, sid in zip(sets, sids, strict=True) if len(own)}
        sids = np.array(list(once), np.int64)
        token = joined(list(once.values()), U64)
        owner = np.repeat(np.arange(len(sids)), [len(s) for s in once.values()])
        at = np.searchsorted(frequent, token)
        often = frequent[np.minimum(at, len(frequent) - 1)] == token if len(frequent) else np.zeros(len(token), bool)
        for flag, mine in ((False, ~often), (True, often)):
            t, o = token[mine], owner[mine]
            for part, (v, i) in split(part_of(sids[o].view(U64) if flag else t, parts), [t, o]):
                local, (ids,) = owners_of(i, sids)
                yield part, flag, v.tobytes(), local.tobytes(), ids.tobytes()

    return deal(keyed, kernel, emit, "part int, frequent boolean, tokens binary, owner binary, sids binary")


_HITS = "part int, tokens binary, df binary, sids binary"
_HITS_ARROW = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("df", pa.binary()), ("sids", pa.binary())])


def _shared_tokens(parts: int):
    """Reducer of one hash range: tokens of two or more sets, with that number, dealt to the sets."""

    def reduce(table: pa.Table) -> pa.Table:
        tokens, owners, out = [], [], []
        for flag, v, o, s in zip(*(table.column(n).to_pylist() for n in ("frequent", "tokens", "owner", "sids")), strict=True):
            token, sid = np.frombuffer(v, U64), np.frombuffer(s, np.int64)[np.frombuffer(o, np.uint32)]
            if flag:
                for part, (t, i) in split(part_of(sid.view(U64), parts), [token, sid]):
                    out.append((part, t.tobytes(), np.full(len(t), _FREQUENT_DF, np.int64).tobytes(), i.tobytes()))
            else:
                tokens.append(token)
                owners.append(sid)
        token, owner = joined(tokens, U64), joined(owners, np.int64)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        head = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
        run = np.cumsum(head) - 1
        many = np.bincount(run)[run] > 1 if len(run) else head
        token, owner = token[many], owner[many]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[fresh], owner[fresh]
        if len(token):
            run = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
            df = np.bincount(run)[run].astype(np.int64)
            for part, (t, d, i) in split(part_of(owner[df > 1].view(U64), parts), [token[df > 1], df[df > 1], owner[df > 1]]):
                out.append((part, t.tobytes(), d.tobytes(), i.tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_HITS_ARROW)], schema=_HITS_ARROW)

    return reduce


def _prefixes(percent: int):
    """Each set's prefix under the frequency order, without the tokens that only it has."""

    def reduce(hits: pa.Table, known: pa.Table) -> pa.Table:
        token, df, sid = (joined([np.frombuffer(v, kind) for v in hits.column(n).to_pylist()], kind) for n, kind in (("tokens", U64), ("df", np.int64), ("sids", np.int64)))
        mine = np.argsort(known.column("sid").to_numpy())
        sids, sizes = known.column("sid").to_numpy()[mine], known.column("n").to_numpy()[mine]
        raw = known.column("ends").to_pylist()
        ends = np.stack([np.zeros(CLASSES + 1, np.int64), *(np.r_[0, np.frombuffer(raw[i], np.int32)] for i in mine.tolist())])[1:]
        level = _CLASS_OF[token >> U64(61)]
        order = np.lexsort((token, df, level, sid))
        token, df, sid, level = token[order], df[order], sid[order], level[order]
        if len(sid):  # a frequent token reaches a set once from every flush that holds it
            fresh = np.r_[True, (sid[1:] != sid[:-1]) | (token[1:] != token[:-1])]
            token, sid, level = token[fresh], sid[fresh], level[fresh]
        at = np.searchsorted(sids, sid)
        head = np.r_[True, (sid[1:] != sid[:-1]) | (level[1:] != level[:-1])] if len(sid) else np.zeros(0, bool)
        start = np.flatnonzero(head)
        size = np.diff(np.r_[start, len(sid)])
        within = np.arange(len(sid)) - np.repeat(start, size)
        rank = ends[at, level + 1] - np.repeat(size, size) + within  # after the class's unshared tokens
        n = sizes[at]
        keep = rank < n - _required(n, percent) + 1
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "sid": pa.array(sid[keep])})

    return reduce


def _forest(width: int, percent: int):
    """Work of one pair of blocks: candidates by two hash orders, exact verification, spanning forest and links."""

    def reduce(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("doc_id").to_pylist(), table.column("tokens").to_pylist(), strict=True))
        if len(dict.fromkeys(rows)) < len(rows):  # repeated rows of one document
            table = table.take([rows.index(r) for r in dict.fromkeys(rows)])
        sets = [np.frombuffer(v, U64) for v in table.column("tokens").to_pylist()]
        docs, copies = table.column("doc_id").to_numpy(), table.column("copies").to_numpy()
        n = np.array([len(s) for s in sets])
        side = table.column("block").to_numpy() == table.column("b").to_numpy()
        need = _required(n, percent)
        allowed = np.triu(np.ones((len(n), len(n)), bool), 1)
        if table.column("a")[0].as_py() != table.column("b")[0].as_py():
            allowed &= side[:, None] != side[None, :]
        allowed &= (n[None, :] >= need[:, None]) & (n[:, None] >= need[None, :])
        for seed in _ORDER_SEEDS:
            meet = np.zeros_like(allowed)
            firsts = [np.sort(mix(s ^ seed))[: k - m + 1] for s, k, m in zip(sets, n.tolist(), need.tolist(), strict=True)]
            token, owner = joined(firsts, U64), np.repeat(np.arange(len(n)), [len(f) for f in firsts])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    own = owner[a:b]
                    meet[np.ix_(own, own)] = True
            allowed &= meet
        _, number = np.unique(joined(sets, U64), return_inverse=True)
        number = np.split(number, np.cumsum(n)[:-1])
        mark = np.zeros(int(max((x.max() for x in number if len(x)), default=0)) + 1, bool)
        root, links = list(range(len(n))), np.zeros(len(n), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.flatnonzero(allowed.any(axis=1)).tolist():
            mark[number[i]] = True
            others = np.flatnonzero(allowed[i])
            starts = np.cumsum(n[others]) - n[others]
            both = np.add.reduceat(mark[np.concatenate([number[j] for j in others])].astype(np.int64), starts)
            mark[number[i]] = False
            good = others[100 * both >= percent * (n[i] + n[others] - both)]
            links[i] += copies[good].sum()
            links[good] += copies[i]
            for j in good.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b, key=lambda x: docs[x])] = min(a, b, key=lambda x: docs[x])
        linked = np.flatnonzero(links)
        return pa.table({"u": pa.array(docs[linked]), "v": pa.array(docs[[find(x) for x in linked.tolist()]] if len(linked) else docs[:0]), "links": pa.array(links[linked])})

    return reduce


def _blocks(prefixes: DataFrame, known: DataFrame, percent: int, most: int) -> DataFrame:
    """(sid, key, doc_id, copies, step, block): candidate groups, roughly gathered, cut into bounded blocks.

    A block holds sets of one size step; partners are at most one step apart.
    """
    home = prefixes.groupBy("sid").agg(F.min("token").alias("home"))
    for _ in range(2):  # groups need not be complete: pairs of blocks that share a token meet anyway
        nearest = durable(prefixes.join(home, "sid").groupBy("token").agg(F.min("home").alias("home")), rows=most)  # so that a hot token's join can be split
        home = prefixes.join(nearest, "token").groupBy("sid").agg(F.min("home").alias("home"))
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)
    homes = durable(known.join(home, "sid").withColumn("step", step).withColumn("home", F.xxhash64("home", "step")), rows=most)
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("chunks"))
    return homes.join(sizes, "home").select("sid", "key", "doc_id", "copies", "step", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("chunks"))).alias("block"))


def _links(keyed: DataFrame, known: DataFrame, prefixes: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v, links): spanning forest edges between representatives, and links counted per pair of blocks."""
    most = prefixes.count()  # of each of the frames below
    blocks = durable(_blocks(prefixes, known, percent, most), rows=most)
    places = durable(prefixes.join(blocks.select("sid", "block", "step"), "sid").select("token", "step", "block").distinct(), rows=most)
    many = places.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    crossing = places.join(many, "token")
    near = crossing.select("token", F.explode(F.array("step", F.col("step") + 1)).alias("step"), F.col("block").alias("b"), F.col("step").alias("own"))
    pairs = crossing.withColumnRenamed("block", "a").join(near, ["token", "step"]).where("own < step or a < b").select("a", "b").distinct()
    alone = blocks.groupBy(F.col("block").alias("a")).agg(F.count("*").alias("k")).where("k > 1").select("a", F.col("a").alias("b"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("block")).unionByName(alone.select("a", "b", F.col("a").alias("block")))
    texts = chosen(keyed, key_bitmap(blocks.select("key")), True).drop("doc_id").join(blocks.hint("shuffle_hash"), "key")

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"block": batch.column("block"), "doc_id": batch.column("doc_id"), "copies": batch.column("copies"), "tokens": [s.tobytes() for s in sets_of(batch, width)]}

    sets = map_batches(texts, kernel, "block long, doc_id long, copies long, tokens binary")
    return sides.join(sets, "block").groupBy("a", "b").applyInArrow(_forest(width, percent), "u long, v long, links long")


def similarity_groups(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_id) of every row.

    Two rows are linked when 100 * shared shingles >= ``percent`` * shingles in either. class_id is
    the smallest doc_id with an equal set, n_links the number of other rows this row is linked with.
    """
    keyed = with_key(documents)
    summary = durable(_summaries(keyed, width, percent), of=keyed)
    found_rows = summary.where("kind = 0").select("key", "doc_id", "sid", "n", "ends")
    total = found_rows.count()
    known = durable(
        found_rows.where("n > 0")
        .groupBy("sid")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key", "n", "ends")).alias("first"), F.count("*").alias("copies"))
        .select("sid", "first.doc_id", "first.key", "first.n", "first.ends", "copies"),
        rows=total,
    )
    limit = max(256, int(FREQUENT / 2 * known.count()))
    often = summary.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("sets")).where(F.col("sets") >= limit).select("sid").collect()
    frequent = np.sort(np.array([r["sid"] for r in often], np.int64).view(U64))
    parts = parts_for(keyed, RANGE_BYTES)
    dealt = _deal_tokens(keyed, width, percent, frequent, parts)
    hits = dealt.groupBy("part").applyInArrow(_shared_tokens(parts), _HITS)
    by_range = known.mapInArrow(_with_part(parts), "part int, sid long, n long, ends binary")
    prefixes = durable(hits.groupBy("part").cogroup(by_range.groupBy("part")).applyInArrow(_prefixes(percent), "token long, sid long"), of=keyed)
    several = prefixes.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    shared = durable(prefixes.join(several, "token"), rows=prefixes.count())
    found = durable(_links(keyed, known.where("doc_id is not null").select("sid", "key", "doc_id", "n", "copies"), shared, width, percent), of=keyed)
    links = found.groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("links"))
    classes = (
        known.select("sid", F.col("doc_id").alias("class_id"), "copies")
        .join(components(found.select("u", "v")).withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(links, "class_id", "left")
        .select("sid", "class_id", F.coalesce("component", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    full = found_rows.where("n > 0").join(classes, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "class_id")
    empty = found_rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return full.unionByName(empty)


def _with_part(parts: int):
    def run(batches):
        for batch in batches:
            sid = batch.column("sid")
            yield pa.RecordBatch.from_arrays([pa.array(part_of(sid.to_numpy().view(U64), parts).astype(np.int32)), sid, batch.column("n"), batch.column("ends")], names=["part", "sid", "n", "ends"])

    return run
