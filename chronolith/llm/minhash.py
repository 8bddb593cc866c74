"""MinHash near-duplicates: bands find candidates, odd sketches sift them, full sets confirm them.

A document is the set of its distinct word shingles; equal sets are one set from the start. ``SAMPLES``
MinHash values of a set make ``BANDS`` band hashes, and sets that share one are a bucket. The same values
folded into ``SKETCH_BITS`` parity bits make the odd sketch: two sketches differ in few bits where
few samples differ, and the number of differing bits tells high similarities apart far better than
the number of common bands. Candidates whose sketches differ too much are dropped before any text moves.

A bucket's pairs are never listed. First each bucket's sets meet one of them, its leader, which differs
among ``LEADERS`` kinds of bands, so that a group of near copies grows together from several centres; each such
star is cut into chunks of at most ``STAR_SETS`` sets, and full sets confirm it. What stars link is merged into
components. Only buckets whose sets still lie in several components are looked at again, exhaustively but only across
components: their sets are gathered in bounded blocks, blocks that share a band meet as blocks of
sketches, and where two sketches are near, the full sets of just these documents meet in the same block. There a pair is
counted out only if nothing links its components yet, and only a spanning forest leaves. Near copies that stay apart from
their group (more edits than the threshold allows) are what this costs for: each is compared with the group's others.

No link is lost but by chance: a pair at the threshold shares no band with probability
``missed_by_bands`` (under 1e-12), and is sifted out with ``SIFT_RISK`` (1e-9). Both shrink fast above the threshold.

Defined results: null or empty text has the empty set, is linked with nothing and is kept; with fewer words
than a shingle the whole sequence is the one shingle; rows without doc_id take their component from rows
of equal sets and are not kept then, else their component is null and they are kept; rows of one doc_id are one
document. Columns beyond doc_id and text don't matter. Shingles are compared by 64-bit hashes, equal sets
by 128 bits.
"""

from __future__ import annotations

import functools
import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.components import components
from chronolith.llm.dealing import chosen, joined, key_bitmap, with_key
from chronolith.llm.frames import durable, map_batches, release
from chronolith.llm.kernels import U64, mix
from chronolith.llm.jaccard import sets_of

ROWS = 4
BANDS = 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
_LONGS = SKETCH_BITS // 64
#: Probability that the sift drops a pair just at the threshold.
SIFT_RISK = 1e-9
#: Leaders that a group of sets may have in the first round.
LEADERS = 4
#: Sets, and shingles, of a block.
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 18
#: Sets, and shingles, that one set is compared with in one star.
STAR_SETS = 128
STAR_SHINGLES = 1 << 18
#: Shingles of the stars that are confirmed in one go.
LOT_SHINGLES = 1 << 19
#: Sketches that are compared in one go.
LOT_SKETCHES = 1 << 13
_FACTORS = (mix(np.arange(1, SAMPLES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1, SAMPLES + 1, dtype=U64) ^ U64(0x5851F42D4C957F2D)).astype(np.uint32)


def missed_by_bands(similarity: float) -> float:
    """Probability that two sets of this similarity share no band."""
    return (1 - similarity**ROWS) ** BANDS


@functools.lru_cache(maxsize=8)
def most_differing_bits(percent: int) -> int:
    """Sketch bits in which pairs at the threshold differ at most, but for a share ``SIFT_RISK`` of them.

    m of the samples differ with binomial probability; 2 m tosses then flip random bits, and the number of set bits
    after a toss goes up or down by one.
    """
    likely, tossed = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    likely[0] = 1
    set_bits = np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    miss = 1 - percent / 100
    for m in range(SAMPLES + 1):
        tossed += comb(SAMPLES, m) * miss**m * (1 - miss) ** (SAMPLES - m) * likely
        for _ in range(2):
            up, down = likely * (1 - set_bits), likely * set_bits
            likely = np.r_[0, up[:-1]] + np.r_[down[1:], 0]
    tail = np.cumsum(tossed[::-1])[::-1]
    return int(np.flatnonzero(tail > SIFT_RISK)[-1])


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values of every set (none may be empty): one row each."""
    token = (joined(sets, U64) >> U64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat(token * _FACTORS[i] + _SHIFTS[i], starts)
    return out.T


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each row of samples; its last bits of two say which kind of band it is."""
    rows = samples.reshape(len(samples), BANDS, ROWS).astype(U64)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(77)), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out ^ rows[:, :, i])
    kind = np.arange(BANDS, dtype=U64) % U64(LEADERS)
    return (out - out % U64(LEADERS) + kind).view(np.int64)


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    place = mix(samples.astype(U64) | (np.arange(SAMPLES, dtype=U64) << U64(32))[None, :]) % U64(SKETCH_BITS)
    flat = (np.arange(len(samples))[:, None] * SKETCH_BITS + place.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(samples) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(samples), _LONGS)


_SUMMARY = "key long, doc_id long, sid binary, n long, sketch array<long>, bands array<long>"


def _summaries(keyed: DataFrame, width: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> dict:
        sets = sets_of(batch, width)
        full = [s for s in sets if len(s)]
        samples = samples_of(full) if full else np.zeros((0, SAMPLES), np.uint32)
        bands, sketches = iter(bands_of(samples)), iter(sketches_of(samples))
        return {
            "key": batch.column("key"),
            "doc_id": batch.column("doc_id"),
            "sid": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "n": [len(s) for s in sets],
            "sketch": [next(sketches) if len(s) else None for s in sets],
            "bands": [next(bands) if len(s) else None for s in sets],
        }

    return map_batches(keyed, kernel, _SUMMARY)


def _sifted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, u_doc, v_doc, n) of the pairs (u, v) that sizes and sketches allow; n is v's size."""
    sides = pairs
    for side in "uv":
        sides = sides.join(sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n", "sketch")]), side)
    differing = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col("u_sketch")[i].bitwiseXOR(F.col("v_sketch")[i])) for i in range(_LONGS)])
    fits = (100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n")) & (differing <= most_differing_bits(percent))
    return sides.where(fits).select("u", "v", F.col("u_doc_id").alias("u_doc"), F.col("v_doc_id").alias("v_doc"), F.col("v_n").alias("n"), "u_n")


def _common(width: int, percent: int):
    """Exact links of a lot of stars."""

    def reduce(table: pa.Table) -> pa.Table:
        order = np.lexsort((~table.column("leads").to_numpy(), table.column("star").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        star, docs = table.column("star").to_numpy(), table.column("doc_id").to_numpy()
        leads = table.column("leads").to_numpy()
        cut, us, vs = np.flatnonzero(np.r_[True, star[1:] != star[:-1], True]), [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if not leads[a]:
                continue
            part = table.slice(a, b - a).combine_chunks()
            first, *others = sets_of(part, width)
            for i, own in enumerate(others, a + 1):
                at = np.minimum(np.searchsorted(first, own), len(first) - 1)
                both = int((first[at] == own).sum())
                if 100 * both >= percent * (len(first) + len(own) - both):
                    us.append(docs[a])
                    vs.append(docs[i])
        release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return reduce


def _confirmed(found: DataFrame, keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) between documents, of the candidates whose full sets are similar enough."""
    sizes = found.groupBy("u").agg(F.greatest(F.ceil(F.count("*") / STAR_SETS), F.ceil(F.sum("n") / STAR_SHINGLES)).alias("chunks"))
    stars = found.join(sizes, "u").withColumn("star", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("chunks"))))
    leaders = stars.select("star", F.col("u").alias("key"), F.col("u_doc").alias("doc_id"), F.col("u_n").alias("n"), F.lit(True).alias("leads")).distinct()
    others = stars.select("star", F.col("v").alias("key"), F.col("v_doc").alias("doc_id"), "n", F.lit(False).alias("leads"))
    needs = durable(leaders.unionByName(others), of=keyed)
    lots = 1 + (needs.agg(F.sum("n")).first()[0] or 0) // LOT_SHINGLES
    rows = needs.join(_texts(needs, keyed), "key").select(F.pmod("star", F.lit(lots)).alias("lot"), "star", "leads", "doc_id", "text")
    return durable(rows.groupBy("lot").applyInArrow(_common(width, percent), "u long, v long"), of=keyed)


_SKETCH = [f"s{i}" for i in range(_LONGS)]
_MEMBER = "task long, block long, key long, doc_id long, component long, n long, " + ", ".join(f"{c} long" for c in _SKETCH)


def _fitting(table: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of a task's sets may be linked: another component, another block if there are two, size and sketch."""
    most = most_differing_bits(percent)
    block, group, n = (table.column(c).to_numpy() for c in ("block", "component", "n"))
    sketch = np.stack([table.column(c).to_numpy() for c in _SKETCH], axis=1).view(U64)
    fits = np.triu(group[:, None] != group[None, :], 1) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if block.min() != block.max():
        fits &= block[:, None] != block[None, :]
    for i in np.flatnonzero(fits.any(axis=1)).tolist():
        others = np.flatnonzero(fits[i])
        fits[i, others] = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1) <= most
    return fits


def _tasks(table: pa.Table):
    """The table cut into its tasks."""
    table = table.take(pa.array(np.argsort(table.column("task").to_numpy(), kind="stable"))).combine_chunks()
    task = table.column("task").to_numpy()
    cut = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield table.slice(a, b - a)


def _near_sketches(percent: int):
    """Of a lot of tasks, the sets that have a fitting partner in their task."""

    def reduce(table: pa.Table) -> pa.Table:
        out = [table.slice(0, 0)]
        for part in _tasks(table):
            fits = _fitting(part, percent)
            out.append(part.filter(pa.array(fits.any(axis=0) | fits.any(axis=1))))
        return pa.concat_tables(out).select([c.split()[0] for c in _MEMBER.split(", ")])

    return reduce


def _forest(width: int, percent: int):
    """Edges that join the components of a lot of tasks, from the exact number of common shingles."""

    def edges(part: pa.Table, us: list, vs: list) -> None:
        fits = _fitting(part, percent)
        sets, docs, group = sets_of(part.combine_chunks(), width), part.column("doc_id").to_numpy(), part.column("component").to_numpy()
        n = np.array([len(s) for s in sets])
        _, number = np.unique(joined(sets, U64), return_inverse=True)
        number, mark = np.split(number, np.cumsum(n)[:-1]), np.zeros(int(number.max()) + 1, bool)
        _, root = np.unique(group, return_inverse=True)  # grows together as links are found
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            mark[number[i]] = True
            others = np.flatnonzero(fits[i] & (root != root[i]))
            for lot in np.split(others, np.arange(64, len(others), 64)):
                lot = lot[root[lot] != root[i]]
                if not len(lot):
                    continue
                starts = np.cumsum(n[lot]) - n[lot]
                both = np.add.reduceat(mark[np.concatenate([number[j] for j in lot])].astype(np.int64), starts)
                for j in lot[100 * both >= percent * (n[i] + n[lot] - both)].tolist():
                    if root[i] != root[j]:
                        us.append(docs[i])
                        vs.append(docs[j])
                        root[root == root[j]] = root[i]
            mark[number[i]] = False

    def reduce(table: pa.Table) -> pa.Table:
        us, vs = [], []
        for part in _tasks(table):
            edges(part, us, vs)
        release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return reduce


def _met(rest: DataFrame, sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """Tasks, as rows of ``_MEMBER``: every pair of sets of two components that share a band is in one task at least.

    ``rest`` is (band, key, component, leader). Sets are gathered by the smallest leader near them and cut into blocks;
    components that fill a quarter of a block on their own make blocks of their own, which needn't meet each other.
    """
    homes = rest.groupBy("key", "component").agg(F.min("leader").alias("home"))
    for _ in range(2):  # bands hand the smallest home on, so that a group of near copies fills few blocks
        nearest = rest.join(homes.select("key", "home"), "key").groupBy("band").agg(F.min("home").alias("home"))
        homes = durable(rest.join(nearest, "band").groupBy("key", "component").agg(F.min("home").alias("home")), of=keyed)
    homes = durable(homes.join(sets.select("key", "doc_id", "n", *[F.col("sketch")[i].alias(c) for i, c in enumerate(_SKETCH)]), "key"), of=keyed)
    own = homes.groupBy("home", "component").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK_SETS // 4).drop("k")
    named = homes.join(own.withColumn("label", F.col("component")), ["home", "component"], "left").withColumn("family", F.xxhash64("home", "label"))
    whole = named.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("chunks"))
    placed = named.join(whole, "family").withColumn("block", F.xxhash64("family", F.pmod(F.xxhash64("key"), F.col("chunks"))))
    placed = durable(placed.select("block", "label", "key", "doc_id", "component", "n", *_SKETCH), of=keyed)
    spots = durable(rest.select("band", "key").join(placed.select("key", "block", "label"), "key").select("band", "block", "label").distinct(), of=keyed)
    left, right = (spots.select("band", F.col("block").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    apart = left.join(right, "band").where("a < b and not coalesce(a_label = b_label, false)").select("a", "b").distinct()
    alone = placed.where("label is null").groupBy(F.col("block").alias("a")).agg(F.count("*").alias("k")).where("k > 1").select("a", F.col("a").alias("b"))
    sides = apart.unionByName(alone).select(F.xxhash64("a", "b").alias("task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return sides.join(placed.drop("label"), "block").select(*[c.split()[0] for c in _MEMBER.split(", ")])


def _across(rest: DataFrame, sets: DataFrame, keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) between documents of components that stars left apart."""
    met = durable(_met(rest, sets, keyed), of=keyed)
    lots = 1 + met.count() // LOT_SKETCHES
    near = met.withColumn("lot", F.pmod("task", F.lit(lots))).groupBy("lot").applyInArrow(_near_sketches(percent), _MEMBER)
    near = durable(near, of=keyed)
    lots = 1 + (near.agg(F.sum("n")).first()[0] or 0) // LOT_SHINGLES
    rows = near.join(_texts(near, keyed), "key").withColumn("lot", F.pmod("task", F.lit(lots)))
    return durable(rows.groupBy("lot").applyInArrow(_forest(width, percent), "u long, v long"), of=keyed)


def _texts(needs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, text) of the keys that are needed, once each."""
    return chosen(keyed, key_bitmap(needs.select("key").distinct()), True).groupBy("key").agg(F.any_value("text").alias("text"))


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked when 100 * shared shingles >= ``percent`` * shingles in either; component_id is the smallest
    doc_id that links reach, and kept is whether the row is that document.
    """
    keyed = with_key(documents)
    summary = durable(_summaries(keyed, width), of=keyed)
    rows = summary.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key", "n", "sketch", "bands")).alias("first")
    known = durable(rows.groupBy("sid").agg(first).select("sid", "first.doc_id", "first.key", "first.n", "first.sketch", "first.bands"), of=keyed)
    sets = known.where("doc_id is not null").select("key", "doc_id", "n", "sketch")
    places = known.where("doc_id is not null").select("key", F.explode("bands").alias("band"))
    leader = F.min(F.struct(F.xxhash64("key", F.pmod("band", F.lit(LEADERS))).alias("order"), "key"))["key"].alias("leader")
    buckets = places.groupBy("band").agg(leader, F.count("*").alias("size")).where("size > 1")
    placed = durable(places.join(buckets, "band").where("key <> leader"), of=keyed)
    stars = _sifted(placed.select(F.col("leader").alias("u"), F.col("key").alias("v")).distinct(), sets, percent)
    edges = _confirmed(durable(stars, of=keyed), keyed, width, percent)
    linked = components(edges)
    # what no leader told apart: buckets whose other sets still lie in several components
    component = known.where("doc_id is not null").select("key", "doc_id").join(linked, F.col("doc_id") == F.col("node"), "left").select("key", F.coalesce("component", "doc_id").alias("component"))
    rest = placed.where("size > 2").select("band", "key", "leader").join(component, "key")
    mixed = rest.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    rest = durable(rest.join(mixed, "band"), of=keyed)
    if rest.head(1):
        more = _across(rest, sets, keyed, width, percent)
        if more.head(1):
            linked = components(edges.unionByName(more))
    classes = known.select("sid", "doc_id").join(linked, F.col("doc_id") == F.col("node"), "left").select("sid", F.coalesce("component", "doc_id").alias("component_id"))
    full = rows.select("sid", "doc_id", F.col("n").alias("n_shingles")).join(classes, "sid").drop("sid")
    empty = summary.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
