"""Merkle manifest of a dataset: a hash tree over each source's rows, a proof for each row, and a check of it.

Every row is a leaf. Per source the leaves lie in ascending order of doc_id, and ``FAN`` consecutive
nodes become one until one is left, the source's subroot; the subroots become the root in the same
way. Higher-order functions do it in blocks: ``FAN ** HEIGHT`` consecutive nodes are one bounded
array, ``sequence`` names the runs of a level, ``slice`` cuts them, ``transform`` hashes each, and
``aggregate`` goes on from level to level. Block roots are the nodes of the next round, so the number
of rounds is the logarithm of the largest source, and no task ever holds more than some blocks.

A node's place in its source comes from one range partitioning by (source, doc_id, leaf): places
within a partition, and the partition's offset, a sum over one number for each partition and source.
A source with a third of all rows is therefore spread over a third of the partitions and blocks.
Texts are hashed where they are read; only digests travel.

Defined results: nulls hash as ``-``; rows without doc_id come before all others of their source,
and rows of one doc_id are ordered by leaf; rows without doc_id are never tampered with; the
source null is a source, before all others; without rows there is no root. The proof of a row that
has no siblings is the hash of the empty text. Columns beyond the five are left out of the leaf.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.frames import durable

FAN = 3
#: Levels that one block collapses: 243 nodes of 64 bytes.
HEIGHT = 5
BLOCK = FAN**HEIGHT
#: Every power of the fan-out that a long can hold.
_POWERS = [FAN**k for k in range(40) if FAN**k < 1 << 63]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(*columns: Column) -> Column:
    """Each value as its number of bytes, a colon and itself; a null as a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in columns)]
    return F.concat(*parts)


def levels_of(n: Column) -> Column:
    """How often ``n`` nodes collapse until one is left."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _next_level(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "")))


def block_levels(nodes: Column, times: Column) -> Column:
    """The block's levels from its nodes up, ``times`` collapses in all (at most ``HEIGHT``)."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(HEIGHT)), F.lit(1), times)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_next_level(F.element_at(done, -1)))))


def block_path(levels: Column, index: Column) -> Column:
    """For the block's node ``index``: what lies left and right of it in its run, level by level."""
    heights = F.slice(F.sequence(F.lit(0), F.lit(HEIGHT)), F.lit(1), F.size(levels) - 1)

    def siblings(height: Column) -> Column:
        at = F.floor(index / F.element_at(F.array(*[F.lit(p) for p in _POWERS[: HEIGHT + 1]]), height + 1)).cast("int")
        within = at % FAN
        return _bound(
            F.element_at(levels, height + 1),
            lambda level: F.struct(
                F.array_join(F.slice(level, at - within + 1, within), "").alias("l"),
                F.array_join(F.slice(level, at + 2, F.lit(FAN - 1) - within), "").alias("r"),
            ),
        )

    return F.transform(heights, siblings)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """The nodes with their place ``pos`` among their tree's, from 0, and the tree's size ``n``.

    ``order`` sorts a tree's nodes; equal ones are interchangeable, and a row number keeps them apart in the
    partitioning. Bounds of a range partitioning are drawn anew by each job, so what follows reads a checkpoint.
    """
    numbered = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    laid = durable(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), of=nodes)
    runs = laid.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("tree")
    before = F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("part", "tree", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(own).alias("n"))
    return laid.join(offsets, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climb(nodes: DataFrame, row: list[str], rounds: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node with its siblings up to the root: (``row``, digest, path, subroot, root).

    ``nodes`` are (tree, pos, n, digest, ``row``). ``above`` gets each tree's own root as (tree, digest), and returns
    (tree, path, subroot, root): the way from there on. One round makes blocks; their roots are the next
    round's nodes. After ``rounds`` rounds every tree has one node.
    """
    item = F.struct("pos", "digest", *row)
    blocks = (
        nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block"))
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn("levels", block_levels(F.transform("items", lambda x: x["digest"]), F.least(levels_of(F.col("n")), F.lit(HEIGHT))))
    )
    kept = durable(blocks, of=nodes)
    roots = kept.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1)[0].alias("digest"))
    if rounds > 1:
        upper = climb(roots.withColumn("way", F.struct("tree", F.col("pos").alias("block"))), ["way"], rounds - 1, above).select("way.*", F.col("path").alias("upper"), "subroot", "root")
    else:
        upper = above(roots.select("tree", "digest")).select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("upper"), "subroot", "root")
    way = F.transform("items", lambda x, i: F.struct(x.alias("x"), block_path(F.col("levels"), i).alias("way")))
    each = kept.join(upper, ["tree", "block"]).select("upper", "subroot", "root", F.inline(way))
    return each.select(*[F.col(f"x.{c}").alias(c) for c in row], F.col("x.digest").alias("digest"), F.concat("way", "upper").alias("path"), "subroot", "root")


def rounds_of(nodes: DataFrame) -> int:
    """Rounds that the largest tree needs: one number for the driver."""
    most, rounds = nodes.agg(F.max("n")).first()[0] or 1, 1
    while most > BLOCK:
        most, rounds = -(-most // BLOCK), rounds + 1
    return rounds


def _sources(tops: DataFrame) -> DataFrame:
    """The tree over the sources' subroots: each source's way to the root."""
    single = tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    ordered = durable(placed(single, "source"), of=single)

    def root(top: DataFrame) -> DataFrame:
        return top.select("tree", F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    way = climb(ordered, ["source"], rounds_of(ordered), root)
    return way.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root")


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    For rows whose decimal doc_id has an even CRC-32 the check is given a text without line feeds: it fails
    where there were any.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(framed(*fields, F.col("text")))
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text").cast("string"), F.lit("\n"))
    tampered = F.when(touched, digest(framed(*fields, F.regexp_replace(F.col("text").cast("string"), "\n", ""))))
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = durable(documents.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), tampered.alias("tampered")), of=documents)
    nodes = durable(placed(leaves, "doc_id", "digest"), of=leaves)
    rows = climb(nodes, ["doc_id", "tampered"], rounds_of(nodes), _sources)
    checked = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same by recursion over levels in DuckDB; the CRC-32 of a number's digits by bits."""

    def h(field: str) -> str:
        return f"coalesce(strlen({field})::varchar || ':' || {field}, '-')"

    def leaf(text: str) -> str:
        return f"sha256(concat({', '.join(h(f'd.{c}::varchar') for c in ('doc_id', 'source', 'lang', 'n_chars'))}, {h(text)}))"

    table = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), b::bigint))"
    crc = "xor(list_reduce(list_transform(string_split(d.doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, k.t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"

    def levels(name: str, start: str) -> str:
        return f"""{name}(g, lvl, p, n, h) as ({start}
      union all select g, lvl + 1, p // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' order by p)) from {name} where n > 1 group by g, lvl, n, p // {FAN})"""

    def path(name: str, start: str, inner: str) -> str:
        return f"""{name} as (select o.id, string_agg(s.h, '' order by s.lvl, s.p) as t from {start} o join {inner} s on s.g is not distinct from o.g and s.n > 1
      and s.p // {FAN} = o.p // ({FAN} ** (s.lvl + 1))::bigint and s.p <> o.p // ({FAN} ** s.lvl)::bigint group by o.id)"""

    def fold(name: str, start: str, inner: str) -> str:
        return f"""{name}(id, g, lvl, p, h) as (select id, g, 0, p, h from {start}
      union all select f.id, f.g, f.lvl + 1, f.p // {FAN}, sha256(string_agg(case when s.p = f.p then f.h else s.h end, '' order by s.p))
      from {name} f join {inner} s on s.g is not distinct from f.g and s.lvl = f.lvl and s.n > 1 and s.p // {FAN} = f.p // {FAN} group by f.id, f.g, f.lvl, f.p, f.h)"""

    return f"""with recursive k as (select {table} as t),
    d as (select rowid_ as id, doc_id, source as g, source, lang, n_chars, text from (select row_number() over () as rowid_, * from documents) x),
    c as (select d.*, {leaf('d.text')} as leaf, case when ({crc}) % 2 = 0 then {leaf("replace(d.text, chr(10), '')")} end as bad from d, k),
    o as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as n from c),
    {levels('tree', 'select g, 0, p, n, leaf from o')},
    tops as (select g as id, null::varchar as g, h, row_number() over (order by g nulls first) - 1 as p, count(*) over () as n from tree where n = 1),
    {levels('upper', 'select g, 0, p, n, h from tops')},
    top as (select h as root from upper where n = 1),
    {path('proofs', 'o', 'tree')},
    {path('top_proofs', 'tops', 'upper')},
    {fold('folds', '(select id, g, p, coalesce(bad, leaf) as h from o)', 'tree')},
    lasts as (select id, g, arg_max(h, lvl) as h from folds group by id, g),
    {fold('top_folds', '(select l.id, t.g, t.p, l.h from lasts l join tops t on t.id is not distinct from l.g)', 'upper')},
    top_lasts as (select id, arg_max(h, lvl) as folded_root from top_folds group by id)
    select o.doc_id, o.leaf, tops.h as subroot, top.root, sha256(coalesce(a.t, '') || coalesce(b.t, '')) as proof_sha256, z.folded_root, z.folded_root = top.root as verified
    from o join tops on tops.id is not distinct from o.g cross join top join top_lasts z on z.id = o.id left join proofs a on a.id = o.id left join top_proofs b on b.id is not distinct from o.g"""
