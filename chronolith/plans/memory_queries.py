"""Registered queries of recall, graph, store, lifecycle, history, merge and evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import evaluation, gates, graph, history, lifecycle, merge, recall, remember, search, spaces, store
from chronolith.plans import fixtures as fx
from chronolith.plans.queries import _SCORE, _TOKENS, query
from chronolith.sources import adapters

NOW, TALK_NOW = fx.NOW, fx.TALK_NOW
T = fx.with_tables

# --- recall: talk turns as observations; every id divisible by 100, a room's first turn, asks with its whole text

_HITS = f"""toks as (select id, {_TOKENS.format("content")} as ws from talk),
  post as (select id as doc_id, term, count(*)::double as tf from (select id, unnest(ws) as term from toks) group by all),
  lens as (select id as doc_id, len(ws)::double as dl from toks where len(ws) > 0), st as (select count(*) as n, avg(dl) as a from lens), dfs as (select term, count(*) as df from post group by term),
  q as (select id as query_id, term, count(*) as times from (select id, unnest({_TOKENS.format("content")}) as term from talk where id % 100 = 0) group by all),
  hs as (select query_id, p.doc_id as id, round({_SCORE}, 6) as raw from q join post p using (term) join dfs using (term) join lens using (doc_id) cross join st group by query_id, p.doc_id),
  hits as (select query_id, id, raw from hs)"""
_RANKED = "round(raw * exp(-0.01e0 * greatest({now} - observed_at, 0) / 86400e0) * least(greatest(confidence, 0e0), 1e0) * (1e0 + 0.25e0 * coalesce(least(greatest(importance, 0e0), 1e0), 0e0)), 6)"


def _recall_sql(where: str, now: int = TALK_NOW) -> str:
    """``now`` is the instant that validity and age are measured at: an as-of recall's own."""
    return f"""rec as (select query_id, id, entity_id, raw, score, row_number() over (partition by query_id order by score desc, id) as rank from
    (select h.query_id, t.id, t.entity_id, h.raw, {_RANKED.format(now=now)} as score from hits h join talk t using (id) join rooms r on r.id = t.entity_id where {where}) where score >= 0.05)"""


_VALID = "not tombstoned and coalesce(valid_from, observed_at) <= {t} and (valid_until is null or valid_until > {t})"


def _turns_asked(spark, sf_dir):
    return fx.talk(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("text"))


_FILTERED = _VALID.format(t=TALK_NOW) + " and r.entity_type = 'project' and t.confidence >= 0.5 and t.memory_tier = 'semantic' and t.source = 'assistant'"


@query(f"{T('talk', 'rooms')}, {_HITS}, {_recall_sql(_FILTERED)} select query_id, rank, id, entity_id, raw, score from rec where rank <= 5")
def recall_filtered(spark, sf_dir):
    filters = recall.Filters(entity_type="project", min_confidence=0.5, tier="semantic", source="assistant")
    return recall.recalled(_turns_asked(spark, sf_dir), fx.talk(spark, sf_dir), fx.rooms(spark, sf_dir), 5, TALK_NOW, filters, 0.01)


_AS_OF = 1_700_005_000


@query(f"{T('talk', 'rooms')}, {_HITS}, {_recall_sql(_VALID.format(t=_AS_OF) + ' and lower(r.name) in (' + ', '.join(repr(f'room {i}') for i in range(30)) + ')', _AS_OF)} select query_id, rank, id, entity_id, raw, score from rec where rank <= 5")
def recall_as_of(spark, sf_dir):
    filters = recall.Filters(entity_names=tuple(f"ROOM {i}" for i in range(30)), as_of=_AS_OF)
    return recall.recalled(_turns_asked(spark, sf_dir), fx.talk(spark, sf_dir), fx.rooms(spark, sf_dir), 5, TALK_NOW, filters, 0.01)


def _room_links(spark, sf_dir):
    """Rooms next to each other are related."""
    rooms = fx.rooms(spark, sf_dir).select(F.substring("id", 2, 20).cast("long").alias("n")).where("n % 3 > 0")
    return rooms.select(F.concat(F.lit("#"), "n").alias("from_entity"), F.concat(F.lit("#"), F.col("n") + 1).alias("to_entity"), F.lit("knows_about").alias("relation_type"), ((F.col("n") % 10) / 10).alias("weight"), F.when(F.col("n") % 13 == 0, F.lit(5)).cast("long").alias("valid_until"))


_LINKS = "links as (select '#' || n as a, '#' || (n + 1) as b, (n % 10) / 10e0 as weight from (select substring(id, 2)::bigint as n from rooms) where n % 3 > 0 and n % 13 > 0)"
_SPREAD = f"""seeds as (select query_id, id, entity_id, score from rec where rank <= 5),
  best as (select query_id, entity_id as seed, max(score) as seed_score from seeds group by all),
  near as (select query_id, seed, seed_score, e.b as nb, weight from best join (select a, b, weight from links union all select b, a, weight from links) e on e.a = seed where not exists (select 1 from best x where x.query_id = best.query_id and x.seed = e.b)),
  pool as (select *, row_number() over (partition by entity_id order by observed_at desc, id) as nth from talk where not tombstoned and (valid_until is null or valid_until > {TALK_NOW})),
  met as (select query_id, seed, seed_score, nb, weight, p.* from near join pool p on p.entity_id = nb join rooms r on r.id = p.entity_id where nth <= 4 and {_VALID.format(t=TALK_NOW)}),
  sc as (select *, 0.5e0 * weight * seed_score as rawx from met),
  fine as (select query_id, seed, seed_score, weight, entity_id, observed_at, id, round(rawx, 6) as raw, {_RANKED.format(now=TALK_NOW).replace("raw *", "rawx *")} as score from sc),
  onc as (select *, row_number() over (partition by query_id, id order by seed_score desc, seed, weight desc, entity_id, observed_at desc, id) as first from fine f where score >= 0.025 and not exists (select 1 from seeds s where s.query_id = f.query_id and s.id = f.id)),
  placed as (select query_id, id, entity_id, raw, score, row_number() over (partition by query_id order by seed_score desc, seed, weight desc, entity_id, observed_at desc, id) as place from onc where first = 1)"""


@query(f"{T('talk', 'rooms')}, {_HITS}, {_recall_sql(_VALID.format(t=TALK_NOW))}, {_LINKS}, {_SPREAD} select query_id, place, id, entity_id, raw, score from placed where place <= 4")
def spread_one_hop(spark, sf_dir):
    talk, rooms = fx.talk(spark, sf_dir), fx.rooms(spark, sf_dir)
    seeds = recall.recalled(_turns_asked(spark, sf_dir), talk, rooms, 5, TALK_NOW, rate=0.01)
    return recall.spread(seeds, _room_links(spark, sf_dir), talk, rooms, 4, TALK_NOW, rate=0.01)


@query(f"{T('talk', 'rooms')}, {_HITS}, {_recall_sql(_FILTERED)} select t.id, t.access_count + count(h.id) as access_count from talk t left join (select id from rec where rank <= 5) h using (id) group by t.id, t.access_count")
def access_fold(spark, sf_dir):
    talk = fx.talk(spark, sf_dir)
    return recall.folded_access(talk, recall.access_events(recall_filtered(spark, sf_dir), TALK_NOW)).select("id", "access_count")


# --- store ------------------------------------------------------------------------------------------

_LIVE = f"not tombstoned and (valid_until is null or valid_until > {NOW})"


@query(f"""{T('entities', 'observations', 'relations', 'chunks')} select count(*) as observations, count(*) filter ({_LIVE}) as live, count(*) filter (tombstoned) as tombstoned, min(observed_at) as oldest, max(observed_at) as newest,
  (select count(*) from entities where source <> 'partition:stub') as entities, (select count(*) from relations) as relations, (select count(vector) from chunks) as vectors from observations""")
def status_counts(spark, sf_dir):
    return store.status(fx.entities(spark, sf_dir), fx.observations(spark, sf_dir), fx.relations(spark, sf_dir), fx.chunks(spark, sf_dir), NOW)


@query(f"{T('observations')} select memory_tier as value, count(*) as n from observations group by memory_tier")
def tier_counts(spark, sf_dir):
    return store.counts_by(fx.observations(spark, sf_dir), "memory_tier")


@query(f"{T('entities')} select source, entity_type, count(*) as n from entities where source <> 'partition:stub' group by all")
def type_counts(spark, sf_dir):
    return store.type_counts_by_source(fx.entities(spark, sf_dir))


@query(f"{T('entities', 'relations')} select e.source, count(*) as n from relations r join entities e on e.id = r.from_entity group by e.source")
def relation_counts(spark, sf_dir):
    return store.relation_counts_by_source(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir))


@query(f"""{T('entities', 'observations')}, page as (select * from entities where source <> 'partition:stub' order by updated_at desc, id limit 50 offset 20),
  live as (select entity_id, count(*) as n from observations where {_LIVE} group by entity_id) select p.id, p.name, p.entity_type, p.updated_at, coalesce(n, 0) as observations from page p left join live on live.entity_id = p.id""")
def entity_listing(spark, sf_dir):
    return store.list_entities(fx.entities(spark, sf_dir), fx.observations(spark, sf_dir), NOW, 50, 20)


@query(f"""{T('entities')}, asked(name) as (select c_name from customer union select 'Nobody' union select lower(n_name) from nation union select n_name from nation)
  select a.name, case count(e.id) when 0 then 'not_found' when 1 then 'unique' else 'ambiguous' end as outcome, arg_min(e.id, (e.created_at, e.id)) as id,
  coalesce(list(e.id order by e.created_at, e.id) filter (e.id is not null), [])[1:64] as candidates, count(e.id) > 64 as truncated
  from asked a left join entities e on e.name = a.name group by a.name""")
def resolve_names(spark, sf_dir):
    nations = fx.table(spark, sf_dir, "nation")
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    for more in (spark.createDataFrame([("Nobody",)], "name string"), nations.select(F.lower("n_name").alias("name")), nations.select(F.col("n_name").alias("name"))):
        asked = asked.unionByName(more)
    return store.resolve(fx.entities(spark, sf_dir), asked)


_SRC = "src as (select url as uri, case when page_id % 3 = 0 then 'web' else 'note' end as kind, strlen(html) as size_bytes, 1 + page_id % 5 as chunk_count, 100 + page_id as created_at, 100 + page_id as updated_at from pages)"
_UPD = "upd as (select uri, kind, size_bytes + 1 as size_bytes, chunk_count + 1 as chunk_count, created_at + 50 as created_at, updated_at + 50 as updated_at from src where size_bytes % 4 = 0 union all select uri || '/new', kind, size_bytes, chunk_count, created_at, updated_at from src where size_bytes % 7 = 0)"


def _sources(spark, sf_dir):
    src = fx.table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.when(F.col("page_id") % 3 == 0, "web").otherwise("note").alias("kind"), F.octet_length("html").cast("long").alias("size_bytes"), (1 + F.col("page_id") % 5).alias("chunk_count"), (100 + F.col("page_id")).alias("created_at"), (100 + F.col("page_id")).alias("updated_at"))
    upd = src.where("size_bytes % 4 = 0").withColumns({c: F.col(c) + n for c, n in (("size_bytes", 1), ("chunk_count", 1), ("created_at", 50), ("updated_at", 50))})
    return src, upd.unionByName(src.where("size_bytes % 7 = 0").withColumn("uri", F.concat("uri", F.lit("/new"))))


@query(f"with {_SRC}, {_UPD} select uri, arg_max(kind, updated_at) as kind, arg_max(size_bytes, updated_at) as size_bytes, arg_max(chunk_count, updated_at) as chunk_count, min(created_at) as created_at, max(updated_at) as updated_at from (select * from src union all select * from upd) group by uri")
def source_upsert(spark, sf_dir):
    return store.upsert_sources(*_sources(spark, sf_dir))


@query(f"with {_SRC} select kind, count(*) as n, cast(sum(chunk_count) as bigint) as chunks, cast(sum(size_bytes) as bigint) as bytes from src group by kind")
def source_stats(spark, sf_dir):
    return store.source_stats(_sources(spark, sf_dir)[0])


@query("""with stored as (select url as uri, case when page_id % 5 = 0 then sha256(html || 'x') else sha256(html) end as digest from pages where page_id % 4 > 0 union all select 'gone://' || page_id, 'x' from pages where page_id % 10 = 0),
  files as (select url as uri, case when page_id % 9 = 0 then '' else html end as content from pages where page_id % 6 > 0)
  select coalesce(s.uri, f.uri) as uri, case when f.uri is null then 'removed' when strlen(content) = 0 or strlen(content) > 2500 then 'skipped' when digest is null then 'inserted' when digest = sha256(content) then 'unchanged' else 'updated' end as change
  from stored s full join files f on s.uri = f.uri""")
def change_detection(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    stored = pages.where("page_id % 4 > 0").select(F.col("url").alias("uri"), F.when(F.col("page_id") % 5 == 0, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256)).alias("digest")).unionByName(pages.where("page_id % 10 = 0").select(F.concat(F.lit("gone://"), "page_id").alias("uri"), F.lit("x").alias("digest")))
    files = pages.where("page_id % 6 > 0").select(F.col("url").alias("uri"), F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("html")).alias("content"))
    return store.changes(stored, files, 2500)


@query("select '#' || conv_id as entity, text as content, 1700000000 + conv_id * 100 + turn as valid_from, role as author from conversations where trim(text) <> ''")
def chat_ingest(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("role").alias("user"), (F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"), "text")
    return adapters.parse_chat(lines)[0]


@query("select distinct '#' || conv_id as from_entity, 'has_participant' as relation_type, role as to_entity from conversations where trim(text) <> ''")
def chat_edges(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("role").alias("user"), F.lit(0).cast("long").alias("ts"), "text")
    return adapters.parse_chat(lines)[1]


def _left(spark, sf_dir):
    """A store from which some people are gone."""
    return fx.entities(spark, sf_dir).where("id not like 'c%7'")


@query(f"""{T('entities', 'relations')}, there as (select * from entities where id not like 'c%7') select distinct id from (select id, unnest([from_entity, to_entity]) as e from relations) where e not in (select id from there)""")
def dangling_relations(spark, sf_dir):
    return store.dangling(fx.relations(spark, sf_dir), _left(spark, sf_dir))


# --- graph ------------------------------------------------------------------------------------------


def _seeds(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return c.where("c_custkey % 30 < 5").select(F.floor(F.col("c_custkey") / 30).alias("query_id"), (F.col("c_custkey") % 30 + 1).cast("int").alias("rank"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"))


@query(f"""{T('relations')}, seeds as (select c_custkey // 30 as query_id, cast(c_custkey % 30 + 1 as int) as rank, 'c' || c_custkey as entity_id from customer where c_custkey % 30 < 5),
  f as (select *, row_number() over (partition by query_id order by rank, entity_id) as seed_no from seeds), live as (select * from relations where valid_until is null or valid_until > {NOW}),
  e as (select from_entity as a, to_entity as b, relation_type, weight from live union all select to_entity, from_entity, relation_type, weight from live),
  m as (select query_id, b, min((seed_no, -weight, relation_type)) as first from f join e on e.a = entity_id where seed_no <= 4 group by all),
  n as (select query_id, b, row_number() over (partition by query_id order by (first[3] = 'part_of')::int, first, b) as near_no from m),
  every as (select query_id, entity_id, 0 as wave, seed_no as x from f where seed_no <= 8 union all select query_id, b, 1, near_no from n where near_no <= 6),
  once as (select query_id, entity_id, min((wave, x)) as spot from every group by all) select query_id, row_number() over (partition by query_id order by spot, entity_id) as place, entity_id from once""")
def traversal_neighbors(spark, sf_dir):
    return graph.traverse(_seeds(spark, sf_dir), fx.relations(spark, sf_dir), NOW)


def _supersedes(spark, sf_dir):
    """A customer's order follows the one before when its key is even; a few links close cycles."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("older"))
    chain = o.where("older is not null and o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("newer"), "older")
    first = o.where("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("newer"), F.max("o_orderkey").alias("older"))
    return chain.unionByName(first.select("newer", "older"))


_SUPER = """o as (select o_orderkey, o_custkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as older from orders),
  links as (select o_orderkey as newer, older from o where older is not null and o_orderkey % 4 > 0 union all select min(o_orderkey), max(o_orderkey) from orders where o_custkey % 10 = 0 group by o_custkey),
  step as (select older as id, min(newer) as nxt from links group by older),
  chain as (select o_orderkey as start, 0 as hop, o_orderkey as id, [o_orderkey] as seen from orders where o_orderkey % 10 = 0
    union all select start, hop + 1, nxt, list_append(seen, nxt) from chain join step using (id) where hop < 8 and not list_contains(seen, nxt))"""


def _chain(spark, sf_dir, starts="o_orderkey % 10 = 0"):
    return graph.supersession_chain(_supersedes(spark, sf_dir), fx.table(spark, sf_dir, "orders").where(starts).select(F.col("o_orderkey").alias("id")))


@query(f"with recursive {_SUPER} select start, hop, id from chain")
def supersession_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


def _ranked_orders(spark, sf_dir):
    """Per customer segment of ten: all orders, dearest first."""
    o = fx.table(spark, sf_dir, "orders")
    by = Window.partitionBy(F.floor(F.col("o_custkey") / 10)).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select(F.floor(F.col("o_custkey") / 10).alias("query_id"), F.row_number().over(by).alias("rank"), F.col("o_orderkey").alias("item"), "o_orderpriority")


_RANKED_SQL = "hits as (select o_custkey // 10 as query_id, row_number() over (partition by o_custkey // 10 order by o_totalprice desc, o_orderkey) as rank, o_orderkey as item, o_orderpriority from orders)"


_SUPER_ALL = _SUPER.replace(" from orders where o_orderkey % 10 = 0", " from orders")  # every order starts a chain


@query(f"""with recursive {_SUPER_ALL}, {_RANKED_SQL}, last as (select start, arg_max(id, hop) as head from chain group by start),
  b as (select query_id, rank, item, head from hits left join last on last.start = item),
  e as (select query_id, rank, 0 as behind, coalesce(head, item) as item from b union all select query_id, rank, 1, item from b where head <> item),
  once as (select query_id, item, min((rank, behind)) as spot from e group by all), p as (select query_id, row_number() over (partition by query_id order by spot, item) as place, item from once) select * from p where place <= 10""")
def successor_promotion(spark, sf_dir):
    return graph.promote_successors(_ranked_orders(spark, sf_dir).drop("o_orderpriority"), _chain(spark, sf_dir, "true"), 10)


@query(f"""with {_RANKED_SQL}, l as (select query_id, left(o_orderpriority, 1) as space, ascii(o_orderpriority) as space_pos, row_number() over (partition by query_id, o_orderpriority order by rank) as rank, item from hits),
  p as (select query_id, row_number() over (partition by query_id order by rank, space_pos, item) as place, space, item from l) select * from p where place <= 12""")
def layered_interleave(spark, sf_dir):
    hits = _ranked_orders(spark, sf_dir)
    ranked = hits.select("query_id", F.substring("o_orderpriority", 1, 1).alias("space"), F.ascii("o_orderpriority").alias("space_pos"), F.row_number().over(Window.partitionBy("query_id", "o_orderpriority").orderBy("rank")).alias("rank"), "item")
    return graph.interleave(ranked, 12)


_ROUTES = """routes as (select o_custkey % 100 as query_id, o_orderkey % 3 as route, row_number() over (partition by o_custkey % 100, o_orderkey % 3 order by o_totalprice desc, o_orderkey) as rank, o_orderkey // 7 as item from orders)"""


def _routes(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("query_id"), (F.col("o_orderkey") % 3).alias("route"), "o_totalprice", "o_orderkey")
    return o.select("query_id", "route", F.row_number().over(Window.partitionBy("query_id", "route").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), F.floor(F.col("o_orderkey") / 7).alias("item"))


@query(f"with {_ROUTES}, once as (select query_id, item, min((route, rank)) as spot from routes group by all), p as (select query_id, row_number() over (partition by query_id order by spot, item) as place, item from once) select * from p where place <= 15")
def append_dedup(spark, sf_dir):
    return graph.append_dedup(_routes(spark, sf_dir), 15)


@query(f"""with {_ROUTES}, q as (select distinct query_id, case query_id % 3 when 0 then 'lookup' when 1 then 'content' else 'relational' end as intent from routes),
  pl(intent, route, place) as (values ('lookup', 0, 0), ('lookup', 1, 1), ('content', 1, 0), ('content', 0, 1), ('relational', 2, 0), ('relational', 1, 1), ('relational', 0, 2)),
  once as (select r.query_id, r.item, min((pl.place, r.rank)) as spot from routes r join q using (query_id) join pl on pl.intent = q.intent and pl.route = r.route group by all),
  p as (select query_id, row_number() over (partition by query_id order by spot, item) as place, item from once) select * from p where place <= 10""")
def routed_retrieval(spark, sf_dir):
    routes = _routes(spark, sf_dir)
    kind = F.when(F.col("query_id") % 3 == 0, "lookup").when(F.col("query_id") % 3 == 1, "content").otherwise("relational")
    asked = routes.select("query_id").distinct().withColumn("intent", kind)
    part = [routes.where(F.col("route") == i).drop("route") for i in range(3)]
    return graph.routed(asked, part[0], part[1], part[2], 10)


# --- lifecycle --------------------------------------------------------------------------------------

_KEPT = "exp(-0.001e0 * greatest({now} - observed_at, 0) / 86400e0) * (1e0 + 0.15e0 * ln(1e0 + greatest(access_count, 0))) * least(greatest(confidence, 0e0), 1e0) * case when source in ('correction', 'cortex:correction') then 1.3e0 else 1e0 end".format(now=NOW)


@query(f"{T('observations')} select id, observed_at, round({_KEPT}, 6) as retention from observations where not tombstoned")
def retention_scores(spark, sf_dir):
    return lifecycle.retention(fx.observations(spark, sf_dir), NOW, 0.001)


_SETTINGS = lifecycle.Consolidation(decay_rate=0.001, prune_floor=0.1, threshold=0.6)


@query(f"{T('observations')} select id, round({_KEPT}, 6) as retention from observations where not tombstoned and {NOW} - observed_at >= 86400 and round({_KEPT}, 6) < 0.1")
def prune_candidates(spark, sf_dir):
    return lifecycle.prune_candidates(fx.observations(spark, sf_dir), NOW, _SETTINGS)


@query(f"{T('observations')} select id from observations where tombstoned and coalesce(valid_until, observed_at) <= {NOW - 14 * 86400}")
def stale_tombstones(spark, sf_dir):
    return lifecycle.stale_tombstones(fx.observations(spark, sf_dir), NOW).select("id")


@query(f"""{T('entities', 'observations', 'relations')} select id, name from entities e where not exists (select 1 from observations o where o.entity_id = e.id)
  and not exists (select 1 from relations r where r.from_entity = e.id and (r.valid_until is null or r.valid_until > {NOW})) and not exists (select 1 from relations r where r.to_entity = e.id and (r.valid_until is null or r.valid_until > {NOW}))""")
def orphan_entities(spark, sf_dir):
    return lifecycle.orphans(fx.entities(spark, sf_dir), fx.observations(spark, sf_dir), fx.relations(spark, sf_dir), NOW).select("id", "name")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim(coalesce(content, ''))), '\\s+'), lambda w: w <> ''))"


@query(f"""{T('talk')}, every as (select entity_id, id, observed_at, {_WORDS} as ws from talk where not tombstoned),
  w as (select * from (select *, row_number() over (partition by entity_id, list_sort(ws) order by observed_at desc, id) as nth from every) where nth = 1),
  p as (select a.entity_id, a.id as i, b.id as j, a.observed_at as t1, b.observed_at as t2, len(list_intersect(a.ws, b.ws)) as n, len(a.ws) + len(b.ws) as m from w a join w b on a.entity_id = b.entity_id and a.id < b.id)
  select entity_id, case when t1 > t2 or (t1 = t2 and i < j) then i else j end as a, case when t1 > t2 or (t1 = t2 and i < j) then j else i end as b, round(n / (m - n)::double, 6) as similarity from p where n / (m - n)::double >= 0.1""")
def jaccard_pairs(spark, sf_dir):
    return lifecycle.similar_pairs(fx.talk(spark, sf_dir), 0.1)


#: The greedy pass, leader by leader within an entity: a leader that is not taken takes what it is similar to and is left.
_LED = f"""every as (select entity_id, id, observed_at, {_WORDS} as ws from talk where not tombstoned),
  named as (select *, first_value(id) over (partition by entity_id, list_sort(ws) order by observed_at desc, id) as class from every), w as (select * from named where id = class),
  p as (select a.entity_id, a.id as i, b.id as j, a.observed_at as t1, b.observed_at as t2, len(list_intersect(a.ws, b.ws)) as n, len(a.ws) + len(b.ws) as m from w a join w b on a.entity_id = b.entity_id and a.id < b.id),
  near as (select entity_id, case when t1 >= t2 then i else j end as a, case when t1 >= t2 then j else i end as b, greatest(t1, t2) as t from p where n / (m - n)::double >= 0.1),
  heads as (select entity_id, a, list(b order by b) as bs, row_number() over (partition by entity_id order by max(t) desc, a) as n from near group by entity_id, a),
  walk as (select distinct entity_id, 0::bigint as n, cast([] as bigint[]) as taken, cast(null as bigint) as a, cast([] as bigint[]) as got from heads
    union all select w.entity_id, h.n, case when list_contains(w.taken, h.a) then w.taken else list_concat(w.taken, h.bs) end, h.a, case when list_contains(w.taken, h.a) then [] else list_filter(h.bs, lambda b: not list_contains(w.taken, b)) end
    from walk w join heads h on h.entity_id = w.entity_id and h.n = w.n + 1),
  led as (select entity_id, a as survivor, unnest(got) as loser from walk where a is not null),
  lost as (select * from led union all select x.entity_id, coalesce(led.survivor, x.class), x.id from named x left join led on led.loser = x.class where x.id <> x.class)"""


@query(f"with recursive {T('talk').removeprefix('with ')}, {_LED} select * from lost")
def duplicate_leaders(spark, sf_dir):
    return lifecycle.duplicates(fx.talk(spark, sf_dir), 0.1)


_LATER = TALK_NOW + 10**8
_OLD = _KEPT.replace(f"{NOW} - observed_at", f"{_LATER} - observed_at").replace("-0.001e0", "-0.01e0")


@query(f"""with recursive {T('talk').removeprefix('with ')}, {_LED}, old as (select id from talk where not tombstoned and {_LATER} - observed_at >= 86400 and round({_OLD}, 6) < 0.05)
  select coalesce(l.loser, old.id) as id, l.loser is not null as duplicate, old.id is not null as pruned from (select distinct loser from lost) l full join old on old.id = l.loser""")
def consolidation(spark, sf_dir):
    return lifecycle.consolidate(fx.talk(spark, sf_dir), _LATER, lifecycle.Consolidation(threshold=0.1))


@query(f"""{T('observations')} select id, tombstoned or id % 10 = 0 as tombstoned, case when id % 10 = 0 then least(coalesce(valid_until, {NOW}), {NOW}) else valid_until end as valid_until from observations""")
def forget_rows(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    return lifecycle.forget(rows, rows.where("id % 10 = 0").select("id"), NOW).select("id", "tombstoned", "valid_until")


@query(f"""{T('observations')}, old as (select * from observations where not tombstoned and id % 25 = 0), rest as (select id, entity_id, content, tombstoned, valid_until from observations where id not in (select id from old))
  select * from rest union all select id, entity_id, content, true, least(coalesce(valid_until, {NOW}), {NOW}) from old union all select -id - 1, entity_id, content || ' (corrected)', false, null from old""")
def supersede_rows(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    changed = rows.where("id % 25 = 0").select("id", (-F.col("id") - 1).alias("new_id"), F.concat("content", F.lit(" (corrected)")).alias("content"))
    return lifecycle.supersede(rows, changed, NOW)[0].select("id", "entity_id", "content", "tombstoned", "valid_until")


# --- history ----------------------------------------------------------------------------------------


def _revisions(spark, sf_dir):
    """Line items as revisions of their order."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")])
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision_id"), F.col("l_orderkey").alias("observation_id"), (F.col("l_orderkey") % 50).alias("changeset_id"), (F.unix_timestamp("l_shipdate")).alias("created_at"), F.col("l_returnflag").alias("content"), F.col("l_linestatus").alias("source"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("importance"))


_REV = "rev as (select l_orderkey * 10 + l_linenumber as revision_id, l_orderkey as observation_id, l_orderkey % 50 as changeset_id, cast(epoch(l_shipdate) as bigint) as created_at, l_returnflag as content, l_linestatus as source, case when l_quantity > 25 then l_quantity end as importance from (select l_orderkey, l_linenumber, max(l_shipdate) as l_shipdate, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus, max(l_quantity) as l_quantity from lineitem group by all))"


@query(f"""with {_REV}, cs as (select n_nationkey as id, 'human' as actor_kind, n_name as actor_id, 'edit' as reason from nation),
  r as (select rev.revision_id, created_at, content, actor_id from rev join cs on cs.id = rev.changeset_id where observation_id = (select min(observation_id) from rev where observation_id % 50 = 3))
  select revision_id, created_at, content, actor_id, row_number() over (order by created_at, revision_id) as rank, (select count(*) from r where (created_at, revision_id) > (700000000, 0)) > 3 as has_more from r where (created_at, revision_id) > (700000000, 0) order by created_at, revision_id limit 3""")
def history_page(spark, sf_dir):
    revs = _revisions(spark, sf_dir)
    cs = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("human").alias("actor_kind"), F.col("n_name").alias("actor_id"), F.lit("edit").alias("reason"))
    first = revs.where("observation_id % 50 = 3").agg(F.min("observation_id").alias("o")).first()["o"]
    return history.history(revs, cs, first, after=(700_000_000, 0), limit=3).select("revision_id", "created_at", "content", "actor_id", "rank", "has_more")


@query(f"""with {_REV}, p as (select a.revision_id as from_revision, b.revision_id as to_revision, a.content as c1, b.content as c2, a.source as s1, b.source as s2, a.importance as i1, b.importance as i2 from rev a join rev b on b.observation_id = a.observation_id and b.revision_id = a.revision_id + 1)
  select from_revision, to_revision, 'content' as field, c1 as before, c2 as after from p where c1 is distinct from c2 union all select from_revision, to_revision, 'source', s1, s2 from p where s1 is distinct from s2""")
def revision_diff(spark, sf_dir):
    revs = _revisions(spark, sf_dir)
    pairs = revs.select(F.col("revision_id").alias("from_revision"), (F.col("revision_id") + 1).alias("to_revision"))
    return history.revision_diff(revs, pairs, ("content", "source"))


_LOG = """log as (select o_orderkey % 2000 as changeset_id, o_orderkey as seq, case when o_orderkey < 2000 then 1 else 1 + o_orderkey % 2 end as row_version, case when o_orderkey < 2000 then 'submit' when o_totalprice > 200000 then 'approve' else 'reject' end as event, o_custkey % 5 as actor from orders)"""


@query(f"""with {_LOG}, o as (select changeset_id, row_version, actor from log where event = 'submit'),
  d as (select l.changeset_id, arg_min(l.event, l.seq) as event from log l join o using (changeset_id) where l.event <> 'submit' and l.row_version = o.row_version and l.actor <> o.actor group by all)
  select o.changeset_id, case d.event when 'approve' then 'applied' when 'reject' then 'rejected' else 'proposed' end as state, o.row_version + (d.event is not null)::int as row_version from o left join d using (changeset_id)""")
def changeset_states(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    early = F.col("o_orderkey") < 2000
    log = o.select((F.col("o_orderkey") % 2000).alias("changeset_id"), F.col("o_orderkey").alias("seq"), F.when(early, F.lit(1)).otherwise(1 + F.col("o_orderkey") % 2).alias("row_version"), F.when(early, "submit").when(F.col("o_totalprice") > 200000, "approve").otherwise("reject").alias("event"), (F.col("o_custkey") % 5).alias("actor"))
    return history.folded_changesets(log)


@query("""with b as (select c_custkey as id, c_name as name, 1 as v from customer), ch as (select c_custkey + 3 as id, c_name || '!' as name, 2 as v, c_custkey % 9 = 0 as del from customer where c_custkey % 3 = 0)
  select coalesce(ch.id, b.id) as id, coalesce(ch.name, b.name) as name from b full join ch using (id) where not coalesce(ch.del, false)""")
def change_feed(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    state = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("row_version"))
    feed = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 3).alias("id"), F.concat("c_name", F.lit("!")).alias("name"), F.lit(2).alias("row_version"), (F.col("c_custkey") % 9 == 0).alias("deleted"))
    return history.apply_changes(state, feed).select("id", "name")


# --- merge ------------------------------------------------------------------------------------------


def _people(spark, sf_dir, side: str):
    c = fx.table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    if side == "target":
        return c.select(n.alias("id"), F.concat(F.lit("Name "), n % 400).alias("label"), F.col("c_mktsegment").alias("kind"), F.array(F.concat(F.lit("alias "), n % 300)).alias("aliases"), F.when(n % 5 == 0, F.concat(F.lit("L"), n)).alias("lineage"), F.array(F.struct(F.lit("crm").alias("namespace"), F.concat(F.lit("v"), n % 700).alias("value"), (n % 2 == 0).alias("verified"))).alias("identifiers"))
    return c.where("c_custkey % 10 = 0").select((n + 1_000_000).alias("id"), F.concat(F.lit("name   "), n % 400).alias("label"), F.col("c_mktsegment").alias("kind"), F.array(F.concat(F.lit("ALIAS "), n % 300), F.concat(F.lit("Name "), (n + 1) % 400)).alias("aliases"), F.concat(F.lit("L"), n).alias("lineage"), F.array(F.struct(F.lit("crm").alias("namespace"), F.concat(F.lit("v"), n % 700).alias("value"), (n % 4 == 0).alias("verified"))).alias("identifiers"))


@query("""with t as (select c_custkey as id, 'name ' || c_custkey % 400 as label, c_mktsegment as kind, 'alias ' || c_custkey % 300 as alias, case when c_custkey % 5 = 0 then 'L' || c_custkey end as lineage, 'v' || c_custkey % 700 as ident, c_custkey % 2 = 0 as ok from customer),
  s as (select c_custkey + 1000000 as id, 'name ' || c_custkey % 400 as label, c_mktsegment as kind, 'alias ' || c_custkey % 300 as a1, 'name ' || (c_custkey + 1) % 400 as a2, 'L' || c_custkey as lineage, 'v' || c_custkey % 700 as ident, c_custkey % 4 = 0 as ok from customer where c_custkey % 10 = 0),
  m as (select s.id as source_id, t.id as target_id, 0 as code from s join t on s.lineage = t.lineage union select s.id, t.id, 1 from s join t on s.ident = t.ident and s.ok and t.ok union select s.id, t.id, 2 from s join t on s.label = t.label and s.kind = t.kind
    union select s.id, t.id, 3 from s join t on s.a1 in (t.label, t.alias) and s.kind = t.kind union select s.id, t.id, 3 from s join t on s.a2 in (t.label, t.alias) and s.kind = t.kind),
  g as (select source_id, target_id, min(code) as priority, array_to_string(list_transform(list_sort(list(code)), lambda c: ['lineage', 'verified_identifier', 'exact_label', 'alias'][c + 1]), ',') as signals from m group by all),
  r as (select *, row_number() over (partition by source_id order by priority, target_id) as rank, count(*) over (partition by source_id) as total from g)
  select source_id, rank, target_id, signals, priority, total, total > 4 as truncated from r where rank <= 4""")
def identity_candidates(spark, sf_dir):
    return merge.identity_candidates(_people(spark, sf_dir, "target"), _people(spark, sf_dir, "source"), 4)


@query("""with p as (select o_orderkey as id, 'state' as field, o_orderstatus as b, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 5 = 0 then 'Y' when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as t from orders
  union all select o_orderkey, 'extra', null, 'new', case when o_orderkey % 2 = 0 then 'new' end from orders where o_orderkey % 13 = 0)
  select id, field, case when t is not distinct from b then s when s is not distinct from b then t when s is not distinct from t then s end as value,
  case when s is not distinct from b and t is not distinct from b then 'base' when t is not distinct from b then 'source' when s is not distinct from b then 'target' when s is not distinct from t then 'identical' else 'conflict' end as origin from p""")
def three_way_fields(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    n, status = F.col("o_orderkey"), F.col("o_orderstatus")
    main, extra = o, o.where("o_orderkey % 13 = 0")

    def side(value, more=None, odd=None):
        out = main.select(n.alias("id"), F.lit("state").alias("field"), value.alias("value"))
        return out if more is None else out.unionByName(extra.where(odd).select(n.alias("id"), F.lit("extra").alias("field"), F.lit(more).alias("value")))

    source = side(F.when(n % 3 == 0, "X").otherwise(status), "new", "true")
    target = side(F.when(n % 5 == 0, "Y").when(n % 7 == 0, "X").otherwise(status), "new", "o_orderkey % 2 = 0")
    return merge.merge_fields(side(status), source, target)


@query("""with s as (select c_custkey as id from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000 from customer where c_custkey % 4 = 0), r as (select c_custkey + 1000000 as id, min(c_custkey) as target_id from customer where c_custkey % 8 = 0 group by all)
  select case when r.target_id is not null then 'merge' when c.c_custkey is not null then 'keep' else 'add' end as action, count(*) as n from s left join r using (id) left join customer c on c.c_custkey = s.id group by all""")
def merge_accounting(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    target = c.select(F.col("c_custkey").alias("id"))
    source = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")).unionByName(c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 1_000_000).alias("id")))
    same = c.where("c_custkey % 8 = 0").select((F.col("c_custkey") + 1_000_000).alias("source_id"), F.col("c_custkey").alias("target_id"))
    return merge.plan_accounting(merge.plan_merge(target, source, same))


@query(f"""{T('entities', 'observations', 'relations')}, there as (select * from entities where id not like 'c%7') select 'observation without entity' as problem, cast(id as varchar) as id from observations where entity_id not in (select id from there)
  union all select distinct 'relation without end', id from (select id, unnest([from_entity, to_entity]) as e from relations) where e not in (select id from there)""")
def snapshot_problems(spark, sf_dir):
    return merge.snapshot_problems(_left(spark, sf_dir), fx.observations(spark, sf_dir), fx.relations(spark, sf_dir))


# --- remember ---------------------------------------------------------------------------------------


@query("""with k as (select *, row_number() over (partition by t order by u desc, id) as nth from (select c_custkey as id, c_name as name, c_mktsegment as t, c_custkey * 7 % 1000 as u from customer)),
  a(name, t) as (select distinct replace(c_name, '#', ' ') || case when c_custkey % 2 = 0 then '' else '7' end, c_mktsegment from customer)
  select a.name, a.t as entity_type, count(*) as candidates from a join k on k.t = a.t and k.nth <= 100 group by all""")
def name_candidates(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") * 7 % 1000).alias("updated_at"))
    asked = c.select(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("7")).alias("name"), F.col("c_mktsegment").alias("entity_type")).distinct()
    recent = search.top_k(known, [F.desc("updated_at"), F.col("id")], remember.RECENT, ["entity_type"], "nth")
    return asked.join(recent.select("entity_type"), "entity_type").groupBy("name", "entity_type").agg(F.count("*").alias("candidates"))


@query()
def fuzzy_names(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") * 7 % 1000).alias("updated_at"))
    asked = c.select(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("7")).alias("name"), F.col("c_mktsegment").alias("entity_type")).distinct()
    return remember.fuzzy_matches(asked, known)


# --- evaluation: benchmark items as queries, documents of a label as answers -------------------------

_EVAL = f"""toks as (select doc_id, {_TOKENS.format("text")} as ws from documents),
  post as (select doc_id, term, count(*)::double as tf from (select doc_id, unnest(ws) as term from toks) group by all), lens as (select doc_id, len(ws)::double as dl from toks where len(ws) > 0),
  st as (select count(*) as n, avg(dl) as a from lens), dfs as (select term, count(*) as df from post group by term),
  q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TOKENS.format("text")}) as term from benchmark) group by all),
  sc as (select query_id, p.doc_id as key, round({_SCORE}, 6) as score from q join post p using (term) join dfs using (term) join lens using (doc_id) cross join st group by query_id, p.doc_id),
  ranked as (select query_id, key, score, rank from (select *, row_number() over (partition by query_id order by score desc, key) as rank from sc) where rank <= 10),
  jd as (select item_id as query_id, doc_id as key, quality + 2 * toxic as relevance from benchmark join labels on doc_id % 40 = item_id % 40 union all select query_id, key, 1 + key % 3 from ranked where rank = 1 + query_id % 10),
  pos as (select query_id, key, max(relevance) as relevance, count(*) as times from jd where relevance > 0 group by all),
  m as (select p.*, r.rank from pos p left join ranked r using (query_id, key)),
  f as (select query_id, sum(times) as judged, sum(case when rank is not null then times else 0 end) as hit, count(*) as keys, count(rank) as hit_keys, min(rank) as first, coalesce(sum(case when rank is not null then (pow(2, relevance) - 1) / log2(rank + 1) end), 0) as dcg from m group by query_id),
  ideals as (select query_id, sum((pow(2, relevance) - 1) / log2(spot + 1)) as ideal from (select *, row_number() over (partition by query_id order by relevance desc, key) as spot from pos) where spot <= 10 group by query_id),
  scored as (select query_id, round(coalesce(hit / judged, 0), 6) as recall, round(coalesce(hit_keys / least(keys, 10), 0), 6) as capacity_recall, round(coalesce(1e0 / first, 0), 6) as mrr, round(coalesce(dcg / ideal, 0), 6) as ndcg from (select distinct query_id from jd) left join f using (query_id) left join ideals using (query_id)),
  qs as (select item_id as query_id, 'cat' || item_id % 3 as category, item_id % 7 = 0 as expect_abstention, item_id % 5 = 0 as waived, case when item_id % 2 = 0 then 'human' else 'auto' end as judgment_source from benchmark)"""


def _ranked(spark, sf_dir):
    """Ten documents for each item. The evaluation reads them several times, so that list (ten rows a query) is kept."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    ranked = search.text_topk(docs, asked, 10, ("doc_id",)).withColumnRenamed("doc_id", "key")
    return spark.createDataFrame(ranked.collect(), ranked.schema)


def _judged(spark, sf_dir, ranked):
    items, labels = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), fx.table(spark, sf_dir, "labels")
    given = items.withColumn("slot", F.col("query_id") % 40).join(labels.withColumn("slot", F.col("doc_id") % 40), "slot").select("query_id", F.col("doc_id").alias("key"), (F.col("quality") + 2 * F.col("toxic")).alias("relevance"))
    return given.unionByName(ranked.where(F.col("rank") == 1 + F.col("query_id") % 10).select("query_id", "key", (1 + F.col("key") % 3).cast("int").alias("relevance")))


def _asked(spark, sf_dir):
    n = F.col("item_id")
    return fx.table(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.concat(F.lit("cat"), n % 3).alias("category"), (n % 7 == 0).alias("expect_abstention"), (n % 5 == 0).alias("waived"), F.when(n % 2 == 0, "human").otherwise("auto").alias("judgment_source"))


def _scored(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return evaluation.score_queries(ranked, _judged(spark, sf_dir, ranked), 10)


@query(f"with {_EVAL} select query_id, recall, capacity_recall, mrr, ndcg from scored")
def ranking_metrics(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"""with {_EVAL}, v as (select category, judgment_source as source, case when not waived then recall end as recall, mrr, ndcg from scored join qs using (query_id) where not expect_abstention)
  select category, source, count(*) as n, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, grouping(category, source) as level from v group by grouping sets ((category), (source), ())""")
def quality_by_category(spark, sf_dir):
    return evaluation.quality(_scored(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""with {_EVAL}, s as (select query_id, count(*) as n from jd where relevance > 0 group by query_id), v as (select category, n, least(n, 10) / n as c from s join qs using (query_id) where not expect_abstention and not waived)
  select category, count(*) as n_queries, round(avg(c), 6) as mean_ceiling, round(min(c), 6) as min_ceiling, count(*) filter (n > 10) as capped from v group by grouping sets ((category), ())""")
def recall_ceiling(spark, sf_dir):
    return evaluation.recall_ceiling(_judged(spark, sf_dir, _ranked(spark, sf_dir)), _asked(spark, sf_dir), 10)


@query("""with o as (select event_type, value as ms, row_number() over (partition by event_type order by value) as place, count(*) over (partition by event_type) as size from events)
  select event_type, count(*) as n, round(avg(ms), 6) as mean, max(case when place = greatest(ceil(0.5 * size), 1) then ms end) as p50, max(case when place = greatest(ceil(0.95 * size), 1) then ms end) as p95, max(case when place = greatest(ceil(0.99 * size), 1) then ms end) as p99, max(ms) as max from o group by event_type""")
def latency_percentiles(spark, sf_dir):
    return evaluation.latency(fx.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), ["event_type"])


@query("""select count(*) as n_queries, count(distinct case when user_id % 5 = 0 then cast(event_id as varchar) else 'u' || user_id end) as n_groups, round(avg((event_id % 4 = 0)::int), 6) as abstained, round(avg(event_id % 4), 6) as mean_false_results, round(greatest(max(value), 0), 6) as max_false_score from events where event_type = 'error'""")
def abstention(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").where("event_type = 'error'")
    return evaluation.abstention(e.select(F.col("event_id").alias("query_id"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("u"), "user_id")).alias("group_id"), (F.col("event_id") % 4).alias("returned"), F.col("value").alias("top_score")))


@query("""with neg as (select round(value, 9) as t from events where event_type = 'error'), pos as (select case when event_id % 5 > 0 then round(value, 9) end as t from events where event_type = 'click'),
  st as (select t, row_number() over (order by t) as place, count(*) over () as size from (select t from neg union select t from pos where t is not null union select 0e0)),
  x as (select t from st where (place - 1) % greatest(size // 12, 1) = 0)
  select t as threshold, round((select count(*) from neg where neg.t <= x.t) / (select count(*) from neg)::double, 6) as abstained, round((select count(*) from pos where pos.t > x.t) / (select count(*) from pos)::double, 6) as answer_retained from x""")
def risk_coverage(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return evaluation.risk_coverage(e.where("event_type = 'error'").select(F.col("value").alias("top_score")), e.where("event_type = 'click'").select(F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("top_relevant_score")))


@query("""with s as (select o_orderpriority as g, o_orderstatus = 'F' as y, round(o_totalprice / 1000) as x from orders), c as (select g, x, count(*) filter (y) as p, count(*) filter (not y) as n from s group by all),
  w as (select g, p, n, p * (coalesce(sum(n) over (partition by g order by x rows between unbounded preceding and 1 preceding), 0) + n / 2e0) as won from c) select g, round(sum(won) / (sum(p) * sum(n)), 6) as auc from w group by g""")
def auc(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderstatus") == "F").alias("label"), F.round(F.col("o_totalprice") / 1000).alias("score"))
    return evaluation.auc(o, ["g"])


@query("with g as (select user_id, count(*) as n, avg(value) as m from events group by user_id) select cast(sum(n) as bigint) as rows, count(*) as clusters, round(avg(m), 6) as mean from g")
def clustered_mean(spark, sf_dir):
    return evaluation.clustered_mean(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), "value"))


@query("""with a as (select o_orderpriority as category, round(avg(o_totalprice), 2) as m from orders where o_orderkey % 2 = 0 group by 1), b as (select o_orderpriority as category, round(avg(o_totalprice), 2) as m from orders where o_orderkey % 2 = 1 and o_orderpriority <> '5-LOW' group by 1)
  select coalesce(b.category, a.category) as category, a.m as before, b.m as after, case when a.m is null or b.m is null then 'indeterminate' when b.m < a.m - 100 then 'fail' else 'pass' end as verdict from a full join b on a.category = b.category""")
def baseline_compare(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")

    def mean(df):
        return df.groupBy(F.col("o_orderpriority").alias("category")).agg(F.round(F.avg("o_totalprice"), 2).alias("m"))

    return evaluation.compare_baseline(mean(o.where("o_orderkey % 2 = 1 and o_orderpriority <> '5-LOW'")), mean(o.where("o_orderkey % 2 = 0")), "m", 100)


@query("select distinct doc_id as key from labels where doc_id not in (select vec_id from embeddings)")
def unknown_keys(spark, sf_dir):
    return evaluation.unknown_keys(fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key")))


_REPORT = "select o_orderpriority as category, round(avg(o_totalprice) / 500000, 6) as recall, round(avg(o_totalprice) / 400000, 6) as mrr, round(avg(o_totalprice) / 300000, 6) as ndcg, count(*) as n, o_orderpriority <> '5-LOW' as judgments_complete from orders where {0} group by o_orderpriority union all select null, round(avg(o_totalprice) / 500000, 6), round(avg(o_totalprice) / 400000, 6), round(avg(o_totalprice) / 300000, 6), count(*), true from orders where {0}"


def _report(spark, sf_dir, where):
    o = fx.table(spark, sf_dir, "orders").where(where)
    means = [F.round(F.avg("o_totalprice") / d, 6).alias(m) for m, d in (("recall", 500000), ("mrr", 400000), ("ndcg", 300000))]
    by = o.groupBy(F.col("o_orderpriority").alias("category")).agg(*means, F.count("*").alias("n")).withColumn("judgments_complete", F.col("category") != "5-LOW")
    return by.unionByName(o.agg(*means, F.count("*").alias("n")).select(F.lit(None).cast("string").alias("category"), "*", F.lit(True).alias("judgments_complete")))


@query(f"""with cur as ({_REPORT.format("o_orderkey % 3 = 0 and o_orderpriority <> '1-URGENT'")}), base as ({_REPORT.format("o_orderkey % 3 = 1")}),
  c as (select base.category, base.ndcg - cur.ndcg as d, base.judgments_complete and cur.judgments_complete as whole from base join cur on cur.category = base.category),
  m as (select 'recall' as metric, b.recall - a.recall as d from base b, cur a where b.category is null and a.category is null union all select 'mrr', b.mrr - a.mrr from base b, cur a where b.category is null and a.category is null union all select 'ndcg', b.ndcg - a.ndcg from base b, cur a where b.category is null and a.category is null)
  select 'category:' || category as gate, case when round(d, 9) <= 0.001 then 'pass' when whole then 'fail' else 'indeterminate' end as verdict from c
  union all select 'aggregate:' || metric, case when round(d, 9) > 0.001 then 'fail' else 'pass' end from m
  union all select 'category_coverage', case when (select count(*) from base where category is not null and category not in (select category from cur where category is not null)) = 0 then 'pass' else 'fail' end""")
def gate_outcomes(spark, sf_dir):
    cur, base = _report(spark, sf_dir, "o_orderkey % 3 = 0 and o_orderpriority <> '1-URGENT'"), _report(spark, sf_dir, "o_orderkey % 3 = 1")
    limits = gates.Limits(category_drop=0.001, aggregate_drop=0.001)
    return gates.category_gates(cur, base, limits).unionByName(gates.aggregate_gate(cur, base, limits)).unionByName(gates.coverage_gate(cur, base)).select("gate", "verdict")


_CATALOG = """sp as (select 'sp' || s_suppkey as id, case when s_suppkey % 3 = 0 then 'user' else 'team' end as owner_kind, case when s_suppkey % 3 = 0 then 'p' || s_suppkey % 40 else 't' || s_suppkey % 25 end as owner_id from supplier),
  pr as (select 'p' || c_custkey as id, case when c_custkey % 11 = 0 then 'closed' else 'active' end as state from customer),
  tm as (select 't' || n_nationkey as id, case when n_nationkey % 6 = 0 then 'closed' else 'active' end as state from nation),
  ms as (select 't' || c_nationkey as team_id, 'p' || c_custkey as principal_id, case when c_custkey % 2 = 0 then 'reader' else 'writer' end as role, case when c_custkey % 5 = 0 then 10 when c_custkey % 7 = 0 then 1000 end as expires_at from customer)"""


@query(f"""with {_CATALOG} select pr.id as principal_id, sp.id as space_id, 'maintainer' as role from sp join pr on pr.id = sp.owner_id and owner_kind = 'user' where pr.state = 'active'
  union all select pr.id, sp.id, ms.role from sp join tm on tm.id = sp.owner_id and owner_kind = 'team' join ms on ms.team_id = tm.id join pr on pr.id = ms.principal_id where pr.state = 'active' and tm.state = 'active' and (expires_at is null or expires_at > 100)""")
def effective_roles(spark, sf_dir):
    s, c, n = (fx.table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    k = F.col("s_suppkey")
    sp = s.select(F.concat(F.lit("sp"), k).alias("id"), F.when(k % 3 == 0, "user").otherwise("team").alias("owner_kind"), F.when(k % 3 == 0, F.concat(F.lit("p"), k % 40)).otherwise(F.concat(F.lit("t"), k % 25)).alias("owner_id"))
    p = F.col("c_custkey")
    pr = c.select(F.concat(F.lit("p"), p).alias("id"), F.when(p % 11 == 0, "closed").otherwise("active").alias("state"))
    tm = n.select(F.concat(F.lit("t"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 6 == 0, "closed").otherwise("active").alias("state"))
    ms = c.select(F.concat(F.lit("t"), "c_nationkey").alias("team_id"), F.concat(F.lit("p"), p).alias("principal_id"), F.when(p % 2 == 0, "reader").otherwise("writer").alias("role"), F.when(p % 5 == 0, 10).when(p % 7 == 0, 1000).alias("expires_at"))
    return spaces.effective_roles(sp, pr, tm, ms, 100)


@query("select event_id as sequence, event_type from events where event_id > 500 order by event_id limit 25")
def events_after(spark, sf_dir):
    return spaces.events_after(fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), "event_type"), 500, 25)


@query(f"""{T('entities', 'observations', 'relations')}, r as (select name, id from entities where id like 'c%' and name in (select c_name from customer)),
  f as (select entity_id, list(id order by observed_at desc, id) as obs from (select *, row_number() over (partition by entity_id order by observed_at desc, id) as nth from observations where {_LIVE}) where nth <= 3 group by entity_id)
  select r.name, 'unique' as outcome, r.id, f.obs as observations, (select count(*) from relations x where x.from_entity = r.id and (valid_until is null or valid_until > {NOW})) as outgoing, (select count(*) from relations x where x.to_entity = r.id and (valid_until is null or valid_until > {NOW})) as incoming from r left join f on f.entity_id = r.id""")
def entity_records(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    found = store.resolve(fx.entities(spark, sf_dir), asked).where("outcome = 'unique'")
    return store.entity_records(found, fx.observations(spark, sf_dir), fx.relations(spark, sf_dir), NOW, 3)


@query(f"{T('observations')} select id, case when id % 20 = 0 then 'procedural' else memory_tier end as memory_tier from observations")
def tier_change(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    wanted = rows.where("id % 20 = 0").select("id", F.lit("procedural").alias("memory_tier")).unionByName(rows.where("id % 31 = 0 and id % 20 > 0").select("id", F.lit("eternal").alias("memory_tier")))
    return lifecycle.set_tier(rows, wanted).select("id", "memory_tier")


@query(f"""{T('observations', 'relations')}, w as (select 'c' || c_custkey as entity_id from customer where c_custkey % 25 = 0)
  select w.entity_id, (select count(*) from observations o where o.entity_id = w.entity_id) as observations, (select count(*) from relations r where r.from_entity = w.entity_id or r.to_entity = w.entity_id) as relations from w""")
def destruction_preview(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "customer").where("c_custkey % 25 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return lifecycle.destruction_preview(fx.observations(spark, sf_dir), fx.relations(spark, sf_dir), ids).drop("digest")


@query(f"{T('entities', 'relations')} select count(*) as entities, (select count(*) from relations) as relations from entities")
def domain_totals(spark, sf_dir):
    report = store.domain_report(fx.entities(spark, sf_dir), fx.relations(spark, sf_dir), 8)
    return report.agg(F.sum("entities").alias("entities"), F.sum(F.col("local") + F.col("crossing")).alias("relations"))
