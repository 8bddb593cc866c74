"""DuckDB SQL of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from chronolith.llm import audit, contamination, manifest

_SPLIT = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def similarity_groups(width: int = 4, percent: int = 85) -> str:
    """Links by counting shared shingles, components by recursion over links."""
    return f"""with recursive w as (select doc_id, {_SPLIT.format(_LOWER)} as ws from documents),
    s as (select distinct doc_id, case when len(ws) >= {width} then array_to_string(ws[i:i + {width - 1}], ' ') else 'whole ' || array_to_string(ws, ' ') end as g
      from (select doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {width - 1}))) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    both_counts as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (select a, b, k = x.n and k = y.n as equal from both_counts join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
    reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on l.a = r.other)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id, coalesce(l.k, 0) as n_links, least(d.doc_id, coalesce(l.e, d.doc_id)) as class_id
    from documents d left join n on n.doc_id = d.doc_id left join (select doc_id, min(other) as m from reach group by doc_id) r on r.doc_id = d.doc_id
    left join (select a, count(*) as k, min(case when equal then b end) as e from links group by a) l on l.a = d.doc_id"""


def removed_windows(width: int = 13) -> str:
    """Words covered by a window that also starts in a document with a smaller doc_id."""
    return f"""with w as (select doc_id, {_SPLIT.format("coalesce(text, '')")} as ws from documents),
    win as (select doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - {width - 1})) as i from w where len(ws) >= {width})),
    firsts as (select g, min(doc_id) as m from win group by g),
    gone as (select distinct doc_id, unnest(generate_series(i, i + {width - 1})) as i from win join firsts using (g) where m < doc_id),
    words as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as i from w),
    kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id)
    select w.doc_id, len(ws)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
    from w left join (select doc_id, count(*) as n from gone group by doc_id) g on g.doc_id = w.doc_id left join kept k on k.doc_id = w.doc_id"""


def removed_bytes(length: int = 200) -> str:
    """Bytes, as pairs of hexadecimal digits, covered by a string that also starts anywhere else."""
    return f"""with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
    win as (select doc_id, i, md5(x[2 * i + 1:2 * i + {2 * length}]) as g from (select doc_id, x, unnest(generate_series(0, len(x) // 2 - {length})) as i from h where len(x) >= {2 * length})),
    twice as (select g from win group by g having count(*) > 1),
    hit as (select doc_id, i from win semi join twice using (g)),
    runs as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from hit),
    spans as (select doc_id, min(i) as a, max(i) + {length} as b from (select doc_id, i, sum(case when gap is null or gap > {length} then 1 else 0 end) over (partition by doc_id order by i) as r from runs) group by doc_id, r),
    pieces as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as t from spans union all select doc_id, max(b), 2000000000 from spans group by doc_id),
    kept as (select p.doc_id, string_agg(x[2 * f + 1:2 * least(t, len(x) // 2)], '' order by f) as k from pieces p join h using (doc_id) group by p.doc_id),
    sums as (select doc_id, count(*) as n, sum(b - a) as r from spans group by doc_id)
    select h.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(s.r, 0)::bigint as n_removed, coalesce(s.n, 0)::bigint as n_spans, sha256(unhex(coalesce(k.k, x))) as kept_sha256
    from h left join sums s on s.doc_id = h.doc_id left join kept k on k.doc_id = h.doc_id"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    """The same links as ``similarity_groups`` counts, whatever found them."""
    return f"select doc_id, n_shingles, component_id, doc_id = component_id as kept from ({similarity_groups(width, percent)})"


ORACLE_SQL = {
    "op1_ngram_jaccard": similarity_groups(),
    "op5_substring_dedup": removed_windows(),
    "op8_suffix_dedup": removed_bytes(),
    "op10_decontamination": contamination.oracle_sql(),
    "op11_merkle_manifest": manifest.oracle_sql(),
    "op12_filter_audit": audit.oracle_sql(),
    "op13_minhash_dedup": near_duplicates(),
}
