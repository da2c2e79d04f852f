"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .line_dedup import _SMALL, _UPPER
from .replication import DEVIATIONS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: gaps and matches in turn, their lengths added up."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, {rank} as rank, '{kind}' as kind, stop - size as start, stop from (
  select doc_id, length(m[i]) as size, length(g[i]) as counts, (list_sum(list_transform(gap[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::bigint as stop
  from (select doc_id, gap, m, g, unnest(generate_series(1, len(m))) as i from (
   select doc_id, regexp_split_to_array(text, '{p}') as gap, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {group}) as g from documents where regexp_matches(text, '{p}')))) where counts >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SQL: dict[str, str] = {
    "op1_winnowing": f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
 item as (select item_id, n, w[i : i + n - 1] as win from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from (select item_id, w, least(13, len(w)) as n from b where len(w) > 0))),
 wins as (select doc_id, n, i, w[i : i + n - 1] as win from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d cross join (select distinct n from item) where len(w) >= n)),
 hit as (select doc_id, item_id, i, wins.n from wins join item using (win)),
 pos as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
 its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join its using (doc_id)""",
    "op4_line_dedup": f"""with lines as (select doc_id, l[i] as line, i, translate(trim(l[i], {_BLANKS}), '{_UPPER}', '{_SMALL}') as key
  from (select doc_id, l, unnest(generate_series(1, len(l))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
 held as (select key, max(doc_id) as last from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
 marked as (select lines.*, coalesce(doc_id <> last, false) as gone from lines left join held using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from marked group by doc_id""",
    "op5_poisson_mix": f"""with sizes as (select source, sum(length(coalesce(text, '')))::bigint as size from documents group by source),
 total as (select sum(size) as all_size, sum(sqrt(size)) filter (size > 0) as all_weight from sizes),
 rates as (select source, case when size = 0 then 1.0 else round(sqrt(size) / all_weight * all_size / size, 9) end as rate from sizes, total),
 steps as (select source, rate, greatest(0, floor(rate - {DEVIATIONS} * sqrt(rate) - 20))::bigint as least, ceil(rate + {DEVIATIONS} * sqrt(rate) + 20)::bigint as most from rates where rate > 0),
 mass as (select source, rate, least, unnest(generate_series(least, most)) as k from steps),
 sums as (select source, rate, least, round(sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k), 12) as s from mass),
 drawn as (select *, md5(coalesce(text, '')) as h from documents),
 u as (select *, ('0x' || substr(md5('0|' || doc_id || '|' || h), 1, 13))::bigint / 4503599627370496.0::double as u from drawn),
 n as (select u.doc_id, u.h, any_value(least) + count(*) filter (s <= u.u) as copies, any_value(rate) as rate from u join sums on u.source is not distinct from sums.source group by u.doc_id, u.h)
select doc_id, text, lang, source, n_chars, rate, copy::int as copy, md5('mix|0|' || doc_id || '|' || h || '|' || copy) as mix_key
from (select drawn.*, rate, unnest(generate_series(1, copies)) as copy from drawn join n using (doc_id, h) where copies > 0)""",
    "op7_blob_ledger": f"""with spans as ({_spans('assign', 0, _ASSIGN, 2, 12)} union all {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 18)} union all {_spans('hex', 2, '[0-9a-f]+', 0, 16)}),
 per as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as listed from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(listed, '')) as base_sha256, coalesce(listed, '') as spans from documents left join per using (doc_id)""",
    "op12_lexical_search": f"""with d as (select r, doc_id, w, len(w) as n from (select row_number() over () as r, doc_id, {_WORDS} as w from documents) where len(w) > 0),
 s as (select count(*) as n_docs, sum(n)::hugeint as n_terms from d),
 post as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
 item as (select distinct item_id, term from (select item_id, unnest({_WORDS}) as term from benchmark)),
 weight as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from post, s group by term),
 m as (select r, doc_id, (10 + (90 * n * n_docs) // n_terms)::bigint as m from d, s),
 scored as (select item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score, any_value(doc_id) as doc_id from item join weight using (term) join post using (term) join m using (r) group by item_id, r)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= 10""",
}
