"""DuckDB SQL of the queries that SQL can express.

The others are tested against brute force: byte-level removal, approximate
neighbours, edit-bounded search, HTML, byte-pair merging, alignment, bootstrapped
patterns and a fitted model are beyond it.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
each as (select source, sum(size)::bigint source_size, count(*) docs from sized group by source),
ranked as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight, source_size * 3 cap from each),
ratios as (select *, cap / weight ratio from ranked),
levels as (select *, row_number() over w place, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from ratios window w as (order by ratio, source nulls last)),
fixed as (select level as fixed from levels where level <= ratio order by place limit 1),
targets as (select source, source_size, docs, least(cap::double, weight * coalesce((select fixed from fixed), 0.0)) target from levels),
placed as (select s.*, t.source_size, t.target, ('0x' || substring(md5('mix' || coalesce(s.doc_id::varchar, '-')), 1, 13))::bigint drawn, greatest(ceil(t.docs / 4096), 1)::bigint parts
  from sized s join targets t on s.source is not distinct from t.source),
dealt as (select *, drawn % parts shard from placed),
shards as (select source, shard, sum(size)::bigint shard_size, any_value(source_size) source_size, any_value(target) target from dealt group by source, shard),
shares as (select *, count(*) over (partition by source) n, floor(target / 32 + 0.5) seats, coalesce(shard_size / nullif(source_size, 0), 0) share from shards),
sures as (select *, case when shard_size > 0 then floor(greatest(seats - n / 2, 0) * share + 0.5) else 0 end sure from shares),
lefts as (select *, seats - sum(sure) over (partition by source) "left" from sures),
bids as (select *, unnest(range(sure::bigint, (sure + floor(share * n) + 2)::bigint)) k from lefts where shard_size > 0),
places as (select *, row_number() over (partition by source order by shard_size / (2 * k + 1) desc, shard, k) place from bids),
quotas as (select source, shard, any_value(shard_size) shard_size, any_value(sure) + count(*) filter (where place <= "left") quota from places group by source, shard),
asks as (select *, least(quota * 32, shard_size * 3) asked from quotas),
running as (select d.*, a.asked, a.shard_size, floor(a.asked / a.shard_size) rounds,
  sum(d.size) over (partition by d.source, d.shard order by d.drawn, d.doc_id, d.size rows unbounded preceding) - d.size as before
  from dealt d left join asks a on d.source is not distinct from a.source and d.shard = a.shard)
select doc_id, size, source_size, target, coalesce(rounds * size + greatest(least(asked - rounds * shard_size - before, size), 0), 0)::bigint as taken from running
"""

OP8 = rf"""
with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') w from documents),
sets as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from worded),
grams as (select doc_id, len(s) n, unnest(s) g from sets),
links as (select a.doc_id a, b.doc_id b from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id from sets
"""

#: One round: the parts' nearest entries (distance and index in one number), then the entries' floored means.
_ROUND = """
near{r} as (select vec_id, p, min(list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e)::bigint k from parts join book{r} using (p) group by vec_id, p),
book{n} as (select p, e, coalesce(m, b) b from book{r} left join (select p, e, list(floor(s / c)::bigint order by i) m from
  (select p, k % 64 e, i, sum(x[i]) s, count(*) c from parts join near{r} using (vec_id, p), range(1, len(x) + 1) t(i) group by all) group by p, e) using (p, e)),"""

OP11 = rf"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] x from kept, range(16) t(p)),
book0 as (select p, dense_rank() over (order by vec_id) - 1 e, x b from parts qualify e < 64),
{_ROUND.format(r=0, n=1)}{_ROUND.format(r=1, n=2)}{_ROUND.format(r=2, n=3)}
coded as (select vec_id, string_agg(lower(lpad(hex(k % 64), 2, '0')), '' order by p) code, sum(k // 64)::bigint error from near2 group by vec_id),
named as (select sha256(string_agg(v::varchar, ',' order by p, e, i)) codebooks_sha256 from (select p, e, i, b[i] v from book2, range(1, len(b) + 1) t(i)))
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from coded join kept using (vec_id), named
"""

OP12 = rf"""
with texts as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
worded as (select *, regexp_extract_all(t, '{_WORD}') w, min(doc_id) over (partition by t) first from texts),
marks as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
failed as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
  {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)}} f
  from worded left join marks using (doc_id)),
masks as (select part, f.A::int + 2 * f.B::int + 4 * f.C::int + 8 * f.D::int + 16 * f.E::int mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from failed group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 4, 8, 16]) bit),
orders as (select a.c || b.c || c.c || d.c || e.c filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits from letter a, letter b, letter c, letter d, letter e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, step, bits[step] bit, coalesce(list_sum(bits[:step - 1]), 0)::int before from orders, (select unnest([1, 2, 3, 4, 5]) step)),
counted as (select part, filter_order, step, bit,
  coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0)::bigint removed,
  coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0)::bigint redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails,
  coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0)::bigint good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0)::bigint toxic_lost
  from masks, steps group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint shapley from counted
"""

OP13 = """
with recursive fine as (select vec_id, label, embedding::double[] v from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
counted as (select a, count(*) n_links from links group by a), rooted as (select a, min(b) root from reach group by a),
named as (select vec_id, coalesce(n_links, 0)::bigint n_links, least(vec_id, coalesce(root, vec_id)) component_id from embeddings left join counted c on vec_id = c.a left join rooted r on vec_id = r.a)
select vec_id, n_links, component_id, vec_id = component_id as kept from named
"""

ORACLE: dict[str, str] = {"op5_source_mix": OP5, "op8_ngram_jaccard": OP8, "op11_vector_codes": OP11, "op12_filter_audit": OP12, "op13_embedding_dedup": OP13}
