"""SQL for DuckDB of the queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """edges as (select a, b from link union select b, a from link),
 reach as (select a as node, b as other from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
 part as (select node, least(node, min(other)) as component from reach group by node)"""

#: Each class of equal shingle sets once; pairs of classes meet in common shingles.
OP4 = f"""with recursive w as (select doc_id, regexp_extract_all({_FOLD}, '{WORDS}') as ws from documents where doc_id is not null),
 s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as sh from w),
 c as (select doc_id, sh, min(doc_id) over (partition by sh) as class_id, count(*) over (partition by sh) as copies from s),
 rep as (select distinct class_id, sh, len(sh) as n from c), x as (select class_id, n, unnest(sh) as t from rep),
 pair as (select p.class_id as a, q.class_id as b, any_value(p.n) as na, any_value(q.n) as nb, count(*) as common from x p join x q on p.t = q.t and p.class_id < q.class_id group by all),
 link as (select a, b from pair where common >= 0.8 * (na + nb - common) - 1e-9), {_REACH},
 deg as (select a as node, count(*) as n from edges group by a)
 select c.doc_id, c.class_id, c.copies, coalesce(deg.n, 0) as n_links, coalesce(part.component, c.class_id) as component_id, c.doc_id = coalesce(part.component, c.class_id) as kept
 from c left join deg on deg.node = c.class_id left join part on part.node = c.class_id"""

OP7 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
 link as (select p.vec_id as a, q.vec_id as b from u p join u q on p.vec_id < q.vec_id and len(p.e) = len(q.e) and list_dot_product(p.e, q.e) >= 0.95), {_REACH},
 deg as (select a as node, count(*) as n from edges group by a)
 select vec_id, coalesce(deg.n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
 from embeddings left join deg on deg.node = vec_id left join part on part.node = vec_id"""

_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_KEY = (
    "case when contains({0}, '://') then translate(regexp_extract({0}, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || "
    + _HOST
    + " || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"
)
_BEST = """(select {0} from (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) as r(rule, h, p, verdict)
 where ({1}.host = h or ends_with({1}.host, '.' || h)) and starts_with({1}.path, p) order by length(rule) desc limit 1)"""
_ABSOLUTE = """case when link = '' then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
 when starts_with(link, '/') then root || link when starts_with(link, '?') or starts_with(link, '#') then root || path || link else root || case when folder = '' then '/' else folder end || link end"""

OP8 = f"""with recursive p as (select page_id, url, html, {_HOST.format('url')} as host, {_PATH.format('url')} as path, {_KEY.format('url')} as key from pages),
 f as (select url, path, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as root, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) as folder, unnest(list_concat(
 list_transform(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
 list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*[''"]?([^"''\\s>]+)', 1)))) as found from p where url is not null and html is not null),
 g as (select *, replace(trim(found), '&amp;', '&') as link from f where found <> ''), h as (select url, {_ABSOLUTE} as target from g),
 link as (select distinct {_KEY.format('url')} as a, {_KEY.format('target')} as b from h where {_KEY.format('url')} is not null and {_KEY.format('target')} is not null and {_KEY.format('url')} <> {_KEY.format('target')}), {_REACH},
 named as (select node, component, {_HOST.format('node')} as host, {_PATH.format('node')} as path from part),
 told as (select component, bool_or(v = 'allow') as allowed, bool_or(v = 'block') as blocked from (select component, {_BEST.format('verdict', 'named')} as v from named) group by component),
 j as (select p.*, {_BEST.format('rule', 'p')} as rule, {_BEST.format('verdict', 'p')} as own from p)
 select page_id, host, path, rule, coalesce(own, case when allowed then 'allow' when blocked then 'block' end, 'allow') as verdict
 from j left join part on part.node = j.key left join told using (component)"""

#: The time at which a share of each of the three integrated schedules is used.
_TIME = """round(case turn when 0 then 2 * # / (1.5::double + sqrt(greatest(2.25::double - 2 * #, 0))) when 1 then #
 else case when # <= 0.3125 then 2 * # / (0.5::double + sqrt(0.25::double + #)) else 0.5 + 2 * (# - 0.3125::double) / (0.75::double + sqrt(0.5625::double + 5 * (# - 0.3125::double))) end end, 6)"""

#: The rate at which uncapped sources are served: the first, in order of saturation, whose rate keeps the next ones uncapped.
OP10 = f"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size, md5('0:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as hash from documents),
 s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
 w as (select *, (place % 3)::int as turn, [5.0, 2.0, 1.0][(place % 3)::int + 1]::double as weight, 2.0::double * source_size as cap from s),
 o as (select *, sum(cap) over a - cap as capped, sum(weight) over () - sum(weight) over a + weight as open, sum(source_size) over () * 1.5::double as demand from w window a as (order by cap / weight, source rows unbounded preceding)),
 r as (select min_by((demand - capped) / open, cap / weight) filter (where (demand - capped) / open <= cap / weight) as rate from o),
 t as (select source, source_size, turn, least(cap, weight * coalesce(rate, 1e300)) as target from w, r),
 q as (select d.*, source_size, turn, target, cast(sum(size) over (partition by d.source order by hash, doc_id nulls first, size rows unbounded preceding) as bigint) - size as start from d join t on d.source is not distinct from t.source),
 u as (select *, greatest(least(floor(round(target, 6)) - start, size), 0)::bigint as w0, greatest(least(floor(round(target, 6)) - start - source_size, size), 0)::bigint as w1 from q),
 x as (select *, (start + w0 / 2.0::double) / greatest(target, 1.0::double) as s0, (start + source_size + w1 / 2.0::double) / greatest(target, 1.0::double) as s1 from u)
 select doc_id, cast(size as bigint) as size, source_size, round(target, 6) as target, w0 + w1 as taken,
 case when w0 > 0 then {_TIME.replace('#', 's0')} when w1 > 0 then {_TIME.replace('#', 's1')} end as first_position, case when w0 > 0 and w1 > 0 then {_TIME.replace('#', 's1')} end as second_position from x"""

#: crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""

#: The automaton's probabilities: a bigram's count and 100 times the word's share, or the share alone behind a word that was never trained.
OP6 = f"""with d as (select doc_id, {_CRC} % 7 = 2 as held, list_concat([' begin'], list_append(regexp_extract_all({_FOLD}, '{WORDS}'), ' end')) as ts from documents),
 q as (select doc_id, held, unnest(ts) as w, generate_subscripts(ts, 1) as i from d), s as (select *, lag(w) over (partition by doc_id order by i) as v from q),
 uni as (select w, count(*) as c from q where not held and w <> ' begin' group by w), ctx as (select w, count(*) as c from q where not held group by w),
 bi as (select v, w, count(*) as c from s where not held and v is not null group by v, w),
 t as (select sum(c)::double as n, count(*)::double as types, count(*) filter (where c = 1)::double as ones, count(*) filter (where c = 2)::double as twos from uni),
 k as (select *, case when ones > 0 then greatest(least(ones / (ones + 2 * twos), 0.95), 0.1)::double else 0.5::double end as cut from t),
 p as (select s.doc_id, s.held, coalesce(uni.c, 0) as c, coalesce(ctx.c, 0) as seen, coalesce(bi.c, 0) as pair, (greatest(coalesce(uni.c, 0) - cut, 0) + cut * types / (types + 1)) / n as share, n, types
 from s left join uni on uni.w = s.w left join ctx on ctx.w = s.v left join bi on bi.v = s.v and bi.w = s.w, k where s.w <> ' begin')
 select doc_id, any_value(held) as held_out, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((c + 1) / (n + types + 1))), 6) as base_score,
 round(sum(log10(case when seen > 0 then (pair + 100 * share) / (seen + 100) else share end)), 6) as score from p group by doc_id"""

#: crc32 of a text's UTF-8 bytes, by a table of 256 remainders.
_TABLE = """tab as (select list(list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end, b) order by b) as t from range(256) as r(b))"""
_TEXT_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"""

#: Groups too large for an equal share of the rest go first; the others are cut under the least capacity that a binary search over greedy fills finds.
OP11 = f"""with recursive {_TABLE}, d as (select doc_id, coalesce(text, '') as text, sha256(coalesce(text, '')) as key, strlen(coalesce(text, '')) + 1 as size from documents),
 c as (select key, any_value({_TEXT_CRC}) as crc from (select key, any_value(text) as text from d group by key), tab group by key),
 g as (select key, sum(size)::bigint as size from d group by key),
 o as (select key, size, row_number() over w as i, sum(size) over () - sum(size) over w + size as rest from g window w as (order by size desc, key)),
 own as (select key, i - 1 as shard from o where i < 16 and i < (select min(i) from o where i >= 16 or size * (17 - i) <= rest)),
 k as (select (16 - (select count(*) from own))::bigint as k),
 a as (select key, size, sum(size) over (order by key)::bigint as until from g where key not in (select key from own)),
 p as (select list_prepend(0::bigint, list(until order by until)) as p, coalesce(max(until), 0)::bigint as total, k from a, k group by k),
 s as (select (total + k - 1) // k as low, total as high from p union all
  select case when fits then low else middle + 1 end, case when fits then middle else high end from (select low, high, middle,
   list_reduce(range(k), lambda q, i: list_max(list_filter(p, lambda x: x <= q + middle)), 0::bigint) >= total as fits from (select *, (low + high) // 2 as middle from s where low < high), p)),
 cap as (select min(low)::bigint as cap from s where low >= high),
 b as (select 0::bigint as j, 0::bigint as spot union all
  select j + 1, list_reduce(list_filter(p, lambda x: x >= greatest(late, spot) and x <= spot + cap), lambda u, v: case when abs((v - spot) * (k - j) - (total - spot)) < abs((u - spot) * (k - j) - (total - spot)) then v else u end)
  from (select *, list_reduce(range(k - j - 1), lambda q, i: list_min(list_filter(p, lambda x: x >= q - cap)), total) as late from b, p, cap where j + 1 < k)),
 t as (select key, shard from own union all select key, (16 - k) + (select count(*) from b where j > 0 and spot <= a.until - a.size) from a, k)
 select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard, row_number() over (partition by shard order by d.key, doc_id nulls first) - 1 as slot, null::int as grown_shard
 from d join t on d.key = t.key join c on d.key = c.key"""

#: Lines, and a cut's place as the length of the lines before it; the text itself bounds the last line, which may have no line feed.
OP12 = """with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, 'null')) as hash from documents),
 n as (select *, string_split(text, chr(10)) as parts, len(string_split(text, chr(10))) - case when text = '' or ends_with(text, chr(10)) then 1 else 0 end as n from d),
 h as (select *, list_transform(range(4), lambda i: ('0x' || substr(hash, 8 * i + 1, 8))::bigint) as h from n),
 c as (select *, text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 as plain, least(h[1] % (n + 1), h[2] % (n + 1)) as i, greatest(h[1] % (n + 1), h[2] % (n + 1)) as j from h),
 e as (select *, least(length(text), i + coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0))::bigint as b, least(length(text), j + coalesce(list_sum(list_transform(parts[1:j], lambda x: length(x))), 0))::bigint as e from c),
 f as (select *, case when plain then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form, substr(text, 1, b) as pre, substr(text, b + 1, e - b) as mid, substr(text, e + 1) as suf from e)
 select doc_id, n::bigint as n, form, case when not plain then b end as prefix_chars, case when not plain then e - b end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from f"""

_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_TREE = "list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))"

#: Levels of both trees as lists; a leaf's siblings are those beside its ancestors.
OP13 = f"""with recursive d as (select doc_id, lang, {_LEAF.format('n_chars')} as leaf, case when {_CRC} % 7 = 0 then {_LEAF.format('(n_chars + 1)')} end as claim from documents),
 r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from d),
 low as (select lang, 0 as level, list(leaf order by i) as hs from r group by lang union all select lang, level + 1, {_TREE} from low where len(hs) > 1),
 sub as (select lang, hs[1] as subroot, row_number() over (order by lang nulls first) - 1 as k from low where len(hs) = 1),
 up as (select 0 as level, list(subroot order by k) as hs from sub union all select level + 1, {_TREE} from up where len(hs) > 1),
 top as (select hs[1] as root from up where len(hs) = 1),
 nodes as (select lang, level, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as j, len(hs) as n from low),
 own as (select r.lang, r.i, list(struct_pack(s := s.h, l := s.j < (r.i >> x.level)) order by x.level) as path
  from r join (select lang, level, len(hs) as n from low where len(hs) > 1) x on r.lang is not distinct from x.lang left join nodes s on s.lang is not distinct from r.lang and s.level = x.level and s.j = xor(r.i >> x.level, 1) group by r.lang, r.i),
 over as (select k, list(struct_pack(s := hs[xor(k >> level, 1) + 1], l := k & (1::bigint << level) > 0) order by level) as path from sub, up where len(hs) > 1 group by k),
 j as (select r.doc_id, r.leaf, r.claim, sub.subroot, top.root, list_concat(coalesce(own.path, []), coalesce(over.path, [])) as path
  from r join sub on r.lang is not distinct from sub.lang left join own on own.lang is not distinct from r.lang and own.i = r.i left join over on over.k = sub.k, top),
 f as (select *, list_reduce(list_prepend(struct_pack(s := coalesce(claim, leaf), l := false), path), lambda a, x: struct_pack(s := sha256(case when x.s is null then a.s when x.l then x.s || a.s else a.s || x.s end), l := false)).s as folded_root from j)
 select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(path, lambda x: x.s is not null), lambda x: x.s), ''), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""

ORACLE_SQL = {
    "op6_lm_scoring": OP6, "op4_jaccard_join": OP4, "op7_embedding_dedup": OP7, "op8_url_filter": OP8, "op10_mixing": OP10,
    "op11_sharding": OP11, "op12_infill": OP12, "op13_merkle": OP13,
}
