"""SQL, run by another engine over the same tables, for the operators that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Spans of marked windows (doc_id, p) of `size` units, merged where they overlap or touch.
_SPANS = """spans as (select doc_id, g, min(p) as low, max(p) + {size} as high from (
    select *, sum(new) over (partition by doc_id order by p) as g from (
      select *, case when p <= lag(p) over (partition by doc_id order by p) + {size} then 0 else 1 end as new from marks)) group by doc_id, g)"""

OP1 = f"""with t as (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
  win as (select doc_id, unnest(range(0, n - 99)) as p, unnest(list_transform(range(0, n - 99), lambda k: md5(substr(h, 2 * k + 1, 200)))) as w from t),
  marks as (select doc_id, p from (select *, row_number() over (partition by w order by doc_id, p) as r from win) where r > 1),
  {_SPANS.format(size=100)},
  kept as (select doc_id, n, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as after, h from t left join spans using (doc_id)),
  pieces as (select doc_id, any_value(n) as n, coalesce(sum(high - low), 0) as gone, count(low) as spans, coalesce(max(high), 0) as last, any_value(h) as h,
    coalesce(string_agg(substr(h, 2 * after + 1, 2 * (low - after)), '' order by low), '') as k from kept group by doc_id)
select doc_id, n as n_bytes, cast(gone as bigint) as n_removed, spans as n_spans, sha256(unhex(k || substr(h, 2 * last + 1))) as kept_sha256 from pieces"""

OP2 = f"""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as l from documents),
  win as (select doc_id, unnest(range(0, len(l) - 49)) as p, unnest(list_transform(range(0, len(l) - 49), lambda k: md5(array_to_string(l[k + 1:k + 50], ' ')))) as w from t),
  marks as (select doc_id, p from (select *, min(doc_id) over (partition by w) as d from win) where doc_id > d),
  {_SPANS.format(size=50)},
  kept as (select doc_id, l, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as after from t left join spans using (doc_id)),
  pieces as (select doc_id, any_value(l) as l, coalesce(sum(high - low), 0) as gone, count(low) as spans, coalesce(max(high), 0) as last,
    coalesce(flatten(list(case when low > after then l[after + 1:low] else [] end order by low)), []) as k from kept group by doc_id)
select doc_id, len(l) as n_words, cast(gone as bigint) as n_removed, sha256(array_to_string((case when spans > 0 then k else [] end) || l[last + 1:], ' ')) as kept_sha256,
  spans as n_spans from pieces"""

_NORMAL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4 = f"""with items as (select item_id, {_NORMAL} as l from benchmark),
  patterns as (select distinct cast(item_id as varchar) as item, least(len(l), 10) as size,
    unnest(list_transform(range(1, greatest(len(l) - 9, 1) + 1), lambda p: array_to_string(l[p:p + 9], ' '))) as w from items where len(l) > 0),
  sizes as (select distinct size from patterns),
  docs as (select doc_id, {_NORMAL} as l from documents),
  win as (select doc_id, size, unnest(range(1, len(l) - size + 2)) as p,
    unnest(list_transform(range(1, len(l) - size + 2), lambda p: array_to_string(l[p:p + size - 1], ' '))) as w from docs, sizes),
  found as (select doc_id, p, size, item from win join patterns using (size, w)),
  hit as (select doc_id, count(distinct x) as n from (select doc_id, unnest(range(p, p + size)) as x from found) group by doc_id),
  named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, len(l) as n_words, coalesce(h.n, 0) as n_hit, coalesce(m.n, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join named m using (doc_id)"""

OP9 = f"""with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as l from documents),
  grams as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(l) - 4, 1) + 1), lambda p: array_to_string(l[p:p + 4], ' '))) as g from t where len(l) > 0),
  sizes as (select doc_id, count(*) as n from grams group by doc_id),
  both_in as (select a.doc_id as a, b.doc_id as b, count(*) as o from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
  links as (select a, b from both_in join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
  reach as (select doc_id, doc_id as r from t union select doc_id, b from reach join links on r = a)
select t.doc_id, coalesce(n, 0) as n_shingles, c.component_id from t left join sizes using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)"""

OP10 = f"""with t as (select doc_id, string_split(text, chr(10)) as lines from documents),
  lines as (select doc_id, unnest(range(0, len(lines))) as i, unnest(lines) as line from t),
  sets as (select doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, {_WORDS}))) as s from lines),
  classes as (select s, min({{'d': doc_id, 'i': i}}) as place, len(s) as n from sets where len(s) > 0 group by s),
  words as (select place, n, unnest(s) as w from classes),
  ranked as (select *, row_number() over (partition by place order by df, w) as r from (select *, count(*) over (partition by w) as df from words)),
  prefix as (select place, n, w from ranked where r <= n - cast(ceil(n * 80 / 100) as bigint) + 1),
  pairs as (select distinct a.place as late, b.place as early from prefix a join prefix b on a.w = b.w and a.place > b.place and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
  alike as (select distinct late from pairs join classes a on a.place = late join classes b on b.place = early
    where 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
  stay as (select place.d as doc_id, place.i as i from classes where place not in (select late from alike)),
  kept as (select x.* from sets x left join stay y using (doc_id, i) where len(x.s) = 0 or y.doc_id is not null),
  joined as (select doc_id, count(*) as n, string_agg(line, chr(10) order by i) as k from kept group by doc_id)
select t.doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines), 0) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from t left join joined using (doc_id)"""

OP12 = f"""with docs as (select doc_id, row_number() over () as r, {_NORMAL} as l from documents),
  words as (select r, doc_id, unnest(l) as t from docs),
  tfs as (select r, doc_id, t, count(*) as tf from words group by all),
  sizes as (select r, count(*) as n from words group by r),
  totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from sizes),
  dfs as (select t, count(*) as df from tfs group by t),
  items as (select item_id, t, count(*) as q from (select item_id, unnest({_NORMAL}) as t from (select distinct item_id, text from benchmark)) group by all),
  weighed as (select item_id, t, q * cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from items join dfs using (t), totals),
  scores as (select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) as bigint) as score
    from weighed join tfs using (t) join sizes using (r), totals group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0 qualify rank <= 20"""

ORACLES = {
    "op1_run_length_index": OP1,
    "op2_seed_extend": OP2,
    "op4_decontaminate": OP4,
    "op9_jaccard_trie": OP9,
    "op10_line_join": OP10,
    "op12_hybrid_search": OP12,
}
