"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = " + ".join(f"(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 1)::double * {16 ** (12 - i)}" for i in range(13))

OP1 = f"""
with l as (select doc_id, coalesce(max(case quality when 1 then 1.0 when 0 then 0.25 end), 0.5)::double as w from labels where doc_id is not null group by doc_id),
r as (select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, {_WORD})), 0)::bigint as size, coalesce(l.w, 0.5)::double as w,
             md5(concat(coalesce(d.source, '~'), '|', coalesce(d.doc_id::varchar, '~'))) as h from documents d left join l on d.doc_id = l.doc_id),
k as (select *, -ln((({_HEX}) + 0.5) / 4503599627370496.0) / w as key from r),
s as (select source, sum(size)::bigint as source_size from k group by source),
ranked as (select *, (((row_number() over (order by source nulls last)) - 1) % 3 + 1)::double as weight from s),
steps as (select *, sum(source_size) over () - coalesce(sum(source_size * 3) over w, 0) as words_left, sum(weight) over () - coalesce(sum(weight) over w, 0.0) as weight_left
          from ranked window w as (order by (source_size * 3)::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least((source_size * 3)::double, (max(words_left::double / weight_left) over ()) * weight) as target from steps),
e as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as epochs from t),
x as (select k.*, e.source_size, e.target, e.epochs, round(e.target)::bigint - e.epochs * e.source_size
             - coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as room
      from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::bigint as taken from x
"""

OP3 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) as t from documents),
g as (select distinct doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] as shingle from (select doc_id, t, unnest(range(1, len(t) - 1)) as i from w where len(t) >= 3)
      union all select doc_id, array_to_string(t, ' ') from w where len(t) between 1 and 2),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
reach(doc_id, seen) as (select doc_id, doc_id from documents union select r.doc_id, e.y from reach r join e on r.seen = e.x)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(seen)::bigint as component_id from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

OP5 = """
with x as (select vec_id, i, floor(256 * c::double) as q from (select vec_id, unnest(embedding) as c, generate_subscripts(embedding, 1) as i from embeddings where embedding is not null)),
bad as (select distinct vec_id from (select vec_id, unnest(embedding) as c from embeddings) where c is null or not isfinite(c)),
v as (select vec_id, i, q::bigint as q from x where vec_id not in (select vec_id from bad)),
s as (select a.vec_id as query_id, b.vec_id, sum(a.q * b.q)::bigint as score from v a join v b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by all)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP7 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as t from documents),
g as (select doc_id, i, array_to_string(t[i:i + 12], ' ') as win from (select doc_id, t, unnest(range(1, len(t) - 11)) as i from w)),
o as (select win, min(doc_id) as owner from g group by win),
gone as (select distinct doc_id, i + k as j from g join o on g.win = o.win, range(13) as r(k) where owner < doc_id),
x as (select w.doc_id, unnest(t) as word, generate_subscripts(t, 1) as j from w),
y as (select x.doc_id, count(gone.j) as n_removed, string_agg(word, ' ' order by x.j) filter (where gone.j is null) as kept from x left join gone on gone.doc_id = x.doc_id and gone.j = x.j group by x.doc_id)
select w.doc_id, len(t)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join y on w.doc_id = y.doc_id
"""

OP9 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) as t from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) as t from benchmark),
bw as (select distinct item_id, least(10, len(t)) as k, array_to_string(t[i:i + least(10, len(t)) - 1], ' ') as win
       from (select item_id, t, unnest(range(1, greatest(2, len(t) - 8))) as i from b where len(t) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(t[i:i + k - 1], ' ') as win from (select doc_id, t, k, unnest(range(1, len(t) - k + 2)) as i from d, ks)),
hit as (select doc_id, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
words as (select doc_id, count(distinct i + o) as n_hit from hit, range(10) as r(o) where o < k group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit) group by doc_id)
select d.doc_id, len(t)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

OP11 = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM}) as t from documents),
w as (select id, lang, source, unnest(t) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by all having count(distinct id) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w group by all),
x as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n, kept.lang_n::hugeint as lang_n
      from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
s as (select *, sum(n) over (partition by lang, source) as total, sum(lang_n) over (partition by lang, source) as lang_total, count(*) over (partition by lang, source) as v from x),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v)::hugeint as p, 1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v)::hugeint as q from s),
pair as (select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
         left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term group by all) f
         on f.lang = a.lang and f.source = a.source and f.item = b.source),
both_parts as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


def _op13(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Plain distances, all entries; a part's codebook is a table of (part, entry, position, component)."""
    nearest = """
d{r} as materialized (select v.vec_id, v.part, b.entry, sum((v.c - b.c) * (v.c - b.c))::bigint as dist from v join b{r} b on b.part = v.part and b.pos = v.pos group by all),
a{r} as materialized (select vec_id, part, entry, dist from (select *, row_number() over (partition by vec_id, part order by dist, entry) as k from d{r}) where k = 1),"""
    averaged = """
b{n} as materialized (select b.part, b.entry, b.pos, coalesce(((m.s - ((m.s % m.k) + m.k) % m.k) // m.k)::bigint, b.c) as c
      from b{r} b left join (select v.part, a.entry, v.pos, sum(v.c)::bigint as s, count(*) as k from v join a{r} a on a.vec_id = v.vec_id and a.part = v.part group by all) m
      on m.part = b.part and m.entry = b.entry and m.pos = b.pos),"""
    steps = "".join(nearest.format(r=r) + averaged.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
with bad as (select distinct vec_id from (select vec_id, unnest(embedding) as c from embeddings) where c is null or not isfinite(c)),
x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // {parts} as w, floor(256 * unnest(embedding)::double)::bigint as c from embeddings
      where embedding is not null and vec_id not in (select vec_id from bad)),
v as materialized (select vec_id, i // w as part, i % w as pos, c from x),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select distinct vec_id from v) order by vec_id limit {entries}),
b0 as materialized (select v.part, seeds.entry, v.pos, v.c from v join seeds on seeds.vec_id = v.vec_id),{steps}
codes as (select vec_id, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(dist)::bigint as error from a{rounds} group by vec_id),
hash as (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from b{rounds})
select codes.vec_id, code, error, sum(error) over (partition by e.label)::bigint as label_error, codebooks_sha256 from codes join embeddings e on e.vec_id = codes.vec_id, hash
"""


ORACLE = {
    "op1_target_weight_mixing": OP1,
    "op3_ngram_jaccard_join": OP3,
    "op5_exact_top_k": OP5,
    "op7_repeated_phrases": OP7,
    "op9_benchmark_decontamination": OP9,
    "op11_source_divergence": OP11,
    "op13_walsh_vector_codes": _op13(),
}
