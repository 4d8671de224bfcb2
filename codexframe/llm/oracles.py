"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from codexframe.llm.quality import STOP_WORDS

_SPACE = "[\\x20\\x09-\\x0D]+"

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from d),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from pos),
dup as (select doc_id, g from win group by doc_id, g having count(*) > 1),
hit as (select win.doc_id, win.i from win join dup on win.doc_id = dup.doc_id and win.g = dup.g),
cov as (select doc_id, count(distinct p) as n from (
  select doc_id, i as p from hit union all select doc_id, i + 1 from hit union all select doc_id, i + 2 from hit) x group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({_STOPS})))::bigint as n_stop_words, len(lines) as n_lines
  from w left join cov on w.doc_id = cov.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  not base_failed
  and coalesce(word_chars::double / nullif(n_words, 0) between 2.5::double and 12.0::double, true)
  and coalesce(n_symbols::double / nullif(n_words, 0) <= 0.1::double, true)
  and coalesce(n_stop_words::double / nullif(n_words, 0) >= 0.05::double, true)
  and coalesce(n_dup_lines::double / nullif(n_lines, 0) <= 0.5::double, true) as kept
from b
"""

#: For tables whose pages declare no redirect and no canonical link; those are tested against brute force.
URLS = """
with p as (
  select page_id, case when contains(url, '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1) else '' end as h,
    case when contains(url, '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2) else '' end as path
  from pages),
q as (select page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(path, '') as path from p),
r(verdict, rh, rp) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (
  select q.page_id, rh || rp as rule, verdict, row_number() over (partition by q.page_id order by length(rh || rp) desc, length(rh) desc) as n
  from q join r on (q.host = rh or ends_with(q.host, '.' || rh)) and starts_with(q.path, rp))
select q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from q left join f on q.page_id = f.page_id and f.n = 1
"""

LINES = f"""
with l as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
  from documents where text is not null),
k as (select *, regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g') as bare from l),
t as (select source, count(*) as total from documents where source is not null group by source),
c as (select source, bare, count(distinct doc_id) as pages from k where bare <> '' and source is not null group by source, bare),
bad as (
  select c.source, c.bare from c join t on c.source = t.source
  where c.pages >= 3 and c.pages::double / t.total > 0.1::double),
s as (
  select k.doc_id, string_agg(k.line, chr(10) order by k.i) filter (where bad.bare is null) as kept,
    count(*) filter (where bad.bare is not null) as n
  from k left join bad on k.source = bad.source and k.bare = bad.bare group by k.doc_id)
select d.doc_id, d.source, case when s.n > 0 then coalesce(s.kept, '') else d.text end as text, coalesce(s.n, 0)::bigint as n_dropped
from documents d left join s on d.doc_id = s.doc_id
"""

#: The plan of the mix, and the schedules' linear pieces with their integrals: even, late, early.
_MIXED = f"""
with z as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::bigint as size,
    md5(cast(doc_id as varchar)) as k
  from documents),
s as (select source, sum(size)::bigint as source_size from z group by source),
w as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, source_size::double * 3.0::double as cap from s),
o as (
  select *, row_number() over (order by cap / weight, source nulls last) as place,
    (sum(source_size) over ())::double as everything,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as before,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as beyond
  from w),
l as (select *, (everything - before) / beyond as level from o),
f as (select level as free from l where level * weight <= cap order by place limit 1),
g as (select source, source_size, least(cap, free * weight) as target, (row_number() over (order by source nulls last) - 1) % 3 as shape from l, f),
a as (
  select z.*, g.source_size, g.target, g.shape, round(g.target)::bigint as reach,
    coalesce(sum(size) over (partition by z.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as first
  from z join g on z.source is not distinct from g.source),
e as (
  select a.*, epoch, greatest(0, least(size, reach - epoch * source_size - first))::bigint as take,
    least((epoch * source_size + first) / greatest(1.0::double, target), 1.0::double) as demand
  from a, (values (0), (1), (2)) as epochs(epoch)),
piece(shape, t0, t1, w0, w1, a0, a1, total) as (values
  (0, 0.0::double, 1.0::double, 1.0::double, 1.0::double, 0.0::double, 1.0::double, 1.0::double),
  (1, 0.0, 0.5, 0.5, 0.5, 0.0, 0.25, 0.875), (1, 0.5, 1.0, 0.5, 2.0, 0.25, 0.875, 0.875),
  (2, 0.0, 0.5, 2.0, 0.5, 0.0, 0.625, 0.875), (2, 0.5, 1.0, 0.5, 0.5, 0.625, 0.875, 0.875)),
h as (
  select e.*, t0, t1, w0, demand * total - a0 as rest, (w1 - w0) / (t1 - t0) as slope
  from e join piece on e.shape = piece.shape and demand * total <= a1 and (a0 = 0 or demand * total > a0)),
r as (
  select *, least(t1, t0 + greatest(0.0::double, 2 * rest / (w0 + sqrt(greatest(0.0::double, w0 * w0 + 2 * slope * rest))))) as position from h)
"""

MIX = f"""{_MIXED}
select doc_id, size, source_size, target, sum(take)::bigint as taken, min(position) filter (where take > 0) as position
from r group by doc_id, size, source_size, target, first
"""

POSITIONS = f"""{_MIXED}
select doc_id, epoch, take, position from r where take > 0
"""

def _codes(rounds: int = 6) -> str:
    """All rounds of the vector codes as common tables: assignments ``a0..`` and codebooks ``c0..``, entries compared one by one."""
    assign = """a{r} as materialized (
  select rid, part, entry, far from (
    select *, row_number() over (partition by rid, part order by far, entry) as n from (
      select e.rid, e.part, c.entry, sum((e.q - c.q) * (e.q - c.q))::bigint as far
      from e join c{r} c on e.part = c.part and e.i = c.i group by e.rid, e.part, c.entry) x) y where n = 1)"""
    move = """c{s} as materialized (
  select c.part, c.entry, c.i, case when m.n is null then c.q else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as q
  from c{r} c left join (
    select e.part, a.entry, e.i, sum(e.q)::bigint as s, count(*)::bigint as n
    from e join a{r} a on e.rid = a.rid and e.part = a.part group by e.part, a.entry, e.i) m
  on c.part = m.part and c.entry = m.entry and c.i = m.i)"""
    steps = [step.format(r=r, s=r + 1) for r in range(rounds) for step in (assign, move)] + [assign.format(r=rounds)]
    return f"""
with k as materialized (
  select row_number() over (order by vec_id) - 1 as rid, vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select rid, v, unnest(range(0, len(v))) as c from k),
e as materialized (
  select rid, c // (len(v) // 8) as part, c % (len(v) // 8) as i, floor(4096 * v[c + 1]::double)::bigint as q from u),
c0 as materialized (select part, rid as entry, i, q from e where rid < 16),
{", ".join(steps)},
f as (
  select k.vec_id, k.label, string_agg(printf('%02x', a.entry), '' order by a.part) as code, sum(a.far)::bigint as error
  from k join a{rounds} a on k.rid = a.rid group by k.rid, k.vec_id, k.label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(q::varchar, ',' order by part, entry, i)) from c{rounds}) as codebooks_sha256
from f
"""


ORACLES = {
    "op4_quality_rules": QUALITY,
    "op5_redirect_equivalence": URLS,
    "op9_line_dedup": LINES,
    "op10_curriculum_mix": MIX,
    "op10_training_positions": POSITIONS,
    "op13_vantage_codes": _codes(),
}
