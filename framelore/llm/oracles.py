"""DuckDB SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

FIXITY = r"""
with p as (select page_id, 'pages-' || lpad((page_id // 1000)::varchar, 6, '0') || '.warc' archive, md5(page_id::varchar) h, coalesce(url, '') url, coalesce(html, '') html from pages where page_id is not null),
r as (select page_id, archive, h, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', regexp_replace(url, '[\r\n]', '%0A', 'g'), chr(13), chr(10),
  'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), '>', chr(13), chr(10),
  'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(html)::varchar, chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) rec from p),
o as (select *, strlen(rec) as length, sum(strlen(rec)) over (partition by archive order by page_id) - strlen(rec) as "offset" from r)
select archive, "offset"::bigint "offset", length::bigint as length, 'corrupt' kind, sha256(rec) left_sha256, sha256(replace(rec, 'e', '3')) right_sha256
from o where substr(h, 1, 2) in ('07', '17', '27', '37', '47') and contains(rec, 'e')
"""

LINES = r"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) pos from documents where text is not null),
k as (select *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) plain from l),
h as (select source, count(*) n from documents group by 1),
c as (select source, plain, count(distinct doc_id) pages from k where plain <> '' group by all),
bad as (select c.source, plain from c join h on c.source is not distinct from h.source where pages > 0.1 * n and pages > 1),
o as (select k.doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where bad.plain is null), '') as text, count(*) n_lines, count(bad.plain) n_dropped
  from k left join bad on k.source is not distinct from bad.source and k.plain = bad.plain group by 1)
select d.doc_id, d.source, o.text, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped from documents d left join o on d.doc_id = o.doc_id
"""

CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|><|im_sep|><|im_end|>') + 1 n from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256, sum(n)::bigint formatted_chars
from e group by 1
"""

#: The permutation's eight rounds, one after the other.
_TURN = """, p{k} as (select * replace (case when substr(md5(concat(key, ':', e, ':{r}:', greatest(x, ((t{r} - x) % m + m) % m))), 1, 1) >= '8' then ((t{r} - x) % m + m) % m else x end as x) from p{r})"""
MIX = (
    r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 3) bucket from documents),
o as (select *, coalesce(sum(size) over (partition by source order by bucket, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start,
  row_number() over (order by source, doc_id, size) as no from d),
z as (select source, sum(size)::bigint source_size from d group by 1),
r as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint w, 3 * source_size cap from z),
l as (select *, coalesce(sum(cap) over v, 0) cb, sum(w) over () - coalesce(sum(w) over v, 0) wl, sum(source_size) over () total from r window v as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, cb * w + cap * wl <= total * w capped from l),
t as (select source, source_size, case when capped then cap::double else (total - sum(case when capped then cap else 0 end) over ())::double * w / sum(case when capped then 0 else w end) over () end target from c),
s as (select *, greatest(ceil(source_size / 128)::bigint - 1, 1) m, ceil(source_size / 128)::bigint blocks, coalesce(round(target)::bigint // nullif(source_size, 0), 0) e, coalesce(round(target)::bigint % nullif(source_size, 0), 0) rest,
  md5('17:' || coalesce('s' || source, 'n')) as key from t),
p0 as (select source, key, e, m, blocks, rest, k, k x, """
    + ", ".join(f"('0x' || substr(md5(concat(key, ':', e, ':{r}')), 1, 13))::bigint % m t{r}" for r in range(8))
    + " from (select *, unnest(range(0, ceil(rest / 128)::bigint)) k from s))"
    + "".join(_TURN.format(k=r + 1, r=r) for r in range(8))
    + r""",
b as (select source, (case when k >= blocks - 1 then k else x end) as block, least(128, rest - k * 128) cut from p8),
u as (select no, source, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) as block from o where size > 0),
x as (select no, sum(greatest(least(u.start + u.size, u.block * 128 + cut) - greatest(u.start, u.block * 128), 0))::bigint more from u join b on u.source is not distinct from b.source and u.block = b.block group by 1)
select o.doc_id, o.source, o.size, s.source_size, s.target, (s.e * o.size + coalesce(x.more, 0))::bigint taken from o join s on o.source is not distinct from s.source left join x on o.no = x.no
"""
)

#: CRC-32 byte by byte; words near each other share a text that one deletion leaves, at the same place if they are equally long.
SPELLING = r"""
with recursive t0 as (select range i, range::ubigint c from range(256)), """ + ", ".join(f"t{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end c from t{k})" for k in range(8)) + r""",
tab as (select list(c order by i) l from t8),
r as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) w from documents)),
o as (select coalesce(doc_id::varchar, '') i, w, count(*) n from r where length(w) >= 5 group by all),
x as (select w, n, hex(encode(i || ':' || w)) b from o),
h as (select w, n, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(b) // 2), lambda k: ('0x' || substr(b, 2 * k + 1, 2))::ubigint)),
  lambda c, d: xor(c >> 8, l[(xor(c, d) & 255)::bigint + 1])), 4294967295::ubigint) h from x, tab),
m as (select case when h % 97 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end word, n from h),
v as materialized (select word, sum(n)::bigint n from m where length(word) >= 5 group by 1 having sum(n) >= 3),
d as (select distinct word, n, length(word) len, k, substr(word, 1, k - 1) || substr(word, k + 1) rest from (select word, n, unnest(range(1, length(word) + 1)) k from v)),
e as (select a.word, a.n, b.word other, b.n m from d a join d b on a.len = b.len and a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select d.word, d.n, v.word, v.n from d join v on d.rest = v.word union select v.word, v.n, d.word, d.n from d join v on d.rest = v.word),
b as (select word, count(*) n_near, max(m) m from e group by 1),
f as (select v.word, v.n, coalesce(n_near, 0)::bigint n_near, case when m >= 2 * v.n then m end form_n, case when m >= 2 * v.n then (select min(other) from e where e.word = v.word and e.m = b.m) end form from v left join b using (word)),
way as (select word, word root, form next, 0 step from f union all select way.word, way.next, f.form, step + 1 from way join f on f.word = way.next)
select f.word, f.form, way.root, f.n, f.n_near, f.form_n from f join way on f.word = way.word and way.next is null
"""


def _clusters(rounds: int = 10) -> str:
    """Components as rows; each round's assignment and centroids are a table of their own."""
    near = """a{r} as materialized (select no, arg_min(c, (d, c)) c, min(d) d from (select v.no, m.c, sum((v.x - m.x) ** 2)::bigint d from v join m{r} m on v.i = m.i group by all) group by no)"""
    mean = """m{s} as materialized (select m.c, m.i, coalesce(case when y.s < 0 then -((-y.s + y.n - 1) // y.n) else y.s // y.n end, m.x)::bigint x from m{r} m
  left join (select c, i, sum(x)::hugeint s, count(*)::hugeint n from v join a{r} using (no) group by all) y on m.c = y.c and m.i = y.i)"""
    steps = ", ".join(f"{near.format(r=r)}, {mean.format(r=r, s=r + 1)}" for r in range(rounds)) + ", " + near.format(r=rounds)
    return f"""
with k as materialized (select row_number() over () no, vec_id, embedding e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: coalesce(isfinite(x::double), false))) = 64),
v as materialized (select no, unnest(range(0, 64)) i, unnest(list_transform(e, lambda x: floor(1024 * x::double)::bigint)) x from k),
s as (select no, row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), e) - 1 c from k qualify c < 8), m0 as materialized (select c, i, x from s join v using (no)), {steps},
h as (select c, sha256(string_agg(x::varchar, ',' order by i)) sha from m{rounds} group by 1)
select k.vec_id, c::int as cluster, d distance, sum(d) over (partition by c)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha centroid_sha256 from a{rounds} join k using (no) join h using (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_fixity": FIXITY, "op6_line_dedup": LINES, "op8_mixing": MIX, "op10_chat": CHAT, "op11_spelling": SPELLING, "op12_clusters": _clusters()}
