"""SQL twins of the queries that SQL can express on whole tables."""

from .quality import ALPHA, DELTA, GRID, STEPS, STRATA

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_W = _WORDS.format(t="coalesce(text, '')")

_VALUES = ", ".join("(" + ", ".join(str(x) for x in (i, *[f"cast({cs[i]} as double)" for cs in GRID.values()])) + ")" for i in range(STEPS))
_STRATA = ", ".join(f"'{s}'" for s in STRATA)

QUALITY = f"""
with w as (select doc_id, lang, coalesce(text, '') as t, {_W} as ws from documents),
 g as (select doc_id, i, ws[i:i+4] as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
 d as (select doc_id, g from g group by 1, 2 having count(*) > 1),
 r as (select doc_id, count(distinct i + k) as n from (select g.doc_id, i, unnest(range(0, 5)) as k from g join d on g.doc_id = d.doc_id and g.g = d.g) group by 1),
 l as (select doc_id, count(*) as lines, count(*) - count(distinct line) as dups from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
 m as (select w.doc_id, t, case when lang in ({_STRATA}) then lang else 'other' end as stratum, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
   cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dups, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(lines, 0) as lines from w left join r on w.doc_id = r.doc_id left join l on w.doc_id = l.doc_id),
 f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_symbols / greatest(word_chars, 1) as symbol_share, n_dup_lines / greatest(lines, 1) as dup_line_share,
   n_repeat_words / greatest(n_words, 1) as repeat_share, word_chars / greatest(n_words, 1) as word_length from m),
 grid as (select * from (values {_VALUES}) as x(step, c1, c2, c3, c4)),
 one as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels where doc_id is not null and quality is not null group by doc_id),
 good as (select stratum, t, min(symbol_share) as m1, min(dup_line_share) as m2, min(repeat_share) as m3, min(word_length) as m4 from f join one on f.doc_id = one.doc_id where not base_failed group by stratum, t having min(quality) = 1 and coalesce(max(toxic), 0) = 0),
 k as (select stratum, step, count(*) as n, count(*) filter (where m1 > c1 or m2 > c2 or m3 > c3 or m4 > c4) as k from good cross join grid group by 1, 2),
 s as (select stratum, {DELTA} * count(*) / (select count(*) from f) as level from f group by 1),
 p as (select k.stratum, step, level, case when k >= n * {ALPHA} then 1 else (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) from unnest(range(0, k + 1)) as u(j)) end as p from k join s on k.stratum = s.stratum),
 b as (select stratum, coalesce(min(case when p > level then step end), {STEPS}) as bad from p group by 1),
 c as (select b.stratum, c1, c2, c3, c4 from b join grid on step = bad - 1),
 x as (select distinct doc_id from f join c on f.stratum = c.stratum where symbol_share > c1 or dup_line_share > c2 or repeat_share > c3 or word_length > c4)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from x) as kept from f"""

SUBSTRINGS = f"""
with w as (select doc_id, {_W} as ws from documents),
 g as (select doc_id, i, array_to_string(ws[i:i+49], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
 m as (select g, min(doc_id) as first from g group by g),
 gone as (select distinct doc_id, i + k as i from (select g.doc_id, i, unnest(range(0, 50)) as k from g join m on g.g = m.g where first < g.doc_id)),
 p as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
 kept as (select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.i) as t from p left join gone on p.doc_id = gone.doc_id and p.i = gone.i where gone.i is null group by p.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id"""

JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
 s as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, case when len(ws) > 0 then 2 else 1 end))) as i from w)),
 n as (select doc_id, count(*) as n from s group by 1),
 c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g where a.doc_id < b.doc_id group by 1, 2),
 l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
 e as (select x, y from l union all select y, x from l),
 r(a, b) as (select x, x from e union select r.a, e.y from r join e on r.b = e.x),
 t as (select a, min(b) as component from r group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, w.doc_id) as component_id from w left join n on w.doc_id = n.doc_id left join t on t.a = w.doc_id"""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * i + 1}, 5) as bigint) // {32**k}) % 32 as integer) + 1, 1)" for i in range(8) for k in (3, 2, 1, 0))
WARC = f"""
with p as (select page_id, coalesce(html, '') as html from pages), f as (select html, min(page_id) as first from p group by html),
 h as (select page_id, octet_length(encode(p.html)) as n, sha1(p.html) as h, first from p join f on p.html = f.html)
select page_id, cast(n as bigint) as payload_bytes, {_B32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as digest_ok from h"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
 ok as (select * from v where label is not null and e is not null and list_sum(list_transform(e, lambda x: abs(x))) > 0),
 l as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label where a.vec_id < b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
 e2 as (select x, y from l union all select y, x from l),
 r(a, b) as (select x, x from e2 union select r.a, e2.y from r join e2 on r.b = e2.x),
 t as (select a, min(b) as component from r group by a), n as (select x, count(*) as n from e2 group by x)
select vec_id, coalesce(n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept from v left join n on n.x = vec_id left join t on t.a = vec_id"""

#: Sources with sizes, caps, weights, and the rate at which weights fill up what the capped ones leave.
SOURCES = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from documents),
 s as (select source, sum(n) as size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
 c as (select *, 2 * size as cap, 2 * size / weight as ratio, 1.5 * sum(size) over () as share from s),
 o as (select *, coalesce(sum(cap) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (order by ratio, source rows between current row and unbounded following) as rest from c),
 r as (select coalesce(min_by((share - before) / rest, (ratio, source)) filter (where (share - before) / rest <= ratio), 1e300) as rate from o)"""

TARGETS = SOURCES + " select doc_id, n as size, cast(o.size as bigint) as source_size, cast(least(cap, rate * weight) as double) as target from d join o on d.source is not distinct from o.source cross join r"

PHRASES = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
 t as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
 g as (select lang, ws[i : i + m - 1] as g from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w cross join range(1, 5) as r(m))),
 f as (select lang, p, len(any_value(g)) as m, any_value(g) as g, count(*) as n from (select *, array_to_string(g, ' ') as p from g) group by lang, p),
 c as (select lang, p, g, m, n as a from f where m > 1 and n >= 30),
 k as (select lang, p, a, k, array_to_string(g[1:k], ' ') as first, array_to_string(g[k + 1:], ' ') as rest from (select *, unnest(range(1, m)) as k from c)),
 s as (select k.lang, k.p, a, k, x.n as l, y.n as r, cast(cast(2000000 as hugeint) * a // (x.n + y.n) as bigint) as score from k join f x on x.lang = k.lang and x.p = first join f y on y.lang = k.lang and y.p = rest),
 low as (select lang, p, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'k': k}) as m from s group by lang, p, a),
 sub as (select lang, a, array_to_string(g[i : i + size - 1], ' ') as p from (select *, unnest(range(1, m - size + 2)) as i from (select *, unnest(range(2, m)) as size from c))),
 gone as (select distinct f.lang, f.p from sub join f on f.lang = sub.lang and f.p = sub.p where cast(100 as hugeint) * sub.a >= cast(80 as hugeint) * f.n),
 z as (select lang, p as phrase, a, m.l as l, m.r as r, m.score as score from low where not exists (select 1 from gone where gone.lang = low.lang and gone.p = low.p)),
 o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select o.lang, rank, phrase, a, l, r, n, score from o join t on t.lang = o.lang where rank <= 2000"""

ORACLE_SQL = {"mix_targets": TARGETS, "op2_quality": QUALITY, "op3_substrings": SUBSTRINGS, "op4_jaccard": JACCARD, "op5_warc": WARC, "op7_embeddings": EMBEDDINGS, "op11_phrases": PHRASES}
