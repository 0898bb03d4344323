"""SQL twins of the collocation and vector-code queries: every count by its own grouping, every distance computed."""

from __future__ import annotations

from lobwright.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

COLLOCATIONS = """
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
total as (select lang, sum(len(w))::hugeint as n from w group by lang),
grams as (select lang, array_to_string(list_slice(w, i, i + k - 1), ' ') as p, k from
  (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4), (5)) as s(k))),
f as (select lang, p, k, count(*)::hugeint as f from grams group by all having count(*) >= 100),
inside as (select lang, k, p, f, array_to_string(list_slice(string_split(p, ' '), i, i + m - 1), ' ') as sub
  from (select *, unnest(range(1, k - m + 2)) as i from f, (values (2), (3), (4)) as v(m) where k > m)),
gone as (select distinct s.lang, s.sub as p from inside s join f on f.lang = s.lang and f.p = s.sub where 100 * s.f >= 100 * f.f),
c as (select f.lang, p, k, f.f as a, unnest(range(1, k)) as cut from f where k > 1 and (f.lang, p) not in (select (lang, p) from gone)),
cuts as (select c.lang, c.p, a, cut, l.f as l, r.f as r, n, 1000 * a * n // (l.f * r.f) as score from c join total using (lang)
  join f l on l.lang = c.lang and l.p = array_to_string(list_slice(string_split(c.p, ' '), 1, cut), ' ')
  join f r on r.lang = c.lang and r.p = array_to_string(list_slice(string_split(c.p, ' '), cut + 1, c.k), ' ')),
low as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from low)
select lang, rank::bigint as rank, p as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000
"""


def vector_codes_sql() -> str:
    """Assignments and updates written out, a pair of steps for each round."""
    def assigned(k: int) -> str:
        return f"""a{k} as (select r, vec_id, label, p, s, min({{'d': d, 'e': e}}) as best from
  (select v.*, e, list_sum(list_transform(range(1, len(v.s) + 1), lambda i: (v.s[i] - b.s[i]) * (v.s[i] - b.s[i])))::bigint as d from v join b{k} b using (p)) group by all)"""

    def updated(k: int) -> str:
        # Integer division here rounds towards zero; the remainder is made positive first.
        return f"""u{k} as (select p, best.e as e, i, sum(s[i])::hugeint as t, count(*) as n from a{k}, (select unnest(range(1, (select max(len(s)) from v) + 1)) as i) group by all),
m{k} as (select p, e, list(((t - ((t % n) + n) % n) // n)::bigint order by i) as s from u{k} group by all),
b{k + 1} as (select p, e, coalesce(m.s, b.s) as s from b{k} b left join m{k} m using (p, e))"""

    steps = ",\n".join(x for k in range(ROUNDS) for x in (assigned(k), updated(k)))
    return f"""
with kept as (select row_number() over () as r, vec_id, label, embedding, len(embedding) // {PARTS} as dim from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select r, vec_id, label, p, list_transform(list_slice(embedding, p * dim + 1, (p + 1) * dim), lambda x: floor({SCALE} * x::double)::bigint) as s
  from kept, (select unnest(range(0, {PARTS})) as p)),
seeds as (select r, row_number() over (order by vec_id, embedding) - 1 as e from kept qualify e < {ENTRIES}),
b0 as (select p, e, s from v join seeds using (r)),
{steps},
{assigned(ROUNDS)},
coded as (select r, vec_id, label, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a{ROUNDS} group by all),
books as (select sha256(string_agg(array_to_string(s, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books
"""
