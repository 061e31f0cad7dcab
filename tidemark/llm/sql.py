"""SQL for the rows of `op11` and `op13`."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]"


def conversation_repair() -> str:
    """Forwards, row by row: for each state the cheapest (cost, audit, repaired lines), so the least pair has the ASCII-least audit."""
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    inserted = lambda p, role: f"{{'c': {p}.c + 5, 'a': {p}.a || 'I', 'o': list_append({p}.o, '{role}:')}}"
    stays = lambda p, sign, cost, line: f"case when x.stays and {p}.c is not null then {{'c': {p}.c + x.extra + {cost}, 'a': {p}.a || '{sign}', 'o': list_append({p}.o, {line})}} end"
    keep = lambda p, letter: f"case when x.initial = '{letter}' then {stays(p, 'K', 0, 'x.line')} end"
    gone = lambda p: f"case when {p}.c is not null then {{'c': {p}.c + 2, 'a': {p}.a || 'D', 'o': {p}.o}} end"
    some = lambda p: f"case when {p}.c is not null then {inserted(p, 'user')} end"
    # what an insertion leads to: the user state first, then the assistant one, then the user one again
    closed = f"""select * replace ({least('u', some('a'))} as u) from (select * replace ({least('a', "case when u.c is not null then " + inserted('u', 'assistant') + " end")} as a)
        from (select * replace ({least('u', some('n'), some('s'), some('a'))} as u) from """
    row_ops = f"""select x.conv_id, x.i as i, {gone('p.n')} as n, {least(gone('p.s'), keep('p.n', 's'))} as s,
        {least(gone('p.u'), *(keep(f'p.{q}', 'u') for q in 'nsa'), *(stays(f'p.{q}', 'R', 1, "'user:' || x.text") for q in 'nsa'))} as u,
        {least(gone('p.a'), keep('p.u', 'a'), stays('p.u', 'R', 1, "'assistant:' || x.text"))} as a
        from p join x on x.conv_id is not distinct from p.conv_id and x.i = p.i + 1"""
    state = "struct(c bigint, a varchar, o varchar[])"
    return rf"""
    with recursive crcs as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)),
            lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as c from range(256) r(i))),
        hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295,
            list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: unicode(c)::bigint)),
            lambda v, c: xor(v >> 8, t[(xor(v, c) & 255) + 1])), 4294967295) % 20 as kind from conversations, crcs),
        d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
            from hashed, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
        o as (select *, role || ':' || text as line, row_number() over (partition by conv_id order by turn nulls first, role || ':' || text, role) as i,
            left(role, 1) as initial from d),
        f as (select *, case when not regexp_matches(text, '{_SPACE}') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
            when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as fault, lag(initial) over (partition by conv_id order by i) as before from o),
        x as (select *, coalesce(fault, '') not in ('blank', 'duplicate') as stays, case when fault = 'truncated' then 5 else 0 end as extra from f),
        counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
            count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
            count(*) filter (where i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from x group by conv_id),
        p as (select * from ({closed} (select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 'o': []}}::{state} as n, null::{state} as s, null::{state} as u, null::{state} as a from counts))))
            union all select * from ({closed} ({row_ops}))))),
        ended as (select p.conv_id, {least('p.n', 'p.a', "case when p.u.c is not null then " + inserted('p.u', 'assistant') + " end")} as best from p join counts c on c.conv_id is not distinct from p.conv_id and p.i = c.n)
    select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
        coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) k left join counts c on c.conv_id is not distinct from k.conv_id left join ended e on e.conv_id is not distinct from k.conv_id
    """


def hard_negatives() -> str:
    """Every anchor against every row."""
    return """
    with v as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
            from v a join v b on a.row <> b.row and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
        p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, vec_id nulls last) <= 5),
        n as (select p.anchor, p.anchor_id, p.row, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
            row_number() over (partition by p.anchor, p.row order by s.score desc, s.vec_id nulls last) as rank
            from p join s on p.anchor = s.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
    """
