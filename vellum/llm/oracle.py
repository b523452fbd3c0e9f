"""DuckDB statements for the operators that SQL can express on the test tables."""
from __future__ import annotations

from .secrets import BASE, RULES

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


OP1 = f"""
with recursive w as (select doc_id, {_words(_LOWER)} as w from documents),
g as (
  select distinct doc_id, hash(s) as s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
      else list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) end) as s from w)),
n as (select doc_id, count(*) as n from g group by doc_id),
sig as (select doc_id, bit_xor(s) as x, sum(s % 1000000007) as y from g group by doc_id),
class as (select n.doc_id, min(n.doc_id) over (partition by n, x, y) as c, n
          from n join sig using (doc_id)),
gc as (select g.doc_id as c, s from g join class on g.doc_id = class.doc_id and class.c = class.doc_id),
rare as (select c, s, row_number() over (partition by c order by df, s) as r from (
  select c, s, count(*) over (partition by s) as df from gc)),
prefix as (select rare.c, s from rare join n on n.doc_id = rare.c
           where r <= n.n - ceil(0.85 * n.n) + 1),
cand as (select distinct a.c as a, b.c as b from prefix a join prefix b on a.s = b.s and a.c < b.c
         join n na on na.doc_id = a.c join n nb on nb.doc_id = b.c
         where least(na.n, nb.n) * 100 >= greatest(na.n, nb.n) * 85),
inter as (select a, b, count(*) as i from cand join gc x on x.c = a join gc y on y.c = b and x.s = y.s
          group by a, b),
link as (select a, b from inter join n na on na.doc_id = a join n nb on nb.doc_id = b
         where 100 * i >= 85 * (na.n + nb.n - i)),
sym as (select a, b from link union select b, a from link),
reach(c, m) as (select c, c from class where c = doc_id
                union select sym.b, reach.m from reach join sym on sym.a = reach.c and reach.m < sym.b),
comp as (select c, min(m) as m from reach group by c)
select d.doc_id, coalesce(class.n, 0)::bigint as n_shingles, coalesce(comp.m, d.doc_id) as component_id,
       coalesce(comp.m, d.doc_id) = d.doc_id as kept
from documents d left join class on class.doc_id = d.doc_id left join comp on comp.c = class.c
"""

OP3 = f"""
with w as (select doc_id, {_words("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, hash(list_slice(w, i, i + 19)) as h
        from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as r from win)
          where r > 1),
gone as (select distinct doc_id, i + k as i from again, range(20) t(k)),
per as (select doc_id, list(i) as g from gone group by doc_id),
kept as (select w.doc_id, len(w) as n, case when g is null then w
           else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(g, x[2])), lambda x: x[1])
           end as k from w left join per on per.doc_id = w.doc_id)
select doc_id, n::bigint as n_words, (n - len(k))::bigint as n_removed,
       sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

OP6 = f"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256 from t
"""


def _rule(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, {rank} as rank, '{kind}' as kind, s as start, s + len(hit) as stop from (
    select doc_id, hits[i] as hit, parts[i] as part,
           coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: len(x))), 0)
           + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: len(x))), 0) as s
    from (select doc_id, gaps, hits, parts, unnest(range(1, len(hits) + 1)) as i from (
      select doc_id, string_split_regex(coalesce(text, ''), '{p}') as gaps, regexp_extract_all(coalesce(text, ''), '{p}', 0) as hits,
             regexp_extract_all(coalesce(text, ''), '{p}', {group}) as parts from documents)))
  where len(part) >= {least}"""


OP10 = f"""
with span as ({" union all ".join(_rule(i, *r) for i, r in enumerate(RULES))}),
text_of as (select *, kind || ':' || start::bigint || ':' || stop::bigint as t from span),
per as (select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)},
          coalesce(string_agg(t, ',' order by start, rank) filter (kind in {BASE}), '') as base,
          string_agg(t, ',' order by start, rank) as spans from text_of group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per on per.doc_id = d.doc_id
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII string."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint), lambda c, b: "
            "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295)")


# An edit path of least cost has no insertion (a pair around one is cheaper to remove), so the
# states carry (cost, audit) from turn to turn.
_STATES = {1: (["s0"], "s"), 2: (["s0", "s1", "s3"], "u"), 3: (["s2"], "a")}


def _state(k: int) -> str:
    cand = [f"case when s{k} is not null then {{'c': s{k}.c + 2, 'a': s{k}.a || 'D'}} end"]
    for s in _STATES.get(k, ([], ""))[0]:
        letter = _STATES[k][1]
        cost = f"{s}.c + if(fault = 't', 5, 0) + if(x = '{letter}', 0, 1)"
        ok = f"{s} is not null and fault not in ('b', 'd')" + (" and x = 's'" if letter == "s" else "")
        cand.append(f"case when {ok} then {{'c': {cost}, 'a': {s}.a || if(x = '{letter}', 'K', 'R')}} end")
    return f"list_min(list_filter([{', '.join(cand)}], lambda z: z is not null)) as s{k}"


_NONE = "null::struct(c bigint, a varchar)"
_END = r"[\x20\x09-\x0D]+$"
OP12 = f"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from raw),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
    regexp_replace(text, '{_END}', '') as body, left(role, 1) as x from damaged),
t as (
  select *, case when body = '' then 'b'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(x) over (partition by conv_id order by i) || x as pair from placed),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
    count(*) filter (where fault = 't') as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from t group by conv_id),
path as (
  select conv_id, 0::bigint as i, n, {{'c': 0::bigint, 'a': ''}} as s0, {_NONE} as s1, {_NONE} as s2, {_NONE} as s3 from sums
  union all
  select conv_id, i + 1, n, {", ".join(_state(k) for k in range(4))}
  from (select path.*, t.x, t.fault from path join t on t.conv_id is not distinct from path.conv_id and t.i = path.i + 1)),
best as (
  select conv_id, list_min(list_filter([s0, s3], lambda z: z is not null)) as b from path where i = n),
steps as (
  select t.*, b.a[t.i] as step from t join best on best.conv_id is not distinct from t.conv_id),
lines as (
  select *, count(*) filter (where not (step = 'K' and x = 's'))
    over (partition by conv_id order by i rows between unbounded preceding and 1 preceding) as before
  from steps where step <> 'D'),
hashed as (
  select conv_id, sha256(string_agg(case when step = 'K' then role when before % 2 = 0 then 'user' else 'assistant' end
    || ':' || text, chr(10) order by i)) as h from lines group by conv_id)
select c.conv_id, {", ".join(f"coalesce({m}, 0)::bigint as {m}" for m in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join sums on sums.conv_id is not distinct from c.conv_id
left join best on best.conv_id is not distinct from c.conv_id
left join hashed on hashed.conv_id is not distinct from c.conv_id
"""

#: Levels that OP13 writes out: trees of up to 3**14 leaves and 3**7 sources.
_DEPTH, _DEPTH_TOP = 14, 7


def _encoded(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, depth: int) -> str:
    """CTEs per level: nodes (tree, idx, n, d) and the siblings left and right of each."""
    out = []
    for k in range(depth):
        run = "over (partition by tree, idx // 3 order by idx rows between"
        out.append(f"""{name}w{k} as materialized (select tree, idx, n > 1 as more,
  coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as r from {name}{k}),
{name}{k + 1} as materialized (select tree, idx // 3 as idx, (n + 2) // 3 as n,
  case when n > 1 then sha256(string_agg(d, '' order by idx)) else min(d) end as d from {name}{k} group by tree, idx // 3, n)""")
    return ",\n".join(out)


def _ways(name: str, depth: int, src: str, tree: str, idx: str) -> str:
    """Joins the siblings of every level, folding them into ``acc`` and ``proof``."""
    for k in range(depth):
        src = (f"select q.* replace (case when w.more then sha256(w.l || acc || w.r) else acc end as acc, "
               f"case when w.more then proof || w.l || w.r else proof end as proof) "
               f"from ({src}) q join {name}w{k} w on w.tree = q.{tree} and w.idx = q.{idx} // {3 ** k}")
    return src


OP13 = f"""
with rows as materialized (
  select doc_id, dense_rank() over (order by source nulls first) - 1 as src, {_leaf("text")} as d,
    case when doc_id is not null and {_crc32("doc_id::varchar")} % 2 = 0
      then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as other from documents),
n0 as materialized (
  select doc_id, src as tree, row_number() over (partition by src order by doc_id nulls first, d, other) - 1 as idx,
    count(*) over (partition by src) as n, d, other from rows),
{_levels("n", _DEPTH)},
t0 as materialized (select -1 as tree, tree as idx, count(*) over () as n, d from n{_DEPTH}),
{_levels("t", _DEPTH_TOP)},
way as ({_ways("t", _DEPTH_TOP, _ways("n", _DEPTH, "select doc_id, d as leaf, tree, idx, -1 as top, other as acc, '' as proof from n0",
                                      "tree", "idx"), "top", "tree")})
select doc_id, leaf, t0.d as subroot, e.d as root, sha256(proof) as proof_sha256, acc as folded_root, acc = e.d as verified
from way join t0 on t0.idx = way.tree join t{_DEPTH_TOP} e on e.tree = way.top
"""

SQL = {"op1_near_dup": OP1, "op3_substring_dedup": OP3, "op6_exact_dedup": OP6, "op10_secret_scan": OP10,
       "op12_conversation_repair": OP12, "op13_merkle_manifest": OP13}
