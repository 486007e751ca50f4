"""DuckDB SQL for the registered text queries that SQL can express on whole tables."""

from . import chat_format, decontaminate, mixing, quality_rules

_CHAT = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized as (
  select *, len(regexp_extract_all(role || chr(0) || text, '{escaped}')) as more from rows),
told as (
  select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum({marks} + length(role) + length(text) + more)::bigint as formatted_chars from sized group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from told
"""

_JACCARD = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, case when len(w) < 3 then md5(array_to_string(w, ' ')) else md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
same as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
link as (select x, y from same join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 90 * (a.n + b.n - k)),
pair as (select x, y from link union all select y, x from link),
reach(x, y) as (select doc_id, doc_id from n union select reach.x, pair.y from reach join pair on reach.y = pair.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.y, d.doc_id) as component_id
from d left join n using (doc_id) left join (select x, min(y) as y from reach group by x) r on r.x = d.doc_id
"""


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _quality() -> str:
    """The counts, and the verdict by the distances, written out from the operator's fixed values."""
    q = quality_rules
    lists = " ".join(f"when '{k}' then {_array(ws)}" for k, ws in q.COMMON.items())
    known = _array(sorted({w for ws in q.COMMON.values() for w in ws}))
    classes = ["[a-z]", r"[\x20\x09-\x0D]", r"[^\x00-\x7F]", "[A-Z]", "[0-9]", r"[.,;:\x27\"?!()\-]"]
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    share = "list_transform({0}, lambda v: v / list_sum({0}))"
    distance = (
        "case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0.0, list_sum(list_transform(list_zip(" + share.format("{p}") + ", " + share.format("{q}") + "), lambda z: "
        "(case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0.0 end) + (case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0.0 end))) / 2)) end"
    )
    return f"""
with d as (
  select doc_id, case when lang in ({', '.join(f"'{k}'" for k in q.COMMON)}) then lang end as language, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
f as (
  select doc_id, language, t, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls, [{counts}] as c6,
    list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: list_contains({known}, x)) as common, case language {lists} else [] end as ref from d),
g as (
  select *, list_transform(list_append(c6, length(t) - list_sum(c6)), lambda v: v::double) as classes,
    list_transform(ref, lambda r: len(list_filter(common, lambda x: x = r))::double) as counts from f),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
rep as (select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as k from tri) where k > 1) group by doc_id),
ref as (
  select language as r, [{', '.join(f'sum(classes[{k + 1}])' for k in range(7))}] as rc, [{', '.join(f'sum(counts[{k + 1}])' for k in range(q.N_COMMON))}] as rn, sum(n_words)::double as rw from g where language is not null group by language
  union all select '*', [{', '.join(f'sum(classes[{k + 1}])' for k in range(7))}], [], sum(n_words)::double from g),
h as (
  select g.*, coalesce(rep.n, 0) as n_repeat_words, rc, list_append(counts, greatest(0.0, n_words - coalesce(list_sum(counts), 0))) as own, list_append(rn, greatest(0.0, rw - coalesce(list_sum(rn), 0))) as other
  from g left join rep using (doc_id) join ref on coalesce(language, '*') = r),
v as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEATED} * n_words as base_failed, {distance.format(p='classes', q='rc')} as cd, case when language is not null then {distance.format(p='own', q='other')} end as wd from h)
select doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(length(t) >= {q.MIN_CHARS} and cd > {q.MAX_CLASS_DISTANCE}, false)
    and not coalesce(n_words >= {q.MIN_COMMON} and wd > {q.WORD_DISTANCE_BASE} + {q.WORD_DISTANCE_SLACK} / sqrt(n_words), false) as kept
from v
"""


def _floor_div(total: str, n: str) -> str:
    return f"(({total} - ((({total} % {n}) + {n}) % {n})) // {n})"


def _lloyd(points: str, first: str, rounds: int, width: int) -> str:
    """CTEs c0, a0, c1, a1, ...: entries (p, c, v) and what is nearest to each point (p, rid, c, dist) of a table of points
    (p, rid, v); distances and numbers are told by one whole number, so the least has ties to the lower entry."""
    out = [f"c0 as ({first})"]
    for r in range(rounds + 1):
        far = "+".join(f"(x.v[{i}] - c.v[{i}]) * (x.v[{i}] - c.v[{i}])" for i in range(1, width + 1))
        out.append(f"a{r} as (select p, rid, (m % 256)::int as c, m // 256 as dist from (select x.p, x.rid, min(({far}) * 256 + c.c) as m from {points} x join c{r} c on x.p = c.p group by x.p, x.rid))")
        if r < rounds:
            sums = ", ".join(_floor_div(f"sum(x.v[{i}])", "count(*)") + "::bigint" for i in range(1, width + 1))
            out.append(f"c{r + 1} as (select c.p, c.c, coalesce(n.v, c.v) as v from c{r} c left join (select a.p, a.c, [{sums}] as v from a{r} a join {points} x on a.p = x.p and a.rid = x.rid group by a.p, a.c) n on n.p = c.p and n.c = c.c)")
    return ",\n".join(out)


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _clusters() -> str:
    first = "select 0 as p, row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as c, v from pts order by sha256('2:' || vec_id::varchar) limit 40"
    return f"""
with pts as (
  select 0 as p, row_number() over (order by vec_id) as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where {_FINITE} and len(embedding) = 64),
{_lloyd("pts", first, 5, 64)}
select vec_id, a5.c as cluster, dist as distance, sum(dist) over (partition by a5.c)::bigint as cluster_inertia, sum(dist) over ()::bigint as inertia,
  sha256(array_to_string(c5.v, ',')) as centroid_sha256
from a5 join pts using (rid) join c5 on c5.c = a5.c
"""


def _codes() -> str:
    first = "select p, row_number() over (partition by p order by vec_id) - 1 as c, v from pts where rid <= 256"
    return f"""
with whole as (
  select row_number() over (order by vec_id) as rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where {_FINITE}),
pts as (select p, rid, vec_id, label, v[16 * p + 1:16 * p + 16] as v from whole, (values (0), (1), (2), (3)) t(p)),
{_lloyd("pts", first, 4, 16)},
coded as (select rid, string_agg(lower(printf('%02x', c)), '' order by p) as code, sum(dist)::bigint as error from a4 group by rid),
told as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, c)) as codebooks_sha256 from c4)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join whole using (rid), told
"""


def oracle_sql() -> dict[str, str]:
    special = "".join(c if c.isalnum() or c in "<>/_" else "\\" + c for c in "\x00".join(("\\", *chat_format.CONTROL))).replace("\\\x00", "|")
    marks = sum(map(len, (chat_format.TURN, chat_format.TEXT, chat_format.END)))
    return {
        "op1_quality_rules": _quality(),
        "op4_mix_sources": mixing.ORACLE,
        "op5_chat_format": _CHAT.format(escaped=special, marks=marks),
        "op8_ngram_jaccard": _JACCARD,
        "op9_decontaminate": decontaminate.ORACLE,
        "op12_vector_codes": _codes(),
        "op13_clusters": _clusters(),
    }
