"""DuckDB SQL for the rows of the queries in ``registry``."""

from __future__ import annotations

from siftwork.functions.scores import Budget
from siftwork.functions.text import KEYWORDS

BUDGET = Budget().l3
L1_TOKENS = Budget().l1
#: Bytes and tokens at which the filter queries cut, so that both filters drop something.
SMALL_LIMITS = (8192, 1500)
#: Folders that the extension query skips, and the lines of the ignore query's file.
SKIPPED = ("nation_4",)
IGNORE_LINES = ("# pages", "*.net/", "**/en/*7", "!*3")
FOCUS_SUPPLIER = "s1"
FOCUS_PAGES = ("thther.example.org/en/685", "m.ththth.example.net/en")

_WORD = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+"


def _tokens(c: str) -> str:
    words = f"list_transform(regexp_extract_all({c}, '{_WORD}'), lambda w: 1.0::double + greatest(strlen(w) - 4, 0) * 0.04::double)"
    marks = rf"length(regexp_replace({c}, '[A-Za-z0-9_\x{{80}}-\x{{10FFFF}} \t\r\n]', '', 'g'))"
    breaks = f"(length({c}) - length(replace({c}, chr(10), '')))"
    cost = f"list_reduce({words}, lambda a, b: a + b, 0.0::double)"
    return f"case when {c} is null then null when length({c}) = 0 then 0 else greatest(1, ceil({cost} + {marks} * 0.65::double + {breaks} * 0.5::double)) end::bigint"


_ENTRIES = f"""
    entries as (
        select doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' as path, {_tokens("text")} as token_count, strlen(text)::bigint as size_bytes, lang as language,
               epoch(timestamp '2024-02-01')::bigint - (n_chars // 100) * 3600 as mtime, md5(text) as digest
        from documents
    )"""


def _history(path: str) -> str:
    return f"""
    commits as (
        select floor(epoch(ts) / 3600)::bigint as commit_id, ts, {path}::varchar as path,
               case event_type when 'purchase' then 'D' when 'signup' then 'A' else 'M' end as status
        from events
    ),
    newest as (select commit_id from (select commit_id, max(ts) as ts from commits group by 1) order by ts desc, commit_id desc limit 500),
    history as (
        select path, least(count(*), 100)::int as commit_count,
               greatest(epoch(timestamp '2024-02-01')::bigint - floor(epoch(max(ts)))::bigint, 0) / 86400.0::double as age_days
        from commits where commit_id in (select commit_id from newest) and status in ('A', 'M', 'C') group by 1
    )"""


def _recency(age: str) -> str:
    return f"greatest(least(exp(-ln(2.0::double) * {age} / 30.0::double), 1.0), 0.0)::float"


_SIZE = "(1.0::double / (1 + (token_count / 500.0::double)::float::double))::float"
_EFF = "(case when token_count > 0 then (composite_score::double / token_count)::float else 0 end)::float"
_TOTAL = "(0.4::float + 0.15::float + 0.2::float + 0.25::float)"
_SCORED = (
    _history("user_id")
    + ","
    + _ENTRIES
    + f""",
    firsts as (select min(doc_id) as doc_id from entries group by digest),
    signals as (
        select e.*, {_recency("coalesce(h.age_days, greatest(epoch(timestamp '2024-02-01')::bigint - e.mtime, 0) / 86400.0::double)")} as recency, {_SIZE} as size_score
        from entries e join firsts using (doc_id) left join history h on h.path::bigint = e.doc_id
    ),
    scored as (
        select *, greatest(least((((0.4::float * recency + 0.15::float * size_score + 0.2::float * 0::float + 0.25::float * 0::float)::double / {_TOTAL}::double))::float, 1::float), 0::float) as composite_score
        from signals
    ),
    effs as (select doc_id, path, token_count as t, composite_score as s, {_EFF} as e from scored)"""
)



def _greedy(budget: int, only_fitting: bool = True) -> str:
    """``picked``: first fit by efficiency. Oversized items are left out, or passed over without ending the search."""
    return f"""
    ranks as (select *, row_number() over (order by e desc, doc_id) as r from effs where t <= {budget} or {not only_fitting}),
    steps as (
        select 0::bigint as r, {budget}::bigint as rest, null::bigint as doc_id, 0::bigint as pick_order, false as took, false as stopped
        union all
        select i.r, case when i.t <= s.rest then s.rest - i.t else s.rest end, i.doc_id, s.pick_order + (i.t <= s.rest)::bigint, i.t <= s.rest,
               i.t <= {budget} and case when i.t <= s.rest then s.rest - i.t else s.rest end < 10
        from steps s join ranks i on i.r = s.r + 1 where not s.stopped
    ),
    picked as (select doc_id, pick_order from steps where took)"""


_GREEDY = "with recursive " + _SCORED + "," + _greedy(BUDGET)

_DIRECTORY = "regexp_replace(path, '/[^/]*$', '')"
_PARENT = "regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '')"


def _diverse(group: str) -> str:
    """One round for each pick: the fitting item of the highest decayed efficiency, by what its group has already given."""
    return (
        "with recursive "
        + _SCORED
        + f""",
    grouped as (select doc_id, t, e::double as e, {group} as g from effs where t <= {BUDGET}),
    items as (select doc_id, t, e, row_number() over (order by e desc, doc_id) as i, dense_rank() over (order by g) as g from grouped),
    steps as (
        select 0::bigint as pick_order, {BUDGET}::bigint as rest, null::bigint as doc_id,
               (select list_transform(range(max(g)), lambda x: 0) from items) as counts, (select list_transform(range(max(i)), lambda x: false) from items) as taken
        union all
        select pick_order + 1, rest - (b).t, (b).doc_id, list_transform(counts, lambda c, k: c + (k = (b).g)::int), list_transform(taken, lambda c, k: c or k = (b).i)
        from (
            select s.pick_order, s.rest, s.counts, s.taken,
                   arg_max({{'doc_id': b.doc_id, 't': b.t, 'g': b.g, 'i': b.i}}, (case when b.t = 0 then 'inf'::double else b.e * power(0.7::double, s.counts[b.g]) end, -b.doc_id)) as b
            from steps s, items b where not s.taken[b.i] and b.t <= s.rest and s.rest >= 10 group by all
        ) where b is not null
    )
    select doc_id, pick_order from steps where doc_id is not null
    """
    )


_KKT = (
    "with recursive "
    + _SCORED
    + f""",
    lams as (select k, (select max(e)::double from effs where t > 0) * 1.1::double * power(2.0::double, -k) as lam from range(1, 31) x(k)),
    trial as (select k, doc_id, t, s::double as s, row_number() over (partition by k order by s::double - lam * t desc, doc_id) as r from lams, effs where t <= {BUDGET} and s::double - lam * t > 0),
    fit as (
        select k, 0::bigint as r, {BUDGET}::bigint as rest, 0::bigint as n, null::bigint as doc_id, false as took, 0.0::double as total from lams
        union all
        select f.k, i.r, case when i.t <= f.rest then f.rest - i.t else f.rest end, f.n + (i.t <= f.rest)::bigint, i.doc_id, i.t <= f.rest, case when i.t <= f.rest then f.total + i.s else f.total end
        from fit f join trial i on i.k = f.k and i.r = f.r + 1
    ),
    best as (select k from (select k, max(total) as total from fit group by 1) order by total desc, k limit 1),
    kkt as (select doc_id, n as pick_order from fit where took and k = (select k from best))"""
)
_KKT_DIVERSE = (
    "with recursive "
    + _SCORED
    + f""",
    lams as (select k, (select max(e)::double from effs where t > 0) * 1.1::double * power(2.0::double, -k) as lam from range(1, 31) x(k)),
    grouped as (select *, dense_rank() over (order by {_DIRECTORY}) as g from effs where t <= {BUDGET}),
    trial as (select k, lam, doc_id, t, s::double as s, g, row_number() over (partition by k order by s::double - lam * t desc, doc_id) as r from lams, grouped where s::double - lam * t > 0),
    fit as (
        select k, 0::bigint as r, {BUDGET}::bigint as rest, 0::bigint as n, null::bigint as doc_id, false as took, 0.0::double as total, (select list_transform(range(max(g)), lambda x: 0) from grouped) as counts from lams
        union all
        select k, r, rest - took::bigint * t, n + took::bigint, doc_id, took, case when took then total + value else total end, case when took then list_transform(counts, lambda c, j: c + (j = g)::int) else counts end
        from (
            select f.k, i.r, f.rest, f.n, i.doc_id, i.t, i.g, f.total, f.counts, i.s * power(0.7::double, f.counts[i.g]) as value, i.t <= f.rest and i.s * power(0.7::double, f.counts[i.g]) - i.lam * i.t > 0 as took
            from fit f join trial i on i.k = f.k and i.r = f.r + 1
        )
    ),
    best as (select k from (select k, max(total) as total from fit group by 1) order by total desc, k limit 1)
    select doc_id, n as pick_order from fit where took and k = (select k from best)"""
)
_IDS = "list_distinct(list_filter(string_split_regex({c}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: strlen(w) >= 3 and not list_contains({kw}, w) and not regexp_full_match(w, '[0-9]+')))"
_KW = "[" + ", ".join(f"'{w}'" for w in KEYWORDS) + "]"


def _ids(c: str) -> str:
    return _IDS.format(c=c, kw=_KW)


_FEEDBACK = (
    "with "
    + _ENTRIES
    + """,
    fb as (
        select split_part(path, '/', 1) as session_id, path as file_path, token_count, 1.0::double / (token_count + 1) as composite_score, toxic = 0 as was_selected,
               case when toxic = 0 then quality::double end as utilization
        from entries join labels using (doc_id)
    )"""
)
_PAGES = "p as (select page_id, regexp_replace(url, '^https?://', '') as path, strlen(html)::bigint as token_count from pages)"


def _near(a: str, b: str) -> str:
    return (
        f"(1.0::double / (1 + len({a}) + len({b}) - 2 * coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] = {b}[k]), false), 0) - 1, least(len({a}), len({b})))))::float"
    )


def _parts(c: str) -> str:
    return f"list_filter(string_split({c}, '/'), lambda x: x <> '')"


_FOCUS = "greatest(" + ", ".join(_near(_parts("path"), _parts(f"'{f}'")) for f in FOCUS_PAGES) + ")"
_GRAPH = f"""
    e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem),
    both_ways as (select a, b from e union all select b, a from e),
    walk as (select '{FOCUS_SUPPLIER}' as node, 0 as distance union select b, distance + 1 from walk join both_ways on node = a where distance < 8),
    far as (select node, min(distance)::int as distance from walk group by node)"""


def _prints() -> str:
    """Fingerprints: by bit, how many shingles have it, over the halves of their digests."""
    half = lambda h: ", ".join(f"sum(({h} >> {i}) & 1) as {h}{i}" for i in range(32))
    join = lambda h, shift: " | ".join(f"((2 * {h}{i} > n)::bigint << {i + shift})" for i in range(32) if i + shift < 63)
    return rf"""
    ws as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as w from documents),
    grams as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: md5(array_to_string(w[i:i + 2], ' ')))) as g from ws where len(w) > 0),
    halves as (select doc_id, ('0x' || substr(g, 1, 8))::bigint as hi, ('0x' || substr(g, 9, 8))::bigint as lo from grams),
    votes as (select doc_id, count(*) as n, {half("hi")}, {half("lo")} from halves group by doc_id),
    bits as (select doc_id, ({join("hi", 32)}) + case when 2 * hi31 > n then (-9223372036854775808)::bigint else 0 end + ({join("lo", 0)}) as simhash from votes),
    prints as (select d.doc_id as key, coalesce(b.simhash, 0) as simhash from documents d left join bits b using (doc_id) where d.text is not null)"""


_PAIRS = """
    bands as (select key, simhash, unnest([{'i': 0, 'v': simhash & 65535}, {'i': 1, 'v': (simhash >> 16) & 65535}, {'i': 2, 'v': (simhash >> 32) & 65535}, {'i': 3, 'v': (simhash >> 48) & 65535}]) as x from %s),
    pairs as (select distinct a.key as a, b.key as b, bit_count(xor(a.simhash, b.simhash))::int as distance from bands a join bands b on a.x = b.x and a.key < b.key where bit_count(xor(a.simhash, b.simhash)) <= %d)"""
_GROUPS = """
    links as (select a, b from pairs union select b, a from pairs),
    reach as (select a as key, a as label from links union select l.b, r.label from reach r join links l on l.a = r.key),
    groups as (select key, min(label) as label from reach group by key)"""

_SOURCES = """
    n0 as (select n_nationkey, n_regionkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) as m from nation),
    n1 as (select *, coalesce(lead(m) over (partition by n_regionkey order by n_nationkey), 'nowhere') as x, (['rust', 'typescript', 'javascript', 'python', 'go'])[n_regionkey + 1] as language from n0),
    files as (
        select *, 'src/' || case language when 'go' then m || '/' || m || '.go' else m || '.' || (['rs', 'ts', 'js', 'py'])[n_regionkey + 1] end as path,
               case language when 'rust' then 'crate::' || x when 'python' then '.' || x when 'go' then 'src/' || x else './' || x end as raw_path
        from n1
    )"""
_LISTINGS = (
    "with "
    + _ENTRIES
    + """,
    old as (select path, mtime, size_bytes as size, digest as hash from entries qualify row_number() over (partition by digest order by doc_id) = 1),
    new as (select path, case when size_bytes > 1000 then mtime + 60 else mtime end as mtime, size_bytes as size, digest as hash from entries where language <> 'fr')"""
)
_UTIL = (
    "with said as (select conv_id, string_agg(text, chr(10) order by turn, text) as r from conversations where role = 'assistant' group by 1), "
    + f"""u as (
        select c.conv_id, c.turn, {_ids("c.text")} as ids, list_distinct(list_filter(string_split_regex(coalesce(s.r, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: strlen(w) >= 3)) as seen
        from conversations c left join said s using (conv_id) where c.role = 'user'
    ),
    used as (select conv_id, turn, round(case when len(ids) = 0 then 0 else len(list_intersect(ids, seen)) / len(ids)::double end::float::double, 6) as utilization from u)"""
)



def _three(c: str) -> str:
    return f"printf('%.3f', round_even(({c})::double, 3))"


ORACLE_SQL: dict[str, str] = {
    "token_estimate": f"select doc_id, {_tokens('text')} as tokens from documents",
    "content_md5": "select doc_id, md5(text) as digest from documents",
    "identifiers": f"select doc_id, array_to_string(list_sort({_ids('text')}), ',') as names from documents",
    "session_ids": "select event_id, substr(md5(user_id || ':' || (epoch_us(ts) * 1000)), 1, 16) as session_id from events",
    "language_map": "with "
    + _SOURCES
    + " select path, regexp_extract(path, '[^.]*$') as extension, language, true as watched from files",
    "extension_filter": f"with {_SOURCES} select path, language from files where language in ('rust', 'go') and not list_has_any(string_split(path, '/'), {list(SKIPPED)})",
    "ignored_paths": r"""
        with p as (select page_id, string_split(regexp_replace(url, '^https?://', ''), '/') as a from pages)
        select page_id, case when len(list_filter(a, lambda x: x like '%3')) > 0 then false
                             when len(list_filter(range(1, len(a)), lambda i: a[i] = 'en' and a[i + 1] like '%7')) > 0 then true
                             else len(list_filter(a[1:len(a) - 1], lambda x: x like '%.net')) > 0 end as ignored from p
    """,
    "group_keys": r"""
        with p as (select page_id, regexp_replace(url, '^https?://', '') as p from pages),
        u as (select *, case when contains(p, '/') then regexp_replace(p, '/[^/]*$', '') else '' end as up from p)
        select page_id, up as directory, case when up = '' then p when contains(up, '/') then regexp_replace(up, '/[^/]*$', '') else '' end as parent from u
    """,
    "path_proximity": f"with {_PAGES}, q as (select page_id, {_parts('path')} as a, {_parts('lead(path) over (order by page_id)')} as b from p) select page_id, {_near('a', 'b')}::double as proximity from q where b is not null",
    "proximity": f"with {_PAGES} select page_id, {_FOCUS}::double as proximity from p",
    "recency": f"select event_id, round({_recency('((epoch(timestamp ' + chr(39) + '2024-02-01' + chr(39) + ')::bigint - floor(epoch(ts))::bigint) / 86400.0::double)')}::double, 5) as recency from events",
    "size_signal": f"with {_ENTRIES} select doc_id, round({_SIZE}::double, 6) as size_score from entries",
    "efficiency": f"with {_SCORED} select doc_id, round(e::double, 8) as efficiency from effs",
    "budget_split": "with o as (select o_orderkey, floor(o_totalprice)::bigint as t from orders) select o_orderkey, "
    + ", ".join(f"floor((t::float * {share}::float)::double)::bigint as {k}" for k, share in (("l1", 0.05), ("l2", 0.25), ("l3", 0.70)))
    + " from o",
    "composite_score": f"with {_SCORED} select doc_id, token_count, round(recency::double, 5) as recency, round(size_score::double, 5) as size_score, round(composite_score::double, 5) as composite_score from scored",
    "focus_score": f"""
        with {_PAGES}, h as (select *, split_part(path, '/', 1) as host from p),
        near as (select distinct host from h where path in {FOCUS_PAGES}),
        d as (select h.*, case when path in {FOCUS_PAGES} then 1.0 when host in (select host from near) then (1.0::double / 3) else 0.0 end::float as dependency from h),
        s as (select *, {_FOCUS} as proximity, {_recency("(token_count * 60 / 86400.0::double)")} as recency, {_SIZE} as size_score from d)
        select page_id, round(dependency::double, 6) as dependency,
               round(least((((0.15::float * recency + 0.05::float * size_score + 0.45::float * proximity + 0.35::float * dependency)::double / (0.15::float + 0.05::float + 0.45::float + 0.35::float)::double))::float, 1::float)::double, 5) as composite_score
        from s
    """,
    "scan_filter": f"with {_ENTRIES} select e.doc_id, size_bytes, token_count from entries e join documents d on d.doc_id = e.doc_id where size_bytes <= {SMALL_LIMITS[0]} and not contains(d.text, chr(0)) and token_count <= {SMALL_LIMITS[1]}",
    "skip_counts": f"select count(*) filter (strlen(text) > {SMALL_LIMITS[0]}) as too_big, count(*) filter (strlen(text) <= {SMALL_LIMITS[0]} and contains(text, chr(0))) as binary from documents",
    "index_stats": f"with {_ENTRIES} select count(*) as files, coalesce(sum(token_count), 0)::bigint as tokens from entries",
    "language_histogram": "select coalesce(lang, 'Other') as language, count(*) as files from documents group by 1",
    "commit_stats": f"with {_history('user_id')} select path::bigint as user_id, commit_count, round(age_days, 6) as age_days from history",
    "commit_stats_by_type": f"with {_history('event_type')} select path as event_type, commit_count, round(age_days, 6) as age_days from history",
    "recency_from_history": f"with {_history('user_id')}, {_ENTRIES} select e.doc_id, round({_recency('coalesce(h.age_days, greatest(epoch(timestamp ' + chr(39) + '2024-02-01' + chr(39) + ')::bigint - e.mtime, 0) / 86400.0::double)')}::double, 5) as recency from entries e left join history h on h.path::bigint = e.doc_id",
    "exact_dedup": "select min(doc_id) as doc_id, md5(text) as digest from documents group by md5(text)",
    "exact_dedup_stats": "select count(*) as total, count(distinct coalesce(md5(text), '')) as kept, count(*) - count(distinct coalesce(md5(text), '')) as removed from documents",
    "simhash": f"with {_prints()} select key as doc_id, simhash from prints",
    "lsh_bands": f"with {_prints()} select key as doc_id, (x.i)::int as band, (x.v)::int as value from (select key, unnest([{{'i': 0, 'v': simhash & 65535}}, {{'i': 1, 'v': (simhash >> 16) & 65535}}, {{'i': 2, 'v': (simhash >> 32) & 65535}}, {{'i': 3, 'v': (simhash >> 48) & 65535}}]) as x from prints)",
    "hamming_pairs": f"with {_prints()}, leads as (select min(key) as key, simhash from prints group by simhash), {_PAIRS % ('leads', 8)} select a, b, distance from pairs",
    "hamming_members": f"with {_prints()}, {_PAIRS % ('prints', 8)}, links as (select a as key from pairs union all select b from pairs) select p.key as doc_id, min(p.key) over (partition by p.simhash) as lead, coalesce(n.n, 0)::bigint as n_links from prints p left join (select key, count(*) as n from links group by key) n on n.key = p.key",
    "near_dup_groups": f"with recursive {_prints()}, {_PAIRS % ('prints', 3)}, {_GROUPS} select key as doc_id, label from groups",
    "near_dup_groups_wide": f"with recursive {_prints()}, {_PAIRS % ('prints', 8)}, {_GROUPS} select key as doc_id, label from groups",
    "near_dedup": f"with recursive {_prints()}, {_PAIRS % ('prints', 8)}, {_GROUPS} select d.doc_id, d.source from documents d left join groups g on g.key = d.doc_id where g.key is null or g.key = g.label",
    "dependency_edges": f"with {_SOURCES} select a.path as src, b.path as dst from files a join files b on b.n_regionkey = a.n_regionkey and b.m = a.x",
    "bfs_distance": f"with recursive {_GRAPH} select node, distance from far",
    "dependency_signal": f"with recursive {_GRAPH} select p_partkey, round(coalesce((1.0::double / (1 + distance))::float, 0::float)::double, 6) as dependency from part left join far on node = 'p' || p_partkey",
    "signatures": f"""
        with {_SOURCES} select path, case language when 'typescript' then 'interface' else 'function' end as kind,
            case language when 'rust' then 'pub fn run_' || m || '(x: u8) -> u8' when 'typescript' then 'interface Kind_' || m when 'javascript' then 'function run_' || m || '(x)'
                          when 'python' then 'def run_' || m || '(x)' else 'func Run_' || m || '(x int) int' end as text,
            case language when 'python' then 4 when 'go' then 5 else 2 end as line from files
    """,
    "imports": f"with {_SOURCES} select path, language, raw_path, case language when 'go' then 3 else 1 end as line from files",
    "resolve_imports": f"with {_SOURCES} select a.path as src, a.raw_path, b.path as dst from files a join files b on b.n_regionkey = a.n_regionkey and b.m = a.x",
    "greedy_knapsack": _GREEDY + " select doc_id, pick_order from picked",
    "greedy_oversized": "with recursive " + _SCORED + "," + _greedy(1000, False) + ", over as (select i.t from steps s join ranks i on i.r = s.r) select count(*) as oversized_skipped from over where t > 1000",
    "greedy_diverse_directory": _diverse(_DIRECTORY),
    "greedy_diverse_parent": _diverse(_PARENT),
    "kkt_knapsack": _KKT + " select doc_id, pick_order from kkt",
    "kkt_knapsack_diverse": _KKT_DIVERSE,
    "select_auto": _KKT
    + ","
    + _greedy(BUDGET)
    + """,
        totals as (select (select sum(s::double) from effs where doc_id in (select doc_id from picked)) as greedy_total, (select sum(s::double) from effs where doc_id in (select doc_id from kkt)) as kkt_total)
        select doc_id, pick_order from kkt where (select kkt_total > greedy_total from totals)
        union all select doc_id, pick_order from picked where not (select kkt_total > greedy_total from totals)
    """,
    "ranked_documents": f"with {_SCORED} select doc_id, row_number() over (order by composite_score desc, path) as rank from scored",
    "l1_prefix": f"with {_SCORED}, r as (select doc_id, row_number() over (order by composite_score desc, path) as rank from scored) select doc_id, rank, (12 * rank)::bigint as l1_tokens from r where 12 * rank <= {L1_TOKENS} or rank = 1",
    "pack_stats": _GREEDY
    + f""",
        a as (select count(*) as scanned, count(distinct digest) as exact_left from entries), c as (select sum(token_count) as left_tokens from scored), u as (select count(*) as n, sum(token_count) as used from scored where doc_id in (select doc_id from picked))
        select scanned, scanned - exact_left as exact_removed, 0::bigint as near_removed, n as files_selected, used::bigint as tokens_used, {BUDGET}::bigint as tokens_budget, round(left_tokens / greatest(used, 1)::double, 6) as compression_ratio from a, c, u
    """,
    "render_l1_lines": f"with {_SCORED}, r as (select *, row_number() over (order by composite_score desc, path) as rank from scored) select rank, path || '  [' || token_count || ' tokens, score=' || {_three('composite_score')} || ']' as line from r where 12 * rank <= {L1_TOKENS} or rank = 1",
    "render_l2_blocks": _GREEDY
    + f"""
        select k.pick_order, chr(10) || '### ' || s.path || chr(10) || '- **Tokens**: ' || s.token_count || chr(10) || '- **Score**: ' || {_three('s.composite_score')} || chr(10)
            || '- **Signals**: recency=' || {_three('s.recency')} || ', size=' || {_three('s.size_score')} || ', proximity=0.000'
            || case when h.path is null then '' else chr(10) || '- **Git**: ' || printf('%.1f', round_even(h.age_days, 1)) || ' days ago, ' || h.commit_count || ' commits' end || chr(10) || '- **Language**: ' || upper(s.language[1]) || s.language[2:] as block
        from picked k join scored s using (doc_id) left join history h on h.path::bigint = s.doc_id
    """,
    "render_l3_files": _GREEDY
    + f"""
        select k.pick_order, '<file path="' || s.path || '" tokens="' || s.token_count || '" score="' || {_three('s.composite_score')} || '">' || chr(10) || d.text || case when d.text like '%' || chr(10) then '' else chr(10) end || '</file>' as file
        from picked k join scored s using (doc_id) join documents d using (doc_id)
    """,
    "utilization": _UTIL + " select conv_id, turn, utilization from used",
    "session_utilization": _UTIL + " select conv_id, sum(round(utilization * 1000000)::bigint)::double / count(*) as avg_utilization from used group by conv_id",
    "feedback_multipliers": _FEEDBACK + " select file_path as path, round(0.5 + avg(utilization), 6) as multiplier from fb where utilization is not null group by 1",
    "score_with_feedback": f"with {_SCORED}, y as (select doc_id, 0.5 + avg(quality::double) as m from labels where toxic = 0 group by 1) select s.doc_id, round(greatest(least(s.composite_score * coalesce(y.m::float, 1::float), 1::float), 0::float)::double, 5) as composite_score from scored s left join y using (doc_id)",
    "session_feedback": _FEEDBACK + " select session_id, file_path, was_selected, row_number() over (partition by session_id order by composite_score desc, file_path) as place from fb",
    "feedback_stats": _FEEDBACK + " select count(distinct session_id) as sessions, count(*) as records, round(avg(utilization), 6) as avg_utilization from fb",
    "updated_weights": _FEEDBACK
    + """,
        a as (
            select count(*) as records, avg(utilization) as avg_utilization, count(*) filter (utilization >= 0.5) as nh, count(*) filter (utilization < 0.5) as nl,
                   avg(token_count) filter (utilization >= 0.5) as th, avg(token_count) filter (utilization < 0.5) as tl,
                   avg(composite_score) filter (utilization >= 0.5) as sh, avg(composite_score) filter (utilization < 0.5) as sl
            from fb where utilization is not null
        ),
        f as (select *, case when nh > 0 and nl > 0 and sl > sh then 1.3 else 1.0 end::double as rf, case when nh > 0 and nl > 0 then case when th < tl then 1.2 else 0.8 end else 1.0 end::double as sf from a),
        w as (select *, 0.9 * 0.4 + 0.1 * 0.4 * rf as r, 0.9 * 0.15 + 0.1 * 0.15 * sf as z from f),
        t as (select *, r + z + 0.2 + 0.25 as total from w)
        select case when nh > 0 then round(r / total, 6) else 0.4 end::double as recency, case when nh > 0 then round(z / total, 6) else 0.15 end::double as size,
               case when nh > 0 then round(0.2 / total, 6) else 0.2 end::double as proximity, case when nh > 0 then round(0.25 / total, 6) else 0.25 end::double as dependency,
               round(avg_utilization, 6) as avg_utilization, records
        from t
    """,
    "latest_weights": _FEEDBACK
    + """,
        a as (
            select session_id, count(*) as records, avg(utilization) as avg_utilization, count(*) filter (utilization >= 0.5) as nh, count(*) filter (utilization < 0.5) as nl,
                   avg(token_count) filter (utilization >= 0.5) as th, avg(token_count) filter (utilization < 0.5) as tl,
                   avg(composite_score) filter (utilization >= 0.5) as sh, avg(composite_score) filter (utilization < 0.5) as sl
            from fb where utilization is not null group by session_id
        ),
        f as (select *, case when nh > 0 and nl > 0 and sl > sh then 1.3 else 1.0 end::double as rf, case when nh > 0 and nl > 0 then case when th < tl then 1.2 else 0.8 end else 1.0 end::double as sf from a),
        w as (select *, 0.9 * 0.4 + 0.1 * 0.4 * rf as r, 0.9 * 0.15 + 0.1 * 0.15 * sf as z from f),
        t as (select *, r + z + 0.2 + 0.25 as total from w)
        select regexp_extract(session_id, '[0-9]+')::bigint as created_at, session_id, case when nh > 0 then round(r / total, 6) else 0.4 end::double as recency, case when nh > 0 then round(z / total, 6) else 0.15 end::double as size,
               case when nh > 0 then round(0.2 / total, 6) else 0.2 end::double as proximity, case when nh > 0 then round(0.25 / total, 6) else 0.25 end::double as dependency,
               round(avg_utilization, 6) as avg_utilization, records
        from t order by created_at desc, session_id desc, recency desc, size desc limit 1
    """,
    "feedback_upsert": _FEEDBACK + " select distinct session_id, file_path, token_count, coalesce(utilization, 0.0) as utilization from fb",
    "cache_hits": _LISTINGS + " select o.path, o.hash from new n join old o using (path, mtime, size)",
    "cache_fresh": _LISTINGS + " select path, mtime from new where (path, mtime, size) not in (select (path, mtime, size) from old)",
    "cache_deleted": _LISTINGS + " select path from old where path not in (select path from new)",
    "incremental_union": _LISTINGS + " select path, mtime, size, hash from new",
}
