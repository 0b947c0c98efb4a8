"""SQL of search, rules, cascades and reports for an independent engine (DuckDB).

Each function gives the text of some CTEs; names of those that depend on the
queries or on a profile begin with a prefix, so that one statement can hold
several.
"""

from __future__ import annotations

from .functions import lexicon as L
from .operators import rules as R
from .operators.rules import Profile
from .oracle import _FOUND, _list, _pack_parts, _q, _r, _squeezed, _words, company, compatible, doses, form, initials, lcs, strength, suffixes, t1, t2, t2b, t3
from .plans.cascade import Flow
from .queries import CATALOG, VENDOR

TOP, LEAST, MOST = 5, 4, 8


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100e0 else 200e0 * ({lcs(a, b)}) / (length({a}) + length({b})) end)"


def partials(name: str, pairs: str) -> str:
    """CTEs: name(a, b, k), the partial ratios of pairs (a, b)."""
    return f"""{name}_p as (select distinct a, b from ({pairs}) where a is not null and b is not null),
    {name}_o as (select a, b, case when length(a) <= length(b) then a else b end as sh, case when length(a) <= length(b) then b else a end as lo from {name}_p where a <> '' and b <> ''),
    {name}_d as (select a, b, sh, lo from {name}_o union all select a, b, lo, sh from {name}_o where length(a) = length(b)),
    {name}_w as (select a, b, sh, substr(lo, greatest(st, 0) + 1, length(sh) + least(st, 0)) as pc from (select *, unnest(range(1 - length(sh), length(lo))) as st from {name}_d)),
    {name}_k as (select sh, pc, {lcs('sh', 'pc')} as n from (select distinct sh, pc from {name}_w)),
    {name} as (select a, b, max(200e0 * n / (length(sh) + length(pc))) as k from {name}_w join {name}_k using (sh, pc) group by a, b union all select a, b, case when a = b then 100e0 else 0e0 end from {name}_p where a = '' or b = '')"""


def _tokens(norm: str) -> str:
    return f"list_transform(regexp_extract_all({norm}, '[a-z]+|[0-9.]+'), lambda t: case when t in ('cc', 'grm') then 'ml' when t = 'g' then 'gm' else t end)"


#: Items, their keys, and what packs mean.
ITEMS = f"""ci as materialized (select item_id, code, name, compname, pack, {strength('name')} as strength, {t1('name')} as norm, {t1('compname')} as comp_norm from ({CATALOG})),
items as (select *, substr(split_part(norm, ' ', 1), 1, 3) as nk, substr(split_part(comp_norm, ' ', 1), 1, 3) as ck from ci),
posts as materialized (select 'name' as idx, nk as key, item_id, norm from items where nk <> '' union all select 'company', ck, item_id, norm from items where ck <> ''),
keys as (select idx, key, count(*) as n_items, min(item_id) as first_item from posts group by idx, key),
packs_ as (select distinct pack from (select pack from ci union all select pack from ({VENDOR}))),
packs as materialized (select pack, {t1('pack')} as form, qty, unit from ({_pack_parts('packs_', 'pack')}))"""


def search(p: str, source: str) -> str:
    """CTEs up to {p}hits: query_id, rank, item_id, code, name, compname, pack, strength, name_score, pack_score, final_score; source: query_id, name, pack, compname."""
    found = _FOUND
    for name in ("found", "like_", "pk", "probes"):
        found = found.replace(f"{name} as", f"{p}{name} as").replace(f"from {name}", f"from {p}{name}")
    found = found.replace(f"from {p}probes, keys", f"from {p}probes, keys")
    front = "coalesce(list_position(list_transform(range(1, least(len(qt), len(tt)) + 1), lambda i: qt[i] <> tt[i]), true) - 1, least(len(qt), len(tt)))"
    return f"""{p}v as materialized (select query_id, pack, norm, qcomp from (select query_id, pack, {t1('name')} as norm, {t1('compname')} as qcomp from ({source})) where norm <> ''),
{p}n as materialized (select distinct norm from {p}v),
{p}w as (select distinct norm, substr(word, 1, 3) as probe from (select norm, unnest(string_split(norm, ' ')) as word from {p}n) where not regexp_full_match(word, '\\d+\\.?\\d*')),
{p}probes as (select distinct probe from {p}w),
{found},
{p}m as materialized (select distinct w.norm, posts.item_id, posts.norm as i_norm from {p}w w join {p}found f on w.probe = f.probe join posts on posts.idx = f.idx and posts.key = f.key),
{p}pairs as (select norm, i_norm, list_sort(list_distinct({_words('norm')})) as x, list_sort(list_distinct({_words('i_norm')})) as y from (select distinct norm, i_norm from {p}m)),
{p}rest as materialized (select norm, i_norm, len(x) > 0 and len(y) > 0 as both_, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') as c, array_to_string(list_filter(x, lambda w: not list_contains(y, w)), ' ') as l, array_to_string(list_filter(y, lambda w: not list_contains(x, w)), ' ') as r from {p}pairs),
{p}lcs as (select l, r, {lcs('l', 'r')} as kd from (select distinct l, r from {p}rest where both_)),
{p}sizes as (select norm, i_norm, l, r, kd, length(c) as s, case when c = '' then 0 else 1 end as g, length(l) as ll, length(r) as lr from {p}rest join {p}lcs using (l, r) where both_),
{p}score as (select norm, i_norm, case when g = 1 and (ll = 0 or lr = 0) then 100e0 else greatest(100e0 - 100e0 * (ll + lr - 2 * kd) / (s + g + ll + s + g + lr), case when g = 1 then 100e0 - 100e0 * (g + ll) / (s + s + g + ll) else 0e0 end, case when g = 1 then 100e0 - 100e0 * (g + lr) / (s + s + g + lr) else 0e0 end) end as s1 from {p}sizes),
{p}kept as materialized (select norm, i_norm, item_id, s1 from (select *, row_number() over (partition by norm order by s1 desc, item_id) as n from {p}m join {p}score using (norm, i_norm) where s1 >= 50) where n <= 120),
{p}kp as materialized (select norm, i_norm, {_tokens('norm')} as qt, {_tokens('i_norm')} as tt from (select distinct norm, i_norm from {p}kept)),
{p}tq as (select distinct unnest(qt) as q from {p}kp), {p}tt as (select distinct unnest(tt) as t from {p}kp),
{p}like as (select q, list(t) as likes from {p}tq, {p}tt where length(q) >= 3 and length(t) >= 3 and {ratio('q', 't')} >= 70 group by q),
{p}at as (select norm, i_norm, tt, i, qt[i] as q, list_position(list_transform(tt, lambda t: starts_with(t, qt[i])), true) as h from (select *, unnest(range(1, len(qt) + 1)) as i from {p}kp)),
{p}hit as (select norm, i_norm, cast(count(*) filter (tt[h] = q) as bigint) as e, cast(count(*) filter (tt[h] <> q) as bigint) as pr, cast(count(*) filter (h is null and list_has_any(coalesce(likes, []), tt)) as bigint) as li, coalesce(list(h order by i) filter (h is not null), []) as hs from (select a.*, likes from {p}at a left join {p}like k on a.q = k.q) group by norm, i_norm),
{p}brand as (select norm, i_norm, {front} as front, -abs(len(qt) - len(tt)) as len_diff, case when len(qt) > 1 and length(qt[1]) <= 2 then qt[2] else coalesce(qt[1], '') end as brand from {p}kp),
{p}f as materialized (select norm, i_norm, front, len_diff, brand, round_even(coalesce(e, 0) + coalesce(pr, 0) + 0.8e0 * coalesce(li, 0), 1) as matched, 2 * coalesce(e, 0) + coalesce(pr, 0) as exactness, -coalesce(list_sum(list_transform(range(2, len(coalesce(hs, [])) + 1), lambda i: abs(hs[i] - hs[i - 1]))), 0) as proximity from {p}brand left join {p}hit using (norm, i_norm)),
{p}vocab as (select distinct unnest(string_split(norm, ' ')) as w from ci union select distinct unnest(string_split(comp_norm, ' ')) from ci),
{p}known as (select brand, list(w) as ws from (select distinct brand from {p}f where length(brand) > 2), {p}vocab where w <> '' and {ratio('brand', 'w')} >= 75 group by brand),
{partials(f'{p}bonus', f"select qcomp as a, comp_norm as b from (select distinct qcomp from {p}v), (select distinct comp_norm from ci) where qcomp <> '' and comp_norm <> ''")},
{p}rows as (select v.query_id, c.item_id, c.code, c.name, c.compname, c.pack, c.strength, front, matched, proximity, exactness, len_diff,
  s1 * (case when length(f.brand) > 2 and not (contains(c.norm, f.brand) or contains(c.comp_norm, f.brand) or list_has_any(coalesce(ws, []), string_split(c.norm || ' ' || c.comp_norm, ' '))) then 0.65e0 else 1e0 end) as name_score,
  case when v.pack = '' or c.pack = '' then 50e0 when x.form = y.form then 100e0 when x.qty <> '' and x.qty = y.qty and (x.unit = '' or y.unit = '' or x.unit = y.unit) and not (contains(y.form, x.form) or contains(x.form, y.form)) then 90e0 when contains(y.form, x.form) or contains(x.form, y.form) then 80e0 else 50e0 end as pack_score,
  case when v.qcomp = '' or c.comp_norm = '' then 0e0 when o.k >= 60 then 10e0 when o.k < 30 then -15e0 else 0e0 end as bonus
  from {p}v v join {p}kept k using (norm) join ci c using (item_id) join {p}f f on f.norm = v.norm and f.i_norm = k.i_norm join packs x on x.pack = v.pack join packs y on y.pack = c.pack left join {p}known b on b.brand = f.brand left join {p}bonus o on o.a = v.qcomp and o.b = c.comp_norm),
{p}hits as materialized (select query_id, rank, item_id, code, name, compname, pack, strength, round_even(name_score, 1) as name_score, round_even(pack_score, 1) as pack_score, round_even(final, 1) as final_score
  from (select *, cast(row_number() over (partition by query_id order by final desc, front desc, matched desc, proximity desc, exactness desc, len_diff desc, item_id) as int) as rank from (select *, name_score * 0.75e0 + pack_score * 0.25e0 + bonus as final from {p}rows)) where rank <= {TOP})"""


def search_twice(p: str, source: str) -> str:
    """CTEs up to {p}hits of the search with a second one for poor results."""
    plain = _words(_squeezed(_r("name", r"[^a-zA-Z0-9\s]", " ")))
    word = f"list_filter({plain}, lambda w: length(w) >= 3 and not regexp_full_match(w, '\\d+'))[1]"
    again = f"select * from (select query_id, {word} as name, pack, compname from ({source}) where query_id not in (select query_id from {p}ahits group by query_id having count(*) >= {LEAST})) where name is not null"
    return f"""{search(p + 'a', source)}, {search(p + 'b', again)},
{p}both as (select *, 1 as pass from {p}ahits union all select *, 2 from {p}bhits b where not exists (select 1 from {p}ahits a where a.query_id = b.query_id and a.code = b.code)),
{p}once as (select *, row_number() over (partition by query_id, code order by pass, rank) as n from {p}both),
{p}hits as (select * replace (place as rank) from (select * exclude (n), cast(row_number() over (partition by query_id order by pass, rank) as int) as place from {p}once where n = 1 or pass = 1) where place <= {MOST})"""


def candidate_rows(p: str, hits: str, source: str) -> str:
    """CTE {p}r: what rules judge."""
    return f"""{p}r as materialized (select v.query_id, h.rank, h.item_id, h.code, trim(v.name || ' ' || v.pack) as query, v.name as q_name, v.pack as q_pack, v.compname as q_comp, h.name as c_name, h.compname as c_comp, h.pack as c_pack, h.strength as c_strength from ({source}) v join {hits} h using (query_id))"""


def _abbreviation(s: str, f: str) -> str:
    return f"(length({s}) >= 3 and {f} <> '' and substr({s}, 1, 1) = substr({f}, 1, 1) and {f} like '%' || array_to_string(string_split({s}, ''), '%') || '%')"


def _acronym(s: str, f: str) -> str:
    return f"(regexp_full_match(lower(trim({s})), '\\p{{L}}{{2,6}}') and {initials(f)} <> '' and contains({initials(f)}, lower(trim({s}))))"


def _dose_list(numbers: str, raw: str) -> str:
    unit = f"regexp_matches({raw}, '(?i)' || replace(n, '.', '\\.') || '\\s*(?:mg|mcg|ml|gm|g|iu|units?)\\b')"
    return f"list_filter({numbers}, lambda n: n not in ({_list(L.PACK_COUNTS)}) or {unit})"


def judged(p: str, rows: str, profile: Profile, strict: bool = False) -> str:
    """CTEs up to {p}j: the rows with valid, similar_brand, doses_match, form_match, accepted, score."""
    norm = t2 if profile.guarded else t2b
    first = lambda ws: f"(regexp_full_match(coalesce({ws}[1], ''), '\\p{{L}}{{2,}}') and list_contains(qw, {ws}[1]))"
    w0, w1 = "coalesce(qw[1], '')", "coalesce(qw[2], '')"
    unit = f"({w1} in ({_list(L.UNIT_AND_FORM)}))"
    short = f"length({w0}) <= 2 and {w1} <> ''" + (f" and not (regexp_matches({w1}, '^\\d') or {unit})" if profile.unit_guard else "")
    brand = f"case when {short} then {w1} else {w0} end"
    if profile.compound_brand:
        number, letters = f"regexp_full_match({w0}, '\\d+') and {w1} <> ''", "length(regexp_replace(" + w1 + ", '\\P{L}', '', 'g'))"
        brand = f"case when {number} and {letters} <= 2 and not {unit} then {w0} || {w1} when {number} and {letters} >= 3 then {w1} when {number} then {w0} when {short} then {w1} else {w0} end"
    brand_words = lambda ws: f"list_filter({ws}, lambda w: not regexp_full_match(w, '\\d+') and w not in ({_list(L.UNIT_SUFFIXES)}))"
    fused = "case when regexp_full_match(coalesce(cnw[1], ''), '\\d+') and regexp_full_match(coalesce(cnw[2], ''), '\\p{L}{1,2}') then cnw[1] || cnw[2] end" if profile.compound_brand else "null"
    least, cutoff = (4, 88) if strict else (1, 85)
    inside = "(contains(cn, b) or contains(cb, b) or contains(cnf, b) or cbf <> '' and (contains(cbf, b) or contains(b, cbf)))"
    around = f"(contains(b, cnf) and length(cnf) >= {0 if profile.empty_name_matches else least})"
    brand_ok = f"({_abbreviation('b', 'cn')} or {_abbreviation('b', 'cb')} or length(b) >= {least} and {inside} or {around} or named or coalesce(best, -1) >= {cutoff}" + (" or length(coalesce(qw[1], '')) >= 3 and contains(cn, qw[1])" if strict else "") + ")"
    suffix_ok = "true" if profile.suffixes is None else f"({suffixes('qt', profile.suffixes)} = {suffixes('c_name', profile.suffixes)})"
    if profile.strength == "first_hit":
        strength_ok = "(len(qd) = 0 or list_has_any(qd, cnum))"
    else:
        split = profile.strength == "subset"
        fit = "len(list_filter(sq, lambda n: not list_contains(sc, n))) = 0" if split else "list_has_any(sq, sc)"
        strength_ok = f"(len(sq) = 0 or len(sc) = 0 or {fit})"
    split = profile.strength == "subset"
    company_ok = f"(trim(q_comp) in ({_list(L.SKIP_COMPANY)}) or c_comp = '' or qco = '' or cco = '' or qco = cco or len(list_filter(list_intersect(string_split(qco, ' '), string_split(cco, ' ')), lambda w: length(w) >= 3)) > 0" + (f" or {_acronym('q_comp', 'c_comp')} or {_acronym('c_comp', 'q_comp')}" if profile.acronym else "") + f" or {ratio('qco', 'cco')} >= 75 or length(qco) >= 4 and length(cco) >= 4 and coalesce(pc.k, 0) >= 85)"
    unlike = "trim(q_comp) not in ('', '--') and qc <> '' and cb <> '' and coalesce(pu.k, 100) < 30"
    score = f"greatest({ratio('qf', 'cnflat')}, case when cbn[1] is not null then {ratio('qf', 'cbn[1]')} else -1 end)"
    return f"""{p}ga as materialized (select *, {_words('q')} as qw, {_words('cn')} as cnw, {_words('cb')} as cbw, replace(cn, ' ', '') as cnf, replace(cb, ' ', '') as cbf, {t3('qt', profile.guarded)} as raw from (select *, {norm('query')} as q, {norm('c_name')} as cn, {norm('c_comp')} as cb, {norm('q_comp')} as qc, case when q_name <> '' then q_name else query end as qt, c_name || ' ' || c_strength as cf, c_name || ' ' || c_pack as cform, {company('q_comp')} as qco, {company('c_comp')} as cco from {rows})),
{p}gn as (select *, regexp_extract_all(raw, '\\d+\\.?\\d*') as qn, regexp_extract_all(cf, '\\d+\\.?\\d*') as cnum, {form('query')} as q_form, {form('cform')} as c_form, {brand} as b, {first('cnw')} or {first('cbw')} as named, {brand_words('qw')} as qbw, {brand_words('cnw')} as cbn, {brand_words('cbw')} as cbb, {doses('qt', split)} as sq, {doses("(c_name || ' ' || c_strength || ' ' || c_pack)", split)} as sc from {p}ga),
{p}gb as materialized (select *, {_dose_list('qn', 'qt')} as qd, {_dose_list('cnum', 'cf')} as cd, array_to_string(qbw[1:2], '') as qf, array_to_string(cbn[1:2], '') as cnflat, array_to_string(cbb[1:2], '') as cbflat, {fused} as fused from {p}gn),
{p}gbest as (select query_id, rank, max(k) as best from (select query_id, rank, b, w from (select query_id, rank, b, unnest(list_concat(cnw, cbw)) as w from {p}gb)) join (select b, w, {ratio('b', 'w')} as k from (select distinct b, w from (select b, unnest(list_concat(cnw, cbw)) as w from {p}gb))) using (b, w) group by query_id, rank),
{p}gothers as materialized (select query_id, rank, qf, o from (select query_id, rank, qf, unnest([cnflat, cbn[1], fused, case when length(cbflat) >= 3 then cbflat end, case when length(cbflat) >= 3 and length(cbb[1]) >= 3 then cbb[1] end]) as o from {p}gb where len(cnw) > 0) where o is not null),
{partials(f'{p}gpp', f"select qf as a, o as b from {p}gothers where length(qf) >= 5 and length(o) >= 5 union select qco, cco from {p}gb where length(qco) >= 4 and length(cco) >= 4 union select qc, cb from {p}gb where qc <> '' and cb <> ''")},
{p}glike as (select query_id, rank, bool_or(qf = o or ok or coalesce(k, 0) >= 90) as sim from {p}gothers join (select qf, o, {ratio('qf', 'o')} >= 78 as ok from (select distinct qf, o from {p}gothers)) using (qf, o) left join {p}gpp on a = qf and b = o group by query_id, rank),
{p}gc as (select x.*, {compatible('q_form', 'c_form')} as form_match, len(qw) > 0 and (coalesce(sim, false) or named) as similar_brand, case when len(qd) > 0 then list_has_any(qd, cnum) else len(cd) = 0 end as doses_match, {brand_ok} as brand_ok, {suffix_ok} and {strength_ok} and {company_ok} as rest_ok, case when {unlike} then greatest(0e0, {score} - 20) else {score} end as score
  from {p}gb x left join {p}gbest using (query_id, rank) left join {p}glike using (query_id, rank) left join (select a as p1, b as p2, k from {p}gpp) pc on pc.p1 = qco and pc.p2 = cco left join (select a as u1, b as u2, k from {p}gpp) pu on pu.u1 = qc and pu.u2 = cb),
{p}j as materialized (select query_id, rank, item_id, code, query, q_name, q_comp, c_name, c_comp, c_pack, c_strength, valid, similar_brand, doses_match, form_match, similar_brand and doses_match and form_match and valid as accepted, score from (select *, len(qw) > 0 and brand_ok and rest_ok and form_match as valid from {p}gc))"""


def flow(p: str, f: Flow, source: str = VENDOR, chosen: str | None = None) -> str:
    """CTEs up to {p}match: the flow's rows, without a reranker. chosen: a CTE of what further steps have found, made of {p}j and {p}accepted."""
    asked = source if f.with_company else f"select query_id, code, name, pack, '' as compname from ({source})"
    found = (search_twice if f.twice else search)(p, asked)
    sure = "true" if f.any_score or f.low_without_model and not chosen else f"score >= {f.accept}"
    method = f"case when score >= {f.accept} then 'Heuristic' else 'Heuristic (Low)' end" if f.low_without_model and not chosen else "'Heuristic'"
    more = f", {chosen}" if chosen else ""
    union = f" union all select query_id, item_id, code, c_name, c_comp, c_pack, c_strength, score, method from {p}chosen" if chosen else ""
    return f"""{found}, {candidate_rows(p, f'{p}hits', source)}, {judged(p, f'{p}r', f.profile)},
{p}accepted as materialized (select * from {p}j where accepted qualify row_number() over (partition by query_id order by rank) = 1){more},
{p}done as (select query_id, item_id, code, c_name, c_comp, c_pack, c_strength, score, {method} as method from {p}accepted where {sure}{union}),
{p}match as materialized (select v.query_id, item_id, d.code, c_name as m_name, c_comp as m_comp, c_pack as m_pack, c_strength as m_strength, score, coalesce(method, 'No Match') as method from ({source}) v left join {p}done d using (query_id))"""


def confidence(q: str, m: str) -> str:
    """SC6 of a matched row; q, m: lower-case texts."""
    plain = lambda c: _words(_squeezed(_r(c, r"[^a-z0-9\s]", "")))
    qw = plain(q)
    brand = f"case when length(coalesce({qw}[1], '')) <= 2 and len({qw}) > 1 then {qw}[2] else coalesce({qw}[1], '') end"
    dose = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '\\d+\\.?\\d*')), lambda n: n not in ({_list(L.PACK_COUNTS)}))"
    srt = lambda c: f"array_to_string(list_sort({_words(_squeezed(c))}), ' ')"
    return f"""(select case when m_name = '' then 0 else greatest(0, least(100, cast(round_even({ratio('brand', 'word')} * 0.5e0 + {ratio('qs', 'ms')} * 0.4e0 + bonus, 0) as int))) end from (select {brand} as brand, coalesce({plain(m)}[1], '') as word, {srt(q)} as qs, {srt(m)} as ms, case when len({dose(q)}) = 0 or len({dose(m)}) = 0 then 0 when list_has_any({dose(q)}, {dose(m)}) then 10 else -15 end as bonus))"""


def report(p: str) -> str:
    """CTEs up to {p}report, of {p}match."""
    status = "case " + " ".join(f"when confidence >= {s} then {_q(label)}" for s, label in R.STATUS) + f" else {_q(R.LOWEST)} end"
    return f"""{p}x as materialized (select v.query_id, v.code as input_code, v.name as input_name, v.pack as input_pack, v.compname as input_company, m.code as hit, coalesce(m_name, '') as m_name, coalesce(m_pack, '') as m_pack, coalesce(m_comp, '') as m_comp, coalesce(m.code, '') as matched_code, method, lower(trim(v.name)) as ql, lower(trim(coalesce(m_name, ''))) as ml, lower(v.compname) as qcl, lower(coalesce(m_comp, '')) as mcl from ({VENDOR}) v left join {p}match m using (query_id)),
{partials(f'{p}cs', f"select qcl as a, mcl as b from {p}x where hit is not null and mcl <> ''")},
{p}y as (select x.*, cs.k as like_, case when hit is null then 0 else {confidence('ql', 'ml')} end as confidence from {p}x x left join {p}cs cs on cs.a = qcl and cs.b = mcl),
{p}report as (select query_id, input_code, input_name, input_pack, input_company, m_name as matched_name, m_pack as matched_pack, m_comp as matched_company, matched_code, cast(confidence as int) as confidence, case when hit is null then {_q(R.NOTHING)} else {status} end as status,
  case when hit is null or trim(input_company) in ('', '--') then '—' when m_comp = '' then '— No Master Co.' when like_ >= 60 then '✅ Match' when like_ >= 35 then '⚠️ Partial' else '❌ Mismatch' end as company_match, method from {p}y)"""


def statement(*ctes: str, of: str) -> str:
    return f"with {ITEMS}, {', '.join(ctes)} {of}"


def oracle_sql() -> dict[str, str]:
    from .operators.rules import PROFILES
    from .plans.cascade import BATCH, HYBRID, OLD_SERVER, SERVER

    hit = "query_id, rank, item_id, code, name, compname, pack, strength, name_score, pack_score, final_score"
    s = search("s", VENDOR)
    rules_ = ", ".join(judged(k, "sr", p) for k, p in zip("abc", PROFILES.values()))
    of_rules = " union all ".join(f"select '{p.name}' as profile, query_id, rank, code, valid, similar_brand, doses_match, form_match, accepted, round_even(score, 6) as score from {k}j" for k, p in zip("abc", PROFILES.values()))
    every = "select query_id, item_id, code, m_name, m_comp, m_pack, m_strength, score, method from {}match"
    total = "count(*) as total, count(*) filter (matched_code <> '') as matched, count(*) filter (matched_code = '') as unmatched, round_even(count(*) filter (matched_code <> '') * 100e0 / count(*), 1) as matched_pct, count(*) filter (confidence >= 90) as high, count(*) filter (confidence >= 75 and confidence < 90) as medium, count(*) filter (confidence > 0 and confidence < 75) as low"
    plain = "select query_id, trim(name || ' ' || pack) as name, pack, compname from ({}) where query_id in (select query_id from smatch where code is null)".format(VENDOR)

    def pick(p: str, f: Flow, shown: str, verified: bool) -> str:
        """CTEs up to {p}chosen: what the stand-in for a model adds."""
        sure = f"select query_id from {p}accepted where score >= {f.accept}"
        yes = f"union all select query_id, rank, item_id, code, c_name, c_comp, c_pack, c_strength, score, 'Verified' as method from {p}accepted where score < {f.accept} and length(query) % 2 = 0" if verified else ""
        return f"""{p}verified as (select query_id, rank, item_id, code, c_name, c_comp, c_pack, c_strength, score, '' as method from {p}accepted where false {yes}),
        {p}open as (select *, row_number() over (partition by query_id order by rank) as nth, count(*) over (partition by query_id) as many from {p}j where {shown} and query_id not in ({sure}) and query_id not in (select query_id from {p}verified)),
        {p}pick as (select query_id, rank, item_id, code, query, q_name, '' as q_pack, q_comp, c_name, c_comp, c_pack, c_strength from {p}open where length(query) % 7 <> 0 and nth = 1 + length(query) % many),
        {judged(p + 'z', p + 'pick', f.profile, strict=True)},
        {p}chosen as (select query_id, item_id, code, c_name, c_comp, c_pack, c_strength, score, method from {p}verified union all select query_id, item_id, code, c_name, c_comp, c_pack, c_strength, score, 'AI Match' from {p}zj where valid)"""

    key = t2b("trim(name || ' ' || pack)")
    cached = f"""k as (select query_id, {key} as k from ({VENDOR})), stored as (select k, code from k join smatch using (query_id) where query_id % 2 = 0 and k <> '' qualify row_number() over (partition by k order by query_id desc) = 1),
    hits as (select k.query_id, s.code from k join stored s using (k) where s.code is not null)"""
    of_cached = """select query_id, i.item_id, i.code, i.name as m_name, i.compname as m_comp, i.pack as m_pack, i.strength as m_strength, cast(null as double) as score, 'Cache' as method from hits join ci i using (code)
    union all select query_id, item_id, code, m_name, m_comp, m_pack, m_strength, score, method from smatch where query_id not in (select query_id from hits)"""
    catalog_, vendor_ = f"({CATALOG})", f"({VENDOR})"
    numbered = "cast(row_number() over (order by {}) as bigint)"
    return {
        "search": statement(s, of=f"select {hit} from shits"),
        "search_twice": statement(search_twice("s", VENDOR), of=f"select {hit} from shits"),
        "candidate_rules": statement(s, candidate_rows("s", "shits", VENDOR), rules_, of=of_rules),
        "match_batch": statement(flow("s", BATCH), of=every.format("s")),
        "match_server": statement(flow("s", SERVER), of=every.format("s")),
        "match_old_server": statement(flow("s", OLD_SERVER), of=every.format("s")),
        "match_hybrid": statement(flow("s", HYBRID), of=every.format("s")),
        "match_reranked": statement(flow("s", BATCH, chosen=pick("s", BATCH, "valid", False)), of=every.format("s")),
        "match_verified": statement(flow("s", OLD_SERVER, chosen=pick("s", OLD_SERVER, "true", True)), of=every.format("s")),
        "match_cached": statement(flow("s", HYBRID), cached, of=of_cached),
        "match_report": statement(flow("s", BATCH), report("s"), of="select * from sreport"),
        "report_summary": statement(flow("s", BATCH), report("s"), of=f"select {total} from sreport"),
        "service_mappings": statement(flow("s", SERVER), report("s"), of="select input_code as vendor_code, matched_code as master_id, input_name as product_name, input_company as company, input_pack as pack, matched_name, matched_pack, matched_company, cast(confidence as double) as confidence from sreport where matched_code <> ''"),
        "unmatched_list": statement(flow("s", BATCH), search("u", plain), of=f"select v.query_id, v.name, v.pack, rank, h.code as master_id, h.name as m_name, h.compname as company, h.pack as m_pack, final_score as score from {vendor_} v left join uhits h using (query_id) where v.query_id in (select query_id from smatch where code is null)"),
        "csv_catalog": f"select {numbered.format('item_id')} as item_id, code, name, '\"A, B\" ' || compname as compname, pack, '' as strength from {catalog_} where item_id % 11 <> 0 and item_id % 13 <> 0",
        "foreign_catalog": f"select n as item_id, 'M_' || n as code, name, compname, pack, {strength('name')} as strength from (select {numbered.format('p_partkey')} as n, p_name || ' ' || cast(p_size as varchar) || 'mg' as name, p_brand as compname, p_type as pack from part where p_size not in (1, 2))",
        "json_catalog": f"select code, name, compname, pack, {strength('name')} as strength from {catalog_}",
        "vendor_file": f"select * from (select {numbered.format('query_id')} as query_id, code, name, case when query_id % 3 = 0 then '' else pack end as pack, case when query_id % 4 = 0 then '' else trim(compname) end as compname from {vendor_} where query_id % 17 <> 0) where query_id <= 150",
        "vendor_requests": f"select case when query_id % 2 = 0 then code else '' end as code, name, pack, compname from {vendor_}",
        "merged_parts": f"select query_id, name, cast(query_id % 101 as int) as confidence from (select *, cast(floor((row_number() over (order by query_id) - 1) / ceil((select count(*) from part) / 4.0)) + 1 as int) as part from {vendor_}) where part in (1, 2, 4) and query_id % 101 > 0",
        "cache_lookup": f"""with k as (select query_id, code, {key} as k from {vendor_}), b as (select k, query_id, 1 as seq, case when query_id % 6 <> 0 then code end as code from k union all select k, query_id, 2, case when query_id % 6 <> 2 then code end from k where query_id % 4 = 0),
            latest as (select k, code from b where k <> '' qualify row_number() over (partition by k order by seq desc, query_id desc) = 1)
            select k.query_id, l.code, i.item_id from k join latest l using (k) join {catalog_} i on i.code = l.code where i.item_id % 10 <> 3""",
        "streamed_reports": statement(flow("s", BATCH), of="select count(*) as processed, count(code) as matched, cast(0 as bigint) as remaining from smatch"),
    }
