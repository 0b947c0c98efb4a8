"""SQL of the engine's queries for an independent engine (DuckDB), built from the same fixed values."""

from __future__ import annotations

from .functions import lexicon as L
from .queries import _COMPANIES, _NAMES, _PAIRS, _SYSTEM, CATALOG, VENDOR


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_q, values))


def _r(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {_q(pattern)}, {_q(by)}, 'g')"


def _apart(c: str, letters: str = "a-z") -> str:
    return _r(_r(c, f"([{letters}])([0-9])", r"\1 \2"), f"([0-9])([{letters}])", r"\1 \2")


def _squeezed(c: str) -> str:
    return f"trim({_r(c, r'\s+', ' ')})"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def t1(c: str) -> str:
    return _squeezed(_r(_r(_apart(f"translate(lower({c}), '-/,', '   ')"), L.FORM_WORDS, ""), r"[^a-z0-9\s.]", ""))


def t2(c: str) -> str:
    return f"regexp_replace({t1(c)}, '^\\d+ ((?:[^ a-z]*[a-z]){{3}})', '\\1')"


def t2b(c: str) -> str:
    return f"trim(regexp_replace({t1(c)}, '^(?:\\d+(?: |$))+', ''))"


def t3(c: str, guarded: bool = True) -> str:
    s = _squeezed(_r(_apart(f"translate({c}, ',/-', '   ')", "a-zA-Z"), r"(\d)\.(\D|$)", r"\1\2"))
    return f"regexp_replace({s}, '^\\d{{1,3}} ((?:[^ \\p{{L}}]*\\p{{L}}){{3}})', '\\1')" if guarded else f"trim(regexp_replace({s}, '^(?:\\d{{1,3}}(?: |$))+', ''))"


def t5(c: str) -> str:
    return _squeezed(_r(_r(f"translate(lower({c}), '-/', '  ')", L.FORM_WORDS, ""), r"[^a-z0-9\s]", ""))


def _units(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: case when t in ('cc', 'grm') then 'ml' when t = 'g' then 'gm' else t end)"


def t4(c: str) -> str:
    return _units(f"regexp_extract_all({t1(c)}, '[a-z]+|[0-9.]+')")


def t6(c: str) -> str:
    return _units(f"regexp_extract_all({t5(c)}, '[a-z]+|[0-9]+')")


def strength(c: str, compound: bool = True) -> str:
    bare = f"regexp_extract({c}, '\\b\\d+(?:\\.\\d+)?\\b', 0)"
    some = [f"nullif(regexp_extract({c}, '(?i)\\b\\d+(?:\\.\\d+)?/\\d+(?:\\.\\d+)?\\s*(?:mg|ml|gm|g|mcg)?\\b', 0), '')"] * compound
    return f"coalesce({', '.join([*some, f"nullif(regexp_extract({c}, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:mg|ml|gm|g|mcg|cap|tab)\\b', 0), '')", f"case when not regexp_full_match({bare}, '0*(?:\\d|10)') then nullif({bare}, '') end", "''"])})"


def plain(n: str) -> str:
    x = f"regexp_replace({n}, '^0+(\\d)', '\\1')"
    return f"case when contains({x}, '.') then regexp_replace(regexp_replace({x}, '0+$', ''), '\\.$', '') else {x} end"


def doses(c: str, split: bool = True) -> str:
    s = f"lower({c} || ' ')"
    if split:
        s = _r(_r(s, "([0-9])([a-z])", r"\1 \2"), "([a-z])([0-9])", r"\1 \2")
    found = f"regexp_extract_all({_r(s, rf'\b\d+\s*(?:{L.COUNT_NOUNS})\b', ' ')}, '\\b\\d+(?:\\.\\d+)?\\b')"
    united = f"regexp_matches({s}, '\\b' || replace(n, '.', '\\.') || '\\s*(?:mg|ml|gm|g|mcg|iu|%)\\b')"
    return f"list_sort(list_distinct(list_transform(list_filter({found}, lambda n: ({plain('n')}) not in ('1', '2') or {united}), lambda n: {plain('n')})))"


def _pack_parts(rows: str, c: str) -> str:
    """The rows of a relation with qty and unit of its pack texts in column c."""
    s = _r(_r(f"translate(lower(trim({c})), ',', ' ')", "([0-9])([a-z])", r"\1 \2"), "([a-z])([0-9])", r"\1 \2")
    unit = "case " + " ".join(f"when regexp_matches(s, {_q(p)}) then '{u}'" for u, p in L.PACK_UNITS) + " else '' end"
    return f"""select * exclude (s, u, by_, tail, strip, plain_), case when by_ <> '' then by_ when strip is not null and u = '' then strip else plain_ end as qty,
      case when by_ <> '' and u = '' then case when tail = 'ml' then 'ml' when tail in ('gm', 'g') then 'gm' else 'tab' end when by_ = '' and u = '' and strip is not null then 'tab' else u end as unit
      from (select *, {unit} as u, regexp_extract(s, {_q(L.PACK_TIMES)}, 2) as by_, regexp_extract(s, {_q(L.PACK_TIMES)}, 3) as tail, coalesce(nullif(regexp_extract(s, {_q(L.PACK_STRIPS[0])}, 1), ''), nullif(regexp_extract(s, {_q(L.PACK_STRIPS[1])}, 1), '')) as strip,
        regexp_extract({_r('s', rf'\b({L.PACK_WORDS})\b', ' ')}, {_q(L.PACK_NUMBER)}, 1) as plain_ from (select *, {s} as s from {rows}))"""


def _pack_sql() -> str:
    return f"with p as (select 'v' || code as id, pack from ({VENDOR}) union all select 'c' || code, pack from ({CATALOG})) {_pack_parts('p', 'pack')}"


def company(c: str) -> str:
    every = _words(_squeezed(_r(f"lower(trim({c}))", r"[^a-z0-9\s]", " ")))
    own = f"list_filter({every}, lambda x: x not in ({_list(L.COMPANY_STOPWORDS)}))"
    return f"case when lower(trim({c})) in ({_list(L.NO_COMPANY)}) then '' else array_to_string(case when len({own}) > 0 then {own} else {every} end, ' ') end"


def initials(c: str) -> str:
    each = f"list_filter(regexp_extract_all({c}, '[A-Za-z]+'), lambda w: lower(w) not in ({_list(L.ACRONYM_STOPWORDS)}))"
    return f"lower(array_to_string(list_transform(flatten(list_transform({each}, lambda w: regexp_extract_all(w, '[A-Z][a-z]*|[a-z]+'))), lambda p: substr(p, 1, 1)), ''))"


def suffixes(c: str, lexicon) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({_words(_squeezed(_r(f'lower({c})', r'[^a-z0-9\s]', ' ')))}, lambda x: x in ({_list(lexicon)})))), '|')"


def form(c: str) -> str:
    s = _r(_r(f"translate(lower({c}), '-/.,()', '      ')", r"(\d+)([a-zA-Z]+)", r"\1 \2"), r"([a-zA-Z]+)(\d+)", r"\1 \2")
    phrases = " ".join(f"when contains({s}, {_q(k)}) then '{f}'" for f, keys in L.FORMS.items() for k in keys if " " in k)
    words = " ".join(f"when list_has_any(string_split({_squeezed(s)}, ' '), [{_list(k for k in keys if ' ' not in k)}]) then '{f}'" for f, keys in L.FORMS.items())
    return f"case {phrases} {words} else '' end"


def compatible(q: str, c: str) -> str:
    c = f"(case when {c} = '' then '{L.DEFAULT_FORM}' else {c} end)"
    return f"({q} = '' or {q} = {c} or (least({q}, {c}) || '|' || greatest({q}, {c})) not in ({_list('|'.join(sorted(p)) for p in L.CLASHES)}))"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence by bit-parallel steps; for texts of up to 62 characters."""
    full = f"((cast(1 as bigint) << length({a})) - 1)"
    mask = f"cast(coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = substr({b}, j, 1) then cast(1 as bigint) << (i - 1) else cast(0 as bigint) end)), 0) as bigint)"
    return f"case when length({a}) = 0 or length({b}) = 0 then 0 else length({a}) - bit_count(list_reduce(range(1, length({b}) + 1), lambda s, j: ((s + (s & {mask})) | (s - (s & {mask}))) & {full}, {full})) end"


def _prompt_sql() -> str:
    out = []
    for name, t in L.PROMPTS.items():
        user = f"{_q(t['user'])} || txt || {_q(t['user_end'])}"
        turn = f"case role when 'user' then {user} when 'assistant' then {_q(t['assistant'])} || txt || {_q(t['assistant_end'])} else '' end"
        lead = _q(_SYSTEM + t["system_end"])
        text = f"case when n = 1 and role = 'user' then {lead} else '' end || text" if name == "gemma" else "text"
        said = f"case when n = 1 then {lead} else '' end || regexp_replace(text, '\\s+$', '')" if name == "gemma" else "regexp_replace(text, '\\s+$', '')"
        head = "''" if name == "gemma" else _q(t["system"] + _SYSTEM + t["system_end"])
        out.append(f"select conv_id, '{name}' as template, {head} || coalesce(string_agg({turn}, '' order by turn) filter (turn < last), '') || {_q(t['user'])} || max(said) || {_q(t['user_end'] + t['assistant'] + t['no_thinking'])} as prompt from (select *, {text} as txt, case when turn = last then {said} end as said from h) group by conv_id")
    return "with c as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as n, max(turn) filter (role = 'user') over (partition by conv_id) as last from conversations), h as (select * from c where turn <= last) " + " union all ".join(out)


def _trim_sql() -> str:
    t = L.PROMPTS["chatml"]
    fixed = len(t["system"] + _SYSTEM + t["system_end"] + t["user"] + "[check]" + t["user_end"] + t["assistant"] + t["no_thinking"])
    most = L.N_CTX - L.MAX_TOKENS - L.RESERVE
    size = f"case role when 'user' then {len(t['user'] + t['user_end'])} + length(coalesce(text, '')) when 'assistant' then {len(t['assistant'] + t['assistant_end'])} + length(coalesce(text, '')) else 0 end"
    return f"""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, {size} as n from conversations),
    r as (select conv_id, turn, i, sum(n) over (partition by conv_id order by turn desc rows unbounded preceding) as rest from c),
    f as (select conv_id, min(i) as start from r where i % 2 = 0 and floor((rest + {fixed}) / 4.0) < {most} group by conv_id)
    select r.conv_id, r.turn from r join f on r.conv_id = f.conv_id and r.i >= f.start"""


def _ratio_sql() -> str:
    k = lambda x, n: f"case when {n} = 0 then 100.0 else 200.0 * {x} / {n} end"
    srt = lambda c: f"array_to_string(list_sort({_words(c)}), ' ')"
    setof = lambda c: f"list_distinct({_words(c)})"
    minus = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: not list_contains({y}, w))), ' ')"
    return f"""with {_PAIRS}, s as (select a, b, {srt('a')} as sa, {srt('b')} as sb, {setof('a')} as x, {setof('b')} as y from pairs),
    t as (select a, b, sa, sb, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') as c, {minus('x', 'y')} as l, {minus('y', 'x')} as r from s),
    u as (select *, {lcs('a', 'b')} as k0, {lcs('sa', 'sb')} as ks, {lcs('l', 'r')} as kd, case when c = '' then 0 else 1 end as g from t),
    v as (select *, length(c) + g + length(l) as one, length(c) + g + length(r) as two from u)
    select a, b, cast(k0 as bigint) as k0, cast(k0 as bigint) as k0_native, round_even({k('k0', '(length(a) + length(b))')}, 6) as k1, round_even({k('ks', '(length(sa) + length(sb))')}, 6) as k3,
      round_even(case when g = 1 and (l = '' or r = '') then 100.0 else greatest(100.0 - 100.0 * (length(l) + length(r) - 2 * kd) / (one + two),
        case when g = 1 then 100.0 - 100.0 * (g + length(l)) / (length(c) + one) else 0 end, case when g = 1 then 100.0 - 100.0 * (g + length(r)) / (length(c) + two) else 0 end) end, 6) as k4 from v"""


def _partial_sql() -> str:
    return f"""with {_PAIRS}, o as (select a, b, case when length(a) <= length(b) then a else b end as sh, case when length(a) <= length(b) then b else a end as lo from pairs),
    d as (select a, b, sh, lo from o union all select a, b, lo, sh from o where length(a) = length(b)),
    w as (select a, b, sh, substr(lo, greatest(st, 0) + 1, length(sh) + least(st, 0)) as pc from (select *, unnest(range(1 - length(sh), length(lo))) as st from d)),
    k as (select a, b, sh, pc, {lcs('sh', 'pc')} as n from (select distinct a, b, sh, pc from w))
    select a, b, round_even(max(200.0 * n / (length(sh) + length(pc))), 6) as k2 from k group by a, b"""


def _dice_sql() -> str:
    grams = lambda c: f"list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1) + 1), lambda i: substr({c}, i, 2)))"
    return f"with {_PAIRS}, g as (select a, b, {grams('a')} as x, {grams('b')} as y from pairs) select a, b, round_even(case when a = b then 1.0 when length(a) < 2 or length(b) < 2 then 0.0 else 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) end, 9) as k7 from g"


def _abbreviation_sql() -> str:
    s = "substr(p_name, 1, 1) || substr(translate(p_name, 'aeiou ', ''), 2, 3)"
    test = lambda x: f"(length({x}) >= 3 and substr({x}, 1, 1) = substr(p_name, 1, 1) and p_name like '%' || array_to_string(string_split({x}, ''), '%') || '%')"
    return f"with n as (select p_partkey, p_name, {s} as s from part) select p_partkey, {test('s')} as k8, {test('reverse(s)')} as k8_reversed from n"


def _alias_sql() -> str:
    values = ", ".join(f"({_q(b)}, {_q(a)})" for b, many in L.ALIASES for a in many)
    return f"""with e as (select * from (values {values}) as t(brand, alias)),
    p as (select brand as x, alias as y from e union select a.brand, b.brand from e a join e b on a.alias = b.alias)
    select x, y, x = y or exists (select 1 from e where brand = x and alias = y) or exists (select 1 from e where brand = y and alias = x) or exists (select 1 from e a join e b on a.alias = b.alias where a.brand = x and b.brand = y) as j10,
      (select count(*) from e where brand = x) as n_aliases from p"""


_ITEMS = f"items as (select item_id, norm, comp_norm, substr(split_part(norm, ' ', 1), 1, 3) as nk, substr(split_part(comp_norm, ' ', 1), 1, 3) as ck from (select item_id, {t1('name')} as norm, {t1('compname')} as comp_norm from ({CATALOG})))"
_POSTS = f"{_ITEMS}, posts as (select 'name' as idx, nk as key, item_id, norm from items where nk <> '' union all select 'company', ck, item_id, norm from items where ck <> ''), keys as (select idx, key, count(*) as n_items, min(item_id) as first_item from posts group by idx, key)"
_PROBES = f"q as (select distinct norm from (select {t1('name')} as norm from ({VENDOR})) where norm <> ''), w as (select distinct norm, substr(word, 1, 3) as probe from (select norm, unnest(string_split(norm, ' ')) as word from q) where not regexp_full_match(word, '\\d+\\.?\\d*')), probes as (select distinct probe from w)"
_FOUND = f"""pk as (select probe, idx, key, first_item, {lcs('probe', 'key')} as k from probes, keys),
like_ as (select probe, idx, key, row_number() over (partition by probe, idx order by 200.0 * k / (length(probe) + length(key)) desc, first_item) as n from pk where 200 * k >= 60 * (length(probe) + length(key))),
found as (select probe, idx, key from like_ where n <= 40 union select probe, idx, key from pk where probe = key union select probe, idx, key from pk where length(probe) < 3 and starts_with(key, probe))"""


def dice(a: str, b: str) -> str:
    grams = lambda c, i: f"list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1) + 1), lambda {i}: substr({c}, {i}, 2)))"
    x, y = grams(a, "i"), grams(b, "j")
    return f"(case when {a} = {b} then 1.0 when length({a}) < 2 or length({b}) < 2 then 0.0 else 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) end)"


def _browser_sql(top: int) -> str:
    """The browser's search: its hits up to a rank."""
    hit = "list_filter(it, lambda x: starts_with(x, t))[1]"
    kind = f"list_transform(qt, lambda t: case when {hit} = t then 'e' when {hit} is not null then 'p' when length(t) >= 3 and len(list_filter(it, lambda x: length(x) >= 3 and {dice('t', 'x')} >= 0.7)) > 0 then 'l' else 'n' end)"
    count = lambda k: f"len(list_filter(k, lambda x: x = '{k}'))"
    qp, ip = t5("v.pack"), t5("c.pack")
    return f"""with v as (select query_id, name, pack, compname, {t6('name')} as qt from ({VENDOR}) where length(trim(name)) >= 2),
    c as (select item_id, code, name, compname, pack, {strength('name')} as strength, {t6('name')} as it from ({CATALOG})),
    u as (select distinct qt, it from v join c on contains(lower(c.name), qt[1]) or contains(lower(c.compname), qt[1])),
    f as (select qt, it, {kind} as k, coalesce(list_position(list_transform(range(1, least(len(qt), len(it)) + 1), lambda i: qt[i] <> it[i]), true) - 1, least(len(qt), len(it))) as front from u),
    g as (select qt, it, {count('e')} as e, {count('p')} as p, {count('l')} as l, front from f),
    h as (select v.query_id, v.name as q_name, v.pack as q_pack, v.compname as q_comp, c.item_id, c.code, c.name, c.compname, c.pack, c.strength, round_even(e + p + l * 0.8, 1) as matched, front,
      ((e + p + l * 0.8::double) / len(v.qt) * 60 + e / len(v.qt) * 20 + front * 20) * 0.75 + (case when v.pack = '' or c.pack = '' then 50 when {qp} = {ip} then 100 when contains({ip}, {qp}) or contains({qp}, {ip}) then 80 else 50 end) * 0.25 as score
      from v join c on contains(lower(c.name), v.qt[1]) or contains(lower(c.compname), v.qt[1]) join g on g.qt = v.qt and g.it = c.it),
    r as (select *, row_number() over (partition by query_id order by matched desc, front desc, score desc, item_id) as rank from h where score >= 35),
    hits as (select * from r where rank <= {top})"""


def _browser_match_sql() -> str:
    both = "trim(q_name || ' ' || q_pack)"
    flat = lambda c: f"replace({c}, ' ', '')"
    doses = lambda c: f"list_filter({c}, lambda n: length(n) > 1 or n not in ({_list(L.BROWSER_COUNTS)}))"
    sides = f"""{_browser_sql(1)}, a as (select query_id, item_id, code, name as c_name, compname as c_comp, pack as c_pack, strength as c_strength, q_comp, lower({both}) as ql, lower(name) as cl, {t5('name')} as cn, {t5('compname')} as cb,
      split_part({t5(both)}, ' ', 1) as v, split_part({t5('q_name')}, ' ', 1) as h, regexp_extract_all({t5('q_name')}, '\\d+') as qn, regexp_extract_all(name || ' ' || strength, '\\d+') as n_, {company('q_comp')} as qc, {company('compname')} as cc from hits),
    b as (select *, {flat('cn')} as cnf, {flat('cb')} as cbf, {doses('qn')} as qd, {doses('n_')} as cd from a)"""
    brand = f"(contains(cn, v) or contains(cb, v) or contains(cnf, v) or contains(cbf, v) or contains(v, cnf) or contains(v, cbf) or {dice('v', 'cn')} >= 0.75)"
    exact = f"(h = cnf or h = cbf or contains(cnf, h) or contains(cbf, h) or {dice('h', 'cn')} >= 0.78)"
    form_ok = "not (contains(ql, 'inj') and contains(cl, 'tab')) and not (contains(ql, 'tab') and contains(cl, 'inj'))"
    comp = f"(trim(q_comp) = '' or c_comp = '' or qc = '' or cc = '' or qc = cc or len(list_filter(list_intersect(string_split(qc, ' '), string_split(cc, ' ')), lambda w: length(w) >= 3)) > 0 or {dice('qc', 'cc')} >= 0.75 or length(qc) >= 4 and length(cc) >= 4 and (contains(qc, cc) or contains(cc, qc)))"
    nums = "case when len(qn) = 0 then len(list_filter(n_, lambda n: length(n) > 1)) = 0 when len(qd) > 0 then len(list_filter(qd, lambda n: not list_contains(cd, n))) = 0 else len(cd) = 0 end"
    ok = f"{brand} and (len(qn) = 0 or list_has_any(qd, n_)) and {form_ok} and {comp} and {exact} and {nums}"
    return f"""{sides}, m as (select * from b where {ok})
    select q.query_id, m.item_id, m.code, m.c_name as m_name, m.c_comp as m_comp, m.c_pack as m_pack, m.c_strength as m_strength, cast(null as double) as score, case when m.code is null then 'No Match' else 'Browser' end as method from ({VENDOR}) q left join m on q.query_id = m.query_id"""


def oracle_sql() -> dict[str, str]:
    from . import oracle_match

    names = f"with {_NAMES} "
    return oracle_match.oracle_sql() | {
        "text_normalisers": names + f"select id, {t1('t')} as t1, {t2('t')} as t2, {t2b('t')} as t2b, {t3('t')} as t3, {t3('t', False)} as t3b, {t5('t')} as t5 from names",
        "text_tokenisers": names + f"select id, array_to_string({t4('t')}, '|') as t4, array_to_string({t6('t')}, '|') as t6 from names",
        "strength_extraction": names + f"select id, {strength('t')} as str1, {strength('t', False)} as str1b from names",
        "dose_numbers": names + f"select id, array_to_string(n, '|') as str3, array_to_string({doses('t')}, '|') as str4, regexp_matches(t, '(?i)' || replace(n[-1], '.', '\\.') || '\\s*(?:mg|mcg|ml|gm|g|iu|units?)\\b') as str2 from (select id, t, regexp_extract_all(t, '\\d+\\.?\\d*') as n from names)",
        "pack_parser": _pack_sql(),
        "companies": f"select id, {company('a')} as clean, {initials('a')} as initials, regexp_full_match(lower(trim(b)), '\\p{{L}}{{2,6}}') and {initials('a')} <> '' and contains({initials('a')}, lower(trim(b))) as acronym from ({_COMPANIES})",
        "suffix_sets": names + f"select id, {suffixes('t', L.SUFFIXES)} as suf1, {suffixes('t', L.OLD_SUFFIXES)} as suf1b from names",
        "forms": f"with p as (select query_id, v.name || ' ' || v.pack as q, c.name || ' ' || c.pack as c from ({VENDOR}) v join ({CATALOG}) c on v.query_id = c.item_id), f as (select query_id, {form('q')} as q_form, {form('c')} as c_form from p) select query_id, q_form, c_form, {compatible('q_form', 'c_form')} as compatible from f",
        "answers": "select event_id, case when k between 1 and 50 then k end as number from (select event_id, cast(regexp_extract(props, '\"k\": (\\d+)', 1) as bigint) as k from events)",
        "chat_prompts": _prompt_sql(),
        "history_trimming": _trim_sql(),
        "answer_pieces": "select conv_id, turn, n, substr(text, 4 * n + 1, 4) as piece from (select conv_id, turn, text, unnest(range(0, cast(ceil(length(text) / 4.0) as bigint))) as n from conversations)",
        "similarity_ratios": _ratio_sql(),
        "partial_ratios": _partial_sql(),
        "letter_pairs": _dice_sql(),
        "abbreviations": _abbreviation_sql(),
        "alias_relation": _alias_sql(),
        "catalog_cleaning": f"with r as (select trim(p_name || ' ' || cast(p_size as string) || 'mg') as name, p_brand as compname from part where p_size > 3) select name, compname, '' as pack, {strength('name')} as strength, count(*) as n from r group by all",
        "range_split": "select p_partkey, cast(floor((row_number() over (order by p_partkey) - 1) / ceil((select count(*) from part) / 7.0)) + 1 as bigint) as part from part",
        "prefix_index": f"with {_POSTS} select idx, key, n_items, first_item from keys",
        "like_keys": f"with {_POSTS}, {_PROBES}, {_FOUND} select probe, idx, key from found",
        "candidate_counts": f"with {_POSTS}, {_PROBES}, {_FOUND}, m as (select distinct w.norm, posts.item_id from w join found on w.probe = found.probe join posts on posts.idx = found.idx and posts.key = found.key) select norm, count(*) as n_items, min(item_id) as first_item from m group by norm",
        "browser_search": _browser_sql(15) + " select query_id, rank, item_id, code, name, compname, pack, strength, round_even(score, 6) as score, matched, front from hits",
        "match_browser": _browser_match_sql(),
        "timing_stats": """select count(*) as n_total, count(l) as n_llm, round_even(count(l) / greatest(1, count(*)), 3) as llm_fraction, round_even(sum(value) / greatest(1, count(*)), 2) as avg_search_ms, round_even(max(value), 2) as max_search_ms,
            round_even(sum(value / 10) / greatest(1, count(*)), 2) as avg_heur_ms, round_even(sum(l) / greatest(1, count(l)), 2) as avg_llm_ms, round_even(max(l), 2) as max_llm_ms from (select value, case when event_type = 'error' then value * 100 end as l from events)""",
        "most_in_flight": "with m as (select epoch_us(ts) as t, 1 as d from events union all select epoch_us(ts) + cast(floor(value * 60000000) as bigint), -1 from events) select cast(max(n) as bigint) as most_in_flight from (select sum(d) over (order by t, d rows unbounded preceding) as n from m)",
        "progress_steps": """with s as (select cast(floor((epoch_us(ts) - min(epoch_us(ts)) over ()) / 1e6 / 86400) as bigint) + 1 as step, event_type <> 'error' as m from events), g as (select step, count(*) as n, count(*) filter (m) as m from s group by step),
            r as (select step, cast(sum(n) over (order by step) as bigint) as processed, cast(sum(m) over (order by step) as bigint) as matched from g)
            select step * 86400 as elapsed_s, processed, matched, round_even(processed / (step * 86400), 3) as rate, round_even((1000000 - processed) / (processed / (step * 86400)), 1) as eta_s from r""",
    }
