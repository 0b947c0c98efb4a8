"""Accept and reject rules as predicate columns over (query, candidate) rows.

Rows have query, q_name, q_comp and of the candidate c_name, c_comp, c_pack,
c_strength; nulls count as empty. A Profile says which variant of each rule
holds. Rules that need similarity of strings share a few calls per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.similarity import best_ratio, dice, partial_ratio, partial_ratio_of, ratio, ratio_of, token_sort_ratio


@dataclass(frozen=True)
class Profile:
    """Variants of the rules; the defaults are the current ones."""

    name: str = "current"
    guarded: bool = True  # a leading number goes only before a word of three letters
    compound_brand: bool = True  # "36 D" is one brand
    unit_guard: bool = True  # a short first word stays the brand before a unit or number
    suffixes: tuple[str, ...] | None = tuple(L.SUFFIXES)
    strength: str = "subset"  # or intersect, or first_hit
    acronym: bool = True
    empty_name_matches: bool = False  # a candidate name without words is part of every brand
    compound_strength: bool = True


CURRENT = Profile()
OLD = Profile("old", False, False, True, tuple(L.OLD_SUFFIXES), "intersect", False, False, False)
HYBRID = Profile("hybrid", False, False, False, None, "first_hit", True, True, False)
PROFILES = {p.name: p for p in (CURRENT, OLD, HYBRID)}


# --- forms and companies ---


def forms_compatible(query, candidate) -> Column:
    """FO2: a query without a form goes with all; a candidate without one counts as solid; else equal or not clashing."""
    q, c = T.form(query), T.form(candidate)
    c = F.when(c == "", L.DEFAULT_FORM).otherwise(c)
    pair = F.concat_ws("|", F.least(q, c), F.greatest(q, c))
    return (q == "") | (q == c) | ~pair.isin(["|".join(sorted(p)) for p in L.CLASHES])


def companies_compatible(query, candidate, acronym: bool = True) -> Column:
    """CO2, and CO2b without acronyms: one missing, equal, a shared word, initials, or like spelling."""
    q, c = T.company(query), T.company(candidate)
    shared = F.exists(F.array_intersect(T.words(q), T.words(c)), lambda w: F.length(w) >= 3)
    out = (q == "") | (c == "") | (q == c) | shared
    if acronym:
        out = out | T.is_acronym(query, candidate) | T.is_acronym(candidate, query)
    return out | (ratio(q, c) >= 75) | ((F.length(q) >= 4) & (F.length(c) >= 4) & (partial_ratio(q, c) >= 85))


def browser_companies_compatible(query, candidate) -> Column:
    """CO2c: like CO2 with letter pairs in place of spelling, all native."""
    q, c = T.company(query), T.company(candidate)
    shared = F.exists(F.array_intersect(T.words(q), T.words(c)), lambda w: F.length(w) >= 3)
    within = (F.length(q) >= 4) & (F.length(c) >= 4) & (F.contains(q, c) | F.contains(c, q))
    return (q == "") | (c == "") | (q == c) | shared | (dice(q, c) >= 0.75) | within


def _company_rule(query, candidate, compatible) -> Column:
    asked = F.trim(T._text(query))
    return asked.isin(L.SKIP_COMPANY) | (T._text(candidate) == "") | compatible(query, candidate)


# --- brand aliases ---


def aliases(spark) -> DataFrame:
    """Edges (brand, alias) of the fixed relation."""
    return spark.createDataFrame([(b, a) for b, many in L.ALIASES for a in many], "brand string, alias string")


def brand_aliases(brand) -> Column:
    """What a brand may also be called; empty if it is unknown."""
    table = F.create_map(*[x for b, many in L.ALIASES for x in (F.lit(b), T.any_of(many))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(T._text(brand)))), F.array().cast("array<string>"))


def brands_equivalent(one, two) -> Column:
    """Equal, one an alias of the other, or with an alias in common."""
    a, b = F.lower(F.trim(T._text(one))), F.lower(F.trim(T._text(two)))
    x, y = brand_aliases(a), brand_aliases(b)
    return (a == b) | F.array_contains(x, b) | F.array_contains(y, a) | F.arrays_overlap(x, y)


# --- validation and heuristic match ---


@pandas_udf(BooleanType())
def similar_to_any(brand: pd.Series, others: pd.Series) -> pd.Series:
    """Equal, a ratio of 78, or for five letters and more a partial ratio of 90, to any of several."""
    known: dict = {}

    def one(a: str, b: str) -> bool:
        if (a, b) not in known:
            known[a, b] = a == b or ratio_of(a, b) >= 78 or len(a) >= 5 and len(b) >= 5 and partial_ratio_of(a, b) >= 90
        return known[a, b]

    return pd.Series([any(one(a, b) for b in bs if b is not None) for a, bs in zip(brand, others)])


def _norm(c, p: Profile) -> Column:
    return T.match_form(c) if p.guarded else T.old_match_form(c)


def _at(words: Column, i: int) -> Column:
    return F.coalesce(F.get(words, F.lit(i)), F.lit(""))


def _letters(w: Column) -> Column:
    return F.length(F.regexp_replace(w, r"\P{L}", ""))


def _brand_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"^\d+$") & ~w.isin(L.UNIT_SUFFIXES))


def _flat(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, 2), "")


def _doses(numbers: Column, raw: Column) -> Column:
    """Numbers that are strengths: no bare pack counts."""
    return F.filter(numbers, lambda n: ~n.isin(L.PACK_COUNTS) | T.has_unit(raw, n))


def judged(rows: DataFrame, p: Profile = CURRENT, strict: bool = False) -> DataFrame:
    """rows with valid (VAL1), similar_brand, doses_match, form_match, accepted (H1) and score (SC10).

    strict: the higher thresholds that guard a reranker's choice.
    """
    names = rows.columns
    blank = lambda c: T._text(c)
    q_text = F.when(blank("q_name") != "", blank("q_name")).otherwise(blank("query"))
    c_form, c_full = F.concat_ws(" ", blank("c_name"), blank("c_pack")), F.concat_ws(" ", blank("c_name"), blank("c_strength"))
    rows = rows.withColumns({"_q": _norm("query", p), "_cn": _norm("c_name", p), "_cb": _norm("c_comp", p), "_qt": q_text, "_cf": c_full})
    rows = rows.withColumns({"_qw": T.words(F.col("_q")), "_cnw": T.words(F.col("_cn")), "_cbw": T.words(F.col("_cb")), "_qraw": T.raw_query("_qt", p.guarded)})
    rows = rows.withColumns({"_qn": T.numbers("_qraw"), "_cnum": T.numbers("_cf"), "_form": forms_compatible("query", c_form)})
    rows = rows.withColumns({"_qd": _doses(F.col("_qn"), F.col("_qt")), "_cd": _doses(F.col("_cnum"), F.col("_cf"))})

    # the brand that validation looks for
    w0, w1 = _at(F.col("_qw"), 0), _at(F.col("_qw"), 1)
    short = (F.length(w0) <= 2) & (w1 != "")
    if p.unit_guard:
        short = short & ~(w1.rlike(r"^\d") | w1.isin(L.UNIT_AND_FORM))
    brand = F.when(short, w1).otherwise(w0)
    if p.compound_brand:
        number = w0.rlike(r"^\d+$") & (w1 != "")
        brand = F.when(number & (_letters(w1) <= 2) & ~w1.isin(L.UNIT_AND_FORM), F.concat(w0, w1)).when(number & (_letters(w1) >= 3), w1).when(number, w0).otherwise(brand)
    flat = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    rows = rows.withColumns({"_b": brand, "_cnf": flat("_cn"), "_cbf": flat("_cb")})
    b, cn, cb, cnf, cbf = (F.col(x) for x in ("_b", "_cn", "_cb", "_cnf", "_cbf"))
    least, cutoff = (4, 88) if strict else (1, 85)
    long = F.length(b) >= least
    inside = F.contains(cn, b) | F.contains(cb, b) | F.contains(cnf, b) | ((cbf != "") & (F.contains(cbf, b) | F.contains(b, cbf)))
    around = F.contains(b, cnf) & (F.length(cnf) >= (0 if p.empty_name_matches else least))
    first_known = lambda ws: _at(F.col(ws), 0).rlike(r"^\p{L}{2,}$") & F.array_contains(F.col("_qw"), _at(F.col(ws), 0))
    named = first_known("_cnw") | first_known("_cbw")
    brand_ok = T.is_abbreviation(b, cn) | T.is_abbreviation(b, cb) | (long & inside) | around | named | (best_ratio(b, F.concat("_cnw", "_cbw")) >= cutoff)
    if strict:
        brand_ok = brand_ok | ((F.length(w0) >= 3) & F.contains(cn, w0))

    suffix_ok = F.lit(True) if p.suffixes is None else T.suffixes("_qt", list(p.suffixes)) == T.suffixes("c_name", list(p.suffixes))
    if p.strength == "first_hit":
        strength_ok = (F.size("_qd") == 0) | F.arrays_overlap("_qd", "_cnum")
    else:
        q_n = T.dose_numbers("_qt", split=p.strength == "subset")
        c_n = T.dose_numbers("c_name", F.concat_ws(" ", blank("c_strength"), blank("c_pack")), split=p.strength == "subset")
        fit = F.size(F.array_except(q_n, c_n)) == 0 if p.strength == "subset" else F.arrays_overlap(q_n, c_n)
        strength_ok = (F.size(q_n) == 0) | (F.size(c_n) == 0) | fit
    company_ok = _company_rule("q_comp", "c_comp", lambda x, y: companies_compatible(x, y, p.acronym))
    valid = (F.size("_qw") > 0) & brand_ok & suffix_ok & strength_ok & F.col("_form") & company_ok

    # the brands that the heuristic compares
    rows = rows.withColumns({"_qbw": _brand_words(F.col("_qw")), "_cbn": _brand_words(F.col("_cnw")), "_cbb": _brand_words(F.col("_cbw"))})
    rows = rows.withColumns({"_qf": _flat(F.col("_qbw")), "_cnflat": _flat(F.col("_cbn")), "_cbflat": _flat(F.col("_cbb"))})
    c0, c1 = _at(F.col("_cnw"), 0), _at(F.col("_cnw"), 1)
    fused = F.when(c0.rlike(r"^\d+$") & c1.rlike(r"^\p{L}{1,2}$"), F.concat(c0, c1)) if p.compound_brand else F.lit(None).cast("string")
    head = F.get("_cbb", F.lit(0))
    others = F.array(F.col("_cnflat"), F.get("_cbn", F.lit(0)), fused, F.when(F.length("_cbflat") >= 3, F.col("_cbflat")), F.when((F.length("_cbflat") >= 3) & (F.length(head) >= 3), head))
    similar = ((F.size("_cnw") > 0) & similar_to_any(F.col("_qf"), F.when(F.size("_cnw") > 0, others).otherwise(F.array().cast("array<string>")))) | named
    doses = F.when(F.size("_qd") > 0, F.arrays_overlap("_qd", "_cnum")).otherwise(F.size("_cd") == 0)
    score = best_ratio(F.col("_qf"), F.filter(F.array(F.col("_cnflat"), F.get("_cbn", F.lit(0))), lambda x: x.isNotNull()))
    asked = F.trim(blank("q_comp"))
    qc = _norm("q_comp", p)
    unlike = ~asked.isin("", "--") & (qc != "") & (cb != "") & (partial_ratio(qc, cb) < 30)
    score = F.when(unlike, F.greatest(F.lit(0.0), score - 20)).otherwise(score)
    out = rows.withColumns({"valid": valid, "similar_brand": (F.size("_qw") > 0) & similar, "doses_match": doses, "form_match": F.col("_form"), "score": score})
    out = out.withColumn("accepted", F.col("similar_brand") & F.col("doses_match") & F.col("form_match") & F.col("valid"))
    return out.select(*names, "valid", "similar_brand", "doses_match", "form_match", "accepted", "score")


def first_accepted(rows: DataFrame) -> DataFrame:
    """H1: of judged() rows the accepted one of least rank for each query_id."""
    # no filter on the rules: it would be pushed below them with all their inputs repeated
    first = F.min(F.when(F.col("accepted"), F.col("rank"))).over(W.partitionBy("query_id"))
    return rows.withColumn("_first", first).filter(F.col("rank") == F.col("_first")).drop("_first")


# --- the browser's rules, all native ---


def browser_judged(rows: DataFrame) -> DataFrame:
    """rows (with q_name, q_pack, q_comp) with valid (VAL1d) and accepted."""
    names = rows.columns
    both = F.trim(F.concat_ws(" ", T._text("q_name"), T._text("q_pack")))
    rows = rows.withColumns({"_cn": T.browser_form("c_name"), "_cb": T.browser_form("c_comp"), "_vb": F.substring_index(T.browser_form(both), " ", 1), "_hb": F.substring_index(T.browser_form("q_name"), " ", 1)})
    flat = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    cn, cb, cnf, cbf, v, h = F.col("_cn"), F.col("_cb"), flat("_cn"), flat("_cb"), F.col("_vb"), F.col("_hb")
    brand_ok = F.contains(cn, v) | F.contains(cb, v) | F.contains(cnf, v) | F.contains(cbf, v) | F.contains(v, cnf) | F.contains(v, cbf) | (dice(v, cn) >= 0.75)
    whole = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    rows = rows.withColumns({"_qn": whole(T.browser_form("q_name")), "_cnum": whole(F.concat_ws(" ", T._text("c_name"), T._text("c_strength")))})
    doses = lambda c: F.filter(F.col(c), lambda n: (F.length(n) > 1) | ~n.isin(L.BROWSER_COUNTS))
    strength_ok = (F.size("_qn") == 0) | F.arrays_overlap(doses("_qn"), F.col("_cnum"))
    q, c = F.lower(both), F.lower(T._text("c_name"))
    form_ok = ~(F.contains(q, F.lit("inj")) & F.contains(c, F.lit("tab"))) & ~(F.contains(q, F.lit("tab")) & F.contains(c, F.lit("inj")))
    company_ok = (F.trim(T._text("q_comp")) == "") | (T._text("c_comp") == "") | browser_companies_compatible("q_comp", "c_comp")
    exact = (h == cnf) | (h == cbf) | F.contains(cnf, h) | F.contains(cbf, h) | (dice(h, cn) >= 0.78)
    nums = F.when(F.size("_qn") == 0, F.size(F.filter("_cnum", lambda n: F.length(n) > 1)) == 0).when(F.size(doses("_qn")) > 0, F.size(F.array_except(doses("_qn"), doses("_cnum"))) == 0).otherwise(F.size(doses("_cnum")) == 0)
    out = rows.withColumn("valid", brand_ok & strength_ok & form_ok & company_ok).withColumn("accepted", exact & nums & form_ok & F.col("valid"))
    return out.select(*names, "valid", "accepted")


# --- confidence and labels ---


def confidence(q_name, m_name) -> Column:
    """SC6: 0 to 100 from brand words, whole names and strengths; 0 without a match."""
    q, m = F.lower(F.trim(T._text(q_name))), F.lower(F.trim(T._text(m_name)))
    plain = lambda c: T.words(T.squeezed(F.regexp_replace(c, r"(?U)[^a-z0-9\s]", "")))
    qw = plain(q)
    first = _at(qw, 0)
    brand = F.when((F.length(first) <= 2) & (F.size(qw) > 1), _at(qw, 1)).otherwise(first)
    doses = lambda c: F.filter(F.array_distinct(T.numbers(c)), lambda n: ~n.isin(L.PACK_COUNTS))
    a, b = doses(q), doses(m)
    bonus = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.arrays_overlap(a, b), 10).otherwise(-15)
    score = ratio(brand, _at(plain(m), 0)) * 0.5 + token_sort_ratio(q, m) * 0.4 + bonus
    return F.when(T._text(m_name) == "", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0).cast("int"))))


# fixed values: labels of the report
STATUS = [(90, "✅ High Confidence"), (75, "🔶 Medium - Review"), (60, "⚠️ Low - Check")]
LOWEST, NOTHING = "❌ Very Low - Likely Wrong", "— No Match Found"


def status(score: Column) -> Column:
    """SC7."""
    return F.coalesce(*[F.when(score >= s, label) for s, label in STATUS], F.lit(LOWEST))


def company_status(q_comp, m_comp) -> Column:
    """SC8."""
    q, m = T._text(q_comp), T._text(m_comp)
    like = partial_ratio(F.lower(q), F.lower(m))
    return F.when(F.trim(q).isin("", "--"), "—").when(m == "", "— No Master Co.").when(like >= 60, "✅ Match").when(like >= 35, "⚠️ Partial").otherwise("❌ Mismatch")
