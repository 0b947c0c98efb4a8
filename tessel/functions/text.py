"""Text functions over columns: normalisers, tokenisers, strengths, packs, companies, forms.

All are built from Spark's own functions, so they stay inside code generation.
A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _r(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def squeezed(c: Column) -> Column:
    return F.trim(_r(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words of a squeezed text; none of an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def any_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def apart(c: Column, letters: str = "a-z") -> Column:
    """Letters and digits that touch, set apart."""
    return _r(_r(c, f"([{letters}])([0-9])", "$1 $2"), f"([0-9])([{letters}])", "$1 $2")


# --- normalisers ---


def search_form(c) -> Column:
    """Lower case, separators to spaces, letters apart from digits, without dosage-form words."""
    c = apart(F.translate(F.lower(_text(c)), "-/,", "   "))
    return squeezed(_r(_r(c, L.FORM_WORDS, ""), r"(?U)[^a-z0-9\s.]", ""))


def match_form(c) -> Column:
    """search_form without a leading number that a word of three letters or more follows."""
    return _r(search_form(c), r"^\d+ ((?:[^ a-z]*[a-z]){3})", "$1")


def old_match_form(c) -> Column:
    """search_form without any leading numbers."""
    return F.trim(_r(search_form(c), r"^(?:\d+(?: |$))+", ""))


def raw_query(c, guarded: bool = True) -> Column:
    """T3, and T3b unguarded: case kept, separators to spaces, no dot after a number's end, no leading vendor code of up to three digits."""
    c = apart(F.translate(_text(c), ",/-", "   "), "a-zA-Z")
    c = squeezed(_r(c, r"(\d)\.(?!\d)", "$1"))
    if guarded:
        return _r(c, r"^\d{1,3} ((?:[^ \p{L}]*\p{L}){3})", "$1")
    return F.trim(_r(c, r"^(?:\d{1,3}(?: |$))+", ""))


def browser_form(c) -> Column:
    """T5: like search_form, but commas and dots are deleted and letters stay with digits."""
    c = _r(F.translate(F.lower(_text(c)), "-/", "  "), L.FORM_WORDS, "")
    return squeezed(_r(c, r"(?U)[^a-z0-9\s]", ""))


# --- tokenisers ---


def _units(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.isin("cc", "grm"), "ml").when(t == "g", "gm").otherwise(t))


def tokens(c) -> Column:
    """T4: runs of letters or of digits and dots of search_form, units under one name."""
    return _units(F.regexp_extract_all(search_form(c), F.lit("([a-z]+|[0-9.]+)"), 1))


def browser_tokens(c) -> Column:
    """The same of browser_form."""
    return _units(F.regexp_extract_all(browser_form(c), F.lit("([a-z]+|[0-9]+)"), 1))


# --- numbers ---


def _first(c: Column, pattern: str) -> Column:
    got = F.regexp_extract(c, pattern, 0)
    return F.when(got != "", got)


def strength(c, compound: bool = True) -> Column:
    """STR1, and STR1b without compounds: the first dose as written; a bare whole number up to 10 is none."""
    c = _text(c)
    bare = _first(c, r"\b\d+(?:\.\d+)?\b")
    bare = F.when(~F.regexp_like(bare, F.lit(r"^0*(?:\d|10)$")), bare)
    dose = _first(c, r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|ml|gm|g|mcg|cap|tab)\b")
    both = _first(c, r"(?i)\b\d+(?:\.\d+)?/\d+(?:\.\d+)?\s*(?:mg|ml|gm|g|mcg)?\b")
    return F.coalesce(*([both] if compound else []), dose, bare, F.lit(""))


def numbers(c) -> Column:
    """STR3: all numbers as written."""
    return F.regexp_extract_all(_text(c), F.lit(r"(\d+\.?\d*)"), 1)


def has_unit(c, number: Column) -> Column:
    """STR2: whether the text has this number before a unit."""
    pattern = F.concat(F.lit("(?i)"), F.replace(number, F.lit("."), F.lit("\\.")), F.lit(r"\s*(?:mg|mcg|ml|gm|g|iu|units?)\b"))
    return F.regexp_like(_text(c), pattern)


def plain_number(n: Column) -> Column:
    """A number without leading zeros, and without trailing ones after its point."""
    n = _r(n, r"^0+(\d)", "$1")
    return F.when(F.instr(n, ".") > 0, _r(_r(n, "0+$", ""), r"\.$", "")).otherwise(n)


def dose_numbers(c, more=None, split: bool = True) -> Column:
    """STR4: the distinct numbers that are no pack counts; 1 and 2 only with a unit."""
    c = F.lower(F.concat(_text(c), F.lit(" "), _text(more) if more is not None else F.lit("")))
    c = _r(_r(c, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2") if split else c
    found = F.regexp_extract_all(_r(c, rf"\b\d+\s*(?:{L.COUNT_NOUNS})\b", " "), F.lit(r"(\b\d+(?:\.\d+)?\b)"), 1)
    united = lambda n: F.regexp_like(c, F.concat(F.lit(r"\b"), F.replace(n, F.lit("."), F.lit("\\.")), F.lit(r"\s*(?:mg|ml|gm|g|mcg|iu|%)\b")))
    kept = F.filter(found, lambda n: ~plain_number(n).isin("1", "2") | united(n))
    return F.array_distinct(F.transform(kept, plain_number))


# --- packs ---


def pack(c) -> Column:
    """PK1: struct of quantity and unit of a pack text."""
    c = F.translate(F.lower(F.trim(_text(c))), ",", " ")
    c = _r(_r(c, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")
    unit = F.coalesce(*[F.when(F.regexp_like(c, F.lit(p)), u) for u, p in L.PACK_UNITS], F.lit(""))
    by = F.regexp_extract(c, L.PACK_TIMES, 2)
    tail = F.regexp_extract(c, L.PACK_TIMES, 3)
    strip = F.coalesce(*[F.when(x != "", x) for x in [F.regexp_extract(c, p, 1) for p in L.PACK_STRIPS]])
    plain = F.regexp_extract(_r(c, rf"\b({L.PACK_WORDS})\b", " "), L.PACK_NUMBER, 1)
    of_strip = strip.isNotNull() & (unit == "")
    qty = F.when(by != "", by).when(of_strip, strip).otherwise(plain)
    unit = F.when((by != "") & (unit == ""), F.when(tail == "ml", "ml").when(tail.isin("gm", "g"), "gm").otherwise("tab")).when((by == "") & of_strip, "tab").otherwise(unit)
    return F.struct(qty.alias("qty"), unit.alias("unit"))


# --- companies, suffixes, forms ---


def company(c) -> Column:
    """CO1: a company's name without punctuation and business words, unless nothing else is left."""
    c = F.lower(F.trim(_text(c)))
    every = words(squeezed(_r(c, r"(?U)[^a-z0-9\s]", " ")))
    own = F.filter(every, lambda w: ~F.array_contains(any_of(L.COMPANY_STOPWORDS), w))
    return F.when(c.isin(L.NO_COMPANY), "").otherwise(F.array_join(F.when(F.size(own) > 0, own).otherwise(every), " "))


def initials(c) -> Column:
    """First letters of a company's words, those inside camel case too, without business words."""
    each = F.filter(F.regexp_extract_all(_text(c), F.lit("([A-Za-z]+)"), 1), lambda w: ~F.array_contains(any_of(L.ACRONYM_STOPWORDS), F.lower(w)))
    parts = F.flatten(F.transform(each, lambda w: F.regexp_extract_all(w, F.lit("([A-Z][a-z]*|[a-z]+|[A-Z]+(?![a-z]))"), 1)))
    return F.lower(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def is_acronym(short, full) -> Column:
    """K9: two to six letters that are or are within the other name's initials."""
    s, i = F.lower(F.trim(_text(short))), initials(full)
    return F.regexp_like(s, F.lit(r"^\p{L}{2,6}$")) & (i != "") & F.contains(i, s)


def is_abbreviation(short, full) -> Column:
    """K8: three letters or more, the same first one, and the rest in the same order inside the other."""
    s, f = F.lower(F.trim(_text(short))), F.lower(F.trim(_text(full)))
    found = F.aggregate(F.split(s, ""), F.lit(1), lambda at, ch: F.when(at == 0, F.lit(0)).otherwise(_after(f, ch, at)))
    return (F.length(s) >= 3) & (f != "") & (F.substring(s, 1, 1) == F.substring(f, 1, 1)) & (found > 0)


def _after(text: Column, ch: Column, at: Column) -> Column:
    """One past the place of ch in text from `at` on, or 0."""
    place = F.call_function("locate", ch, text, at)
    return F.when(ch == "", at).when(place > 0, place + 1).otherwise(F.lit(0))


def suffixes(c, lexicon: list[str] = L.SUFFIXES) -> Column:
    """SUF1: the sorted suffix words of a name."""
    each = words(squeezed(_r(F.lower(_text(c)), r"(?U)[^a-z0-9\s]", " ")))
    return F.array_sort(F.array_intersect(each, any_of(lexicon)))


def form(c) -> Column:
    """FO1: the dosage form that a text names, or empty: phrases first, then words, forms in their order."""
    c = F.translate(F.lower(_text(c)), "-/.,()", "      ")
    c = _r(_r(c, r"(\d+)([a-zA-Z]+)", "$1 $2"), r"([a-zA-Z]+)(\d+)", "$1 $2")
    each = words(squeezed(c))
    phrases = [(f, k) for f, keys in L.FORMS.items() for k in keys if " " in k]
    by_phrase = [F.when(F.contains(c, F.lit(k)), f) for f, k in phrases]
    by_word = [F.when(F.arrays_overlap(each, any_of([k for k in keys if " " not in k])), f) for f, keys in L.FORMS.items()]
    return F.coalesce(*by_phrase, *by_word, F.lit(""))


def without_thoughts(c) -> Column:
    """EN1: an answer without its thinking block."""
    return _r(_r(_text(c), r"(?s)<think>.*?</think>\s*", ""), r"^\n+", "")


def query_text(name, pack_=None, given=None) -> Column:
    """PF8: the query given, or else name and pack."""
    own = F.trim(F.concat(_text(name), F.lit(" "), _text(pack_) if pack_ is not None else F.lit("")))
    return F.coalesce(F.nullif(F.trim(_text(given)), F.lit("")), own) if given is not None else own


def no_placeholder(c) -> Column:
    """A cell that says nan or None counts as empty."""
    c = F.trim(_text(c))
    return F.when(c.isin("nan", "None", "NaN"), "").otherwise(c)
