"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Each rule is a condition that rejects a document. On a sample of rows spread
over the whole table each rule is run alone: the share of rows that it rejects
is its selectivity, the time it takes beyond an empty pass its cost. Rules are
then tried in falling order of rejection per cost, in one CASE over the words
of a text, which are split once; a document pays for no rule after the first
that rejects it. The order changes the cost and which rule is named, but never
the verdict, so measured times may vary from run to run.

Edge cases: a null, empty or all-white-space text has no words and is rejected
(too few words); texts of any length are read whole, and every rule takes time
in proportion to the text, however long its words are; repeated rows get equal
verdicts; rules that reject equally much per cost keep their given order; an
empty table yields an empty one and leaves the rules as given; a null doc_id
is kept; extra columns of any name pass through kept() and stay out of judged().
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows, about, of the sample that costs and selectivities are measured on; the verdict does not depend on it.
SAMPLE = 1000

_SPACES = r"' \t\n\u000B\u000C\r'"
_CLASS = r"'[ \\t\\n\\x0B\\f\\r]+'"


def let(value: str, name: str, body: str) -> str:
    """body with the value under a name, computed once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: From here on every expression is over a column named text, never null.
TRIMMED = f"trim(BOTH {_SPACES} FROM text)"
WORDS = let(TRIMMED, "t", f"if(t = '', cast(array() as array<string>), split(t, {_CLASS}))")
LINES = r"filter(split(text, '\\n', -1), l -> trim(BOTH " + _SPACES + " FROM l) != '')"


def repeat_words(words: str) -> str:
    """Words inside windows of 8 words that occur at least twice.

    Hashes of all windows, made of those of their halves, tell whether any can
    occur twice; only then are the windows themselves sorted, with their places,
    and the stretches that the repeated ones cover added up.
    """
    width = 8
    at, hashes = f"sequence(1, size(w) - {width - 1})", "transform(w, x -> xxhash64(x))"
    for step in (1, 2, 4):
        hashes = let(hashes, "h", f"transform(h, (x, i) -> xxhash64(x, get(h, i + {step})))")
    hashes = let(f"slice({hashes}, 1, size(w) - {width - 1})", "h", "size(array_distinct(h)) < size(h)")
    sorted_ = f"array_sort(transform({at}, i -> struct(array_join(slice(w, i, {width}), ' ') as s, i as i)))"
    twice = "filter(z, (x, j) -> x.s = get(z, j - 1).s or x.s = get(z, j + 1).s)"
    places = let(sorted_, "z", f"array_sort(transform({twice}, x -> x.i))")
    covered = f"aggregate({places}, named_struct('n', 0L, 'to', 0), (a, p) -> named_struct('n', a.n + p + {width} - greatest(a.to, p), 'to', p + {width}), a -> a.n)"
    body = f"case when size(w) < {width + 1} then 0L when {hashes} then {covered} else 0L end"
    return body if words == "w" else let(words, "w", body)


N_WORDS = "size(w)"
WORD_CHARS = r"cast(char_length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '')) as bigint)"
N_SYMBOLS = "cast(regexp_count(text, '[#*$%&|<>]') as bigint)"
N_LINES = f"cast(size({LINES}) as bigint)"
N_DUP_LINES = f"cast({let(LINES, 'l', 'size(l) - size(array_distinct(l))')} as bigint)"
N_REPEAT = repeat_words("w")
N_UPPER = r"(char_length(text) - char_length(regexp_replace(text, '\\p{Lu}+', '')))"
# from a word's first letter to its end, so that no word is looked through twice
N_LETTER_WORDS = r"regexp_count(text, '\\p{L}[^ \\t\\n\\x0B\\f\\r]*')"


@dataclass(frozen=True)
class Rule:
    """name; reject: SQL condition over text and its words w."""

    name: str
    reject: str


def rules(n_words: str = N_WORDS, n_symbols: str = N_SYMBOLS, n_dup_lines: str = N_DUP_LINES, n_repeat: str = N_REPEAT, word_chars: str = WORD_CHARS) -> list[Rule]:
    """The standing rules; the arguments name columns that already hold a count."""
    return [
        Rule("few_words", f"{n_words} < 20"),
        Rule("symbols", f"10 * {n_symbols} > {n_words}"),
        Rule("word_length", let(word_chars, "c", f"c < 2 * {n_words} or c > 15 * {n_words}")),
        Rule("repeated_lines", f"100 * {n_dup_lines} > 50 * {N_LINES}"),
        Rule("shouting", f"2 * {N_UPPER} > {word_chars}"),
        Rule("letterless_words", f"100 * {N_LETTER_WORDS} < 70 * {n_words}"),
        Rule("repeated_windows", f"100 * {n_repeat} > 30 * {n_words}"),
    ]


def sampled(texts: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """text and words w of about `rows` rows spread over the whole table, written once."""
    n = texts.count()
    some = texts.select("text") if n <= rows else texts.select("text").sample(rows / n, seed=7)
    return written(some.withColumn("w", F.expr(WORDS)).repartition(1), "sample")


def measured(sample: DataFrame, of: list[Rule], repeats: int = 2) -> dict[str, tuple[float, float]]:
    """Of each rule the rows of the sample that it rejects, and the seconds it takes beyond a pass without rules, the least of some runs."""

    def run(condition: str) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.selectExpr(f"count_if({condition}) as n").first()[0]
        return time.perf_counter() - start, rejected

    base = min(run("length(text) + size(w) < 0")[0] for _ in range(repeats))
    out = {}
    for r in of:
        runs = [run(r.reject) for _ in range(repeats)]
        out[r.name] = (float(runs[0][1]), max(1e-3, min(t for t, _ in runs) - base))
    return out


def ordered(texts: DataFrame, of: list[Rule], rows: int = SAMPLE) -> list[Rule]:
    """The rules by falling rejection per cost on a sample; ties keep their order. texts has a column text."""
    found = measured(sampled(texts, rows), of)
    rate = {name: rejected / cost for name, (rejected, cost) in found.items()}
    return sorted(of, key=lambda r: -rate[r.name])


def verdict(of: list[Rule]) -> str:
    """SQL of the name of the first rule that rejects the text, or null."""
    return "case " + " ".join(f"when {r.reject} then '{r.name}'" for r in of) + " end"


def texts_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def kept(docs: DataFrame, text_col: str = "text", of: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that no rule rejects."""
    chain = ordered(texts_of(docs, text_col), of or rules(), sample)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return inner.filter(F.expr(let(WORDS, "w", verdict(chain))).isNull()).select("_row.*")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (that rejected it)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chain = ordered(rows.select("text"), rules(), sample)
    by_words = let(WORDS, "w", f"named_struct('n', cast(size(w) as bigint), 'r', {repeat_words('w')})")
    counted = rows.withColumn("_w", F.expr(by_words)).select("doc_id", "text", F.col("_w.n").alias("n_words"), F.expr(WORD_CHARS).alias("word_chars"), F.expr(N_SYMBOLS).alias("n_symbols"), F.expr(N_DUP_LINES).alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"))
    given = {r.name: r for r in rules("n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "word_chars")}
    counted = counted.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return counted.withColumn("rule", F.expr(verdict([given[r.name] for r in chain]))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").isNull().alias("kept"), "rule")
