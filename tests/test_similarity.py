"""Similarity kernels against plain definitions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import similarity as K

words = st.text(alphabet="abcd ", max_size=12)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_kernels(a, b):
    assert K.lcs_length(a, b) == plain_lcs(a, b)
    assert K.ratio_of(a, b) == K.ratio_of(b, a)
    assert (K.ratio_of(a, b) == 100) == (a == b)
    assert K.token_sort_ratio_of(a, b) == K.token_sort_ratio_of(" ".join(reversed(a.split())), b)
    assert K.token_set_ratio_of(a, b) == K.token_set_ratio_of(b, " ".join(reversed(a.split())))


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_partial_ratio(a, b):
    short, long = sorted((a, b), key=len)
    if not short or not long:
        assert K.partial_ratio_of(a, b) == (100 if a == b else 0)
        return
    m = len(short)
    both = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    want = max(K.ratio_of(s, w[max(0, i) : i + m]) for s, w in both for i in range(1 - m, len(w)))
    assert K.partial_ratio_of(a, b) == want >= K.ratio_of(a, b) - 1e-9 or want < K.ratio_of(a, b)


def test_native_forms_agree(spark):
    rows = [("", ""), ("a", ""), ("abc", "abd"), ("x" * 62, "xy" * 31), ("pantop", "pan top"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", K.lcs(F.col("a"), F.col("b")).alias("k"), K.short_lcs(F.col("a"), F.col("b")).alias("n"), K.dice(F.col("a"), F.col("b")).alias("d")).collect():
        if r.a is None:
            assert r.k is None and r.n is None
        else:
            assert r.k == r.n == plain_lcs(r.a, r.b)
            assert 0 <= r.d <= 1
