"""String similarity between columns, from 0 to 100.

All rest on the length of the longest common subsequence (K0), found with
bit-parallel arithmetic: for the distinct pairs of an Arrow batch at once, on
arrays of 64-bit integers, one step for each character of the longer texts;
texts of more than 64 characters one by one on Python's integers. dice() is
native.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """K0: length of the longest common subsequence."""
    if a == b:
        return len(a)
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for ch in b:
        hit = open_ & where.get(ch, 0)
        if hit:
            open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


def ratio_of(a: str, b: str) -> float:
    """K1: twice the common subsequence over both lengths; two empty texts are equal."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def partial_ratio_of(a: str, b: str) -> float:
    """K2: best ratio of the shorter text and a stretch of its length, or shorter at either end, of the other."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    letters = set(a)
    best = 0.0
    for start in range(1 - m, n):
        piece = b[max(0, start) : start + m]
        # a stretch that ends (begins) outside the shorter text's letters is no better than its neighbour
        if piece[-1] not in letters if start <= 0 else piece[0] not in letters and start + m > n:
            continue
        best = max(best, ratio_of(a, piece))
        if best == 100.0:
            return best
    return max(best, partial_ratio_of_same(b, a)) if m == n else best


def partial_ratio_of_same(a: str, b: str) -> float:
    """Texts of one length, the other way round."""
    m, best = len(a), 0.0
    for start in range(1 - m, m):
        best = max(best, ratio_of(a, b[max(0, start) : start + m]))
    return best


def token_sort_ratio_of(a: str, b: str) -> float:
    """K3: ratio of the sorted words."""
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio_of(a: str, b: str) -> float:
    """K4: like K3, but words that both have are set before what either has beside them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and not (left and right):
        return 100.0
    s, gap = len(shared), 1 if shared else 0
    one, two = s + gap + len(left), s + gap + len(right)
    apart = len(left) + len(right) - 2 * lcs_length(left, right)
    scores = [100.0 - 100.0 * apart / (one + two)]
    if shared:
        scores += [100.0 - 100.0 * (gap + len(left)) / (s + one), 100.0 - 100.0 * (gap + len(right)) / (s + two)]
    return max(scores)


def best_ratio_of(word: str, words) -> float:
    """K6: the best ratio of a word and any of several; -1 without any."""
    return max((ratio_of(word, w) for w in words), default=-1.0)


# --- many pairs at once ---

_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def code_matrix(texts: list[str]) -> np.ndarray:
    """Code points by place and text; 0 behind a text's end."""
    longest = max(map(len, texts), default=0)
    out = np.zeros((len(texts), longest), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts])
    out[np.repeat(np.arange(len(texts)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(out.T)


def open_places(hits: np.ndarray, size) -> np.ndarray:
    """The bit-parallel steps: what is left open of patterns of `size` characters; hits: by place, where each pattern has its text's character."""
    every = np.where(np.asarray(size) >= 64, _ALL, (_ONE << np.asarray(size, np.uint64).clip(0, 63)) - _ONE).astype(np.uint64)
    left = np.broadcast_to(every, hits.shape[1:]).copy()
    for at in hits:
        hit = left & at
        left = ((left + hit) | (left - hit)) & every
    return np.bitwise_count(left).astype(np.int64)


def lcs_lengths(pairs: list[tuple[str, str]], at_once: int = 20_000) -> np.ndarray:
    """K0 of many pairs."""
    out = np.zeros(len(pairs), np.int64)
    short, long = [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = len(a)
        elif a and b:
            if len(a) > len(b):
                a, b = b, a
            if len(a) > 64:
                out[i] = lcs_length(a, b)
            else:
                short.append((i, a, b))
    short.sort(key=lambda x: len(x[2]))  # texts of like length together
    for start in range(0, len(short), at_once):
        part = short[start : start + at_once]
        patterns, texts = ({t: i for i, t in enumerate(dict.fromkeys(x[k] for x in part))} for k in (1, 2))
        own, codes = code_matrix(list(patterns)), code_matrix(list(texts))
        letters = np.unique(own)
        letters = letters[letters > 0]
        where = np.zeros((len(patterns), len(letters) + 1), np.uint64)  # the last letter is one that no pattern has
        for place, row in enumerate(own):
            at = np.flatnonzero(row)
            where[at, np.searchsorted(letters, row[at])] |= _ONE << np.uint64(place)
        found = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
        number = np.where(letters[found] == codes, found, len(letters))
        p, t = (np.array([ids[x[k]] for x in part]) for k, ids in ((1, patterns), (2, texts)))
        sizes = np.array([len(x[1]) for x in part])
        out[[x[0] for x in part]] = sizes - open_places(np.stack([where[p, row[t]] for row in number]), sizes)
    return out


def _sizes(pairs) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(a) for a, _ in pairs], np.int64), np.array([len(b) for _, b in pairs], np.int64)


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """K1 of many pairs."""
    a, b = _sizes(pairs)
    return np.where(a + b > 0, 200.0 * lcs_lengths(pairs) / np.maximum(a + b, 1), 100.0)


def token_sort_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def set_scores(shared: np.ndarray, left: np.ndarray, right: np.ndarray, common: np.ndarray) -> np.ndarray:
    """K4 from the lengths of what both have, of what either has beside it, and of the latter's common subsequence."""
    gap = (shared > 0).astype(np.int64)
    one, two = shared + gap + left, shared + gap + right
    out = 100.0 - 100.0 * (left + right - 2 * common) / np.maximum(one + two, 1)
    more = np.maximum(100.0 - 100.0 * (gap + left) / np.maximum(shared + one, 1), 100.0 - 100.0 * (gap + right) / np.maximum(shared + two, 1))
    out = np.where(gap > 0, np.maximum(out, more), out)
    return np.where((gap > 0) & ((left == 0) | (right == 0)), 100.0, out)


def token_set_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """K4 of many pairs."""
    sets = [(set(a.split()), set(b.split())) for a, b in pairs]
    rest = [(" ".join(sorted(x - y)), " ".join(sorted(y - x))) for x, y in sets]
    shared = np.array([len(" ".join(sorted(x & y))) for x, y in sets], np.int64)
    out = set_scores(shared, *_sizes(rest), lcs_lengths(rest))
    return np.where([bool(x) and bool(y) for x, y in sets], out, 0.0)


def best_ratios(pairs: list[tuple[str, tuple[str, ...]]]) -> np.ndarray:
    """K6 of many words, each against its own several."""
    each = {k: i for i, k in enumerate(dict.fromkeys((a, b) for a, many in pairs for b in many if b is not None))}
    scores = ratios(list(each)).tolist()
    return np.array([max((scores[each[a, b]] for b in many if b is not None), default=-1.0) for a, many in pairs])


class TokenSets:
    """Several texts that K4 is taken of against one query after another.

    Texts that share the same words with a query are scored at once; what is
    left of texts without some words is kept for the next queries.
    """

    def __init__(self, texts: list[str], most: int = 300_000):
        self.sets = [sorted(set(t.split())) for t in texts]
        where: dict[str, list[int]] = {}
        for i, words in enumerate(self.sets):
            for w in words:
                where.setdefault(w, []).append(i)
        self.where = {w: np.array(at) for w, at in where.items()}
        self.letters = np.unique(code_matrix([" ".join(x) for x in self.sets] + [" "]))
        self.some = np.array([bool(x) for x in self.sets])
        self.rests: dict[tuple[str, ...], tuple] = {}
        self.most, self.held = most, 0

    def _rest(self, shared: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts that have all shared words: their places here by number of text, lengths and letters of what else they have."""
        if shared not in self.rests:
            at = np.arange(len(self.sets)) if not shared else np.sort(np.concatenate([self.where[w] for w in shared]))
            if len(shared) > 1:
                at, n = np.unique(at, return_counts=True)
                at = at[n == len(shared)]
            texts = [" ".join(w for w in self.sets[i] if w not in shared) for i in at]
            codes = code_matrix(texts)
            if self.held + codes.size > self.most * 32:
                self.rests.clear()
                self.held = 0
            self.held += codes.size
            place = np.full(len(self.sets), -1)
            place[at] = np.arange(len(at))
            self.rests[shared] = place, np.array([len(t) for t in texts], np.int64), np.searchsorted(self.letters, codes).astype(np.uint16 if len(self.letters) < 1 << 16 else np.uint32)
        return self.rests[shared]

    def scores(self, query: str, least: float = 0.0) -> np.ndarray:
        """K4 of the query and each text; what cannot reach `least` may be less than it is."""
        words, out = sorted(set(query.split())), np.zeros(len(self.sets))
        if not words:
            return out
        known = [w for w in words if w in self.where][:62]
        bits = np.zeros(len(self.sets), np.int64)
        for k, w in enumerate(known):
            bits[self.where[w]] |= 1 << k
        if len(known) == 62:  # so many words: one by one
            return token_set_ratios([(query, " ".join(x)) for x in self.sets])
        for kind in np.unique(bits):
            at = np.flatnonzero(bits == kind)
            shared = tuple(w for k, w in enumerate(known) if kind >> k & 1)
            left = " ".join(w for w in words if w not in shared)
            place, sizes, numbers = self._rest(shared)
            size = sizes[place[at]]
            n = np.full(len(at), len(" ".join(shared)), np.int64)
            bound = set_scores(n, np.full(len(at), len(left)), size, np.minimum(len(left), size))
            at, n, size = (x[bound >= least] for x in (at, n, size))
            if not len(at):
                continue
            if len(left) > 64:
                common = np.array([lcs_length(left, " ".join(w for w in self.sets[i] if w not in shared)) for i in at])
            else:
                where = np.zeros(len(self.letters) + 1, np.uint64)
                for k, ch in enumerate(left):
                    i = np.searchsorted(self.letters, ord(ch))
                    if i < len(self.letters) and self.letters[i] == ord(ch):
                        where[i] |= _ONE << np.uint64(k)
                longest = int(size.max())
                common = len(left) - open_places(where[numbers[:longest, place[at]]], len(left))
            out[at] = set_scores(n, np.full(len(at), len(left)), size, common)
        return np.where(self.some, out, 0.0)


def _pairs(of):
    """A function of many distinct pairs as one of two columns, null where either is."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        keys = [None if x is None or y is None else (x, y) if isinstance(y, str) else (x, tuple(y)) for x, y in zip(a, b)]
        known = {k: i for i, k in enumerate(dict.fromkeys(k for k in keys if k is not None))}
        scores = np.append(np.asarray(of(list(known)), float), np.nan)
        return pd.Series(scores[[known.get(k, -1) if k is not None else -1 for k in keys]], dtype="float64").astype(object).where(lambda x: x.notna(), None) if None in keys else pd.Series(scores[[known[k] for k in keys]], dtype="float64")

    return run


def _udf(of):
    run = _pairs(of)

    def typed(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return pandas_udf(typed, DoubleType())


ratio = _udf(ratios)
partial_ratio = _udf(lambda pairs: [partial_ratio_of(a, b) for a, b in pairs])
token_sort_ratio = _udf(token_sort_ratios)
token_set_ratio = _udf(token_set_ratios)
best_ratio = _udf(best_ratios)
lcs = _udf(lcs_lengths)


def short_lcs(a: Column, b: Column) -> Column:
    """K0 in native expressions for texts of up to 62 characters: the same bit-parallel steps on a bigint."""
    mask = lambda ch: F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0).cast("bigint"), lambda m, i: F.when(F.substring(a, i, F.lit(1)) == ch, m + F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1)).otherwise(m))
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(a)) - 1
    step = lambda o, ch: F.transform(F.array(o.bitwiseAND(mask(ch))), lambda hit: (o + hit).bitwiseOR(o - hit).bitwiseAND(every))[0]
    left = F.aggregate(F.filter(F.split(b, ""), lambda ch: ch != ""), every, step)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.length(a) - F.bit_count(left))


def dice(a: Column, b: Column) -> Column:
    """K7: shared pairs of letters over all, from 0 to 1; equal texts 1, shorter than two letters 0."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    x, y = grams(a), grams(b)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
