"""Quality classifier: a factorisation machine over whole texts.

Inputs are hashed words, hashed word shapes (runs of letters, digits and other
characters), values and bins of statistics of structure, and hashed metadata:
one input for each column that is named (a number by its power of two). The
score is
sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)),
which takes time in proportion to the inputs that are present. Texts are taken
in batches: one sort gives the counts of all words of a batch.

Training reads a bounded sample of labelled rows (TRAIN_ROWS, the least by hash
of doc_id); only their hashed inputs reach the driver, where Adagrad fits the
weights. Scoring is one pass without a shuffle. What must not be learnt from
(the label tables, ids, sources) is not to be named as metadata; op8 and the
pipeline name n_chars alone.

Edge cases: a null or empty text has no words and is scored by its structure
and metadata alone; very long texts are scored whole, in a batch of their own;
a null in a metadata column is a value of its own; conflicting labels of one
doc_id count as their mean, ties as 1; null labels are ignored; without labels
every score is 0.5; repeated rows are scored alike; an empty table yields an
empty one; a null doc_id is kept; an extra column named score stays out of
scored() unless its columns are named, and kept() passes all columns through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rare_collections, released, words_of

#: Labelled rows that training may read at most.
TRAIN_ROWS = 8000
#: Hash buckets of words and shapes.
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 12

#: Hash buckets of metadata.
META = 1 << 10
_N_STATS = 12
_BINS = 8
#: Characters of texts that are taken at once, or one text if it has more.
BATCH_CHARS = 500_000

_LETTER, _UPPER, _DIGIT, _SYMBOL, _POINT = 1, 2, 4, 8, 16


_letters, _digits, _again = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def _case(letters: str) -> str:
    return "A" if letters.isupper() else "a" if letters.islower() else "Aa" if letters.istitle() else "aA"


def _shape(word: str) -> str:
    letters = word.rstrip(".,;:!?#*$%&")
    if letters.isalpha():  # most words
        marks = word[len(letters) :]
        return _case(letters) + (marks if len(marks) < 2 else _again.sub(r"\1\1", marks)[:22])
    return _again.sub(r"\1\1", _digits.sub("0", _letters.sub(lambda m: _case(m[0]), word)))[:24]


class Buckets(dict):
    """The hash buckets of a word and of its shape, as bytes; emptied before a batch when it has reached `most` entries."""

    def __init__(self, buckets: int = BUCKETS, most: int = 200_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> bytes:
        out = self[word] = (xxhash.xxh32_intdigest(word) % self.buckets).to_bytes(4, "little") + (xxhash.xxh32_intdigest(_shape(word), 1) % self.buckets).to_bytes(4, "little")
        return out

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4").reshape(-1, 2).astype(np.int64)


@cache
def _kinds() -> np.ndarray:
    """What each character of the basic plane is."""
    kinds = np.array([_LETTER if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint8)
    for flag, chars in ((_DIGIT, "0123456789"), (_SYMBOL, "#*$%&|<>!"), (_POINT, ".,;:?"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0xDF))))):
        kinds[[ord(c) for c in chars]] |= flag
    return kinds


def _counted(doc: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of the distinct pairs of both, in order."""
    keys = np.sort(doc * buckets + bucket)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    keys, n = keys[at], np.diff(np.r_[at, len(keys)])
    return keys // buckets, keys % buckets, n


def inputs(texts: list[str], table: Buckets, metadata: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of the inputs of several texts, text after text, and how many each has: words, shapes, values and bins of the statistics, metadata."""
    size, buckets = len(texts), table.buckets
    split = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(size), n_words)
    both = table.of([w for words in split for w in words])
    index, value, of = [], [], []
    distinct, top = np.zeros(size), np.zeros(size)
    for part in (0, 1):
        d, at, n = _counted(doc, both[:, part], buckets)
        x = 1 + np.log(n)
        norm = np.sqrt(np.bincount(d, x * x, size))
        index.append(at + part * buckets)
        value.append(x / norm[d])
        of.append(d)
        if part == 0:
            distinct = np.bincount(d, minlength=size).astype(float)
            np.maximum.at(top, d, n)
    near = doc[1:] == doc[:-1]
    pairs = np.bincount(_counted(doc[1:][near], both[:-1, 0][near] * buckets + both[1:, 0][near], buckets * buckets)[0], minlength=size) if len(doc) else np.zeros(size)

    chars = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    flags = _kinds()[np.minimum(codes, 0xFFFF)]
    beyond = np.flatnonzero(codes > 0xFFFF)
    if len(beyond):
        own, inverse = np.unique(codes[beyond], return_inverse=True)
        flags[beyond] = np.array([_LETTER * chr(c).isalpha() for c in own], np.uint8)[inverse]
    ends = np.cumsum(chars)
    share = {}
    for flag in (_LETTER, _UPPER, _DIGIT, _SYMBOL, _POINT):
        total = np.r_[0, np.cumsum((flags & flag) != 0)]
        share[flag] = (total[ends] - total[ends - chars]).astype(float)
    lines = [[x for x in t.split("\n") if x and not x.isspace()] for t in texts]
    n_lines, own_lines = np.array([len(x) for x in lines]), np.array([len(set(x)) for x in lines])
    word_chars = np.array([sum(map(len, w)) for w in split])
    n, c = np.maximum(1, n_words), np.maximum(1, chars)
    stats = np.stack([
        np.minimum(1, np.log10(1 + n_words) / 5), np.minimum(1, word_chars / n / 16), share[_LETTER] / c, share[_UPPER] / c, share[_DIGIT] / c, np.minimum(1, share[_SYMBOL] / n),
        distinct / n, top / n, 1 - own_lines / np.maximum(1, n_lines), np.minimum(1, n_lines / n * 4), np.where(n_words > 1, 1 - pairs / np.maximum(1, n - 1), 0), np.minimum(1, share[_POINT] / n),
    ], 1)
    base, each = 2 * buckets, np.arange(_N_STATS)
    index += [np.tile(base + each, size), (base + _N_STATS + each * _BINS + np.minimum((stats * _BINS).astype(int), _BINS - 1)).ravel()]
    value += [stats.ravel(), np.full(size * _N_STATS, 0.5)]
    of += [np.repeat(np.arange(size), _N_STATS)] * 2
    for column in metadata or []:
        index.append(base + _N_STATS * (1 + _BINS) + np.array([xxhash.xxh32_intdigest(x) % META for x in column], np.int64))
        value.append(np.ones(size))
        of.append(np.arange(size))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(index)[order].astype(np.int32), np.concatenate(value)[order].astype(np.float32), np.bincount(of, minlength=size)


def features(text: str | None, buckets: int = BUCKETS, metadata: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text's inputs."""
    return inputs([text or ""], Buckets(buckets), [[m] for m in metadata])[:2]


def runs(texts: list[str | None], most: int = BATCH_CHARS):
    """Ranges of texts that together have `most` characters at most, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if total + size > most and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if len(texts) > start:
        yield start, len(texts)


def described(docs: DataFrame, metadata: tuple[str, ...]) -> list:
    """Columns of strings that stand for metadata: name=value, numbers by sign and power of two."""
    kinds = dict(docs.dtypes)
    out = []
    for name in metadata:
        c = F.col(f"`{name}`")
        if kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal"):
            c = F.concat(F.signum(c).cast("int").cast("string"), F.lit("^"), F.floor(F.log2(1 + F.abs(c.cast("double")))).cast("string"))
        out.append(F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit("\0null"))))
    return out


def size_of(buckets: int) -> int:
    return 2 * buckets + _N_STATS * (1 + _BINS) + META


@dataclass
class Machine:
    """Weights of a factorisation machine; their size depends on nothing but its parameters."""

    buckets: int = BUCKETS
    factors: int = FACTORS
    w0: float = 0.0
    w: np.ndarray = field(default=None)  # type: ignore[assignment]
    v: np.ndarray = field(default=None)  # type: ignore[assignment]
    metadata: tuple[str, ...] = ()

    def __post_init__(self):
        n = size_of(self.buckets)
        if self.w is None:
            self.w = np.zeros(n, np.float32)
            self.v = np.zeros((n, self.factors), np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of several texts what the sigmoid is taken of; sizes: how many inputs each has, one at least."""
        starts = np.cumsum(sizes) - sizes
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))

    def scores(self, texts: list[str | None], metadata: list[list[str]] | None = None, table: Buckets | None = None) -> np.ndarray:
        table, out = Buckets(self.buckets) if table is None else table, [np.empty(0)]
        for a, b in runs(texts):
            raw = self.raw(*inputs([t or "" for t in texts[a:b]], table, [m[a:b] for m in metadata or []]))
            out.append(1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30))))
        return np.concatenate(out)

    def score(self, text: str | None, *metadata: str) -> float:
        return float(self.scores([text], [[m] for m in metadata])[0])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, seed: int = 1) -> "Machine":
        if not rows:
            return self
        rng = np.random.default_rng(seed)
        n = len(self.w)
        self.v = rng.normal(0, 0.05, self.v.shape).astype(np.float32)
        p = min(max(labels.mean(), 0.01), 0.99)
        self.w0 = math.log(p / (1 - p))
        gw, gv = np.full(n, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), 64):
                part = order[start : start + 64]
                index = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                starts = np.r_[0, np.cumsum([len(rows[i][0]) for i in part])[:-1]]
                of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                vx = self.v[index] * x[:, None]
                s = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[index] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
                self.w0 -= rate * float(g.sum())
                gx = g[of] * x
                own, inverse = np.unique(index, return_inverse=True)
                d = np.bincount(inverse, gx) + l2 * self.w[own]
                gw[own] += d * d
                self.w[own] -= rate * d / np.sqrt(gw[own])
                for f in range(self.factors):
                    d = np.bincount(inverse, gx * (s[of, f] - vx[:, f])) + l2 * self.v[own, f]
                    gv[own, f] += d * d
                    self.v[own, f] -= 0.3 * rate * d / np.sqrt(gv[own, f])
        return self


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, label_col: str = "quality", metadata: tuple[str, ...] = ()) -> DataFrame:
    """text, label, and a string for each metadata column, of at most `most` labelled documents."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of 12 bytes: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(f"m{i}") for i, c in enumerate(described(docs, metadata))])
    return rows.join(F.broadcast(chosen), "doc_id").drop("doc_id").select("text", "label", *[f"m{i}" for i in range(len(metadata))])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, buckets: int = BUCKETS, factors: int = FACTORS, label_col: str = "quality", metadata: tuple[str, ...] = ()) -> Machine:
    """A machine fitted on the rows of labels; leave out of labels what must not be learnt from. metadata: columns of docs that are inputs too."""

    def run(batches):
        table = Buckets(buckets)
        for batch in batches:
            texts, meta = [t or "" for t in batch.column(0).to_pylist()], [c.to_pylist() for c in batch.columns[2:]]
            for a, b in runs(texts):
                index, value, sizes = inputs(texts[a:b], table, [m[a:b] for m in meta])
                cuts = np.cumsum(sizes)[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in np.split(index, cuts)], pa.binary()), pa.array([x.tobytes() for x in np.split(value, cuts)], pa.binary())], ["label", "index", "value"])

    rows = training_rows(docs, labels, most, label_col, metadata).mapInArrow(run, "label int, index binary, value binary").toArrow()
    pairs = sorted((i, v, y) for i, v, y in zip(rows.column("index").to_pylist(), rows.column("value").to_pylist(), rows.column("label").to_pylist()))
    return Machine(buckets, factors, metadata=tuple(metadata)).fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v, _ in pairs], np.array([y for *_, y in pairs], float))


def score_of(docs: DataFrame, machine: Machine) -> Column:
    """The score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        rare_collections()
        own, table = shared.value, Buckets(shared.value.buckets)
        for text, *metadata in batches:
            yield pd.Series(own.scores(text.tolist(), [m.tolist() for m in metadata] if own.metadata else None, table))
        released()

    # a column that is always there, so that the batches are tuples
    return score(F.coalesce(F.col("text").cast("string"), F.lit("")), *(described(docs, machine.metadata) or [F.lit("")]))


def scored(docs: DataFrame, machine: Machine, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all but one named score, unless given) and score."""
    names = [c for c in docs.columns if c != "score"] if columns is None else columns
    return docs.select(*[F.col(f"`{c}`") for c in names], score_of(docs, machine).alias("score"))


def kept(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is `least` or more."""
    return docs.filter(score_of(docs, machine) >= least)
