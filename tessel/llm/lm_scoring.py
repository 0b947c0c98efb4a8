"""Language-model scores from class-based bigrams (Brown et al.) with exchange clustering.

P(w | h) = L * P(class(w) | class(h)) * P(w | class(w)) + (1 - L) * P(w), where h
is the last known token and P(w) the add-0.1 unigram that is also the base
score. Every document ends with an end token, which is a class of its own and
the history of a document's first word. Unknown words have the unigram's
probability in either part, so that all probabilities of a history sum to 1.

Layout. Documents are gathered into blocks of about BLOCK tokens, kept as local
codes. Words are dealt by hash to shards, which hold the vocabulary: counts and
classes. Blocks tell shards what they saw, as packed arrays with one entry for
each distinct word of the block, and shards answer block by block; no row is
made per token, nothing that grows with the vocabulary is broadcast, and a word
that is a third of all tokens is one entry of each block.

Clustering. The most frequent words start as classes of their own, all others
in one. In each round the shards get every word's counts of left and right
neighbour classes and move it to the class with the greatest gain in
log-likelihood (of the exchange alone, all other words being held). All words
move in the first round, then every other one by hash. Words that move together
can lose together: a round that does not raise the likelihood is taken back,
and the next one moves half as many words.

Edge cases: a null or empty text is the end token alone; a document of any
length is one part of one block; a document whose doc_id is null is in no fold,
so it trains the model; repeated rows are counted as often as they occur; words
equally frequent go by hash, classes with equal gains by number; an empty table
yields an empty one; if no document trains, no word is known and both scores
rest on the add-0.1 of an empty table; extra columns, whatever their names, are
not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, distinct_sorted, dump, kept_on_disk, load, lower_ascii, rare_collections, shards, words_of, written

CLASSES = 32
ROUNDS = 3
WEIGHT = 0.9
#: Tokens of a block, or one document if it has more.
BLOCK = 2_000_000
ALPHA = 0.1
NONE = 255
_END = xxhash.xxh3_64_intdigest("")
_ROWS = "block bigint, shard int, data binary"



def hashes(text: str | None, table: WordHashes) -> np.ndarray:
    """Of the lower-cased words and the end token."""
    return table.of(words_of(lower_ascii(text)) if text else [], _END)


def blocks_of(docs: DataFrame, n_shards: int, held_out) -> DataFrame:
    """block, shard, data: a block's documents (shard -1) and its words in each shard, with their counts in training documents."""

    def run(batches):
        rare_collections()
        task, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens = [], [], [], []
        total, table = 0, WordHashes()

        def out():
            block = task << 24 | number
            flat = np.concatenate(tokens)
            trains = np.repeat(~np.array(held, bool), lengths)
            own = distinct_sorted(flat)
            codes = np.searchsorted(own, flat)
            counts = np.bincount(codes, minlength=len(own))
            by_count = np.argsort(-counts, kind="stable")  # small codes for frequent words
            place = np.empty(len(own), np.int64)
            place[by_count] = np.arange(len(own))
            codes = place[codes]
            own = own[by_count]
            in_training = np.bincount(codes[trains], minlength=len(own))
            shard = (own % np.uint64(n_shards)).astype(np.int64)
            rows = [(block, -1, dump(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.array(held, np.uint8), np.array(lengths, np.int32), codes.astype(np.int32)))]
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                rows.append((block, int(s), dump(own[at], in_training[at].astype(np.uint32), at.astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "data"])

        for batch in batches:
            for doc_id, text, out_ in zip(*(c.to_pylist() for c in batch.columns)):
                got = hashes(text, table)
                ids.append(doc_id)
                held.append(bool(out_))
                lengths.append(len(got))
                tokens.append(got)
                total += len(got)
                if total >= BLOCK:
                    yield out()
                    number += 1
                    ids, held, lengths, tokens, total = [], [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, _ROWS)


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["block", "shard", "data"])


def vocabulary(words: DataFrame) -> DataFrame:
    """Of each shard its words, counts and (block -1), and for each of its blocks the places and counts of the block's words."""

    def run(key, pdf):
        per_block = [(b, load(d)) for b, d in zip(pdf["block"], pdf["data"])]
        own, inverse = np.unique(np.concatenate([x[0] for _, x in per_block]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([x[1] for _, x in per_block]), len(own)).astype(np.int64)
        rows, start = [(-1, key[0], dump(own, counts))], 0
        for b, (h, _, at) in per_block:
            mine = inverse[start : start + len(h)]
            start += len(h)
            rows.append((b, key[0], dump(at, mine.astype(np.uint32), counts[mine])))
        return _frame(rows)

    return words.groupBy("shard").applyInPandas(run, _ROWS)


def _phi(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(left: np.ndarray, right: np.ndarray, counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each word's best class. left, right: words x classes, its counts of neighbour classes; pairs: class bigrams.

    A class without words is left empty: it would look best to all words at once.
    """
    k = len(pairs)
    totals = pairs.sum(0)
    out = classes.copy()
    tables = [_phi(pairs + x) - _phi(pairs) for x in range(9)]
    less = lambda m, x: _phi(m) - _phi(np.maximum(m - x, 0))
    for start in range(0, len(counts), 20_000):
        part = slice(start, start + 20_000)
        n, own = counts[part].astype(float), classes[part].astype(np.int64)
        gain = -2 * (_phi(totals[None, :] + n[:, None]) - _phi(totals)[None, :])
        stay = -2 * less(totals[own], n)
        for side, m in ((left[part], pairs), (right[part], pairs.T)):
            w, c = np.nonzero(side)
            x = side[w, c].astype(float)
            for size in range(1, 9):
                at = np.flatnonzero(x == size)
                table = tables[size] if m is pairs else tables[size].T
                _add(gain, w[at], table[c[at]])
            at = np.flatnonzero(x > 8)
            for few in np.array_split(at, len(at) // 50_000 + 1):
                _add(gain, w[few], _phi(m[c[few]] + x[few, None]) - _phi(m[c[few]]))
            stay += np.bincount(w, less(m[c, own[w]], x), len(n))
        rows = np.arange(len(n))
        gain[:, k - 1] = -np.inf  # the end token's
        gain[:, totals == 0] = -np.inf
        gain[rows, own] = stay
        best = gain.argmax(1)
        moves = (n > 0) & (own != k - 1) & (gain[rows, best] > stay + 1e-9)
        out[part] = np.where(moves, best, own)
    return out


def moves_in(words: np.ndarray, parts: int, turn: int) -> np.ndarray:
    """Which words, by hash, may move in a round that moves one in `parts`."""
    return (words >> np.uint64(7)) % np.uint64(parts) == turn % parts


def likelihood(pairs: np.ndarray) -> float:
    """What the classes contribute to the log-likelihood of the training text."""
    return float(_phi(pairs).sum() - _phi(pairs.sum(0)).sum() - _phi(pairs.sum(1)).sum())


def _add(gain, w, rows) -> None:
    if len(w):  # w ascends
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[starts]] += np.add.reduceat(rows, starts)


class Model:
    """Class bigrams and their smoothed logarithms; its size depends on the number of classes alone."""

    def __init__(self, pairs: np.ndarray, n: int, v: int, weight: float = WEIGHT):
        self.n, self.v, self.weight = n, v, weight
        totals = pairs.sum(0)
        share = (totals + ALPHA) / (totals.sum() + ALPHA * len(totals))
        # a class bigram's estimate leans on the class's own share as if it had been seen once more per class
        self.next = (pairs + len(totals) * share) / (pairs.sum(1, keepdims=True) + len(totals))
        self.totals = np.maximum(totals, 1)

    def scores(self, lengths, counts, classes):
        """base and score of each document; counts, classes: of its tokens."""
        unigram = (counts + ALPHA) / (self.n + ALPHA * (self.v + 1))
        unknown = ALPHA / (self.n + ALPHA * (self.v + 1))
        known = counts > 0
        end = len(self.next) - 1
        # the class of the last known token before each; a document starts after an end
        at = np.where(known, np.arange(len(classes)), -1)
        last = np.maximum.accumulate(at)
        before = np.r_[end, np.where(last >= 0, classes[last], end)[:-1]].astype(np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        before[starts] = end
        c = np.where(known, classes, end).astype(np.int64)
        by_class = np.where(known, (1 - unknown) * self.next[before, c] * counts / self.totals[c], unknown)
        mixed = self.weight * by_class + (1 - self.weight) * unigram
        return np.add.reduceat(np.log10(unigram), starts), np.add.reduceat(np.log10(mixed), starts), np.add.reduceat(known.astype(np.int64), starts)


def _answers(pdf, fields: tuple[int, ...]) -> list[np.ndarray]:
    """Arrays by local code out of the shards' answers to a block."""
    parts = [load(d) for d in pdf["data"]]
    at = np.concatenate([p[0] for p in parts]).astype(np.int64)
    out = []
    for f in fields:
        values = np.concatenate([p[f] for p in parts])
        a = np.zeros(len(at), values.dtype)
        a[at] = values
        out.append(a)
    return out


def scored(docs: DataFrame, held_out, classes: int = CLASSES, rounds: int = ROUNDS, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    held_out: a boolean Column of the documents that the model must not learn from.
    """
    spark = docs.sparkSession
    n_shards = shards(docs)
    gathered = written(blocks_of(docs, n_shards, held_out), "blocks")
    # dealt once; lost parts are read again from the written table
    payload = kept_on_disk(gathered.filter("shard = -1").select("block", "data").repartition(n_shards, "block"))
    answers = written(vocabulary(gathered.filter("shard >= 0")), "words")

    def largest(batches):
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                own, counts = load(data)
                top = np.argsort(-counts, kind="stable")[:classes]
                rows += [(int(h), int(counts[i]), 0, 0) for i, h in ((i, own[i].view(np.int64)) for i in top) if counts[i]]
                rows.append((None, 0, int(counts.sum()), int((counts > 0).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["hash", "n", "total", "kinds"])

    seen = answers.filter("block = -1").select("data").mapInArrow(largest, "hash bigint, n bigint, total bigint, kinds bigint")
    n, v = seen.agg(F.sum("total"), F.sum("kinds")).first()
    n, v = n or 0, v or 0
    end = int(np.uint64(_END).view(np.int64))
    top = [r[0] for r in seen.filter(F.col("hash").isNotNull() & (F.col("hash") != end)).orderBy(F.desc("n"), "hash").limit(classes - 2).collect()]
    first = {h: i for i, h in enumerate(top)} | {end: classes - 1}

    def start(batches):
        for batch in batches:
            rows = []
            for shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                own, counts = load(data)
                c = np.full(len(own), classes - 2, np.uint8)
                for i in np.flatnonzero(np.isin(own.view(np.int64), list(first))):
                    c[i] = first[int(own[i].view(np.int64))]
                rows.append((-1, shard, dump(np.where(counts > 0, c, NONE).astype(np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "data"])

    current = written(answers.filter("block = -1").select("shard", "data").mapInArrow(start, _ROWS), "classes")

    def tell(key, mine, now):
        """Shard to block: places and classes of the block's words, and their counts."""
        c = load(now["data"].iloc[0])[0]
        rows = []
        for b, data in zip(mine["block"], mine["data"]):
            at, word, counts = load(data)
            rows.append((b, key[0], dump(at, c[word], counts)))
        return _frame(rows)

    def told(current: DataFrame) -> DataFrame:
        return written(answers.filter("block >= 0").groupBy("shard").cogroup(current.groupBy("shard")).applyInPandas(tell, _ROWS), "told")

    def count_pairs(key, mine, said):
        import pandas as pd

        _, _, held, lengths, codes = load(mine["data"].iloc[0])
        c = _answers(said, (1,))[0][codes].astype(np.int64)
        before = np.r_[classes - 1, c[:-1]]
        before[np.r_[0, np.cumsum(lengths)[:-1]]] = classes - 1
        trains = np.repeat(held == 0, lengths)
        cells = np.bincount(before[trains] * classes + c[trains], minlength=classes * classes)
        at = np.flatnonzero(cells)
        return pd.DataFrame({"cell": at.astype("int32"), "n": cells[at].astype("int64")})

    def pairs_of(answered: DataFrame) -> np.ndarray:
        """Class bigrams: as many numbers as classes squared."""
        cells = payload.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(count_pairs, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect()
        out = np.zeros(classes * classes)
        for cell, count in cells:
            out[cell] = count
        return out.reshape(classes, classes)

    def neighbours(key, mine, said):
        """Block to shards: its words' counts of neighbour classes in training documents."""
        _, _, held, lengths, codes = load(mine["data"].iloc[0])
        of = np.concatenate([np.full(len(load(d)[0]), s) for s, d in zip(said["shard"], said["data"])])
        place = _answers(said, (1,))[0]
        at = np.concatenate([load(d)[0] for d in said["data"]]).astype(np.int64)
        shard = np.empty(len(at), np.int64)
        shard[at] = of
        c = place[codes].astype(np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        before = np.r_[classes - 1, c[:-1]]
        before[starts] = classes - 1
        after = np.r_[c[1:], classes - 1]
        after[np.cumsum(lengths) - 1] = classes - 1  # an end is followed by a start, which counts as an end's successor only before words
        trains = np.repeat(held == 0, lengths)
        words = len(place)
        sides = [np.bincount(codes[trains].astype(np.int64) * classes + x[trains], minlength=words * classes).astype(np.uint32).reshape(words, classes) for x in (before, after)]
        rows = []
        for s in np.unique(of):
            mine_at = np.flatnonzero(shard == s)
            cells = [side[mine_at].ravel() for side in sides]
            some = [np.flatnonzero(x) for x in cells]
            rows.append((key[0], int(s), dump(mine_at.astype(np.uint32), *[y for x, i in zip(cells, some) for y in (np.diff(i, prepend=0).astype(np.uint32), x[i])])))
        return _frame(rows)

    def improved(shared, one_in: int, turn: int):
        def run(key, news, mine):
            pairs = shared.value
            words = {b: load(d) for b, d in zip(mine["block"], mine["data"])}
            c = load(mine["now"].dropna().iloc[0])[0]
            counts = load(mine.loc[mine["block"] == -1, "data"].iloc[0])[1]
            sums = [np.zeros((len(c), classes), np.uint32) for _ in range(2)]
            for b, data in zip(news["block"], news["data"]):
                at, *parts = load(data)
                where, word, _ = words[b]
                own = word[np.searchsorted(where, at)] if np.all(where[1:] > where[:-1]) else word[np.argsort(where)][np.searchsorted(np.sort(where), at)]
                for side, (step, x) in zip(sums, (parts[:2], parts[2:])):
                    i = np.cumsum(step.astype(np.int64))
                    side[own[i // classes], i % classes] += x
            safe = np.where(c == NONE, 0, c)
            new = exchange(*sums, counts, safe, pairs)
            hashes_ = load(mine.loc[mine["block"] == -1, "data"].iloc[0])[0]
            new = np.where(moves_in(hashes_, one_in, turn), new, safe)
            return _frame([(-1, key[0], dump(np.where(c == NONE, NONE, new).astype(np.uint8)))])

        return run

    best, parts = None, 1
    for turn in range((rounds if n else 0) + 1):
        answered = told(current)
        pairs = pairs_of(answered)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = value, current, answered, pairs
        else:
            parts *= 2
        _, current, answered, pairs = best
        if turn == rounds or not n:
            break
        shared = spark.sparkContext.broadcast(pairs)
        news = payload.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(neighbours, _ROWS)
        state = answers.join(current.select("shard", F.lit(-1).cast("bigint").alias("block"), F.col("data").alias("now")), ["shard", "block"], "left").select("block", "shard", "data", "now")
        current = written(news.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(improved(shared, parts, turn), _ROWS), "classes")
        parts = max(parts, 2)
    shared = spark.sparkContext.broadcast(Model(pairs, n, v, weight))

    def score(key, mine, said):
        import pandas as pd

        ids, missing, held, lengths, codes = load(mine["data"].iloc[0])
        c, counts = (x[codes] for x in _answers(said, (1, 2)))
        base, score_, known = shared.value.scores(lengths, counts, c)
        doc_id = pd.Series(ids, dtype="Int64").mask(missing.astype(bool))
        return pd.DataFrame({"doc_id": doc_id, "held_out": held.astype(bool), "n_tokens": lengths.astype("int64"), "n_known": known, "train_tokens": np.full(len(ids), n, "int64"), "base_score": base, "score": score_})

    return payload.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
