"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct shingles of `width` words (its tokens).
Documents link when the Jaccard similarity of their sets is at least `percent`
hundredths. Equal sets are one class, so copies never form pairs.

Prefixes. All tokens are put in one order: rare ones first, each class of
frequency by hash. Two sets that link share so many tokens that the first k
they share are within the first n - ceil(percent * n / 100) + k of either. If
the first one they share is rare, it is in the prefix for k = 1 of both, and a
single-token key finds the pair. Otherwise all they share are frequent. These
are dealt by hash to g groups; of the first g + 1 that both have two fall into
one group, so a key of two frequent tokens of one group, from the prefix for
k = g + 1, finds the pair. g grows with the set's size (1 for short ones), so
that keys stay in proportion to the prefix however long a set is; sets near
the next size's bound make that one's keys too. A token is frequent when
FREQUENT classes have it, counted over all documents in hash shards. Which
tokens count as frequent changes the cost and never the result.

Verification. The members of a key are first compared with its least member.
Links found that way join most of a large group of near copies at the price of
one comparison each; then only pairs of a key that are still in different
components are compared, where their sizes, places and folded sketches (parities
of tokens by hash) allow a link: those of small keys in sorted partitions; members
of larger ones are dealt to blocks, and pairs of blocks to tasks. Where a key still has very many, they are dealt on by bands of
their sketches: sets that link differ in few tokens, so that of one band more
than that one is equal in both. Their pairs are found by sizes and places
first, so that members of no two sizes that cannot link meet. Texts of the
documents that take part are compared by whole sets.

Edge cases: a null or empty text, and one without words, has an empty set and
is a component of its own; fewer words than `width` make one token; very long
texts are one set like any other; repeated rows share a class; an empty table
yields an empty one; rows with one doc_id and different texts are compared
each; a null doc_id is kept, links like any other and is never the id of a
component unless it has no other member; ties of frequency and of the least
member go by hash; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, distinct_sorted, id_text, lower_ascii, rare_collections, released, shards, words_of, written
from .components import components

WIDTH = 3
PERCENT = 90
#: A token of so many classes is frequent.
FREQUENT = 16
#: Frequent tokens that are broadcast, at 8 bytes each. Where there are more, FREQUENT is doubled, to CLASSES at
#: most; where there are still more, a share of them by hash is treated as frequent.
MOST_FREQUENT = 4_000_000
#: Values that classes are counted by: a token's count goes no further.
CLASSES = 1 << 12
#: Members of a key, left in different components, that meet each other directly, and of these that one task has at once
#: on either side. Keys with more go through bands, which cost some fifty rows a member.
HOT, BLOCK = 20_000, 2_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S32 = np.uint64(29), np.uint64(32)


def mixed(a, b):
    h = a * _M1
    h = (h ^ (h >> _S29)) + b
    h = h * _M2
    return h ^ (h >> _S32)


def token_set(text: str | None, width: int = WIDTH, table: WordHashes | None = None) -> np.ndarray:
    """The sorted distinct 64-bit token hashes of a text; table: words' hashes that a task keeps."""
    words = words_of(lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words), len(words))], np.uint64)
    hashes = (WordHashes() if table is None else table).of(words)
    n = len(hashes) - width + 1
    h = hashes[:n] * _M3
    for k in range(1, width):
        h = mixed(h, hashes[k : k + n])
    return distinct_sorted(h)


def class_of(tokens: np.ndarray) -> int | None:
    """Signed 64-bit id of an equal-set class."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else None


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit integers as compressed differences."""
    diff = np.diff(values, prepend=np.uint64(0))
    return len(values).to_bytes(4, "little") + zstandard.compress(np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


#: Bits of the smallest sketch, and of a band at least.
SKETCH, BAND = 2048, 12


def size_class(n: int) -> int:
    return n.bit_length() - 1


def size_classes(n: int, percent: int) -> list[int]:
    """A set's power of two, and the next if a set of that size can link with it: of any two that link, one of the larger's is among the other's."""
    c = size_class(n)
    return [c, c + 1] if 100 * n >= percent << (c + 1) else [c]


def most_apart(c: int, percent: int) -> int:
    """Tokens in which two sets that link can differ, of sizes below that of class c + 1."""
    return (100 - percent) * (1 << (c + 2)) // (100 + percent)


def sketch_bits(c: int, percent: int) -> int:
    """Bits of the sketches of size class c: enough for bands of the next class."""
    return max(SKETCH, 1 << (BAND * most_apart(c + 1, percent)).bit_length())


def sketch_of(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of how many tokens fall on each bit: two sketches differ in no more bits than their sets in tokens."""
    bits = sketch_bits(size_class(len(tokens)), percent)
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches as the smaller sketches of the same sets; size: bytes."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, size), 1) if sketches.shape[1] > size else sketches


def bands_of(sketch: bytes, c: int, percent: int) -> list[int]:
    """Hashes of a sketch's bands for size class c: one more than the tokens that can differ, so one is equal in both."""
    bits = np.unpackbits(folded(np.frombuffer(sketch, np.uint8)[None], sketch_bits(c - 1, percent) // 8)[0])
    n = most_apart(c, percent) + 1
    cuts = np.linspace(0, len(bits), n + 1).astype(np.int64)
    return [xxhash.xxh3_64_intdigest(np.packbits(bits[x:y]).tobytes(), (c << 32) + i) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]


class _Lately:
    """The classes that a task has had lately."""

    def __init__(self, most: int = 500_000):
        self.seen: set[int] = set()
        self.most = most

    def new(self, cls: int | None) -> bool:
        if cls is None or cls in self.seen:
            return False
        if len(self.seen) > self.most:
            self.seen.clear()
        self.seen.add(cls)
        return True


def _place(tokens: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard and 32 bits of each token: what frequencies are counted by."""
    return ((tokens >> np.uint64(40)) % np.uint64(n_shards) << _S32) | (tokens & np.uint64(0xFFFFFFFF))


def gathered(docs: DataFrame, n_shards: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Two kinds of rows from one scan, told apart by shard.

    shard null: doc_id, h (hash of the text), n (set size), cls (null: empty
    set), sketch of every document. Else blob: a task's tokens of this shard with twelve bits of their
    class, as packed numbers.
    """
    kinds = {"doc_id": pa.int64(), "h": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "sketch": pa.binary(), "shard": pa.int32(), "blob": pa.binary()}

    def rows_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()], list(kinds))

    def run(batches):
        rare_collections()
        lately, table, held, total = _Lately(), WordHashes(), [], 0

        def tokens_out():
            values = distinct_sorted(np.concatenate(held))
            held.clear()
            shard = (values >> np.uint64(44)).astype(np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            rows = [(int(shard[a]), packed(values[a:b] & np.uint64((1 << 44) - 1))) for a, b in zip(cuts, cuts[1:])]
            return rows_of(len(rows), shard=[r[0] for r in rows], blob=[r[1] for r in rows])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, classes, sketches = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = token_set(text, width, table)
                    cls = class_of(tokens)
                    n.append(len(tokens))
                    classes.append(cls)
                    sketches.append(sketch_of(tokens, percent) if cls is not None else None)
                    if lately.new(cls):
                        held.append((_place(tokens, n_shards) << np.uint64(12)) | np.uint64(cls & (CLASSES - 1)))
                        total += len(tokens)
                yield rows_of(len(n), doc_id=part.column(0), h=part.column(2), n=n, cls=classes, sketch=sketches)
                if total > 1_500_000:
                    yield tokens_out()
                    held, total = [], 0
        if held:
            yield tokens_out()
        released()

    return id_text(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, h bigint, n bigint, cls bigint, sketch binary, shard int, blob binary")


def frequent_tokens(blobs: DataFrame, frequent: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted places of the tokens that at least `frequent` classes have; blobs: shard, blob of gathered().

    Two tokens of one place count as one, which makes them more frequent and
    nothing else.
    """

    def count(key, pdf):
        import pandas as pd

        values = distinct_sorted(np.concatenate([unpacked(b) for b in pdf["blob"]])) >> np.uint64(12)
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        tokens, n = values[starts], np.diff(np.r_[starts, len(values)])
        often = n >= frequent
        return pd.DataFrame({"shard": [key[0]], "tokens": [tokens[often].astype("<u4").tobytes()], "n": [n[often].astype("<u2").tobytes()]})

    per_shard = written(blobs.groupBy("shard").applyInPandas(count, "shard int, tokens binary, n binary"), "frequent")
    floor = frequent
    level = lambda f: per_shard.agg(F.sum(_at_least(f)("n"))).first()[0] or 0
    while (reached := level(floor)) > most and level(2 * floor):
        floor *= 2
    keep = _over(floor, min(1.0, most / max(1, reached)))
    parts = [np.frombuffer(r[1], "<u4").astype(np.uint64) | (np.uint64(r[0]) << _S32) for r in per_shard.select("shard", keep("tokens", "n")).toLocalIterator()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _at_least(floor: int):
    @F.pandas_udf("bigint")
    def how_many(n):
        return n.map(lambda x: int((np.frombuffer(x, "<u2") >= floor).sum()))

    return how_many


def _over(floor: int, share: float):
    @F.pandas_udf("binary")
    def keep(tokens, n):
        import pandas as pd

        out = []
        for t, x in zip(tokens, n):
            got = np.frombuffer(t, "<u4")[np.frombuffer(x, "<u2") >= floor]
            out.append((got[(got.astype(np.uint64) * _M1 >> _S32) <= np.uint64(share * 0xFFFFFFFF)] if share < 1 else got).tobytes())
        return pd.Series(out)

    return keep


class Frequent:
    """Membership in a sorted array, most often settled by a bit map."""

    def __init__(self, places: np.ndarray):
        self.places, self.map = places, np.zeros(1 << 22, bool)
        self.map[(places & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, places: np.ndarray) -> np.ndarray:
        out = self.map[(places & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            found = np.searchsorted(self.places, places[at])
            found[found == len(self.places)] = 0
            out[at] = self.places[found] == places[at]
        return out


def n_groups(c: int, percent: int) -> int:
    """Groups of frequent tokens for sets of size class c."""
    return max(1, (1 << c) * (100 - percent) // 160)


def prefix_keys(tokens: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of rare tokens, and of pairs of frequent ones in one group; each with the number of tokens that its place in the order shows to be unshared."""
    n = len(tokens)
    first = n - -(-percent * n // 100) + 1
    rare, common, hot = tokens[~often], tokens[often], [(tokens[:0], np.empty(0, np.int64))]
    for g in sorted({n_groups(c, percent) for c in size_classes(n, percent)}):
        few = common[: max(0, first + g - len(rare))]
        of = (few >> np.uint64(17)) % np.uint64(g)
        order = np.argsort(of, kind="stable")
        few, of, place = few[order], of[order], len(rare) + order
        for step in range(1, len(few)):
            i = np.flatnonzero(of[step:] == of[:-step])
            if not len(i):
                break
            # of the tokens before a pair's second one, each group has one at most that both sets have
            hot.append((mixed(mixed(few[i], few[i + step]), np.uint64(g)), np.maximum(place[i + step] - g, 0)))
    return [(rare[:first], np.arange(len(rare[:first]))), tuple(np.concatenate(x) for x in zip(*hot))]


def index(docs: DataFrame, often: np.ndarray, n_shards: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, cls, n, r, hot (of frequent tokens): the prefix keys of every class; copies may repeat rows.

    r: how many of the set's tokens are not shared where the key is the first
    that both sets have; where it isn't, the pair may be passed over.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        rare_collections()
        is_often, lately, table = Frequent(shared.value), _Lately(), WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for text in batch.column(0).slice(start, 256).to_pylist():
                    tokens = token_set(text, width, table)
                    cls = class_of(tokens)
                    if not lately.new(cls):
                        continue
                    often_ = is_often(_place(tokens, n_shards))
                    for hot, (got, places) in enumerate(prefix_keys(tokens, often_, percent)):
                        if len(got):
                            out.append((got, cls, len(tokens), places, bool(hot)))
                if out:
                    size = [len(o[0]) for o in out]
                    column = lambda i, t: pa.array(np.repeat(np.array([o[i] for o in out], t), size))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), column(1, np.int64), column(2, np.int32), pa.array(np.concatenate([o[3] for o in out]).astype(np.int32)), column(4, bool)], ["key", "cls", "n", "r", "hot"])
        released()

    return id_text(docs).select("text").mapInArrow(run, "key bigint, cls bigint, n int, r int, hot boolean")


def may_link(x, y, percent: int):
    """Whether sets x and y, columns (n, r), can link if the key is the first that both have: all they share is at most what either has beside its r."""
    most = F.least(x[0] - x[1], y[0] - y[1]).cast("bigint")
    return most * 100 >= (x[0] + y[0] - most) * percent


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, cls, n, r, leader, leader_n, leader_r: the rows of every key that several classes have; leader: the one with the least r."""
    rows = rows.distinct()
    lead = rows.groupBy("key").agg(F.min(F.struct("r", "cls", "n")).alias("l"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    return rows.join(lead.select("key", F.col("l.cls").alias("leader"), F.col("l.n").alias("leader_n"), F.col("l.r").alias("leader_r")), "key")


def whole_keys(batches):
    """The columns of sorted batches, cut where a key of the first column ends."""
    held = None  # the run of equal keys that may go on in the next batch
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = np.searchsorted(columns[0], columns[0][-1], "left")
        held = [c[cut:] for c in columns]
        yield [c[:cut] for c in columns]
    if held is not None:
        yield held


def shared_keys_sorted(rows: DataFrame, n_parts: int) -> DataFrame:
    """The same of keys with few rows each, in one pass over sorted partitions."""

    def run(batches):
        for columns in whole_keys(batches):
            yield runs(*columns)

    def runs(key, r, cls, n):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, r, cls, n = key[new], r[new], cls[new], n[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[starts, len(key)])
        lead, many = np.repeat(starts, size), np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (key, cls, n, r, cls[lead], n[lead], r[lead])], ["key", "cls", "n", "r", "leader", "leader_n", "leader_r"])

    dealt = rows.select("key", "r", "cls", "n").repartition(n_parts, "key").sortWithinPartitions("key", "r", "cls")
    return dealt.mapInArrow(run, "key bigint, cls bigint, n int, r int, leader bigint, leader_n int, leader_r int")


#: Documents to compare whose ids and hashes are broadcast, 16 bytes each; where there are more, texts are joined by shuffle.
MOST_WANTED = 500_000


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) whose sketches allow a link; classes: cls, size, sketch. No linked pair is left out."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array(batch.column(i).to_pylist(), object) for i in (4, 5))
            size = np.array([(len(a), len(b)) for a, b in zip(x, y)])
            differ = np.zeros(batch.num_rows, np.int64)
            for m, k in {tuple(s) for s in size.tolist()}:
                at = np.flatnonzero((size[:, 0] == m) & (size[:, 1] == k))
                one, two = (folded(np.frombuffer(b"".join(v[at]), np.uint8).reshape(len(at), -1), min(m, k)) for v in (x, y))
                differ[at] = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= (100 - percent) * n))

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b: classes) that link; classes: cls, doc, h (a document that has it, whose id may be null or another's too, and the hash of its text)."""
    wanted = written(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", "doc", "h"), "cls"), "wanted")
    same = lambda x, y: x.doc.eqNullSafe(y.doc) & (x.h == y.h)

    def compress(batches):
        pack, lately = zstandard.ZstdCompressor(level=1), _Lately()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = [r for r in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns)) if lately.new(r[::2])]
                z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for _, t, _ in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(z, pa.binary())], ["doc", "h", "z"])

    own = id_text(docs).withColumnRenamed("doc_id", "doc").withColumn("h", F.xxhash64("text"))
    if wanted.count() <= MOST_WANTED:
        few = wanted.select("doc", "h").distinct()
        own = own.join(F.broadcast(few), same(own, few), "left_semi")
    texts = own.mapInArrow(compress, "doc bigint, h bigint, z binary")
    texts = written(wanted.join(texts, same(wanted, texts)).select("cls", "z"), "texts", "none")
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")

    def compare(batches):
        rare_collections()
        known: dict[int, np.ndarray] = {}
        table = WordHashes()

        def tokens(cls, z):
            if cls not in known:
                if len(known) > 2000:
                    known.clear()
                known[cls] = token_set(zstandard.decompress(z).decode("utf-8", "surrogatepass"), width, table)
            return known[cls]

        for batch in batches:
            out = []
            for a, b, za, zb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = tokens(a, za), tokens(b, zb)
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both_ >= percent * (len(x) + len(y) - both_):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(compare, "a bigint, b bigint").distinct()


#: Columns of a sketch folded to 64 bits each, by which most unlike sets are told apart where they meet: 1,024 bits, as fewer
#: are full of unlike tokens, and tell nothing, from sets of some hundred on. Rows of bands carry FEWER of them, folded once more.
FOLDED, FEWER = [f"s{i}" for i in range(16)], [f"s{i}" for i in range(4)]


def with_folded(classes: DataFrame) -> DataFrame:
    """cls and the sketch as FOLDED."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            bits = np.array([folded(np.frombuffer(b, np.uint8)[None], 8 * len(FOLDED))[0] for b in blobs], np.uint8).reshape(-1, 8 * len(FOLDED)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(bits.T))], ["cls", *FOLDED])

    return classes.select("cls", "sketch").mapInArrow(run, "cls bigint, " + ", ".join(f"{c} bigint" for c in FOLDED))


def banded(apart: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """apart with each key made finer by the bands of its members' sketches; pairs that link stay together under one key at least."""
    names = ["key", "cls", "n", "r", "component", *FEWER]
    few = [reduce(Column.bitwiseXOR, map(F.col, FOLDED[i :: len(FEWER)])).alias(c) for i, c in enumerate(FEWER)]
    rows = apart.join(classes.select("cls", "sketch"), "cls").select(*names[:5], *few, "sketch")

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys, at = [], []
                for i, (key, cls, n, sketch) in enumerate(zip(*(part.column(k).to_pylist() for k in ("key", "cls", "n", "sketch")))):
                    if cls not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[cls] = [b for c in size_classes(n, percent) for b in bands_of(sketch, c, percent)]
                    keys += [xxhash.xxh3_64_intdigest(b.to_bytes(8, "little"), key & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for b in known[cls]]
                    at += [i] * len(known[cls])
                rest = part.select(names[1:]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *rest.columns], names)

    return rows.mapInArrow(run, "key bigint, cls bigint, n int, r int, component bigint, " + ", ".join(f"{c} bigint" for c in FEWER))


def unlinked(x: str, y: str, percent: int, sketch: list[str] = FOLDED):
    """Whether rows x and y of one key are in different components and may link by sizes, places and folded sketches."""
    c = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in sketch), F.lit(0))
    alike = differ * (100 + percent) <= (c(x, "n") + c(y, "n")) * (100 - percent)
    return (c(x, "component") != c(y, "component")) & may_link((c(x, "n"), c(x, "r")), (c(y, "n"), c(y, "r")), percent) & alike


def _pair(x: str, y: str) -> list:
    return [F.least(f"{x}.cls", f"{y}.cls").alias("a"), F.greatest(f"{x}.cls", f"{y}.cls").alias("b")]


def met(apart: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of unlinked() classes of one key; apart has m, a key's members, too. Members of a key are dealt to blocks, and pairs of blocks to tasks."""
    rows = apart.withColumn("of", F.ceil(F.col("m") / block).cast("int")).withColumn("at", F.pmod(F.xxhash64("cls"), "of").cast("int"))
    x = rows.withColumn("i", F.col("at")).withColumn("j", F.explode(F.sequence("at", F.col("of") - 1))).alias("x")
    y = rows.withColumn("j", F.col("at")).withColumn("i", F.explode(F.sequence(F.lit(0), "at"))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.cls") < F.col("y.cls"))
    return x.join(y, same & once & unlinked("x", "y", percent)).select(*_pair("x", "y"))


def met_sorted(apart: DataFrame, n_parts: int, percent: int = PERCENT) -> DataFrame:
    """The same for keys of few members each, in one pass over sorted partitions; a batch tells each pair once."""

    def run(batches):
        for columns in whole_keys(batches):
            yield pairs(*columns)

    def pairs(key, cls, n, r, component, *sketch):
        bits = np.ascontiguousarray(np.stack(sketch, 1)).view(np.uint64)
        n, most = n.astype(np.int64), (n - r).astype(np.int64)
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.empty(0, np.int64)
        behind = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(key))  # members of the key after this one
        x, step, found = np.flatnonzero(behind), 1, [np.empty((2, 0), np.int64)]
        while len(x):
            i = x[component[x] != component[x + step]]
            j = i + step
            shared = np.minimum(most[i], most[j])
            may = shared * 100 >= (n[i] + n[j] - shared) * percent
            i, j = i[may], j[may]
            alike = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            a, b = cls[i[alike]], cls[j[alike]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            step += 1
            x = x[behind[x] >= step]
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = apart.select("key", "cls", "n", "r", "component", *FOLDED).repartition(n_parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def met_by_kind(apart: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same for keys of many members: sizes and places meet first, each once for a key, and only where two of them allow a link their members."""
    kinds = apart.groupBy("key", "n", "r").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    x, y = kinds.alias("x"), kinds.alias("y")
    ordered = F.struct("x.n", "x.r") <= F.struct("y.n", "y.r")
    several = F.least("x.least", "y.least") != F.greatest("x.most", "y.most")
    kinds = x.join(y, (F.col("x.key") == F.col("y.key")) & ordered & several & may_link((F.col("x.n"), F.col("x.r")), (F.col("y.n"), F.col("y.r")), percent))
    kinds = kinds.select(F.col("x.key").alias("key"), F.col("x.n").alias("n"), F.col("x.r").alias("r"), F.col("y.n").alias("n2"), F.col("y.r").alias("r2"))
    left = kinds.join(apart, ["key", "n", "r"]).alias("x")
    y = apart.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.n2") == F.col("y.n")) & (F.col("x.r2") == F.col("y.r"))
    return left.join(y, same & (F.col("x.cls") != F.col("y.cls")) & unlinked("x", "y", percent, FEWER)).select(*_pair("x", "y"))


@dataclass(frozen=True)
class Join:
    """What is known of the documents before any are compared: tables of documents, of classes and of the members of keys that several classes have."""

    docs: DataFrame
    signed: DataFrame  # doc_id, h (hash of the text), n (set size), cls (null: empty set), sketch
    classes: DataFrame  # cls, doc, h (the class's least document), size, sketch
    members: DataFrame  # key, cls, n, r, leader, leader_n, leader_r
    width: int
    percent: int

    def verified(self, pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, self.docs, self.classes, self.width, self.percent), "links")

    def stars(self) -> DataFrame:
        """Pairs (a, b) of a key's members and its leader that may link."""
        x, y = (F.col("n"), F.col("r")), (F.col("leader_n"), F.col("leader_r"))
        pairs = self.members.filter((F.col("cls") != F.col("leader")) & may_link(x, y, self.percent))
        pairs = pairs.select(F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b")).distinct()
        return written(likely(pairs, self.classes, self.percent), "pairs")

    def rest(self, labels: DataFrame, hot: int, block: int) -> DataFrame:
        """Distinct pairs (a, b) of different components (labels: node, component; others are their own) that share a key and may link."""
        apart = self.members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", "r", F.coalesce("component", "cls").alias("component"))
        split = apart.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")).filter("x != y").select("key", "m")
        apart = written(apart.join(split, "key").join(with_folded(self.classes), "cls"), "apart")
        pairs = met_sorted(apart.filter(F.col("m") <= min(block, hot)), shards(self.docs), self.percent)
        dealt, many = apart.filter((F.col("m") > block) & (F.col("m") <= hot)), apart.filter(F.col("m") > hot)
        if dealt.limit(1).count():
            pairs = pairs.union(met(dealt, self.percent, block))
        if many.limit(1).count():
            finer = written(banded(many, self.classes, self.percent), "bands")
            several = finer.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
            pairs = pairs.union(met_by_kind(finer.join(several, "key"), self.percent))
        return likely(pairs.distinct(), self.classes, self.percent)


def prepared(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT) -> Join:
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, so that linked sets share two tokens")
    n_shards = shards(docs)
    scanned = written(gathered(docs, n_shards, width, percent), "sets")
    signed = scanned.filter("shard is null").select("doc_id", "h", "n", "cls", "sketch")
    often = frequent_tokens(scanned.filter("shard is not null").select("shard", "blob"), frequent, most_frequent)
    keys = written(index(docs, often, n_shards, width, percent), "keys")
    members = written(shared_keys_sorted(keys.filter("not hot"), n_shards).unionByName(shared_keys(keys.filter("hot").select("key", "cls", "n", "r"))), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("l")  # null ids last
    classes = signed.filter("cls is not null").groupBy("cls").agg(first, F.max("n").alias("size"), F.max("sketch").alias("sketch"))
    classes = written(classes.select("cls", F.col("l.doc_id").alias("doc"), F.col("l.h").alias("h"), "size", "sketch"), "classes")
    return Join(docs, signed, classes, members, width, percent)


def placed(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, hot: int = HOT, most_frequent: int = MOST_FREQUENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, h, n, cls of every document, and cls, doc, h (the class's least document), component of every class."""
    join = prepared(docs, width, percent, frequent, most_frequent)
    stars = join.stars()
    edges = join.verified(stars)
    labels = components(edges)
    rest = written(join.rest(labels, hot, block).join(stars, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        more = join.verified(rest)
        if more.limit(1).count():
            labels = components(edges.union(more))
    own = join.classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc", "h", F.coalesce("component", "cls").alias("component"))
    return join.signed.select("doc_id", "h", "n", "cls"), written(own, "placed")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The join itself: all linked pairs (a, b) of classes of equal sets, a < b, and doc_id, n_shingles, cls, n_links of every document.

    n_links: documents that link with it, those of its own class included, itself
    not. Every pair that shares a key and may link is compared, so the cost
    follows the number of links, which components do without.
    """
    join = prepared(docs, width, percent, frequent)
    alone = join.classes.select(F.col("cls").alias("node"), F.col("cls").alias("component"))
    pairs = join.verified(written(join.rest(alone, hot, block), "pairs"))
    size = join.signed.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.union(pairs.select("b", "a")).join(size.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("near"))
    count = size.join(both, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    rows = join.signed.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(count, "cls", "left")
    return pairs, rows.select("doc_id", "n_shingles", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, hot: int = HOT, most_frequent: int = MOST_FREQUENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    signed, own = placed(docs, width, percent, frequent, hot, most_frequent, block)
    least = own.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = own.join(least, "component").select("cls", "component_id")
    return signed.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def firsts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns, without all documents but one of each component: that of least doc_id, null ids last, ties by hash of the text.

    Rows that share both doc_id and text count as one document; documents
    without words all stay.
    """
    signed, own = placed(docs, width, percent)
    best = own.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "h")).alias("l"))
    stay = best.select(F.col("l.doc").alias("d"), F.col("l.h").alias("x")).union(signed.filter("cls is null").select("doc_id", "h").distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    kept = row.join(stay, F.col("i").eqNullSafe(F.col("d")) & (F.col("t") == F.col("x")), "left_semi")
    twice = signed.filter("cls is not null").groupBy("doc_id", "h").count().filter("count > 1")
    if twice.limit(1).count():  # rows that stand for one document several times
        again = twice.select(F.col("doc_id").alias("d"), F.col("h").alias("x"))
        same = F.col("i").eqNullSafe(F.col("d")) & (F.col("t") == F.col("x"))
        one = kept.join(again, same, "left_semi").groupBy("i", "t").agg(F.first("row").alias("row")).select("row", "i", "t")
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.select("row.*")
