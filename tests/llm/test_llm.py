"""The training-data operators: edge cases, and comparison with plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessel.llm import components, fingerprints, html_extract, license_scan, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, token_counts
from tessel.llm.common import fold

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, cls string, score string"
BASE = "the quick brown fox jumps over the lazy dog while a small cat sleeps under an old tree near the long river bank today"
TEXTS = [
    None, "", "   \n\t ", "one", "two words", "Ünïcode ﬁne  text here", "ÜNÏCODE fine text here", BASE, BASE, BASE.upper(), BASE + " again", BASE.replace("cat", "mouse"),
    "line one is here\nline one is here\n\nline two", "a b c d e f g h " * 40, "x" * 5000, "word " * 3000, "<|endoftext|> it's <b>#1</b> & $5 | %", "▁ ▁▁ a▁b", "中文 text 🎉 \x00 end",
    "Released under the MIT License.\nLicensed under CC BY-NC 4.0. and more", " ".join(f"w{i}" for i in range(4000)),
]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None, "clash", 1, "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [(3 * 7, BASE, "en", "s0", 3, None, None, None, None), (None, BASE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- 1 fingerprints ---


def plain_prints(docs):
    """Rows of edited_fingerprints(), by the order of descending ids, then unsigned hashes of texts."""
    rows = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2] % 2**64, r[1] or ""))
    want = Counter()
    for (i, t, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(t), fingerprints.digest(edited), float(fingerprints.digest(t) == fingerprints.digest(edited)), float(fingerprints.digest(t) == fingerprints.digest(following))] += 1
    return want


def test_fingerprints(docs, none):
    assert Counter(map(tuple, fingerprints.edited_fingerprints(docs).collect())) == plain_prints(docs)
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_many_documents_of_one_id(spark):
    """Rows of a null and of a repeated doc_id are dealt to several slots."""
    rng = random.Random(3)
    rows = [(rng.choice([None, None, 7, i]), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(12)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(map(tuple, fingerprints.edited_fingerprints(df).collect())) == plain_prints(df)
    slots = fingerprints.with_next(df).filter("not tail and doc_id is null").groupBy("slot").count().collect()
    assert len(slots) > 4


def test_canonical_form(docs):
    assert fingerprints.digest(TEXTS[5]) == fingerprints.digest(TEXTS[6]) == fingerprints.digest(" ünïcode FINE text here")
    assert fingerprints.digest(None) == fingerprints.digest(" \n") != fingerprints.digest("a")
    g = {r.fingerprint: r for r in fingerprints.groups(fingerprints.fingerprints(docs)).collect()}
    same = g[fingerprints.digest(BASE)]
    assert (same.group_id, same.n_copies) == (21, 5)
    assert fingerprints.mixed_buckets(docs.select("text")).count() == 0


def test_mixed_buckets_are_told_apart(docs, monkeypatch):
    """With a digest that is the same for all texts, fingerprints are equal exactly where canonical strings are."""
    rows = plain_prints(docs)
    digest = fingerprints.xxhash.xxh3_128_hexdigest
    want = Counter()
    for (i, n, sha, own, edited, near, following), count in rows.items():
        want[i, n, sha, near, following] += count

    class Same:
        xxh3_128_hexdigest = staticmethod(lambda x: "f" * 32)
        xxh3_128_digest = staticmethod(lambda x: b"\xff" * 16)

    monkeypatch.setattr(fingerprints, "xxhash", Same)
    got = fingerprints.edited_fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    assert all(r.fingerprint.startswith("f" * 32) for r in got)
    assert len({r.fingerprint for r in got}) == len({r[3] for r in rows}) and len({r.edited_fingerprint for r in got}) == len({r[4] for r in rows})
    prints = fingerprints.fingerprints(docs, keep_text=True).collect()
    assert len({r.fingerprint for r in prints}) == len({digest(fingerprints._bytes(r.text)) for r in prints})


def test_one_document(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")
    r = fingerprints.edited_fingerprints(one).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r[0].near_next == 1.0


# --- 2 quality rules ---


def base_counts(t):
    t = t or ""
    w, places, covered = WORDS.findall(t), defaultdict(list), set()
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    for p in places.values():
        if len(p) > 1:
            for i in p:
                covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none):
    got = quality_rules.judged(docs).collect()
    want = Counter((i, *base_counts(t)) for i, t in rows_of(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.rule is None)
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert 21 in {r.doc_id for r in got if r.kept}
    assert quality_rules.judged(none).count() == quality_rules.kept(none).count() == 0


def test_rule_order_follows_rejections_per_cost(spark):
    texts = spark.createDataFrame([("a b " * 300,)] * 900 + [("b" * 50,)] * 100, "text string")
    rare, often = quality_rules.Rule("rare", "length(text) = 50"), quality_rules.Rule("often", "length(text) > 50")
    dear = quality_rules.Rule("dear", " + ".join(f"regexp_count(text, '[a-z]+ b|{k}')" for k in range(12)) + " > 0")
    chain = [r.name for r in quality_rules.ordered(texts, [dear, rare, often])]
    assert chain.index("often") < chain.index("dear") and chain.index("often") < chain.index("rare")
    assert [r.name for r in quality_rules.ordered(texts.limit(0), [dear, rare, often])] == ["dear", "rare", "often"]


def test_sample_is_spread(spark):
    texts = spark.range(20_000, numPartitions=8).select(F.col("id").cast("string").alias("text"))
    got = [int(r.text) for r in quality_rules.sampled(texts).collect()]
    assert 800 < len(got) < 1200 and all(sum(k <= g // 2500 < k + 1 for g in got) > 80 for k in range(8))


def test_rules_on_very_long_words(spark):
    df = spark.createDataFrame([(1, "7" * 80_000), (2, " ".join("7" * 20_000 for _ in range(30))), (3, " ".join(["word"] + ["x" * 9000 + "é"] * 40))], "doc_id bigint, text string")
    start = time.time()
    assert {r.doc_id: r.kept for r in quality_rules.judged(df).collect()} == {1: False, 2: False, 3: False}
    assert quality_rules.kept(df).count() == 0 and time.time() - start < 60


# --- 3 language model ---


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    sides = [[f"{s}{i}" for i in range(40)] for s in "ab"]
    rows = []
    for i in range(600):
        own = sides[i % 2]
        rows.append((i, " ".join(rng.choice(own[: 1 + rng.randrange(40)]) for _ in range(rng.randrange(5, 60)))))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()


def base_scores(rows, held):
    tokens = [(i, [*WORDS.findall(lower(t or "")), None]) for i, t in rows]
    c = Counter()
    for i, w in tokens:
        if not held(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    return Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens)


def test_lm_base(docs, none):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = lm_scoring.scored(docs, fold("doc_id", 10) == 0).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base_scores(rows_of(docs), held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.scored(none, fold("doc_id", 10) == 0).count() == 0
    untrained = lm_scoring.scored(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def plain_scores(rows, held, classes, rounds):
    """The model learnt and the documents scored token by token, with nothing dealt out."""
    hashed = lambda w: xxhash.xxh3_64_intdigest(w)
    docs = [(i, [hashed(w) for w in WORDS.findall(lower(t or ""))] + [hashed("")]) for i, t in rows]
    count = Counter(w for i, d in docs if not held(i) for w in d)
    words, end = sorted(count), hashed("")
    n, v, at = sum(count.values()), len(count), {w: k for k, w in enumerate(sorted(count))}
    order = sorted((w for w in words if w != end), key=lambda w: (-count[w], int(np.uint64(w).view(np.int64))))
    first = {w: k for k, w in enumerate(order[: classes - 2])} | {end: classes - 1}
    now = np.array([first.get(w, classes - 2) for w in words], np.uint8)

    def counted(c):
        pairs, left, right = np.zeros((classes, classes)), np.zeros((v, classes), np.uint32), np.zeros((v, classes), np.uint32)
        for i, d in docs:
            if not held(i):
                k = [classes - 1] + [int(c[at[w]]) for w in d]
                for j, w in enumerate(d):
                    pairs[k[j], k[j + 1]] += 1
                    left[at[w], k[j]] += 1
                    right[at[w], k[j + 2] if j + 2 < len(k) else classes - 1] += 1
        return pairs, left, right

    best, parts = None, 1
    for turn in range(rounds + 1):
        pairs, left, right = counted(now)
        value = lm_scoring.likelihood(pairs)
        if best is None or value > best[0]:
            best = value, now, pairs, left, right
        else:
            parts *= 2
        _, now, pairs, left, right = best
        if turn < rounds:
            new = lm_scoring.exchange(left, right, np.array([count[w] for w in words]), now, pairs)
            now = np.where([(w >> 7) % parts == turn % parts for w in words], new, now).astype(np.uint8)
            parts = max(parts, 2)
    totals = pairs.sum(0)
    share = (totals + 0.1) / (totals.sum() + 0.1 * classes)
    out = Counter()
    for i, d in docs:
        score, before = 0.0, classes - 1
        for w in d:
            unigram, unknown = (count[w] + 0.1) / (n + 0.1 * (v + 1)), 0.1 / (n + 0.1 * (v + 1))
            own = unknown
            if count[w]:
                c = int(now[at[w]])
                own = (1 - unknown) * (pairs[before, c] + classes * share[c]) / (pairs[before].sum() + classes) * count[w] / max(totals[c], 1)
                before = c
            score += math.log10(0.9 * own + 0.1 * unigram)
        out[i, round(score, 6)] += 1
    return out


@pytest.mark.parametrize("classes,rounds", [(8, 3), (4, 5), (8, 0)])
def test_lm_scores_are_the_plain_ones(spark, corpus, docs, monkeypatch, classes, rounds):
    monkeypatch.setattr(lm_scoring, "BLOCK", 700)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for df in (corpus.limit(150), docs.filter("text is null or length(text) < 4000")):
        got = lm_scoring.scored(df, fold("doc_id", 10) == 0, classes, rounds).collect()
        assert Counter((r.doc_id, round(r.score, 6)) for r in got) == plain_scores(rows_of(df), held, classes, rounds)


def test_lm_learns_classes(corpus):
    rows = lm_scoring.scored(corpus, fold("doc_id", 10) == 0, classes=8).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.15


def test_lm_probabilities_sum_to_one():
    pairs = np.array([[5.0, 2, 1], [1, 4, 2], [2, 1, 0]])
    counts, classes = np.array([4, 4, 5, 2, 3]), np.array([0, 0, 1, 1, 2])
    assert [counts[classes == c].sum() for c in range(3)] == [8, 7, 3]
    m = lm_scoring.Model(pairs, 18, 5)
    m.totals = np.array([8.0, 7, 3])
    for history in (0, 2, 4):  # a word of each class
        total = 0.0
        for w in [*range(5), None]:
            c = np.array([counts[history], counts[w] if w is not None else 0])
            k = np.array([classes[history], classes[w] if w is not None else lm_scoring.NONE])
            first = m.scores(np.array([1]), c[:1], k[:1])[1][0]
            total += 10 ** (m.scores(np.array([2]), c, k)[1][0] - first)
        assert abs(total - 1) < 1e-9


def test_exchange_gain_is_the_likelihoods():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 6, 400)
    classes = np.array([0, 0, 1, 1, 0, 2], np.uint8)

    def pairs(c):
        out = np.zeros((3, 3))
        np.add.at(out, (c[text[:-1]], c[text[1:]]), 1)
        return out

    def value(c):
        m = pairs(c)
        return lm_scoring._phi(m).sum() - 2 * lm_scoring._phi(m.sum(0)).sum()

    left, right = np.zeros((6, 3), np.uint32), np.zeros((6, 3), np.uint32)
    np.add.at(left, (text[1:], classes[text[:-1]]), 1)
    np.add.at(right, (text[:-1], classes[text[1:]]), 1)
    new = lm_scoring.exchange(left, right, np.bincount(text), classes, pairs(classes))
    assert new[5] == 2  # the last class is the end token's
    for w in np.flatnonzero(new != classes):
        one = classes.copy()
        one[w] = new[w]
        assert value(one) > value(classes) - 3  # but for the word's own pairs


# --- 4 sentencepiece ---


def test_sentencepiece_is_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECE), PIECE)
    want = Counter()
    for i, t in rows_of(docs):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), np.asarray(ids, "<u4").tobytes(), sp.decode(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in coded.collect()) == want
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none, PIECE), PIECE).count() == 0
    small = sentencepiece_codec.encode(docs, PIECE, most=30)  # many blocks
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in small.collect()) == sum((Counter({k[:3]: n}) for k, n in want.items()), Counter())


def test_each_distinct_chunk_is_segmented_once(spark, docs, tmp_path, monkeypatch):
    """Over all blocks and tasks; a chunk's segmentation is seen by the file that it leaves."""
    folder = str(tmp_path)

    class Codec(sentencepiece_codec.ChunkCodec):
        def segmented(self, chunks):
            with open(f"{folder}/{random.random()}", "w") as f:
                f.write(repr(chunks))
            return super().segmented(chunks)

    monkeypatch.setattr(sentencepiece_codec, "ChunkCodec", Codec)
    sentencepiece_codec.encode(docs, PIECE, most=40).collect()
    import ast
    import os

    seen = Counter(c for name in os.listdir(folder) for c in ast.literal_eval(open(f"{folder}/{name}").read()))
    assert set(seen) == {c for _, t in rows_of(docs) for c in sentencepiece_codec.chunks_of(t)} and set(seen.values()) == {1}


def test_sentencepiece_on_random_texts():
    codec, rng = sentencepiece_codec.ChunkCodec(PIECE, most=50), random.Random(5)
    texts = ["".join(rng.choice(" \n▁aéB.x9½ß中🎉\x00") for _ in range(rng.randrange(30))) for _ in range(500)]
    for t, ids in zip(texts, codec.encode(texts)):
        want = codec.sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == codec.sp.decode(want)
    odd = [1, 3 + 0xFF, 3 + 0x80, 300, 2]
    assert codec.decode(np.asarray(odd, "<u4").tobytes()) == codec.sp.decode(odd)


# --- 5 packing ---


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs, WORD, seq_len=128).collect()
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows_of(docs))
    by_doc = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and p.ids_crc32 == zlib.crc32(p.ids) and p.offset + p.length <= 128
        by_doc[p.sequence_id, p.offset] = (p, ids.tolist())
    at, out, open_ = 0, Counter(), []
    for s, o in sorted(by_doc):
        p, ids = by_doc[s, o]
        assert s * 128 + o == at  # gapless, and every sequence but the last is full
        at += p.length
        assert p.start == len(open_)
        open_ += ids
        if len(open_) == p.doc_tokens:
            out[p.doc_id, tuple(open_)] += 1
            open_ = []
    assert out == want and not open_
    whole = packing.sequences(packing.pack(docs, WORD, seq_len=128)).collect()
    assert sum(r.n_tokens for r in whole) == at and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(none, WORD).count() == 0


def test_tokenizer_on_random_texts():
    codec, rng = packing.ChunkTokenizer(WORD, most=60), random.Random(7)
    texts = ["".join(rng.choice(" \n\x0b'aTsßÉçx9½.,<|>İ中🎉\x1c\xa0&") for _ in range(rng.randrange(30))) for _ in range(500)]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == codec.tokenizer.encode(t, add_special_tokens=False).ids


# --- 6 join ---


def plain_components(rows, width, percent):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = WORDS.findall(lower(t or ""))
        sets[n] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    least = defaultdict(list)
    for n in sets:
        least[find(n)].append(rows[n][0])
    return Counter((rows[n][0], len(sets[n]), min((i for i in least[find(n)] if i is not None), default=None)) for n in sets)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_edge_cases(docs, none, width, percent):
    got = Counter(map(tuple, ngram_join.linked(docs, width, percent).collect()))
    assert got == plain_components(rows_of(docs), width, percent)
    assert ngram_join.linked(none, width, percent).count() == 0


@pytest.mark.parametrize("frequent,percent,hot,most", [(3, 90, 64, 10**6), (2, 80, 2, 10**6), (1000, 90, 3, 10**6), (2, 90, 2, 40)])
def test_join_of_near_copies(spark, frequent, percent, hot, most):
    rng = random.Random(frequent)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(60)]
    rows = []
    for g in range(8):
        base = [word() for _ in range([6, 25, 80, 300, 1500, 120, 130, 700][g])] + shared * (g % 2)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, len(base) // 40])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own[: len(own) - rng.choice([0, 0, len(own) // 30])])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.linked(df, 3, percent, frequent, hot, most, 3).collect())) == plain_components(rows, 3, percent)


@pytest.mark.parametrize("width,percent,hot", [(3, 90, 20_000), (5, 80, 2)])
def test_links_are_all_links(spark, docs, width, percent, hot):
    """Pairs of classes and links of each document, against all pairs."""
    rng = random.Random(hot)
    near = [" ".join(f"{g}w{i}" if rng.random() > 0.01 else f"x{rng.randrange(9)}" for i in range(90)) for g in "abc" for _ in range(14)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id bigint, text string"))
    rows = rows_of(df)
    sets = [frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []) for w in (WORDS.findall(lower(t or "")) for _, t in rows)]
    like = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
    want = Counter((i, len(x), sum(like(x, y) for k, y in enumerate(sets) if k != n)) for n, ((i, _), x) in enumerate(zip(rows, sets)))
    pairs, members = ngram_join.links(df, width, percent, 3, hot, 3)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in members.collect()) == want
    distinct = list(set(sets))
    got = pairs.collect()
    assert len(got) == len(set(got)) == sum(like(x, y) for n, x in enumerate(distinct) for y in distinct[n + 1 :])


def test_frequent_tokens_never_run_out(spark):
    """Where more tokens than may be broadcast reach the highest count, a share of them is frequent."""
    rng = np.random.default_rng(4)
    rows = []
    for shard in range(3):
        tokens = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
        values = np.unique(np.concatenate([(tokens << np.uint64(12)) | np.uint64(c) for c in range(ngram_join.CLASSES)]))
        rows.append((shard, ngram_join.packed(values)))
    blobs = spark.createDataFrame(rows, "shard int, blob binary")
    assert len(ngram_join.frequent_tokens(blobs, 16, 1000)) == 600
    assert 150 < len(ngram_join.frequent_tokens(blobs, 16, 250)) < 350


@pytest.mark.parametrize("percent", [80, 90])
def test_prefix_keys_and_bands_find_all_links(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.choice([2, 5, 20, 60, 126, 130, 500, 1020, 3000, 9000]))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        rate = rng.random() * (100 - percent) / 100
        b = np.unique(np.r_[a[rng.random(len(a)) > rate], rng.integers(0, 1 << 62, int(rng.integers(0, 2 + int(n * rate / 2))), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        share = np.uint64(1000 * rng.choice([0.0, 0.5, 0.97, 1.0]))
        often = lambda s: s % np.uint64(1000) < share  # noqa: E731, B023
        keys = [dict(zip(np.concatenate([k for k, _ in got]).tolist(), np.concatenate([r for _, r in got]).tolist())) for got in (ngram_join.prefix_keys(s, often(s), percent) for s in (a, b))]
        found = [k for k in keys[0].keys() & keys[1].keys() if min(len(a) - keys[0][k], len(b) - keys[1][k]) * (100 + percent) >= percent * (len(a) + len(b))]
        assert found or len(a) == len(b) == both
        bands = [{x for c in ngram_join.size_classes(len(s), percent) for x in ngram_join.bands_of(ngram_join.sketch_of(s, percent), c, percent)} for s in (a, b)]
        assert bands[0] & bands[1]


def test_a_passage_in_many_documents(spark):
    """Documents that are one passage and a little of their own: most pairs cannot link by their sizes and places alone."""
    passage = [f"p{i}" for i in range(62)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(8)])) for i in range(300)]
    rows += [(1000 + i, " ".join(passage + [f"near{i}"])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.linked(df, hot=20).collect())) == plain_components(rows, 3, 90)


def test_sketch_never_loses_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.05], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])
        x, y = (np.frombuffer(ngram_join.sketch_of(s), np.uint8)[None] for s in (a, b))
        x, y = (ngram_join.folded(s, min(x.shape[1], y.shape[1])) for s in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_sets_of_some_hundred_that_half_agree_are_told_apart_where_they_meet(spark):
    """The members of a key make rows for the pairs that may link, not for all: their sketches have room for what is unlike."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 1 << 62, 300, dtype=np.uint64)]) for _ in range(60)]
    sets += [np.unique(np.r_[sets[0][k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)]) for k in (5, 20, 50)]
    classes = spark.createDataFrame([(i, len(s), bytearray(ngram_join.sketch_of(s, 80))) for i, s in enumerate(sets)], "cls bigint, size int, sketch binary")
    rows = classes.crossJoin(spark.range(2).selectExpr("id as key")).selectExpr("key", "cls", "size as n", "0 as r", "cls as component", f"{len(sets)} as m")
    apart = rows.join(ngram_join.with_folded(classes), "cls")
    want = {(0, 60), (0, 61), (0, 62), (60, 61), (60, 62), (61, 62)}
    assert Counter(map(tuple, ngram_join.met(apart, 80, 7).collect())) == {p: 2 for p in want}
    assert set(map(tuple, ngram_join.met_sorted(apart, 2, 80).collect())) == want


@pytest.mark.parametrize("most", [0, 10**6])
def test_texts_of_many_or_few_documents(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST_WANTED", most)
    rows = [(i, " ".join(f"{k}w{j}" for j in range(40)) + (" tail" if i % 2 else "")) for i, k in enumerate("aabbccdd")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.linked(df).collect())) == plain_components(rows, 3, 90)


def test_packed_numbers():
    for values in ([], [0], [5, 6, 2**40 - 1]):
        a = np.array(values, np.uint64)
        assert np.array_equal(ngram_join.unpacked(ngram_join.packed(a)), a)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 9), (10, 8), (8, 7), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 10: 7, 9: 9}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_a_shuffled_path(spark):
    for n, step in ((3000, 1), (1000, 4)):  # step: links to so many on either side
        rng = random.Random(n)
        ids = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        edges = [(ids[i], ids[i + k]) for i in range(n) for k in range(1, step + 1) if i + k < n]
        got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert sorted(r.node for r in got) == sorted(ids) and {r.component for r in got} == {min(ids)}


@pytest.mark.parametrize("turned", [False, True])
def test_join_of_repeated_and_null_ids(spark, turned):
    text = lambda k, a, b: " ".join(f"{k}{i}" for i in range(a, b))
    rows = [(1, text("a", 0, 60)), (1, text("b", 0, 60)), (2, text("a", 0, 61)), (3, text("b", 0, 61)), (1, text("c", 0, 60)), (4, text("c", 0, 61))]
    rows += [(5, text("n", 0, 60)), (None, text("n", 4, 62)), (6, text("n", 6, 66)), (None, text("m", 0, 60)), (None, text("m", 0, 61)), (7, text("m", 0, 62))]
    rows = rows[::-1] if turned else rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert Counter(map(tuple, ngram_join.linked(df).collect())) == plain_components(rows, 3, 90)


def test_join_of_a_chain_of_revisions(spark):
    words = [f"w{i}" for i in range(420)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(250)]
    random.Random(6).shuffle(rows)
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=96).collect()
    assert len(got) == 250 and {r.component_id for r in got} == {0}


# --- 7 token counts ---


def rollup_rows(r):
    return Counter({(x.source, x.lang, x.tokenizer_version, k): x[k] for x in r.totals().collect() for k in token_counts.SUMS if x[k]})


def test_rollup(spark, docs, none, tmp_path):
    words, T = token_counts.word_count, token_counts
    r = T.Rollup(spark, f"file://{tmp_path}/store")
    assert r.totals().count() == 0 and r.committed() == []
    assert r.commit("a", T.inserted(docs, "words", words)) and not r.commit("a", T.inserted(docs, "words", words))
    want = Counter()
    for d in docs.collect():
        n = len(WORDS.findall(d.text or ""))
        for k, x in (("n_docs", 1), ("n_tokens", n), ("n_chars", len(d.text or ""))):
            want[d.source, d.lang, "words", k] += x
    assert rollup_rows(r) == +want
    assert r.commit("empty", T.inserted(none, "words", words)) and rollup_rows(r) == +want
    en = docs.filter("lang = 'en'")
    assert r.commit("b", T.revised(en, en, "words", "pieces", words, T.sentencepiece_count(PIECE)))
    assert not any(k[1] == "en" and k[2] == "words" for k in rollup_rows(r))
    before = rollup_rows(r)
    r.compact()
    assert r.committed() == ["a", "b", "empty"] and len(r._taken()) == 1 and rollup_rows(r) == before
    assert not r.commit("a", T.inserted(docs, "words", words)) and rollup_rows(r) == before
    assert r.vacuum() == 0 and r.vacuum(-60) == 6 and rollup_rows(r) == before and len(r._entries()) == 1
    r.commit("undo", T.deleted(docs.filter("lang is null or lang != 'en'"), "words", words))
    r.commit("undo2", T.deleted(en, "pieces", T.sentencepiece_count(PIECE)))
    assert r.totals().count() == 0
    with pytest.raises(ValueError):
        r.commit("../x", T.inserted(docs, "words", words))


def test_rollup_counts_are_the_libraries(spark, docs, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)
    r = token_counts.Rollup(spark, f"file://{tmp_path}/store")
    r.commit("a", token_counts.inserted(docs, "word", token_counts.tokenizer_count(WORD)))
    r.commit("b", token_counts.inserted(docs, "piece", token_counts.sentencepiece_count(PIECE)))
    want = Counter()
    for d in docs.collect():
        want[d.source, d.lang, "word", "n_tokens"] += len(tok.encode(d.text or "", add_special_tokens=False).ids)
        want[d.source, d.lang, "piece", "n_tokens"] += len(sp.encode(d.text or ""))
    assert Counter({k: n for k, n in rollup_rows(r).items() if k[3] == "n_tokens"}) == +want


def test_rollup_survives_a_kill_at_any_point(spark, docs, tmp_path, monkeypatch):
    batch = lambda: token_counts.inserted(docs, "words", token_counts.word_count)
    r = token_counts.Rollup(spark, f"file://{tmp_path}/store")
    r.commit("a", batch())
    r.commit("b", batch())
    before = rollup_rows(r)

    class Killed(Exception):
        pass

    def killed(*_):
        raise Killed

    for name in ("_write", "_enter"):
        for run in (lambda: r.commit("c", batch()), r.compact):
            with monkeypatch.context() as m, pytest.raises(Killed):
                m.setattr(r, name, killed)
                run()
            assert rollup_rows(r) == before and r.committed() == ["a", "b"]

    class Fs:  # dies with the entry written and not yet in place
        def __getattr__(self, name):
            return killed if name == "rename" else getattr(fs, name)

    fs = r._fs
    for run in (lambda: r.commit("c", batch()), r.compact):
        r._fs = Fs()
        with pytest.raises(Killed):
            run()
        r._fs = fs
        assert rollup_rows(r) == before and not r.commit("a", batch())
    assert r.commit("c", batch()) and r.committed() == ["a", "b", "c"]
    r.compact()
    assert rollup_rows(r) == Counter({k: n // 2 * 3 for k, n in before.items()})


def test_rollup_of_racing_runs(spark, docs, tmp_path, monkeypatch):
    batch = lambda: token_counts.inserted(docs, "words", token_counts.word_count)
    one, two = (token_counts.Rollup(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.commit("a", batch())
    once = rollup_rows(one)
    with monkeypatch.context() as m:  # neither sees the other's batch before it commits
        m.setattr(one, "committed", lambda: [])
        m.setattr(two, "committed", lambda: [])
        assert [one.commit("b", batch()), two.commit("b", batch())].count(True) >= 1
    assert rollup_rows(one) == Counter({k: 2 * n for k, n in once.items()}) and one.committed() == ["a", "b"]
    stale = one._taken()
    two.commit("c", batch())
    with monkeypatch.context() as m:  # a compaction that has not seen c, and one that has
        m.setattr(one, "_taken", lambda: stale)
        one.compact()
    two.compact()
    one.vacuum(-60)
    assert rollup_rows(two) == Counter({k: 3 * n for k, n in once.items()}) and two.committed() == ["a", "b", "c"]


# --- 8 classifier ---


def test_classifier(spark, docs, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join(word() + ("" if good else "%%%") for _ in range(rng.randrange(5, 60))), 1 if good else 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int"))
    machine = quality_classifier.train(df, labels.filter("doc_id < 200 or doc_id is null"))
    out = quality_classifier.scored(df, machine).filter("doc_id >= 200").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in out) / len(out) > 0.97
    edge = quality_classifier.scored(docs, machine, ["doc_id"]).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality_classifier.scored(none, machine).count() == quality_classifier.kept(none, machine).count() == 0
    kept = quality_classifier.kept(docs, machine, 0.4)  # a column named score is the documents' own
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edge if r.score >= 0.4)
    blank = quality_classifier.train(df, labels.limit(0))
    assert {r.score for r in quality_classifier.scored(df, blank).collect()} == {0.5}


def plain_inputs(text, buckets, metadata=()):
    """Inputs of a text, counted one by one: {index: value}."""
    q, out = quality_classifier, Counter()
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    shape = lambda w: re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa" if m[0].istitle() else "aA", w)))[:24]
    kinds = Counter(xxhash.xxh32_intdigest(w) % buckets for w in words), Counter(xxhash.xxh32_intdigest(shape(w), 1) % buckets for w in words)
    for part, c in enumerate(kinds):
        norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in c.values()))
        for k, n in c.items():
            out[part * buckets + k] += (1 + math.log(n)) / norm
    n, chars, lines = max(1, len(words)), max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    of = lambda pattern: len(re.findall(pattern, text))
    hashed = [xxhash.xxh32_intdigest(w) % buckets for w in words]
    stats = [
        min(1, math.log10(1 + len(words)) / 5), min(1, sum(map(len, words)) / n / 16), sum(ch.isalpha() for ch in text) / chars, of("[A-ZÀ-Þ]") / chars, of("[0-9]") / chars, min(1, of("[#*$%&|<>!]") / n),
        len(kinds[0]) / n, max(kinds[0].values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)), min(1, len(lines) / n * 4), 1 - len(set(zip(hashed, hashed[1:]))) / max(1, n - 1) if n > 1 else 0, min(1, of("[.,;:?]") / n),
    ]
    for k, x in enumerate(stats):
        out[2 * buckets + k] += x
        out[2 * buckets + 12 + 8 * k + min(7, int(8 * x))] += 0.5
    for m in metadata:
        out[2 * buckets + 12 * 9 + xxhash.xxh32_intdigest(m) % q.META] += 1
    return out


def test_scores_are_those_of_all_pairs(spark):
    """A machine's scores, in batches, against every pair of inputs taken by itself."""
    rng = np.random.default_rng(0)
    m = quality_classifier.Machine(buckets=16, factors=3, metadata=("n", "key"))
    m.w, m.v, m.w0 = rng.normal(size=m.w.shape), 0.3 * rng.normal(size=m.v.shape), 0.3
    texts = [t for t in TEXTS if t is None or len(t) < 400] + ["ABC def-GHI 12_3 Ünï!!! ..  x\n\nx", "İ 🎉🎉 9½"]
    df = spark.createDataFrame([(i, t, None if i % 5 == 0 else i - 3, "k" if i % 2 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, n int, key string")
    got = {r.doc_id: r.score for r in quality_classifier.scored(df, m, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        x = i - 3
        number = "\0null" if i % 5 == 0 else f"{(x > 0) - (x < 0)}^{int(math.log2(1 + abs(x)))}"
        own = plain_inputs(t or "", 16, (f"n={number}", "key=" + ("k" if i % 2 else "\0null")))
        pairs = sum(m.v[a] @ m.v[b] * own[a] * own[b] for a in own for b in own if a < b)
        want = 1 / (1 + math.exp(-max(-30, min(30, m.w0 + sum(m.w[k] * x for k, x in own.items()) + pairs))))
        assert abs(got[i] - want) < 1e-4


def test_metadata_can_decide(spark):
    rows = [(i, "some words that say nothing", "wiki" if i % 2 else None, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string, quality int")
    machine = quality_classifier.train(df, df.select("doc_id", "quality"), metadata=("site",))
    assert all((r.score >= 0.5) == (r.quality == 1) for r in quality_classifier.scored(df, machine).collect())


# --- 9 licences ---


def test_licenses(docs, none):
    got = {(r.doc_id, r.license, r.n_different) for r in license_scan.scan(docs).collect()}
    assert got == {(57, "MIT", 0), (57, "CC-BY-NC-4.0", 0)}
    assert license_scan.scan(none).count() == 0
    s = license_scan.Scanner()
    filler = " ".join(f"word{i}" for i in range(400))
    found = s.scan(f"{filler} Licensed under the Apache License, Version 2.0. {filler}\nno licence is given here")
    assert [(x[0], x[3]) for x in found] == [("Apache-2.0", 0)]
    long = license_scan.TEMPLATES["MIT-text"].replace("free of charge", "free of all charge").replace(", to any", ",\nto any")
    found = s.scan("intro\n" + long + "\noutro")
    assert [(x[0], x[3]) for x in found] == [("MIT-text", 1)]
    text = "x Released under the MIT License. y"
    (name, a, b, n, saved), = s.scan(text)
    assert text[a:b] == "Released under the MIT License" and saved > license_scan.LEAST_SAVED


def test_altered_words_at_either_end():
    """Found with one difference, whatever the words before and behind are."""
    s, rng = license_scan.Scanner(), random.Random(1)
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        if s.most[name] and name not in ("GPL-2.0", "GPL-3.0"):  # whose last word names the licence
            for k in (0, -1):
                own = list(words)
                own[k] = "altered"
                if not s.candidate.search(" ".join(own)):  # it was the only licensing word
                    continue
                sides = [[words[k] if x == 5 else f"w{rng.randrange(99)}" for x in range(rng.choice([7, 12, 70]))] for _ in range(2)]
                found = [(x[0], x[3]) for x in s.scan(" ".join(sides[0] + own + sides[1]))]
                assert found == [(name, 1)], (name, k, found)


def test_equal_templates_go_by_name():
    s = license_scan.Scanner({k: license_scan.TEMPLATES["MIT"] for k in "BAC"})
    assert [x[0] for x in s.scan("x Released under the MIT License. y")] == ["A"]


@pytest.mark.parametrize("n_words", [100, 300, 600, 1000, 3000, 20000])
def test_unaltered_notice_in_a_long_line(n_words):
    s, rng = license_scan.Scanner(), random.Random(n_words)
    for name, template in license_scan.TEMPLATES.items():
        words = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
        words.insert(rng.randrange(n_words), template)
        assert [(x[0], x[3]) for x in s.scan(" ".join(words))] == [(name, 0)]


def test_notices_beside_each_other():
    s, names = license_scan.Scanner(), list(license_scan.TEMPLATES)
    text = " ".join(license_scan.TEMPLATES[k] for k in names + ["MIT", "MIT"])
    assert [(x[0], x[3]) for x in s.scan(text)] == [(k, 0) for k in names + ["MIT", "MIT"]]


def test_notices_that_wrap(spark):
    s = license_scan.Scanner()
    assert [(x[0], x[3]) for x in s.scan("Some words of prose before it. Released under\nthe MIT License.")] == [("MIT", 0)]
    rows = []
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        for k in range(1, len(words)):
            for gap in ("\n", "\r\n", "\n# "):
                rows.append((len(rows), "Some words of prose before it. " + " ".join(words[:k]) + gap + " ".join(words[k:]) + " Some behind it.", name))
    got = {(r.doc_id, r.license, r.n_different) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, license string")).collect()}
    assert got == {(i, name, 0) for i, _, name in rows}


# --- 10 html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First  <b>para</b>\ngraph&nbsp;here.<br><p>Short.</p><!-- no --><div class="ad">Buy</div><aside>Side</aside><form><p>Mail</p></form>
<p>3 < 4 &lt;b&gt; &eacute;</p><noscript><p>js</p></noscript></article><section id="comments"><p>the best of the posts</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == ["Head & line", "First para graph here.", "Short.", "3 < 4 <b> é"]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""


def test_blocks_without_an_article():
    good = "This is the text of the page and it has the words that are in all of the texts, as one can see. " * 4
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><p>{good}</p><p>Short one.</p><p>{good}</p><div><a href=z>{good}</a></div><p>\xa9 2020</p></body>"
    assert html_extract.main_text(page).split("\n") == [good.strip(), "Short one.", good.strip()]


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{}</article></body>", "<html class='no-ads'><body><article>{}</article></body></html>", "<main class='search-page'>{}</main>",
    "<article class='post has-comments'>{}</article>", "<div class='content with-sidebar'><article>{}</article></div>", "<div class='content with-sidebar'>{}<article><p>More.</p></article></div>",
    "<div class='content with-sidebar'>{}</div>", "<div id=widget><div class='social'><main>{}</main></div></div>", "<div class='menu'><p>No</p></div><div class='with-menu'><div><article>{}</article></div></div><div class='ad'>No</div>",
])
def test_class_names_do_not_drop_an_article(page):
    assert "First paragraph.\nSecond one." in html_extract.main_text(page.format("<p>First paragraph.</p><div class='sidebar'><p>No</p></div><p>Second one.</p>")).replace("\nMore.", "")
    assert "No" not in html_extract.main_text(page.format("<p>First paragraph.</p><div class='sidebar'><p>No</p></div><p>Second one.</p>"))


def test_boilerplate_that_holds_articles_goes():
    page = "<main><article><p>Text.</p><div class='related'><article><p>Teaser</p></article></div></article><ol class='comments'><li><article class='comment'><p>Me</p></article></ol><aside><article><p>Aside</p></article></aside></main>"
    assert html_extract.main_text(page) == "Text."


def test_links_in_an_article():
    page = "<article><p><a href=x>A whole sentence that is a link.</a></p><p>See <a href=x>this long page</a>, <a href=y>that</a>.</p><ul><li><a href=x>Only a link</a></li><li>An item with words.</li></ul>"
    nav = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div><a href=x>Back</a> | <a href=y>Next</a></div></article>"
    assert html_extract.main_text(page + nav).split("\n") == ["A whole sentence that is a link.", "See this long page, that.", "Only a link", "An item with words."]


def plain_labels(found):
    """Both passes with nested loops."""
    h, out = html_extract, []
    page = any(b.inside == "article" for b in found)
    for k, b in enumerate(found):
        words = re.findall(r"\w+", b.text.lower())
        stops = sum(w in h.STOP_WORDS for w in words) / max(1, len(words))
        much = b.links / max(1, sum(ch != " " for ch in b.text)) > 0.33
        if page and much:
            mates = [x for x in found if x.in_list == b.in_list]
            much = len(mates) > 1 and all(x.links / max(1, sum(ch != " " for ch in x.text)) > 0.33 for x in mates) if b.in_list >= 0 else b.of not in h.PROSE and b.n_links > 1
        if b.inside == "boiler" or page and b.inside != "article":
            out.append(("bad", False))
        elif much:
            out.append(("bad", not page))
        elif len(b.text) >= 200 and stops >= 0.25:
            out.append(("good", True))
        elif not page and ("\xa9" in b.text or len(b.text) >= 70 and stops < 0.15):
            out.append(("bad", True))
        else:
            out.append(("", False))
    final = []
    for k, (label, _) in enumerate(out):
        near = sorted((abs(i - k), i) for i, (_, words) in enumerate(out) if words)
        final.append(label or (out[near[0][1]][0] if near else "good" if page or len(found[k].text) >= 70 else "bad"))
    return final


def test_both_passes_are_the_plain_ones():
    rng = random.Random(9)
    seen = Counter()
    for n in range(600):
        found = []
        for _ in range(rng.randrange(1, 14)):
            words = ["the", "of"] if rng.random() < 0.5 else ["some", "thing"]
            text = " ".join(rng.choice(words + ["prose", "here"] * rng.randrange(3)) for _ in range(rng.choice([1, 3, 12, 20, 60]))) + rng.choice(["", "", " \xa9"])
            inside = rng.choice(["", "", "boiler"] if n % 2 else ["article", "article", "", "boiler"])
            found.append(html_extract.Block(text, rng.choice([0, 0, 0, len(text)]), inside, n_links=rng.randrange(3), of=rng.choice(["p", "div", "li"]), in_list=rng.choice([-1, -1, 1, 2])))
        want = plain_labels(found)
        seen.update(want)
        assert [b.label for b in html_extract.decide(found)] == want
    assert min(seen["good"], seen["bad"]) > 500


@pytest.mark.parametrize("name", ["market share", "related-work", "x hidden y", "tag-line social-science", "adverb"])
def test_names_that_are_no_boilerplate(name):
    page = f"<body><article><h1>Title</h1><p class='{name}'>A paragraph of the article.</p><p id='{name}'>And one more.</p></article></body>"
    assert html_extract.main_text(page) == "Title\nA paragraph of the article.\nAnd one more."


@pytest.mark.parametrize("tag", ["div class='cookie-notice'", "section id='postComments'", "p class=ad", "div class='site-nav mobile'", "div hidden", "p style='color: red; display: none'", "ul class='share-buttons'", "div class='article-footer'", "div role=complementary"])
def test_names_that_are_boilerplate(tag):
    page = f"<body><article><h1>Title</h1><p>Text.</p><{tag}>Not of it.</{tag.split()[0]}><p>More.</p></article></body>"
    assert html_extract.main_text(page) == "Title\nText.\nMore."


def test_open_anchors_are_no_links_for_the_rest_of_the_page():
    good = "This is the text of the page and it has the words that are in all of the texts, as one can see. " * 4
    for anchor in ("<a name=top>", "<a href=x>Open", "<A HREF='x'>Open <a href=y>twice"):
        page = f"<body><div>{anchor}</div><p>{good}</p><p>Short.</p></body>"
        assert html_extract.main_text(page).split("\n")[-2:] == [good.strip(), "Short."]
        assert html_extract.main_text(f"<article><p>{anchor}</p><div>First <i>one</i> here</div><div>Next.</div></article>").endswith("First one here\nNext.")


def test_extract(spark):
    schema = "page_id bigint, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (None, None, None, None), (3, "x", "<p>" + "the and of " * 20000, None)], schema)
    rows = html_extract.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.n_chars for r in rows if r.page_id == 3} == {len(("the and of " * 20000).strip())}
    assert html_extract.extract(df.limit(0)).count() == 0
