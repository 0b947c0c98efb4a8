"""The pipeline against a plain version of each stage, on a small table."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tessel.llm import ngram_join, packing, quality_classifier, quality_rules

from .test_llm import BASE, TEXTS, plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "x", 1, "x", "x", "x") for i, t in enumerate([*TEXTS, BASE + " more", *[f"{BASE} {BASE.replace('o', 'u')} {k}" for k in range(3)]])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _id int, component_id string, h string, row string").repartition(3)


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "packing"]
    now = docs
    judged = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        after = Counter(r.doc_id for r in now.collect())
        if name == "quality_rules":
            assert after == Counter(i for i, _ in before if judged[i])
        elif name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            m = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, metadata=("n_chars",))
            assert after == Counter(i for i, t in before if m.score(t, "n_chars=\0null") >= 0.5)
        else:
            assert after == Counter({i: 1 for i, _, c in plain_components(before, 5, 80).elements() if i == c})
    pieces = corpus_pipeline.packing_stage(spark, now, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in now.collect()}


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    codec = packing.ChunkTokenizer.of(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(n == len(codec.encode([texts[i]])[0]) // 4 + 1 for i, n in total.items())
    bad = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0]
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1]
    assert not set(total) & set(bad) and len(set(total) & set(good)) > 0.8 * len(good)


def test_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (None, BASE + " " + BASE.upper(), None, None, None), (4, BASE, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
    assert ngram_join.linked(df).count() == df.count()


def test_one_document_of_each_group_stays(spark):
    near = BASE + " " + BASE.replace("o", "u")
    rows = [(None, near), (3, near + " tail"), (3, near + " tail"), (3, near), (7, near), (None, "alone " + near[::-1]), (None, "alone " + near[::-1]), (9, None), (9, None)]
    got = ngram_join.firsts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), 5, 80).collect()
    assert Counter(r.doc_id for r in got) == {3: 1, None: 1, 9: 2}
