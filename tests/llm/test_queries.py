"""The registered queries of this subpackage against their SQL, and the columns of the others."""

import pytest

from compare import SF, check
from tessel.llm import queries

COLUMNS = {
    "op1_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_token_counts": "source lang tokenizer_version n_docs n_tokens n_chars",
    "op8_quality_classifier": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


def test_held_out_quality(spark):
    """Scores of documents whose labels were not learnt."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_token_counts_against_the_libraries(spark):
    """What is left after the load, the recount of German and the withdrawal, counted text by text."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    sp, tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if not (r.source == "src0" and r.lang == "en"):
            piece = r.lang == "de"
            n = len(sp.encode(r.text or "")) if piece else len(tok.encode(r.text or "", add_special_tokens=False).ids)
            key = r.source, r.lang, "piece_bpe_32k" if piece else "word_bpe_49k"
            want[key] = [a + b for a, b in zip(want.get(key, [0, 0, 0]), (1, n, len(r.text or "")))]
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op7_token_counts(spark, SF).collect()}
    assert got == want
