"""A corpus pipeline of four stages, each over all that the one before kept.

quality rules (rejected documents go), quality classifier (documents scored
under 0.5 go), n-gram Jaccard join (the document with the least id of each
group stays), packing. Every stage but the last returns the columns of
documents.

Edge cases are those of the operators: documents without text fail the rules;
ties and repeated rows: of documents that share one doc_id in a group the one
of least hash stays, of rows that repeat a document one; a null doc_id is a
document like any other and the last of its group; extra columns of any name
pass through all stages but the last; an empty table stays empty and packs into
no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import ngram_join, packing, quality_classifier, quality_rules
from tessel.llm.common import table, written

#: Likelihood of good quality that a document needs to stay.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality_classifier.kept(docs, machine, LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.firsts(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality_rules", quality_stage), ("quality_classifier", classifier_stage), ("ngram_jaccard_join", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express neither the trained classifier nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
