"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_extract, license_scan, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, token_counts
from .common import fold, new_folder, table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("rule")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a recount of German under another tokenizer, the withdrawal of a source's English documents, and the load once more."""
    docs = table(spark, sf_dir, "documents")
    word, piece = "word_bpe_49k", "piece_bpe_32k"
    by_word, by_piece = token_counts.tokenizer_count(public_tokenizers.path(f"{word}.json")), token_counts.sentencepiece_count(public_tokenizers.path(f"{piece}.model"))
    rollup = token_counts.Rollup(spark, new_folder(spark, "token-counts"))
    rollup.commit("load-1", token_counts.inserted(docs, word, by_word))
    german = docs.filter("lang = 'de'")
    rollup.commit("recount-2", token_counts.revised(german, german, word, piece, by_word, by_piece))
    hot = docs.filter("source = 'src0' and lang = 'en'")
    rollup.commit("withdraw-3", token_counts.deleted(hot, word, by_word))
    rollup.commit("load-1", token_counts.inserted(docs, word, by_word))  # a batch that comes again changes nothing
    rollup.compact()
    return rollup.totals()


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_classifier.train(docs, labels.filter(fold("doc_id", 3) != 1), metadata=("n_chars",))
    scores = quality_classifier.scored(docs, machine, ["doc_id"])
    return scores.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("n_found"), F.min("n_different").alias("least_different"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


_OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(8)) as k from twice) group by doc_id),
ln as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
lines as (select doc_id, count(*) as n, count(*) - count(distinct l) as dup from ln group by doc_id),
m as (
  select w.doc_id, text, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(coalesce(lines.dup, 0) as bigint) as n_dup_lines, coalesce(lines.n, 0) as n_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) as n_letter_words,
    length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) as n_upper
  from w left join lines using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 100 * n_dup_lines > 50 * n_lines or 2 * n_upper > word_chars or 100 * n_letter_words < 70 * n_words) as kept
from m
"""


# Shingle sets, all linked pairs that share a shingle, then least reachable ids: a plain restatement for small tables.
_OP6_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as both_ from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * both_ >= 90 * (nx.n + ny.n - both_)),
e as (select x as a, y as b from l union all select y, x from l),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(least(d.doc_id, coalesce(c.m, d.doc_id)) as bigint) as component_id
from d left join n using (doc_id) left join (select node, min(seen) as m from r group by node) c on c.node = d.doc_id
"""

# The notices as whole phrases; the tables hold no altered ones.
_OP9_SQL = """
with t as (select * from (values {}) as t(license, phrase)),
m as (select doc_id, license, cast((length(text) - length(replace(text, phrase, ''))) / length(phrase) as bigint) as n_found from documents, t where text like '%' || phrase || '%')
select doc_id, license, n_found, cast(0 as bigint) as least_different from m
""".format(", ".join(f"('{k}', '{v[:-1]}')" for k, v in license_scan.TEMPLATES.items() if "'" not in v and k not in ("Apache-2.0-header", "MIT-text")))

# Pages here have one article of h1 and p; other blocks lie outside it.
_OP10_SQL = r"""
with b as (select page_id, url, unnest(string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(?:h1|p)>')) as t, generate_subscripts(string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(?:h1|p)>'), 1) as i from pages),
c as (select page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as t from b),
j as (select page_id, string_agg(t, chr(10) order by i) as text from c where t <> '' group by page_id)
select page_id, url, coalesce(j.text, '') as text, cast(length(coalesce(j.text, '')) as bigint) as n_chars from pages left join j using (page_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_quality_rules, op3_lm_scoring, op4_sentencepiece, op5_packing, op6_ngram_jaccard_join, op7_token_counts, op8_quality_classifier, op9_license_scan, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2_SQL, "op6_ngram_jaccard_join": _OP6_SQL, "op9_license_scan": _OP9_SQL, "op10_html_extraction": _OP10_SQL}
