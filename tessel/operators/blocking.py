"""Candidate generation: prefix keys, their fuzzy neighbours, and the items behind them.

Catalog rows have item_id (bigint), code, name, compname, pack, strength.
Every step is an equi-join: a query word's key finds like keys through shared
two-letter signatures, never through a cross product of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import ratio

#: Like keys that a query word may use in each index, and how alike they must be.
MOST_KEYS, LEAST_LIKE = 40, 60
#: Characters of a key.
KEY = 3


def prepared(catalog: DataFrame) -> DataFrame:
    """The catalog with norm and tokens of each name and norm of each company; meant to be cached or written once."""
    return catalog.select("*", T.search_form("name").alias("norm"), T.tokens("name").alias("tokens"), T.search_form("compname").alias("comp_norm"))


def key_of(norm: Column) -> Column:
    """The first letters of the first word; null without words."""
    return F.when(norm != "", F.substring(F.substring_index(norm, " ", 1), 1, KEY))


def classes(items: DataFrame) -> DataFrame:
    """Items that all searches treat alike up to the last ranking: norm, comp_key, n_items, first_item."""
    return items.select("item_id", "norm", key_of(F.col("comp_norm")).alias("comp_key")).groupBy("norm", "comp_key").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"))


def postings(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows (idx, key, carried): idx says whether the name's or the company's first word has the key. rows: norm, comp_key."""
    both = F.explode(F.array(F.struct(F.lit("name").alias("idx"), key_of(F.col("norm")).alias("key")), F.struct(F.lit("company").alias("idx"), F.col("comp_key").alias("key"))))
    return rows.select(*carried, both.alias("k")).select("k.idx", "k.key", *carried).filter("key is not null")


def posting_lists(kinds: DataFrame) -> DataFrame:
    """A5: idx, key, n_items, first_item of every key; kinds from classes()."""
    return postings(kinds, "n_items", "first_item").groupBy("idx", "key").agg(F.sum("n_items").alias("n_items"), F.min("first_item").alias("first_item"))


def signatures(key: Column) -> Column:
    """Parts that any two keys with a ratio of 60 or more share: two letters in order, or one if either key is one letter."""
    at = lambda i: F.substring(key, i, 1)
    n = F.length(key)
    one = F.when(n <= 2, F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))).otherwise(F.array().cast("array<string>"))
    two = F.when(n == 2, F.array(key)).when(n >= 3, F.array(F.concat(at(1), at(2)), F.concat(at(1), at(3)), F.concat(at(2), at(3)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(one, two))


def like_keys(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (probe, idx, key, score): per probe and index the MOST_KEYS likest keys, the earlier in the catalog first on ties.

    probes: distinct column probe; keys: idx, key, first_item.
    """
    left = probes.select("probe", F.explode(signatures(F.col("probe"))).alias("part"))
    right = keys.select("idx", "key", "first_item", F.explode(signatures(F.col("key"))).alias("part"))
    pairs = left.join(right, "part").select("probe", "idx", "key", "first_item").distinct()
    scored = pairs.withColumn("score", ratio(F.col("probe"), F.col("key"))).filter(F.col("score") >= LEAST_LIKE)
    best = W.partitionBy("probe", "idx").orderBy(F.desc("score"), "first_item")
    return scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= MOST_KEYS).select("probe", "idx", "key", "score")


def probes_to_keys(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (probe, idx, key): equal keys, like keys, and for short probes the keys that start with them."""
    equal = probes.join(keys, probes.probe == keys.key).select("probe", "idx", "key")
    like = like_keys(probes, keys).select("probe", "idx", "key")
    heads = keys.select("idx", "key", F.explode(F.array_distinct(F.array(F.substring("key", 1, 1), F.substring("key", 1, 2)))).alias("probe"))
    short = probes.filter(F.length("probe") < KEY).join(heads, "probe").select("probe", "idx", "key")
    return equal.unionByName(like).unionByName(short).distinct()


def query_words(queries: DataFrame) -> DataFrame:
    """PF5: distinct (norm, probe) of the words that are no numbers. queries: column norm."""
    each = queries.filter("norm != ''").select("norm").distinct().select("norm", F.explode(T.words(F.col("norm"))).alias("word"))
    return each.filter(~F.col("word").rlike(r"^\d+\.?\d*$")).select("norm", F.substring("word", 1, KEY).alias("probe")).distinct()


def found_keys(queries: DataFrame, kinds: DataFrame) -> DataFrame:
    """Distinct (norm, idx, key) for the distinct norms of queries; kinds from classes()."""
    own = query_words(queries)
    keys = posting_lists(kinds).select("idx", "key", "first_item")
    return own.join(probes_to_keys(own.select("probe").distinct(), keys), "probe").select("norm", "idx", "key").distinct()


def names_behind(kinds: DataFrame) -> DataFrame:
    """idx, key, i_norm, name_key, n_items, first_item: the distinct names behind each key, with the items that the key leads to."""
    posts = postings(kinds.select("norm", "comp_key", F.col("norm").alias("i_norm"), "n_items", "first_item"), "i_norm", "n_items", "first_item")
    return posts.groupBy("idx", "key", "i_norm").agg(F.sum("n_items").alias("n_items"), F.min("first_item").alias("first_item")).withColumn("name_key", key_of(F.col("i_norm")))


def candidate_names(queries: DataFrame, kinds: DataFrame) -> DataFrame:
    """(norm, i_norm, comp_key, n_items, first_item): what each norm is compared with, every item under one row.

    comp_key is null where all items of the name are candidates, as the name's
    key was found; else those of this company key are. A name that both keys
    lead to is left to the first, by an anti-join of keys: no pair of norm and
    name is ever sorted out by a shuffle.
    """
    found, names = found_keys(queries, kinds), names_behind(kinds)
    by_name = found.filter("idx = 'name'").select("norm", "key").join(names.filter("idx = 'name'").drop("name_key"), "key")
    behind = names.filter("idx = 'company'")
    combos = behind.select("key", "name_key").distinct()
    left = found.filter("idx = 'company'").select("norm", "key").join(combos, "key")
    left = left.join(found.filter("idx = 'name'").select("norm", F.col("key").alias("name_key")), ["norm", "name_key"], "left_anti")
    # names without words have no key and are found by company alone
    bare = found.filter("idx = 'company'").select("norm", "key").join(behind.filter("name_key is null").drop("name_key"), "key")
    by_company = left.join(behind, ["key", "name_key"]).drop("name_key").unionByName(bare)
    columns = lambda df, key: df.select("norm", "i_norm", key.alias("comp_key"), "n_items", "first_item")
    return columns(by_name, F.lit(None).cast("string")).unionByName(columns(by_company, F.col("key")))


def candidates(queries: DataFrame, items: DataFrame) -> DataFrame:
    """J6 by item: distinct (norm, item_id); items from prepared()."""
    own = items.select("item_id", F.col("norm").alias("i_norm"), key_of(F.col("comp_norm")).alias("_k"))
    found = candidate_names(queries, classes(items))
    return found.join(own, "i_norm").filter("comp_key is null or comp_key = _k").select("norm", "item_id")


def containing(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (first, item_id): items whose lower-cased name or company contains a query's first token.

    A substring condition has no key: every distinct first token meets every
    distinct name and company once, never every query every item.
    """
    first = queries.select("first").filter("first is not null").distinct()
    texts = items.select(F.lower("name").alias("t")).union(items.select(F.lower("compname"))).filter("t != ''").distinct()
    # a token's first three letters are in every text that contains it
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    long = first.filter("length(first) >= 3").withColumn("g", F.substring("first", 1, 3)).join(texts.select("t", F.explode(grams(F.col("t"))).alias("g")), "g")
    letters = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substring(c, i, F.lit(1)), F.substring(c, i, F.lit(2))))))
    short = first.filter("length(first) < 3").withColumn("g", F.col("first")).join(texts.select("t", F.explode(letters(F.col("t"))).alias("g")), "g")
    hits = long.filter(F.contains("t", "first")).select("first", "t").union(short.select("first", "t")).distinct()
    by = items.select("item_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("compname")))).alias("t"))
    return hits.join(by, "t").select("first", "item_id").distinct()
