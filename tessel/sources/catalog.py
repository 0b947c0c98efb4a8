"""Catalog and vendor files: CSV, JSON, workbooks, Parquet and what else Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from . import workbook

FIELDS = ["code", "name", "compname", "pack", "strength"]
#: Foreign headers and what they mean.
FOREIGN = {"material description": "name", "brands": "compname", "pack size per strip": "pack"}


def named(df: DataFrame, foreign: bool = False) -> DataFrame:
    """The five fields as trimmed strings, found by header whatever its case; missing ones are empty."""
    by = {c.lower().lstrip("﻿").strip(): c for c in reversed(df.columns)}
    if foreign:
        by = {FOREIGN[k]: c for k, c in by.items() if k in FOREIGN} | by
    return df.select(*[(F.trim(F.coalesce(F.col(f"`{by[f]}`").cast("string"), F.lit(""))) if f in by else F.lit("")).alias(f) for f in FIELDS])


def with_position(df: DataFrame, name: str = "item_id") -> DataFrame:
    """Rows numbered from 1 in input order: one scan counts the rows of each partition, so nothing is sorted in one task."""
    spark = df.sparkSession
    marked = df.withColumn("_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id())
    counts = sorted(tuple(r) for r in marked.groupBy("_p").agg(F.count(F.lit(1)), F.min("_o")).collect())
    before, rows = 0, []
    for p, n, first in counts:
        rows.append((p, before, first))
        before += n
    base = spark.createDataFrame(rows, "_p int, _b bigint, _f bigint")  # a row per partition
    return marked.join(F.broadcast(base), "_p").withColumn(name, F.col("_o") - F.col("_f") + F.col("_b") + 1).drop("_p", "_o", "_b", "_f")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a file in their order, as texts where the kind has no types; kind xlsx: the first sheet."""
    if kind == "xlsx":
        return workbook.read(spark, path)
    return spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").format(kind).load(path)


def read_catalog(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """IO1: rows with a code and a name, numbered in input order. A missing file is an error."""
    return with_position(named(_read(spark, path, kind)).filter("code != '' and name != ''"))


def clean_names(df: DataFrame, col: str = "name") -> DataFrame:
    """IO3, PF2: without rows whose name is null or echoes a header."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).cast("string").rlike(r"(?i)^(name|----)$"))


def read_foreign_catalog(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """IO2 to IO5: foreign headers renamed, echoes dropped, codes M_1 to M_n in input order, strength from the name."""
    return derived(_read(spark, path, kind))


def derived(raw: DataFrame) -> DataFrame:
    by = {c.lower(): c for c in raw.columns}
    name = by.get("name") or by.get("material description")
    rows = with_position(named(clean_names(raw, f"`{name}`") if name else raw, foreign=True))
    return rows.withColumn("code", F.concat(F.lit("M_"), "item_id")).withColumn("strength", T.strength("name"))


def read_vendor(spark: SparkSession, path: str, kind: str = "csv", limit: int = 0) -> DataFrame:
    """IO8, IO9: query_id, code, name, pack, compname of a vendor's file; with a limit, its first rows."""
    rows = vendor(clean_names(_read(spark, path, kind)))
    return rows.filter(F.col("query_id") <= limit) if limit > 0 else rows


def vendor(raw: DataFrame) -> DataFrame:
    rows = with_position(named(raw, foreign=True), "query_id")
    return rows.select("query_id", "code", "name", T.no_placeholder("pack").alias("pack"), T.no_placeholder("compname").alias("compname"))


def from_json(df: DataFrame) -> DataFrame:
    """IO6: items of documents with catalog[]: master_id or code, name, company, pack; strength from the name."""
    c = df.select(F.explode("catalog").alias("c")).select("c.*")
    has = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) if f in c.columns else F.lit(None).cast("string")
    rows = c.select(F.coalesce(has("master_id"), has("code"), F.lit("")).alias("code"), *[F.coalesce(has(f), F.lit("")).alias(n) for f, n in (("name", "name"), ("company", "compname"), ("pack", "pack"))])
    return with_position(rows.filter("code != '' and name != ''").withColumn("strength", T.strength("name")))


CATALOG_JSON = "catalog array<struct<master_id: string, code: string, name: string, company: string, pack: string>>"


def read_json_catalog(spark: SparkSession, path: str, fallback: str | None = None, lines: bool = False) -> DataFrame:
    """IO6: a JSON catalog (lines: a document in each line), or where there is none at the path the CSV of `fallback`, if one is named.

    What is there and is no JSON is an error.
    """
    try:
        raw = spark.read.schema(CATALOG_JSON).options(multiLine=not lines, mode="FAILFAST").json(path)
    except AnalysisException as e:
        if fallback is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return read_catalog(spark, fallback)
    return from_json(raw)


def products(df: DataFrame) -> DataFrame:
    """IO7: query rows of requests with products[]: name, pack, company, code."""
    p = df.select(F.explode("products").alias("p")).select("p.*")
    rows = p.select(F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("pack", F.lit("")).alias("pack"), F.coalesce("company", F.lit("")).alias("compname"))
    return with_position(rows, "query_id")


def to_static_json(items: DataFrame) -> DataFrame:
    """IO17: each item as the JSON array that a static page embeds."""
    return items.select("item_id", F.to_json(F.array("code", "name", "compname", "pack", "strength")).alias("json"))
