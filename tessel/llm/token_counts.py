"""Token counts as delta-maintained rollups.

A store holds batches of signed rows: an insert adds a document's counts, a
delete takes away those that were added, a revision does both. Totals by
source, language and tokenizer version are sums, so a batch costs its own size
and nothing that lies in the store is read to add one. Each batch is summed by
key before it is written (map-side first, so a hot source is a few rows).

A store is a folder of data folders and of entries, small JSON files that name
one data folder and the batches whose sums it holds. Both have names of their
own that no other run uses; a data folder is written first and its entry then
put in place whole by one rename, which is the commit. Nothing is ever replaced
or renamed away, so a run that is cut off at any point leaves the totals as
they were, and can be run again. What counts is read off the entries alone: the
ones with most batches first, ties by name, each taken unless a batch of it has
been taken. So a batch counts once, though two runs of it commit at the same
time, and the entry that compact() adds stands for those it has summed from the
moment it is there. vacuum() removes what no longer counts.

A tokenizer version names a function from a text column to a count; those here
run a tokenizer file's own tokenizer over whole texts.

Edge cases: a null text counts no tokens but one document; very long texts are
counted whole; a null source, lang or tokenizer version is a key of its own;
repeated rows count as often as they occur; an empty batch commits and changes
nothing; keys whose counts have all gone back to nothing are left out of
totals; a batch may mix tokenizer versions; ties cannot arise in sums; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rare_collections, shared_dir
from .packing import ChunkTokenizer
from .sentencepiece_codec import ChunkCodec

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
ROWS = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_chars bigint"

Count = Callable[[Column], Column]


def _counted(codec_of, fixed: int) -> Count:
    """A count of the ids that a codec gives, without the `fixed` ones that each text has."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rare_collections()
        codec = codec_of()
        for texts in batches:
            out = []
            for start in range(0, len(texts), 256):
                out += [len(ids) // 4 - fixed for ids in codec.encode(texts.iloc[start : start + 256].tolist())]
            yield pd.Series(out, dtype="int64")
        codec.forget()

    return lambda text: count(F.coalesce(text, F.lit("")))


def sentencepiece_count(path: str) -> Count:
    """Ids of a sentencepiece model, without begin and end."""
    return _counted(lambda: ChunkCodec.of(path), 2)


def tokenizer_count(path: str) -> Count:
    """Ids of a tokenizers file, without special ones."""
    return _counted(lambda: ChunkTokenizer.of(path), 0)


def word_count(text: Column) -> Column:
    """Runs outside white space; in the JVM."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("bigint")


def counts(docs: DataFrame, version: str, count: Count, sign: int = 1) -> DataFrame:
    """Signed rows of documents under a tokenizer version: source, lang, tokenizer_version, n_docs, n_tokens, n_chars."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer_version"),
        F.lit(sign).cast("bigint").alias("n_docs"),
        (sign * count(text)).alias("n_tokens"),
        (sign * F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")).alias("n_chars"),
    )


def inserted(docs: DataFrame, version: str, count: Count) -> DataFrame:
    return counts(docs, version, count, 1)


def deleted(docs: DataFrame, version: str, count: Count) -> DataFrame:
    return counts(docs, version, count, -1)


def revised(before: DataFrame, after: DataFrame, old: str, new: str, old_count: Count, new_count: Count) -> DataFrame:
    """The rows that turn counts of `before` under one version into those of `after` under another."""
    return deleted(before, old, old_count).unionByName(inserted(after, new, new_count))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, name: str = "token-counts"):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/{name}").rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder of the store, with the time of their last change in milliseconds."""
        at = self._path(f"{self.path}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def _entries(self) -> list[tuple[str, set[str]]]:
        """Data folder and batches of each entry. The driver reads as many ids as batches were ever committed."""
        names = [f"{self.path}/entries/{n}" for n in self._names("entries") if n.endswith(".json")]
        rows = self.spark.read.schema("folder string, batches array<string>").json(names).collect() if names else []
        return [(r.folder, set(r.batches)) for r in rows]

    def _taken(self) -> list[tuple[str, set[str]]]:
        """The entries that count."""
        out, seen = [], set()
        for folder, batches in sorted(self._entries(), key=lambda e: (-len(e[1]), e[0])):
            if not batches & seen:
                seen |= batches
                out.append((folder, batches))
        return out

    def committed(self) -> list[str]:
        """Ids of all batches that count."""
        return sorted(set().union(*(b for _, b in self._taken())))

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _enter(self, folder: str, batches: set[str]) -> None:
        tried, entry = (self._path(f"{self.path}/entries/{name}") for name in (f"_{folder}", f"{folder}.json"))
        out = self._fs.create(tried, False)
        out.write(bytearray(json.dumps({"folder": folder, "batches": sorted(batches)}).encode()))
        out.close()
        if not self._fs.rename(tried, entry):
            raise OSError(f"{entry} could not be put in place")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch of signed rows; False, and nothing changes, if a batch of this id is there or another run of it was first."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch id is made of letters, digits, points and dashes: {batch!r}")
        if batch in self.committed():
            return False
        folder = self._write(_summed(rows))
        self._enter(folder, {batch})
        return folder in {f for f, _ in self._taken()}

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, n_chars over all committed batches."""
        paths = [f"{self.path}/data/{f}" for f, _ in self._taken()]
        rows = self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)
        return _summed(rows).filter(" or ".join(f"{c} != 0" for c in SUMS))

    def compact(self) -> None:
        """Adds one entry that stands for all batches so far."""
        taken = self._taken()
        if len(taken) > 1:
            rows = self.spark.read.schema(ROWS).parquet(*[f"{self.path}/data/{f}" for f, _ in taken])
            self._enter(self._write(_summed(rows).coalesce(1)), set().union(*(b for _, b in taken)))

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Removes entries that do not count and data folders that no counting entry names, if older than that (longer than any run or reader takes); returns how many."""
        live, before, n = {f for f, _ in self._taken()}, (time.time() - older_than_s) * 1000, 0
        for folder, of in (("entries", lambda name: name.removesuffix(".json")), ("data", str)):  # entries first
            for name, changed in self._names(folder).items():
                if of(name) not in live and changed <= before:
                    n += self._fs.delete(self._path(f"{self.path}/{folder}/{name}"), True)
        return n
