"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case folded, NFKC again, white space runs
made one space and trimmed. Its 128-bit xxhash names a bucket. Inside equal
buckets the canonical bytes are compared: the least and the greatest of a
bucket are the same string exactly if all its members are, and both are
aggregates with map-side combining, so a bucket with a third of all rows costs
a task no more than any other. Members of a bucket that holds several strings
get their string's sha256 as a suffix of the fingerprint. Edited texts, which
are nowhere stored, are told apart in their buckets by the sha256 of their
canonical bytes, and likeness is equality of canonical strings.

Edge cases: a null text counts as empty; empty and all-white-space texts share
one fingerprint; very long texts are read whole; repeated rows have equal
fingerprints; documents that share a doc_id (a null one too, which comes last)
follow each other by hash of the text, then by text; an empty table yields an
empty one; a null doc_id is kept; extra columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_text, shards, written

_space = re.compile(r"\s+")


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return _space.sub(" ", text).strip()


def _bytes(text: str | None) -> bytes:
    return canonical(text).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(_bytes(text))


def fingerprints(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, fingerprint of every document (and its text)."""
    texts = id_text(docs)

    def run(batches):
        for batch in batches:
            forms = [_bytes(t) for t in batch.column(1).to_pylist()]
            out, exact = pa.array([xxhash.xxh3_128_hexdigest(x) for x in forms], pa.string()), pa.array([hashlib.sha256(x).digest() for x in forms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, exact, *[batch.column(1)] * keep_text], ["doc_id", "fingerprint", "exact", *["text"] * keep_text])

    rows = texts.mapInArrow(run, "doc_id bigint, fingerprint string, exact binary" + ", text string" * keep_text)
    return separated(rows, mixed_buckets(texts), {"fingerprint": "exact"})


#: Buckets with several rows that are broadcast, at some 50 bytes each; where there are more, the rows of all buckets are compared.
MOST_SHARED = 200_000


def mixed_buckets(texts: DataFrame) -> DataFrame:
    """Digests that stand for more than one canonical string, by comparing bytes inside each bucket.

    A bucket with one row needs no comparison: where the others are few enough
    to be broadcast, only their rows are sent on.
    """

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(_bytes(t)) for t in batch.column(0).to_pylist()], pa.binary())], ["digest"])

    def form(batches):
        # the compressor is deterministic and invertible, so equal strings and only they give equal bytes
        pack = zstandard.ZstdCompressor(level=1, write_content_size=False)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                forms = [_bytes(t) for t in batch.column(0).slice(start, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in forms], pa.binary()), pa.array([pack.compress(x) for x in forms], pa.binary())], ["digest", "form"])

    texts = texts.select("text")
    shared = written(texts.mapInArrow(name, "digest binary").groupBy("digest").count().filter("count > 1").select("digest"), "buckets")
    forms = texts.mapInArrow(form, "digest binary, form binary")
    if shared.count() <= MOST_SHARED:
        forms = forms.join(F.broadcast(shared), "digest", "left_semi")
    both = forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    return both.filter("least != most").select(F.lower(F.hex("digest")).alias("fingerprint"))


def mixed_digests(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Digests that stand for more than one string by their sha256; columns: digest columns of rows and those of their strings' sha256."""
    each = F.explode(F.array(*[F.struct(F.col(d).alias("digest"), F.col(x).alias("exact")) for d, x in columns.items()]))
    both = rows.select(each.alias("e")).groupBy("e.digest").agg(F.min("e.exact").alias("least"), F.max("e.exact").alias("most"))
    return both.filter("least != most").select(F.col("digest").alias("fingerprint"))


def separated(df: DataFrame, mixed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with digests told apart where they are in mixed (fingerprint), without the sha256 columns; columns: digest columns and those of their strings' sha256."""
    names = [c for c in df.columns if c not in columns.values()]
    if mixed.limit(1).count():
        for digest_, exact in columns.items():
            own = mixed.select(F.col("fingerprint").alias("_of")).distinct()
            told = F.when(F.col("_of").isNotNull(), F.concat_ws("-", digest_, F.lower(F.hex(exact)))).otherwise(F.col(digest_))
            df = df.join(own, F.col(digest_) == F.col("_of"), "left").withColumn(digest_, told).drop("_of")
    return df.select(names)


def groups(prints: DataFrame) -> DataFrame:
    """fingerprint, group_id (least doc_id), n_copies of fingerprints()."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_copies"))


LEAST = -(1 << 63)


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """Rows (doc_id, text, slot, tail) laid out so that each slot, read in order, has every document's successor.

    The order is descending doc_id (null last), documents of one doc_id by hash
    of the text and then by text, closed to a ring. Slots are ranges of doc_id
    between quantiles; where one doc_id has more rows than a slot should hold,
    its slot is split by ranges of the hash. The first document of each slot is
    repeated as the tail of the one before, so no task needs another. All that
    the driver sees is some numbers per slot.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumns({"_key": F.coalesce("doc_id", F.lit(LEAST)), "h": F.xxhash64("text")})
    n = shards(docs) * per_partition
    got = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10_000), F.count(F.lit(1))).first()
    cuts, most = np.array(got[0] or [], np.int64), max(1, 2 * got[1] // n)
    # a key that takes up several quantiles is cut off on either side, to have a slot of its own
    own, times = np.unique(cuts, return_counts=True)
    alone = own[times > 1]
    cuts = np.unique(np.r_[own, alone[alone > LEAST] - 1])  # ascending; a key belongs to the slot of the first cut that isn't under it

    @pandas_udf("int")
    def slot(key):
        import pandas as pd

        return pd.Series((len(cuts) - np.searchsorted(cuts, key.to_numpy(np.int64), "left")).astype("int32"))

    rows = rows.withColumn("_slot", slot("_key"))
    sizes = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("a"), F.max("_key").alias("b")).collect()
    parts = {r[0]: -(-r.n // most) for r in sizes if r.a == r.b and r.n > most}
    if parts:
        split = spark.createDataFrame([(s, p) for s, p in parts.items()], "_slot int, parts int")  # a row per slot at most
        rows = rows.join(F.broadcast(split), "_slot", "left")
        part = F.coalesce(F.floor((F.shiftrightunsigned("h", 32)) * F.col("parts") / F.lit(float(1 << 32))), F.lit(0))
        rows = rows.withColumn("slot", F.col("_slot").cast("bigint") * (1 << 32) + part).drop("parts")
    else:
        rows = rows.withColumn("slot", F.col("_slot").cast("bigint") * (1 << 32))
    # unsigned, so that ranges and order agree
    rows = rows.withColumn("h", F.col("h").bitwiseXOR(F.lit(LEAST)))
    firsts = {r.slot: (r.f.k, r.f.h) for r in rows.groupBy("slot").agg(F.max(F.struct(F.col("_key").alias("k"), (-1 - F.col("h")).alias("h"))).alias("f")).orderBy("slot").collect()}
    slots = list(firsts)
    before = {s: slots[i - 1] for i, s in enumerate(slots)}  # the first one's is the last
    if not slots:
        return rows.select("doc_id", "text", "slot", F.lit(False).alias("tail"))
    table = spark.createDataFrame([(s, *firsts[s], before[s]) for s in slots], "slot bigint, fk bigint, fh bigint, before bigint")
    rows = rows.join(F.broadcast(table), "slot")
    here = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("slot"), F.lit(True).alias("tail"))
    first = (F.col("_key") == F.col("fk")) & (-1 - F.col("h") == F.col("fh"))
    rows = rows.select("doc_id", "text", "h", F.explode(F.when(first, F.array(here, tail)).otherwise(F.array(here))).alias("at"))
    dealt = rows.select("doc_id", "text", "h", "at.*").repartition(shards(docs), "slot")
    return dealt.sortWithinPartitions("slot", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; an
    exact digest's likeness is 1.0 or 0.0.
    """

    def run(batches):
        held = None  # (slot, doc_id, text, canonical bytes) that waits for its successor
        for batch in batches:
            out = []
            for doc_id, text, slot, tail in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                form = _bytes(text)
                if held is not None and held[0] == slot:
                    _, of, whole, own = held
                    k = len(whole) // 3
                    edited = whole[: len(whole) - k] + text[:k]
                    other = _bytes(edited)
                    raw = edited.encode("utf-8", "surrogatepass")
                    out.append((of, len(whole), hashlib.sha256(raw).hexdigest(), xxhash.xxh3_128_hexdigest(own), xxhash.xxh3_128_hexdigest(other), float(own == other), float(own == form), hashlib.sha256(own).digest(), hashlib.sha256(other).digest()))
                held = None if tail else (slot, doc_id, text, form)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "own", "other"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    result = with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, own binary, other binary")
    result = written(result, "prints")
    pairs = {"fingerprint": "own", "edited_fingerprint": "other"}
    mixed = mixed_buckets(id_text(docs)).unionByName(mixed_digests(result, pairs))
    return separated(result, mixed, pairs)
