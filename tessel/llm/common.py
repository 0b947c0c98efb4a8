"""What the operators of this subpackage share: words, written tables, settings."""

from __future__ import annotations

import gc
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept_on_disk, new_folder, release, shared_dir, written, written_in_buckets  # noqa: F401  the operators take them from here

#: The white space of the query contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
_OTHERS = SPACES[1:]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of characters outside SPACES; a null text has none."""
    if not text:
        return []
    for ch in _OTHERS:
        if ch in text:
            text = text.replace(ch, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """np.unique of numbers by one sort, which is much faster here."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class WordHashes(dict):
    """64-bit hashes of words as bytes, emptied before a text when it has reached `most` entries."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> bytes:
        out = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return out

    def of(self, words: list[str], *more: int) -> np.ndarray:
        """An array of the words' hashes and of further numbers behind them."""
        if len(self) > self.most:
            self.clear()
        return np.frombuffer(b"".join([*map(self.__getitem__, words), *(m.to_bytes(8, "little") for m in more)]), "<u8")


def dump(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as compressed byte planes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        packed = zstandard.compress(raw, level)
        out += [struct.pack("<4sII", a.dtype.str.encode().ljust(4), len(a), len(packed)), packed]
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        kind, n, size = struct.unpack_from("<4sII", data, at)
        at += 12
        dtype = np.dtype(kind.strip().decode())
        raw = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8)
        at += size
        out.append(raw.view(dtype) if dtype.itemsize == 1 else np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel())
    return out


def released() -> None:
    """At a task's end: an idle Python worker keeps no memory that Arrow has put by."""
    pa.default_memory_pool().release_unused()


def rare_collections() -> None:
    """For Python workers with large tables of strings: they make no cycles, and looking for some in the tables costs more than the work."""
    gc.set_threshold(1_000_000, 20, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names and types; others, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Bytes of input, as stored, that one hash shard answers for at most.
SHARD_BYTES = 32 << 20
MOST_SHARDS = 1 << 20


def shards(docs: DataFrame) -> int:
    """Number of hash shards for a shuffle of what docs hold: spark.sql.shuffle.partitions, or more where the input is larger than SHARD_BYTES each.

    The size is the optimizer's estimate, which for files is their length; where
    it knows none (an estimate of a petabyte or more) the setting alone counts.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_SHARDS, max(n, -(-size // SHARD_BYTES) if size < 1 << 50 else 0))


def fold(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id falls in no fold (null)."""
    return F.crc32(F.col(id_col).cast("string")) % mod
