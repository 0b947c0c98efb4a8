"""Packing by concatenate and cut.

Pass one tokenises each document into a written table; each task numbers its
documents by a running token count, so a partition's total and the place of
each document in it are known without a shuffle. A prefix sum over the
partition totals (one row per partition, all that the driver ever sees) turns
them into global offsets. Pass two cuts the stream at multiples of seq_len; a
document that crosses a boundary yields one piece per window it touches.

Edge cases: a null or empty text is a document of the end id alone; a null
doc_id is kept as null; repeated rows are packed as often as they occur; an
empty table yields no pieces; a document longer than seq_len spans sequences.
Only the last sequence is short. Texts of any length are tokenised whole; extra
columns, whatever their names, are not read; there are no ties to break. Which documents are neighbours follows from
the order of the input files; every id lies in exactly one piece.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _OTHERS, id_text, rare_collections, released, written

SEQ_LEN = 4096
END_ID = 2
#: Entries of the table of encoded chunks that a Python worker keeps.
CHUNKS = 500_000

_codecs: dict[str, "ChunkTokenizer"] = {}
#: Printable ASCII without apostrophes (which open contractions) and without the first sign of special tokens, and the letters of Latin-1: text that NFC leaves alone.
_plain = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
_latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_parts = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level models write the bytes that are no visible Latin-1 characters as those from 256 on.
_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _visible)}


class ChunkTokenizer(dict):
    """Encodes with a tokenizers file, each distinct chunk between white space once: a table from chunks to ids.

    Its pre-tokenizer never joins characters across ASCII white space, so a
    text's ids are its chunks' ids in a row. The table is emptied before a
    text when it has reached `most` entries.
    """

    def __init__(self, path: str, most: int = CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.parts: dict[str, bytes] = {}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.tokenize = self.tokenizer.model.tokenize
        for p in ("The Cat,", "a1b22c!?", "x-y_z.", "Q&A", "#*$%&|>!", "[^~]{}`@", "Éçà Ñß-ÿ."):  # is the fast way this file's way?
            if self.encode([p])[0] != self._library(p):
                raise ValueError("this tokenizer file has other rules than lower case, letters, digits and the rest apart")

    @classmethod
    def of(cls, path: str) -> "ChunkTokenizer":
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, ids = [], self.__getitem__
        for text in texts:
            text = text or ""
            for ch in _OTHERS:
                if ch in text:
                    text = text.replace(ch, " ")
            if len(self) > self.most:
                self.clear()
            out.append(b"".join(map(ids, text.split(" "))))
        return out

    def forget(self) -> None:
        """At a task's end: the next one has mostly other rare chunks, and an idle worker should be small."""
        self.clear()
        self.parts.clear()
        released()

    def _library(self, text: str) -> bytes:
        return b"".join([self.four[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or _latin(chunk)):
            out = self._part(chunk.lower())
        elif _plain(chunk):
            out = b"".join(map(self._part, _parts.findall(chunk.lower())))
        else:
            out = self._library(chunk) if chunk else b""
        self[chunk] = out
        return out

    def _part(self, part: str) -> bytes:
        """Of a stretch of letters, a digit or other signs: the file's rules for it, without the library's bookkeeping."""
        out = self.parts.get(part)
        if out is None:
            if len(self.parts) > self.most:
                self.parts.clear()
            four = self.four
            out = self.parts[part] = b"".join([four[t.id] for t in self.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))])
        return out


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (tokens of this partition ahead of it), n, ids (bytes): one row per document."""
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        rare_collections()
        codec, part, before = ChunkTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                ids = [x + end for x in codec.encode(rows.column(1).to_pylist())]
                n = [len(x) // 4 for x in ids]
                at = list(accumulate(n, initial=before))
                before = at.pop()
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])
        codec.forget()

    return id_text(docs).mapInArrow(encode, "doc_id bigint, part int, before bigint, n bigint, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (bytes)."""
    tokens = written(tokenised(docs, tokenizer_path, end_id), "tokens")
    totals = sorted((r[0], r[1]) for r in tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n"))).collect())
    base = dict(zip([p for p, _ in totals], accumulate((t for _, t in totals), initial=0)))
    base = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, part, before, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at, done, view = base.value[part] + before, 0, memoryview(ids)
                while done < n:
                    sequence, offset = divmod(at + done, seq_len)
                    length = min(n - done, seq_len - offset)
                    piece = view[4 * done : 4 * (done + length)]
                    rows.append((doc_id, done, length, zlib.crc32(piece), n, sequence, offset, *([bytes(piece)] * with_ids)))
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    return tokens.mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the pieces of each window put together; a window holds seq_len ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
