"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the model has a whitespace marker after another character,
pieces cannot cross into the next marked word: a text is a row of chunks, each
some markers and the characters up to the next marker. Other models (checked
when loaded) are refused.

Layout. Documents are gathered into blocks of about BLOCK chunks, kept as local
numbers. A block tells shards, which chunks are dealt to by hash, each of its
distinct chunks once; a shard segments each distinct chunk of the whole corpus
once, by the library, and answers block by block; a block joins ids back by
position. So a chunk that is a third of all words is one entry of each block.

Edge cases: a null or empty text has the begin and end ids alone and decodes
to the empty text; repeated rows are encoded as often as they occur; an empty
table yields an empty one; texts of any length are encoded whole; extra
columns, whatever their names, are not read; there are no ties to break.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import dump, id_text, load, rare_collections, released, shards, written_in_buckets

MARK = "▁"
#: Entries of a codec's own table of chunks, for texts that are encoded where they are.
CHUNKS = 300_000
_chunk = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, "ChunkCodec"] = {}


class ChunkCodec:
    def __init__(self, path: str, most: int = CHUNKS):
        import sentencepiece

        self.sp, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("this model has pieces that cross whitespace markers")
        probe = "a  b "
        if self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError("this model changes white space; chunks would not add up to its ids")
        self.begin, self.end = (x.to_bytes(4, "little") for x in (self.sp.bos_id(), self.sp.eos_id()))
        # a marker alone can't be had from the library by itself: what it adds to a text
        self.lone = np.asarray(self.sp.encode("a ")[len(self.sp.encode("a")) :], "<u4").tobytes()
        self.known = {MARK: self.lone}
        self.surface = [self._surface(i, p) for i, p in enumerate(pieces)]

    @classmethod
    def of(cls, path: str) -> "ChunkCodec":
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def _surface(self, i: int, piece: str) -> bytes:
        if self.sp.is_control(i):
            return b""
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.sp.is_unknown(i):
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        split = [chunks_of(t) for t in texts]
        self._learn(set().union(*split))
        known = self.known.__getitem__
        return [self.begin + b"".join(map(known, chunks)) + self.end for chunks in split]

    def _learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {MARK: self.lone}
            new = chunks - {MARK}
        new = list(new)
        self.known.update(zip(new, self.segmented(new)))

    def segmented(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, by the library; it puts one marker in front of what it encodes."""
        ids = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [self.lone if c == MARK else np.asarray(x, "<u4").tobytes() for c, x in zip(chunks, ids)]

    def forget(self) -> None:
        """At a task's end: an idle worker should be small."""
        self.known = {MARK: self.lone}
        released()

    def decode(self, ids: bytes) -> str:
        """The text of ids, as the library's decode has it."""
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # byte pieces that are no UTF-8: the library says what they become
            return self.sp.decode(np.frombuffer(ids, "<u4").tolist())
        return text[1:] if text[:1] == " " else text


#: Chunks of a block, or one document if it has more.
BLOCK = 1_500_000
#: Of zstandard: these tables lie on disk twice.
LEVEL = 5
_ROWS = "block bigint, shard int, data binary"


class _Numbers(dict):
    """Numbers of a block's distinct chunks, in order of their first place."""

    def __missing__(self, chunk: str) -> int:
        out = self[chunk] = len(self)
        return out


def chunks_of(text: str | None) -> list[str]:
    return _chunk.findall(MARK + text.replace(" ", MARK)) if text else []


def _slices(sizes: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def blocks_of(docs: DataFrame, n_shards: int, most: int = BLOCK) -> DataFrame:
    """block, shard, data: a block's documents as numbers (shard -1), and its distinct chunks in each shard."""

    def run(batches):
        rare_collections()
        task, number = TaskContext.get().partitionId(), 0
        ids, held, table = [], [], _Numbers()

        def out():
            block, lengths = task << 24 | number, np.array([len(c) for c in held], np.int32)
            # small numbers for frequent chunks, and like chunks beside each other: both take less room
            flat = np.concatenate(held)
            by_count = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")
            place = np.empty(len(table), np.int32)
            place[by_count] = np.arange(len(table))
            own = [c.encode("utf-8", "surrogatepass") for c in table]
            table.clear()
            order = np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)
            shard = np.fromiter((xxhash.xxh3_64_intdigest(c) % n_shards for c in own), np.int64, len(own))[order]
            order, shard = order[by := np.argsort(shard, kind="stable")], shard[by]
            # the order in which shards, one after the other, get the chunks and answer stays here
            rows = [(block, -1, dump(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), lengths, place[flat], place[order], level=LEVEL))]
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else []
            for a, b in zip(cuts, cuts[1:]):
                mine = [own[i] for i in order[a:b]]
                rows.append((block, int(shard[a]), dump(np.array([len(c) for c in mine], np.uint32), np.frombuffer(b"".join(mine), np.uint8), level=LEVEL)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "data"])

        total = 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                chunks = chunks_of(text)
                ids.append(doc_id)
                held.append(np.fromiter(map(table.__getitem__, chunks), np.int32, len(chunks)))
                total += len(chunks)
                if total >= most:
                    yield out()
                    number, total, ids, held, table = number + 1, 0, [], [], _Numbers()
        if ids:
            yield out()
        released()

    return id_text(docs).mapInArrow(run, _ROWS)


def encode(docs: DataFrame, model_path: str, most: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids (bytes, little-endian unsigned 32-bit), one row per document."""
    n = shards(docs)
    gathered = written_in_buckets(blocks_of(docs, n, most), "blocks", "block", n)

    def segment(key, told):
        rare_collections()
        codec = ChunkCodec.of(model_path)
        known, asked = _Numbers(), []
        for block, data in zip(told["block"], told["data"]):
            sizes, flat = load(data)
            asked.append((block, [known[c] for c in _slices(sizes, flat.tobytes())]))
        ids = codec.segmented([c.decode("utf-8", "surrogatepass") for c in known])
        rows = []
        for block, own in asked:
            mine = [ids[i] for i in own]
            flat = np.frombuffer(b"".join(mine), "<u4")
            rows.append((block, key[0], dump(np.array([len(x) // 4 for x in mine], np.uint32), flat.astype("<u2") if codec.sp.get_piece_size() <= 1 << 16 else flat, level=LEVEL)))
        return pd.DataFrame(rows, columns=["block", "shard", "data"])

    def join(key, payload, answers):
        rare_collections()
        codec = ChunkCodec.of(model_path)
        doc_ids, missing, lengths, numbers, order = load(payload["data"].iloc[0])
        said = []
        for data in answers.sort_values("shard")["data"]:
            sizes, ids = load(data)
            said += _slices(4 * sizes, ids.astype("<u4").tobytes())
        table = dict(zip(order.tolist(), said, strict=True))
        get = table.__getitem__
        ends = np.cumsum(lengths, dtype=np.int64)
        out = [codec.begin + b"".join(map(get, numbers[b - n : b].tolist())) + codec.end for b, n in zip(ends.tolist(), lengths.tolist())]
        rows = pd.DataFrame({"doc_id": pd.Series(doc_ids, dtype="Int64").mask(missing.astype(bool)), "n_tokens": [len(x) // 4 for x in out], "ids": out})
        released()
        return rows

    answers = gathered.filter("shard >= 0").groupBy("shard").applyInPandas(segment, _ROWS)
    own = gathered.filter("shard = -1").select("block", "data")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(join, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, text: the decoded text of each row of encode()."""

    def run(batches):
        rare_collections()
        codec = ChunkCodec.of(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                texts = [None if x is None else codec.decode(x) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, text string")
