"""Token ids in length-delimited binary records with a separate offset index.

File format: one frame after another; a frame is the payload's length (8 bytes, little endian), the masked checksum of these 8
bytes (4 bytes), the payload, the masked checksum of the payload (4 bytes). A masked checksum is a CRC-32 rotated right by 15 bits
plus a constant, modulo 2**32. A payload is one byte with the width of an id (2 or 4), then the ids, little endian. Files hold
consecutive ranges of doc_id in ascending order. The index has a row for each record (doc_id, file, offset, length, tokens, first
token), so that readers can take records in any order.

A task writes its file under a name of its own attempt and names it in the index rows it returns; files of lost attempts are never
named, so lost executors leave no wrong data. Files go to any file system that pyarrow opens by URI.

Defined cases: a null text is encoded like an empty one: the end id alone; null doc_ids come first; rows that share a doc_id are
ordered by a hash of the text, then by text, and may lie in several files; repeated rows are repeated records; a text that holds the
text of a special token is encoded by the tokenizers library in one call; other columns are ignored; an empty table gives an empty
index.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackgraph.functions.storage import shared_dir

#: Unicode white space as the tokenizer splits it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The tokenizer never joins characters across these pieces, so a piece can be encoded by itself.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Marks that are never part of a letter run nor the start of a contraction.
_MARKS = ".,;:!?|%&$*#"
#: Runs of letters that every version of Unicode has as letters, which the tokenizer does not split.
_LATIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_INDEX = "doc_id long, part int, file string, offset long, length long, n_tokens long, first long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(raw: bytes) -> bytes:
    """The payload of one whole frame; ValueError if a checksum or the length is wrong."""
    (length,), (mark,) = struct.unpack_from("<Q", raw), struct.unpack_from("<I", raw, 8)
    if masked(raw[:8]) != mark or len(raw) != length + 16:
        raise ValueError("a record's length is damaged")
    payload = raw[12 : 12 + length]
    if masked(payload) != struct.unpack_from("<I", raw, 12 + length)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _byte_letters() -> str:
    """The character that stands for each byte in the vocabulary: printable Latin-1 characters for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class _Pieces(dict):
    """Ids of pieces as bytes. Unknown pieces are encoded when asked for; the last used ones are kept, up to twice ``remember``."""

    def __init__(self, tokenizer, kind: np.dtype, remember: int):
        super().__init__()
        self.tokenizer, self.model, self.kind, self.remember, self.older = tokenizer, tokenizer.model, kind, remember, {}
        told = json.loads(tokenizer.to_str())
        split = told.get("pre_tokenizer") or {}
        self.plain = told["normalizer"] is None and told["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"]
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            word = piece.rstrip(_MARKS)
            if len(word) < len(piece) and word and word[-1].isalpha():  # marks after a word are a piece of their own for the tokenizer
                ids = self[word] + self[piece[len(word) :]]
            elif self.plain and _LATIN.fullmatch(piece):  # one piece for the tokenizer too: its model takes it as it is
                mapped = piece.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(mapped)], self.kind).tobytes()
            else:
                ids = self.whole(piece)
        self[piece] = ids
        return ids

    def rest(self) -> None:
        """Forgets the pieces that were not used for long; called between texts."""
        if len(self) > self.remember:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts as bytes, with the tokenizers library; see :class:`_Pieces` for what it remembers."""

    def __init__(self, tokenizer_file: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(tokenizer, self.kind, remember)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        get = self.pieces.__getitem__
        for text in texts:
            if any(s in text for s in self.special):
                yield self.pieces.whole(text)
            else:
                yield b"".join(map(get, _PIECE.findall(text)))
                self.pieces.rest()


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(tokenizer_file: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that pieces stay known."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_records(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes the files to ``folder`` and the index to ``folder/index`` (Parquet); returns the index as read from there."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_bytes))
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_for(tokenizer_file)
        end, width = np.array([end_id], encoder.kind).tobytes(), bytes([encoder.kind.itemsize])
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"records-{part:06d}-{uuid.uuid4().hex}.bin"
        offset = first = 0
        out = None
        try:
            for batch in batches:
                at, length, tokens, start = [], [], [], []
                for ids in encoder.encode(batch.column(1).to_pylist()):
                    out = out or system.open_output_stream(f"{path}/{name}")
                    record = frame(width + ids + end)
                    out.write(record)
                    n = (len(ids) + len(end)) // encoder.kind.itemsize
                    at.append(offset)
                    length.append(len(record))
                    tokens.append(n)
                    start.append(first)
                    offset, first = offset + len(record), first + n
                size = len(at)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * size, pa.int32()), pa.array([name] * size), *[pa.array(x, pa.int64()) for x in (at, length, tokens, start)]], ["doc_id", "part", "file", "offset", "length", "n_tokens", "first"])
        finally:
            if out:
                out.close()

    index = source.mapInArrow(write, _INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``, the ids of all records before a record. One row for each file meets in a window."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(files.select("part", before.alias("before")), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``ids`` (array of int) of every row of an index, in any order of rows, after the index's columns."""
    return _read(index, folder, "ids array<int>", lambda ids: ids.astype(np.int32), pa.list_(pa.int32()))


def read_checksums(index: DataFrame, folder: str) -> DataFrame:
    """``n_read`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) of every row of an index."""
    return _read(index, folder, "n_read long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), None)


def _read(index: DataFrame, folder: str, columns: str, form, kind) -> DataFrame:
    names = index.columns
    where = {n: names.index(n) for n in ("file", "offset", "length")}
    new = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for f, at, length in zip(*(batch.column(where[n]).to_pylist() for n in ("file", "offset", "length"))):
                if f != name:
                    if source:
                        source.close()
                    name, source = f, system.open_input_file(f"{path}/{f}")
                payload = unframe(source.read_at(length, at))
                out.append(form(np.frombuffer(payload, f"<u{payload[0]}", offset=1)))
            made = [pa.array(out, kind)] if kind else [pa.array([x[i] for x in out], pa.int64()) for i in range(len(new))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *new])
        if source:
            source.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", " + columns
    return index.mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from files in the shared folder that are written and read back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-records-{uuid.uuid4().hex}"
    index = with_starts(write_records(docs, folder, tokenizer_file, end_id)).select("doc_id", "start", "file", "offset", "length")
    return read_checksums(index.sortWithinPartitions("file", "offset"), folder).select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
