"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, and a sequence is one piece.

A document of ``n`` tokens (its ids and one end id) becomes ``n // max_length`` pieces of ``max_length`` and a piece for each set bit of
the rest, longest first. Pieces of equal length form a bucket, whose number is the length's logarithm; each is a sequence of its bucket, so no
sequence crosses documents and none needs padding, since each length is a power of two. ``write_buckets`` stores a bucket's sequences together.

Ids are those of ``tokenizers`` with the vocabulary file at ``tokenizer``, a parameter, without special tokens around a text; an added token that a
text holds literally is one id, as that library has it. It encodes itself what holds white space runs or an added token; for plain words the same
merges are run by a faster library (half the time a word), and the tests compare all ids with the former. A text is cut before single spaces between other characters, which are boundaries
of the vocabulary's own word pattern too; the ids of each piece between are remembered, so that a frequent word is encoded once per
worker. What is remembered is bounded by its bytes (``REMEMBERED``), and long words aren't.

Defined results: null text is empty and gives one piece, the end id; empty tables give no pieces; extra columns are ignored; very long texts
are encoded whole; rows that share a doc_id, equal or null ones too, are packed each on its own. ``sequence_id`` is unique: the partition's number
and a count in it. Ties don't arise: pieces are in the order of their start.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strata.llm._arrow import blocks

MAX_LENGTH, END_ID, REMEMBERED, LONG, BLOCK = 1024, 0, 1 << 28, 200, 1 << 22
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"
_BY_PATH: dict[str, tuple["_Words", "_Words"]] = {}


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """ids (little-endian bytes) of a piece of text after a prefix, filled on demand."""

    def __init__(self, path: str, prefix: str = "") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        import tiktoken
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_file(path)
        self.prefix, self.room = prefix, REMEMBERED
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [x["content"] for x in model.get("added_tokens", [])]
        byte = _byte_of_symbol()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
        self.merges = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if _SPACES.search(text) or any(a in text for a in self.added):
            return np.array(self.codec.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        found = self.ids(self.prefix + piece.decode())
        if len(piece) <= LONG:
            self.room -= len(piece) + len(found) + 200  # with the objects themselves
            if self.room < 0:
                self.clear()
                self.room = REMEMBERED
            self[piece] = found
        return found


#: Fixed value: the word pattern of the byte-level vocabulary.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s")
#: Where a cut before a space could change the word pattern's words, and where it surely doesn't even so.
_RUN = re.compile(r"\s\s(?:\s|\Z)")
_SURE = re.compile(rb"(?<=[!-~])(?= [!-~])")


def token_ids(text: str, pieces_of: _Words, words: _Words) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers; ``words`` adds a space to what it is asked for."""
    raw = text.encode()
    if _RUN.search(text):
        return b"".join(map(pieces_of.__getitem__, _SURE.split(raw)))
    first, *rest = raw.split(b" ")
    return pieces_of[first] + b"".join(map(words.__getitem__, rest))


def pieces(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of ``n`` tokens."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def words_of(path: str) -> tuple[_Words, _Words]:
    if path not in _BY_PATH:
        _BY_PATH[path] = _Words(path), _Words(path, " ")
    return _BY_PATH[path]


def pack(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ``ids`` if asked for."""
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = words_of(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, "text", BLOCK):
            doc, start, length, crc, total, parts = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(token_ids(text or "", *known) + end)
                n, at = len(ids) // 4, 0
                for k in pieces(n, max_length):
                    doc.append(doc_id)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    total.append(n)
                    if with_ids:
                        parts.append(ids[4 * at : 4 * (at + k)])
                    at += k
            m = len(doc)
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + [pa.array(np.arange(sequence, sequence + m)), pa.array(np.zeros(m, np.int64))]
            columns.append(pa.array([k.bit_length() - 1 for k in length], pa.int32()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                flat = np.frombuffer(b"".join(parts), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            sequence += m
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Stores the sequences by bucket, a folder for each length, so that a reader takes batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
