"""Best-fit packing of token ids into sequences of a fixed length.

Bounded-space online best fit: each partition keeps at most OPEN_BINS open bins, and a bitset with one bit for each
free space that some open bin has. A piece goes where the least space is left after it; when there would be one bin
too many, the fullest closes first. The pieces of one Arrow batch come longest first. Nothing is shuffled: places
are known as soon as a piece arrives, and a task that runs again gives the same rows.

Defined cases: null and empty texts are one piece of the end id alone; a text longer than a sequence is cut, and its
first piece takes what is over full ones; strings of special tokens become these tokens, as the tokenizer's file has it; rows
that repeat a doc_id are packed each, null doc_ids too; long texts are cut into pieces whole; no rows give no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from segloom.llm.tables import map_arrow

LENGTH, OPEN_BINS, END_ID = 2048, 1024, 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ENCODERS: dict[tuple, object] = {}


class BestFit:
    """Open bins by free space; place() gives a piece's bin and offset."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.bits, self.by_space, self.open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def _take(self, space: int) -> int:
        found = self.by_space[space].pop()
        if not self.by_space[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            found, space = self.made, self.length
            self.made += 1
        if space > size:
            self.by_space[space - size].append(found)
            self.bits |= 1 << (space - size)
            self.open += 1
        return found, self.length - space


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings that a tokenizer's JSON file takes as one token each, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """The tokenizer of a ranks file; one for each Python worker."""
    import tiktoken

    key = (ranks_path, pattern, *special.items())
    if key not in _ENCODERS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[key]


def pieces(ids: array, length: int) -> Iterator[tuple[int, int]]:
    """Start and length; the first piece may be shorter, the others are full."""
    first = (len(ids) - 1) % length + 1
    yield 0, first
    for start in range(first, len(ids), length):
        yield start, length


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row for each piece of each document, with its place. special: see special_tokens."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern, special)
        bins, first_id = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", encoding.encode(text.as_py() or "", allowed_special="all"))
                ids.append(END_ID)
                for piece, (start, size) in enumerate(pieces(ids, length)):
                    rows.append([doc_id, piece, start, size, zlib.crc32(memoryview(ids)[start : start + size].cast("B"))])
            for row in sorted(rows, key=lambda r: -r[3]):
                found, offset = bins.place(row[3])
                row += [first_id + found, offset]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), packed, SCHEMA)
