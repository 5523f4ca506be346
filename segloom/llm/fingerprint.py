"""SimHash fingerprints of documents, their likeness, and all fingerprints within a Hamming radius.

Weighted terms vote on BITS signed bits: neighbouring words, longer words, and, for texts of fewer than SHORT words,
groups of four bytes whose weight fades with the number of words. Likeness is the cosine that the share of differing bits estimates,
not below 0. The permuted tables of all within RADIUS bits take two intact blocks of eight as key.

Defined cases: a null text counts as empty; texts without terms have a fingerprint of zeros; equal texts have equal
fingerprints; rows that share a doc_id follow each other by a hash of the text; null doc_ids come first; a table of
one row has itself as next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.linking import components, linked
from segloom.llm.simhash import block_keys, signs, votes, word_terms
from segloom.llm.tables import map_arrow, settle
from segloom.llm.words import chunks, mix, span_hashes, spans

BITS, SHORT = 128, 64
RADIUS, BLOCKS, BLOCK_BITS = 6, 8, 16
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOOSE = "part int, last boolean, loose_text string, loose_id long"


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BITS / 64 words for each text."""
    out = np.zeros((len(texts), BITS // 64), np.uint64)
    for lo, hi in chunks(texts):
        raw, starts, ends, at = spans(texts[lo:hi])
        owner, terms, weights = word_terms(span_hashes(raw, starts, ends), ends - starts, at)
        words = np.diff(at)
        extra = [(owner, terms, weights)]
        opens = np.flatnonzero(words < SHORT)
        if len(opens):
            ends_of = np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass").lower()) + 1 for t in texts[lo:hi])])
            for i in opens:
                own = raw[ends_of[i] : ends_of[i + 1] + 1].astype(np.uint64)
                if words[i] and len(own) >= 4:
                    gram = (own[:-3] << np.uint64(24)) | (own[1:-2] << np.uint64(16)) | (own[2:-1] << np.uint64(8)) | own[3:]
                    extra.append((np.full(len(gram), i), mix(gram + np.uint64(1 << 40)), np.full(len(gram), 1 - words[i] / SHORT)))
        owner, terms, weights = (np.concatenate(x) for x in zip(*extra, strict=True))
        out[lo:hi] = signs(votes(owner, terms, weights, hi - lo, BITS))
    return out


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(np.cos(np.pi * differing(x, y) / BITS), 0.0, 1.0)


def _shown(words: np.ndarray) -> list[str]:
    return ["".join(f"{w:016x}" for w in row) for row in words.tolist()]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(ids: list, texts: list[str], following: str, first: np.ndarray | None) -> tuple[list, np.ndarray]:
    """Columns of _ROW for texts that follow each other, the last one followed by following."""
    nexts = [*texts[1:], following]
    own = fingerprints([*texts, following]) if first is None else np.concatenate([first, fingerprints([*texts[1:], following])])
    changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
    other = fingerprints(changed)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(_shown(own[:-1])), pa.array(_shown(other)),
        pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
    ], own[-1:]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each compared with the next; its first and last row come as loose ends too."""
    part = TaskContext.get().partitionId()
    ids, texts, first, began = [], [], None, False

    def loose(last: bool, doc_id, text: str) -> pa.RecordBatch:
        row = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*row, pa.array([part], pa.int32()), pa.array([last]), pa.array([text], pa.string()), pa.array([doc_id], pa.int64())], names=_names(_ROW + ", " + _LOOSE))

    def done(columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.string(), pa.int64()))], names=_names(_ROW + ", " + _LOOSE))

    for batch in batches:
        new_ids, new_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if new_ids and not began:
            began = True
            yield loose(False, new_ids[0], new_texts[0])
        for lo, hi in chunks(new_texts, 1 << 21):
            ids, texts = ids + new_ids[lo:hi], texts + new_texts[lo:hi]
            if len(texts) > 1:
                columns, first = _compared(ids[:-1], texts[:-1], texts[-1], first)
                yield done(columns)
                ids, texts = ids[-1:], texts[-1:]
    if began:
        yield loose(True, ids[0], texts[0])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], following, None)[0], names=_names(_ROW))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text's are."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = settle(map_arrow(ordered, _in_order, _ROW + ", " + _LOOSE))
    # Two loose ends for each partition: each partition's last row is followed by the first of the next that has rows.
    ends = rows.where("part is not null").select("part", "last", "loose_id", F.col("loose_text").alias("text"))
    firsts = ends.where(~F.col("last")).select(F.col("part").alias("at"), F.col("text").alias("following"))
    order = firsts.select("at", F.row_number().over(Window.orderBy("at")).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    lasts = ends.where("last").join(order, F.col("part") == F.col("at")).select("loose_id", "text", (F.col("k") % F.col("n") + 1).alias("want"))
    nexts = firsts.join(order, "at").select("following", F.col("k").alias("want"))
    closed = map_arrow(lasts.join(nexts, "want").select("loose_id", "text", "following"), _joined, _ROW)
    return rows.where("part is null").select(*_names(_ROW)).unionByName(closed)


def _key_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = block_keys(_words(batch.column(1).to_pylist()), BLOCKS, BLOCK_BITS, BLOCKS - RADIUS)
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"])


class Prints:
    """Decides by the bits that differ."""

    def __init__(self, rows: pa.Table):
        self.words = _words(rows.column("fingerprint").to_pylist())

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        off = differing(self.words[a], self.words[b])
        return np.where(off <= RADIUS, off.astype(float), np.inf)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ones(len(a), bool)


def _words(prints: list[str]) -> np.ndarray:
    return np.array([[int(x[i : i + 16], 16) for i in range(0, BITS // 4, 16)] for x in prints], np.uint64).reshape(-1, BITS // 64)


def near_classes(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fingerprint, more) with near_class: the smallest doc_id that links within RADIUS bits reach.

    Every two different fingerprints within the radius share a key; only groups without the same class are compared.
    """
    equal = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node is not null"))
    rows = map_arrow(equal.select("node", "fingerprint"), _key_rows, "key long, node long")
    groups = components(linked(rows, lambda nodes: equal.join(nodes, "node", "left_semi"), Prints))
    near = equal.join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("near_class"))
    return prints.join(near, "fingerprint", "left").select(*prints.columns, F.coalesce("near_class", "doc_id").alias("near_class"))
