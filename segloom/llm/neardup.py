"""Near-duplicate documents by min-max hashing.

A document is the set of its hashed 5-word shingles. Each of PERMUTATIONS permutations gives two values, the set's
minimum and maximum; the values are dealt into bands, and documents that agree on a whole band are candidates.
Equal sets are one class from the start, classes are linked through their bands (see linking), and a link holds when
100 * intersection >= 75 * union over the full sets, which are made again from the whole texts of the candidates.

64 bands of 6 values miss a pair at similarity 0.75 with a chance of 4 in a million, and less above. Of candidates, the
lowest four bits of all values are compared before their sets: where more than NEAR of them differ, five deviations
above what similarity 0.75 expects, the sets aren't; at similarity 0.75 that misses one pair in three million.

Defined cases: null texts and texts without words have empty sets and link with nothing; fewer than five words are
one shingle; rows with one doc_id are one document that has the links of all its rows, whatever their texts; a null doc_id is its own
component (null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.linking import components, linked
from segloom.llm.tables import map_arrow, settle, small
from segloom.llm.words import chunks, mix, shingle_sets

WIDTH, PERCENT = 5, 75
PERMUTATIONS, BAND = 192, 6
BANDS = 2 * PERMUTATIONS // BAND
#: Of the lowest four bits of all values, how many may differ: five deviations above what similarity 0.75 expects.
NEAR = 132
_RNG = np.random.default_rng(41)
_FACTORS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of each permutation over a set that isn't empty."""
    low = np.full(PERMUTATIONS, np.uint64(2**64 - 1))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        values = _FACTORS[:, None] * shingles[None, at : at + _BLOCK]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One key for each band; minima and maxima of the same permutation fall into different bands."""
    banded = signatures.reshape(len(signatures), BANDS, BAND)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), banded.shape[:2]).copy()
    for i in range(BAND):
        key = mix(key ^ banded[:, :, i]) * np.uint64(0x2545F4914F6CDD1D)
    return key


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in chunks(texts, 1 << 19):
            sets = shingle_sets(texts[lo:hi], WIDTH)
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            sig = np.array([signature(s) for s in full], np.uint64).reshape(len(full), 2 * PERMUTATIONS)
            prints = [_prints(s) for s in sets]
            keys = iter(_bands(sig).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo:hi], pa.int64()), pa.array(n), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()),
                    pa.array([next(keys) if k else None for k in n], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "p", "q", "keys"],
            )


def _sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest four bits of each mixed value."""
    low = (mix(sig) & np.uint64(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).view(np.uint64)


def _prints(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell sets of one size apart."""
    sums = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(sums[0].view(np.int64)), int(sums[1].view(np.int64))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = batch.column(1).to_pylist()
        for lo, hi in chunks(texts, 1 << 19):
            sets = [s for s in shingle_sets(texts[lo:hi], WIDTH) if len(s)]
            prints = [_prints(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64())]
            columns += [pa.array([_sketch(signature(s)).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "p", "q", "sketch", "shingles"])


class Sets:
    """Decides by full sets; pairs whose sketches are far apart, or sets too different in size, aren't looked at."""

    def __init__(self, rows: pa.Table):
        self.sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
        self.sketch = np.array([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("sketch")])
        self.sizes = np.array([len(s) for s in self.sets])

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ones = np.uint64(0x1111111111111111)
        d = self.sketch[a] ^ self.sketch[b]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        differing = np.bitwise_count(d & ones).sum(axis=1)
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        return np.where((differing <= NEAR) & (small * 100 >= large * PERCENT), differing.astype(float), np.inf)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            own, other = self.sets[x], self.sets[y]
            common = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
            out[k] = common * 100 >= (len(own) + len(other) - common) * PERCENT
        return out


def _node(n, p, q) -> F.Column:
    return F.xxhash64(n, p, q)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(map_arrow(texts, _signed, "doc_id long, n long, p long, q long, keys array<long>").withColumn("node", _node("n", "p", "q")))
    # The nodes are classes of equal sets, not documents: a doc_id may come with several texts.
    full = signed.where("n > 0 and doc_id is not null")
    classes = settle(full.groupBy("node").agg(F.min("doc_id").alias("rep")))
    first = full.join(classes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi")
    rows = first.select(F.explode("keys").alias("key"), "node").distinct() if _repeats(full) else first.select(F.explode("keys").alias("key"), "node")

    def payload(nodes: DataFrame) -> DataFrame:
        own = classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        held = texts.join(own.hint("merge"), "doc_id", "left_semi")  # these grow with the input: never broadcast
        sets = map_arrow(held, _sets, "n long, p long, q long, sketch binary, shingles binary")
        return settle(sets.withColumn("node", _node("n", "p", "q")).select("node", "sketch", "shingles").dropDuplicates(["node"]).join(nodes, "node", "left_semi"))

    groups = components(linked(rows, payload, Sets).unionByName(_same_document(full)))
    groups = classes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "rep")
    least = groups.groupBy("component").agg(F.min("rep").alias("least"))
    member = signed.select("doc_id", "n", "node").join(groups.join(least, "component").select("node", "least"), "node", "left")
    member = member.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")))
    if _repeats(signed):
        # Of one doc_id's rows some may have no words: the id's component holds for them as well.
        own = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        member = member.join(own, "doc_id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Whether a doc_id comes more than once."""
    return not rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def _same_document(full: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a doc_id with different texts."""
    least = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    return full.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
