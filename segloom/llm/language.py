"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram's vector is the product of its letters' vectors, rotated by
their place; a text's vector is the sum (bundle) over its trigrams, a language's prototype the sum over its training
texts. A text gets the language whose prototype is closest by cosine. Runs of other characters are one gap, which
has a vector too. Letters share a fixed number of vectors beyond the first 2048 code points, so memory is bounded.

Defined cases: a null text or one without letters is `und` with score 0; without any training text all are `und`;
ties go to the language that sorts first; repeated rows get a row each; a text of any length counts whole, in stretches
of bounded memory; an empty table gives an empty result, and learning from one knows no language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from segloom.llm.tables import map_arrow
from segloom.llm.words import chunks

DIMENSIONS, SLOTS = 1024, 4096
#: Slots of texts that are counted in one go, and different trigrams whose vectors are made in one go: they bound the memory.
STRETCH, AT_ONCE = 1 << 19, 4096
UNKNOWN = "und"
_MEMORY: dict[str, np.ndarray] = {}


def _slots() -> np.ndarray:
    """The slot of each code point; 0: not a letter."""
    if "slots" not in _MEMORY:
        at = np.arange(0x110000, dtype=np.uint32)
        half = SLOTS // 2
        slot = np.where(at < half, at, half + (at * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(half)).astype(np.uint16)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _MEMORY["slots"] = np.where(letter, slot, 0).astype(np.uint16)
        item = (np.random.default_rng(7).integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.int8)
        _MEMORY["items"] = np.stack([np.roll(item, k, axis=1) for k in (2, 1, 0)])
    return _MEMORY["slots"]


def bundles(texts: Sequence[str | None], row: Sequence[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the trigrams' vectors of the texts of each row, and which texts have letters. row: of each text."""
    table = _slots()
    codes = [table[np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")] for t in texts]
    has = np.array([bool(c.any()) for c in codes])
    flat = np.zeros(sum(len(c) + 2 for c in codes), np.uint16)
    owner = np.zeros(len(flat), np.int32)
    at = 0
    for i, c in enumerate(codes):
        flat[at + 1 : at + 1 + len(c)] = c
        owner[at : at + len(c) + 2] = i
        at += len(c) + 2
    # Gaps collapse to one; a text begins and ends with one.
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    place = np.asarray(row, np.int64)
    out = np.zeros((rows, DIMENSIONS))
    for lo in range(0, max(0, len(flat) - 2), STRETCH):
        _add(out, flat[lo : lo + STRETCH + 2], owner[lo : lo + STRETCH + 2], place)
    return out, has


def _add(out: np.ndarray, flat: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
    """Add the vectors of the trigrams of a stretch of slots, some different trigrams at once."""
    alphabet, small = np.unique(flat, return_inverse=True)
    n = len(alphabet)
    same = (owner[2:] == owner[:-2]) & (flat[1:-1] != 0)
    keys = (small[:-2].astype(np.int64) * n + small[1:-1]) * n + small[2:]
    keys, of = keys[same], place[owner[2:][same]]
    if n <= 128:
        seen = np.zeros(n**3, bool)
        seen[keys] = True
        present = np.flatnonzero(seen)
        lookup = np.zeros(n**3, np.int32)
        lookup[present] = np.arange(len(present))
        column = lookup[keys]
    else:
        present, column = np.unique(keys, return_inverse=True)
    if len(present) > AT_ONCE:
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
    items = _MEMORY["items"]
    for lo in range(0, len(present), AT_ONCE):
        some = present[lo : lo + AT_ONCE]
        a, b = np.searchsorted(column, [lo, lo + len(some)]) if len(present) > AT_ONCE else (0, len(column))
        counts = np.bincount(of[a:b] * len(some) + column[a:b] - lo, minlength=len(out) * len(some)).reshape(len(out), len(some))
        vectors = items[0][alphabet[some // (n * n)]] * items[1][alphabet[some // n % n]] * items[2][alphabet[some % n]]
        out += counts.astype(np.float32) @ vectors.astype(np.float32)


def _few(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Chunks small in characters and in texts, so that counts by text and trigram stay small."""
    for lo, hi in chunks(texts, 1 << 19):
        for at in range(lo, hi, 128):
            yield at, min(hi, at + 128)


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes of length 1, from all rows of training (text, lang).

    What reaches the driver is one vector for each language.
    """

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _few(texts):
                names = sorted(set(langs[lo:hi]))
                found, _ = bundles(texts[lo:hi], [names.index(x) for x in langs[lo:hi]], len(names))
                for name, bundle in zip(names, found, strict=True):
                    sums[name] = sums.get(name, 0) + bundle
        for name, bundle in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([np.rint(bundle).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = map_arrow(training.where("lang is not null and text is not null").select("text", "lang"), summed, "lang string, bundle array<long>")
    total = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    found = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return [r["lang"] for r in rows], found / np.where(norms, norms, 1)


def identify(docs: DataFrame, languages: list[str], profiles: np.ndarray) -> DataFrame:
    """docs with lang_pred and score beside their columns; columns of docs with these names go."""
    docs = docs.drop("lang_pred", "score")

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in _few(texts) if languages else ():
                bundle, has = bundles(texts[lo:hi], range(hi - lo), hi - lo)
                norm = np.linalg.norm(bundle, axis=1)
                cosine = (bundle @ profiles.T) / np.where(norm, norm, 1)[:, None]
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(has):
                    names[lo + i], scores[lo + i] = languages[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, predicted, StructType(list(docs.schema)).add("lang_pred", StringType()).add("score", DoubleType()))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
