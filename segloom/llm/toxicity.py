"""Toxicity by a linear classifier on words, regularised with counterfactual identity terms.

Training texts that name a group are given once more with the term swapped for another of its kind, and the squared
difference between both scores is added to the loss, so that naming a group cannot move a score by itself. Features
are words and their beginnings present in a text (punctuation off, lower case); those far more frequent in toxic texts
are kept, with weights that aren't negative.

The fit takes at most SAMPLE labelled texts, those of the smallest hashes of doc_id, and at most FEATURES features, which
executors count; both are parameters of train. Scoring takes whole texts, however long.

Defined cases: null and empty texts get the score of a text without features; without two classes to learn from
every score is the share of label 1 (0 without labels); a doc_id with several labels has the highest; null labels teach
nothing; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from segloom.llm.lines import normal_bytes
from segloom.llm.tables import forget, map_arrow, settle, small
from segloom.llm.words import chunks, mix, span_hashes, spans

SAMPLE, FEATURES, LEAST_TEXTS, LEAST_Z = 20000, 4096, 5, 6.0
PREFIX = 5
PENALTY, SHRINKAGE, STEPS, RATE = 4.0, 1e-4, 800, 0.5
# Identity terms by kind and language; a term is swapped for the next of its kind.
KINDS = (
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist", "black white asian latino arab african",
    "gay lesbian bisexual straight transgender", "immigrants refugees foreigners natives", "deaf blind disabled autistic", "femmes hommes filles garçons", "femme homme fille garçon",
    "musulmans chrétiens juifs athées", "noirs blancs asiatiques arabes", "frauen männer mädchen jungen", "muslime christen juden atheisten", "mujeres hombres niñas niños", "mujer hombre niña niño",
    "musulmanes cristianos judíos ateos", "negros blancos asiáticos árabes",
)
SWAP = {a: b for kind in KINDS for a, b in zip(kind.split(), [*kind.split()[1:], kind.split()[0]], strict=True)}


def plain(text: str | None) -> str:
    return normal_bytes(text).decode("utf-8", "surrogatepass").replace("\n", " ") if text else ""


def counterfactual(text: str) -> str | None:
    """A plain text with its identity terms swapped; None where it has none."""
    words = text.split()
    swapped = [SWAP.get(w, w) for w in words]
    return " ".join(swapped) if swapped != words else None


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each word, and of the first PREFIX bytes of longer ones: stems carry over to unseen words."""
    raw, starts, ends, at = spans(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    long = np.flatnonzero(ends - starts > PREFIX)
    stems = mix(span_hashes(raw, starts[long], starts[long] + PREFIX) ^ np.uint64(0x1D8E4E27C47D124F))
    return np.concatenate([owner, owner[long]]), np.concatenate([span_hashes(raw, starts, ends), stems])


def _present(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for lo, hi in chunks(texts):
        owner, h = _terms([t or "" for t in texts[lo:hi]])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(hi - lo + 1))
        out += [np.unique(h[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.hashes):
            for lo, hi in chunks(texts):
                owner, h = _terms([plain(t) for t in texts[lo:hi]])
                found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[found] == h)
                pair = np.unique(owner[hit] * np.int64(len(self.hashes)) + found[hit])
                total[lo:hi] += np.bincount(pair // len(self.hashes), weights=self.weights[pair % len(self.hashes)], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(labels: np.ndarray, hashes: np.ndarray, hits: list[np.ndarray], swapped: list[np.ndarray | None]) -> Model:
    """Logistic regression with balanced classes on the features of hashes; hits[i] are those of text i, swapped[i] of its counterfactual."""
    n, ones = len(labels), int(labels.sum())
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    kept = len(hashes)
    r, c = np.repeat(np.arange(n), [len(x) for x in hits]), np.concatenate([*hits, np.zeros(0, np.int64)])
    # Differences between texts and their counterfactuals, as rows of +1 and -1.
    named = [i for i in range(n) if swapped[i] is not None]
    pairs = [(i, x, v) for i in named for x, v in ((hits[i], 1.0), (swapped[i], -1.0))]
    dr = np.repeat([i for i, _, _ in pairs], [len(x) for _, x, _ in pairs]).astype(np.int64)
    dc = np.concatenate([*[x for _, x, _ in pairs], np.zeros(0, np.int64)])
    dv = np.repeat([v for _, _, v in pairs], [len(x) for _, x, _ in pairs])
    weight = np.where(labels > 0, 0.5 / ones, 0.5 / (n - ones))
    w, bias, seen, seen_bias = np.zeros(kept), 0.0, np.full(kept, 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=w[c], minlength=n), -60, 60)))
        off = weight * (p - labels)
        g = np.bincount(c, weights=off[r], minlength=kept) + SHRINKAGE * w
        if len(dr):
            gap = np.bincount(dr, weights=dv * w[dc], minlength=n)
            g += 2 * PENALTY * np.bincount(dc, weights=dv * (weight * gap)[dr], minlength=kept)
        seen += g * g
        seen_bias += off.sum() ** 2
        w = np.maximum(w - RATE * g / np.sqrt(seen), 0.0)  # benign words can't hide others
        bias -= RATE * off.sum() / np.sqrt(seen_bias)
    return Model(hashes, w, float(bias))


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in small(batches):
        texts = [plain(t) for t in batch.column(1).to_pylist()]
        other = [counterfactual(t) for t in texts]
        with_other = [x.view(np.int64) if t is not None else None for t, x in zip(other, _present(other), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in _present(texts)], kind), pa.array(with_other, kind)], names=["label", "present", "swapped"])


def _chosen(examples: DataFrame, n: int, ones: int, features: int, least_texts: int, least_z: float) -> np.ndarray:
    """Sorted hashes of the features: identity terms that occur, and the words most typical of label 1."""
    words = examples.select("label", F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("texts"), F.sum("label").alias("hits"))
    named = F.col("word").isin(*_terms([" ".join(SWAP)])[1].view(np.int64).tolist())
    share = F.col("texts") / n
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / ones + 1 / (n - ones)))
    words = words.withColumn("z", F.when(named, F.lit(float("inf"))).otherwise((F.col("hits") / ones - (F.col("texts") - F.col("hits")) / (n - ones)) / spread))
    top = words.where(named | ((F.col("texts") >= least_texts) & (F.col("z") >= least_z))).orderBy(F.desc("z"), "word").limit(features)
    return np.sort(np.array([x["word"] for x in top.select("word").collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z) -> Model:
    """labels: doc_id, label. What reaches the driver is the features, at most so many, and which of them the at most sample texts have.

    A feature is in least_texts texts, and so much more frequent with label 1 that the difference is least_z deviations.
    """
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so that the broadcast is bounded
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("label", "text")
    examples = settle(map_arrow(rows, _examples, "label int, present array<long>, swapped array<long>"))
    total = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    hashes = _chosen(examples, total["n"], total["ones"], features, least_texts, least_z) if 0 < total["ones"] < total["n"] else np.zeros(0, np.uint64)

    def hit(own) -> np.ndarray | None:
        if own is None or not len(hashes):
            return None if own is None else np.zeros(0, np.int64)
        values = own.values.to_numpy().view(np.uint64)
        at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
        return at[hashes[at] == values]

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            columns = [pa.array([hit(x if x.is_valid else None) for x in batch.column(k)], kind) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["label", "present", "swapped"])

    got = map_arrow(examples, hits, "label int, present array<long>, swapped array<long>").toArrow()
    own, other = ([None if x.as_py() is None else x.values.to_numpy() for x in got.column(k)] for k in (1, 2))
    forget(examples)
    return fit(np.array(got.column(0).to_pylist(), float), hashes, own, other)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score beside their columns; a column of docs with this name goes."""
    docs = docs.drop("score")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts), pa.float64())], names=[*batch.schema.names, "score"])

    return map_arrow(docs, scored, StructType(list(docs.schema)).add("score", DoubleType()))
