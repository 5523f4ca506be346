"""Language-model scores of whole texts: prediction by partial matching over bytes, beside a unigram of words.

The model reads a text as its words (A-Z lower-cased) joined by single spaces and closed by a line feed. Its trie has
all byte contexts of up to ORDER bytes of the training texts. A byte costs what the longest known context gives it;
where that never saw it, the escape is paid (half a count for each different byte of the context, which the bytes
seen there give up), those bytes are excluded, and the next shorter context is asked, down to equal chances for what is left of 256.

What a byte costs after ORDER bytes doesn't depend on the document, so it is worked out once for each gram (context
and byte) that occurs: known grams by one aggregation, the others by a cascade of joins, one for each order. Costs of
the most frequent grams, at most HEAD_GRAMS, and counts of the most frequent words, at most HEAD_WORDS, are broadcast;
whatever a document has besides joins the rest of the table, so nothing is dropped.

Defined cases: a null text counts as empty, which is its end alone; rows are scored each, repeated or not; without
training texts every byte has equal chances; a null doc_id hashes as an empty text; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.tables import map_arrow, settle, small
from segloom.llm.words import chunks, mix, word_hashes

ORDER = 5
HEAD_GRAMS, HEAD_WORDS = 1 << 21, 1 << 20
#: Distinct keys that a task holds before it passes their counts on.
_HELD = 1 << 20
_FEED = 10
_END_WORD = int(mix(np.array([0x656E64], np.uint64))[0])


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ORDER + 1 bytes, one for each byte that is predicted, and the offsets of the texts among them."""
    pad = bytes([_FEED]) * ORDER
    parts = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n" for t in texts]
    raw = np.frombuffer(pad + pad.join(parts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    gram = np.zeros(len(raw) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        gram = (gram << np.uint64(8)) | raw[i : len(raw) - ORDER + i]
    # Text k's bytes follow k + 1 pads, and gram j ends at byte j + ORDER.
    keep = np.ones(len(gram), bool)
    for k in range(1, len(parts)):
        lo = at[k] + (k - 1) * ORDER
        keep[lo : lo + ORDER] = False
    return gram[keep], at


class _Counts:
    """Counts by key, passed on when there are many."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.held = kind, [], [], 0

    def add(self, keys: np.ndarray, one: int) -> None:
        if len(keys):
            found, n = np.unique(keys, return_counts=True)
            self.keys.append(found)
            self.counts.append(n * one)
            self.held += len(found)

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.counts = [keys], [np.bincount(where, weights=np.concatenate(self.counts)).astype(np.int64)]
            self.held = len(keys)

    def passed(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.held > 2 * least:
            self.merge()
            if self.held <= least:
                return
            for at in range(0, self.held, 1 << 18):
                keys, n = self.keys[0][at : at + (1 << 18)], self.counts[0][at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
            self.keys, self.counts, self.held = [], [], 0


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams (kind 0; 0 for those of held-out texts alone) and of training words (kind 1)."""
    grams, words = _Counts(0), _Counts(1)
    for batch in small(batches):
        texts, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for train in (True, False):
            own = [t for t, h in zip(texts, held, strict=True) if h is not train]
            for lo, hi in chunks(own, 1 << 20):
                grams.add(streams(own[lo:hi])[0], int(train))
                if train:
                    words.add(word_hashes(own[lo:hi])[0], 1)
                    words.add(np.full(hi - lo, _END_WORD, np.uint64), 1)
                yield from grams.passed(_HELD)
                yield from words.passed(_HELD)
    yield from grams.passed(0)
    yield from words.passed(0)


class Lookup:
    """Values by 64-bit key, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), values
        todo = np.arange(len(keys), dtype=np.int32)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.place[slot] < 0
            self.place[slot[free]] = todo[free]
            won = self.place[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the values, -1 for unknown keys."""
        out = np.full(len(keys), -1, np.int32)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        place = self.place[slot]
        hit = (place >= 0) & (self.keys[slot] == keys)
        out[hit] = place[hit]
        todo = np.flatnonzero((place >= 0) & ~hit)
        slot = (slot[todo] + 1) & self.mask
        while len(todo):
            place = self.place[slot]
            hit = (place >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = place[hit]
            go = (place >= 0) & ~hit
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out


#: Of the model in use; one for each Python worker.
_LOOKUPS: dict[str, tuple[Lookup, Lookup]] = {}


def _costs(grams: DataFrame) -> DataFrame:
    """gram, n, cost: the log10 probability of each gram's byte after its context. grams: gram, n."""
    known = grams.where("n > 0")
    byte = F.col("gram").bitwiseAND(F.lit(255))
    context = F.shiftright("gram", 8)
    totals = known.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    seen = known.withColumn("context", context).join(totals, "context").select("gram", "n", F.log10((F.col("n") - 0.5) / F.col("total")).alias("cost"))
    todo = settle(grams.where("n = 0").select("gram", F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("out")))
    done = []
    level = settle(known)
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            level = settle(level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n")))
        # At most 256 bytes for each context.
        table = level.groupBy(context.alias("context")).agg(F.collect_list(F.struct(byte.cast("int").alias("b"), F.col("n"))).alias("bytes"))
        asked = todo.withColumn("context", F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)), 8)).join(table, "context", "left")
        asked = asked.withColumn("left", F.expr("filter(coalesce(bytes, array()), x -> not array_contains(out, x.b))")).drop("bytes", "context")
        asked = asked.withColumns({"kinds": F.size("left"), "total": F.expr("aggregate(left, 0L, (s, x) -> s + x.n)"), "own": F.expr("try_element_at(filter(left, x -> x.b = cast(gram & 255 as int)), 1).n")})
        step = F.when(F.col("kinds") == 0, F.lit(0.0)).otherwise(F.log10(F.coalesce(F.col("own") - 0.5, F.col("kinds") * 0.5) / F.col("total")))
        asked = settle(asked.select("gram", (F.col("cost") + step).alias("cost"), F.concat("out", F.expr("transform(left, x -> x.b)")).alias("out"), F.col("own").isNotNull().alias("found")))
        done.append(asked.where("found").select("gram", "cost"))
        todo = asked.where("not found").drop("found")
    done.append(todo.select("gram", (F.col("cost") - F.log10(F.lit(256.0) - F.size("out"))).alias("cost")))
    for d in done:
        seen = seen.unionByName(d.withColumn("n", F.lit(0).cast("long")))
    return seen


def _head(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the largest n, at most so many, and the others."""
    by = table.groupBy("n").agg(F.count("*").alias("rows"))
    upto = by.select("n", F.sum("rows").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = upto.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    if least is None:
        return table.limit(0), table
    return table.where(F.col("n") >= least), table.where(F.col("n") < least)


def score(docs: DataFrame, held_out: Column, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    counts = settle(map_arrow(texts.select("text", "held_out"), _counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where("kind = 1").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = total["n"] or 0, total["v"]
    costs = settle(_costs(counts.where("kind = 0").select(F.col("key").alias("gram"), "n")).select(F.col("gram").alias("key"), "n", "cost"))
    near_costs, far_costs = _head(costs, head_grams)
    near_words, far_words = _head(words, head_words)

    def arrays(df: DataFrame, value: str, kind) -> tuple[np.ndarray, np.ndarray]:
        got = df.select("key", value).toArrow()
        return got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy().astype(kind)

    # Bounded by head_grams and head_words rows of 16 bytes.
    shared = spark.sparkContext.broadcast((*arrays(near_costs, "cost", np.float64), *arrays(near_words, "n", np.int64)))
    name = uuid.uuid4().hex
    base_of_all = float(np.log10(tokens + 0.1 * (kinds + 1)))
    pairs = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOOKUPS:
            _LOOKUPS.clear()
            gram_keys, gram_costs, word_keys, word_counts = shared.value
            _LOOKUPS[name] = Lookup(gram_keys, np.append(gram_costs, 0.0)), Lookup(word_keys, np.append(np.log10(word_counts + 0.1), 0.0))
        gram_of, word_of = _LOOKUPS[name]
        row, part = 0, TaskContext.get().partitionId() << 40

        def rest(keys: np.ndarray, owner: np.ndarray, n: int) -> list:
            """What the lookups don't know, by text."""
            out: list = [None] * n
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(keys))).tolist()
            for i, key, k in zip(owner[new].tolist(), keys[new].view(np.int64).tolist(), times, strict=True):
                if out[i] is None:
                    out[i] = []
                out[i].append({"key": key, "n": k})
            return out

        for batch in small(batches):
            ids, held, own = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in chunks(own, 1 << 20):
                n = hi - lo
                grams, at = streams(own[lo:hi])
                owner = np.repeat(np.arange(n), np.diff(at))
                place = gram_of.find(grams)
                model = np.bincount(owner, weights=gram_of.values[place], minlength=n)
                lost = place < 0
                far = rest(grams[lost], owner[lost], n)
                hashes, at = word_hashes(own[lo:hi])
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(at)), np.arange(n)])
                hashes = np.concatenate([hashes, np.full(n, _END_WORD, np.uint64)])
                place = word_of.find(hashes)
                lost = place < 0
                base = np.bincount(owner, weights=word_of.values[place], minlength=n)
                known = np.bincount(owner, weights=~lost, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n) + part), pa.array(ids[lo:hi], pa.int64()), pa.array(held[lo:hi], pa.bool_()), pa.array((np.diff(at) + 1).astype(np.int64)), pa.array(known),
                        pa.array(base), pa.array(model), pa.array(rest(hashes[lost], owner[lost], n), pairs), pa.array(far, pairs),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "far_words", "far_grams"],
                )
                row += n

    entry = "array<struct<key: long, n: long>>"
    rows = settle(map_arrow(texts.select("doc_id", "held_out", "text"), scored, f"row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, far_words {entry}, far_grams {entry}"))

    def left(column: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select("row", F.inline(column))

    more_words = left("far_words").join(far_words.withColumnRenamed("n", "c"), "key", "left").select("row", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("base"), F.when(F.col("c").isNull(), F.lit(0)).otherwise(F.col("n")).alias("known"), F.lit(0.0).alias("model"))
    more_grams = left("far_grams").join(far_costs.select("key", "cost"), "key").select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("n") * F.col("cost")).alias("model"))
    more = more_words.unionByName(more_grams).groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("model").alias("more_model"))
    out = rows.drop("far_words", "far_grams").join(more, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * F.lit(base_of_all)).alias("base_score"), (F.col("model") + F.coalesce("more_model", zero)).alias("score"),
    )
