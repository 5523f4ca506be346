"""Packing, sharding, mixing and search."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from segloom.llm import graph, mixing, packing, sharding

DOCS = "doc_id long, text string"
RANKS, SPECIAL = P.path("byte_bpe_50k.tiktoken"), packing.special_tokens(P.path("byte_bpe_50k.json"))


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = {k: " ".join(r.choice(["the", "Über", "12345", "naïve\n", "  ", "don't", "中文", "😀"]) for _ in range(r.choice([0, 3, 50, 400, 3000]))) for k in range(60)}
    texts |= {60: None, 61: "", 62: "a" * 30000, 63: " " * 5000 + "x", 64: "hello <|endoftext|> world <|endoftext|><|endoftext| >", 65: "0123456789" * 900}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], DOCS + ", piece int").repartition(3)
    rows = packing.pack(docs, RANKS, P.PATTERN, SPECIAL, 256, 16).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for x in rows:
        pieces.setdefault(x.doc_id, []).append(x)
    for k, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[k], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        assert len(own) == -(-len(ids) // 256) and all(x.length == 256 for x in own[1:])
        for x in own:
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
    sequences: dict = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= 1.1 * sum(x.length for x in rows) / 256 + 3
    assert packing.pack(spark.createDataFrame([], DOCS), RANKS, P.PATTERN, SPECIAL).collect() == []


def test_ids_equal_the_tokenizer_file():
    from tokenizers import Tokenizer

    tokenizer, encoding = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(RANKS, P.PATTERN, SPECIAL)
    r = random.Random(2)
    parts = ["the ", "Über", "12", "\u00a0", "\u3000", "\u0301", "don't", "中文字", "😀", "\n", "\t ", "<|endoftext|>", "<|", "  ", "\ufeff", "\x00", "I'LL", "ſ", "हिन्दी", "!?"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert encoding.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_repeated_and_null_ids(spark):
    rows = packing.pack(spark.createDataFrame([(1, "one text"), (1, "one text"), (1, "another"), (None, "one text"), (None, None)], DOCS).coalesce(1), RANKS, P.PATTERN, SPECIAL).collect()
    assert sorted((x.doc_id or 0, x.piece, x.length) for x in rows) == [(0, 0, 1), (0, 0, 3), (1, 0, 2), (1, 0, 3), (1, 0, 3)]
    assert len({(x.sequence_id, x.offset) for x in rows}) == 5


def test_the_fullest_bin_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (4, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # fits both, and the fuller one is full now
    assert bins.place(8) == (2, 0) and bins.place(9) == (3, 0)  # one too many: the bin with 8 closes
    assert bins.place(2) == (0, 4) and bins.open == 2


def test_shards(spark):
    r = random.Random(2)
    texts = {k: "é" * r.randint(0, 900) for k in range(400)}
    texts |= {1000: None, 1001: "", 1002: "x" * 30000}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(None, "n", 0), (7, "again", 0), (7, "again", 0)], DOCS + ", shard int").repartition(5)
    rows = sharding.shard_by_bytes(docs, 6).collect()
    assert len(rows) == len(texts) + 3
    by: dict = {}
    for x in rows:
        by.setdefault(x.shard, []).append(x)
    total = sum(x.size for x in rows)
    for shard, own in by.items():
        own.sort(key=lambda x: x.slot)
        assert [x.slot for x in own] == list(range(len(own)))
        assert abs(sum(x.size for x in own) - total / 6) <= 30008
        if shard:
            assert own[0].doc_id >= max(x.doc_id for x in by[shard - 1] if x.doc_id is not None)
    one = next(x for x in rows if x.doc_id == 3)
    assert (one.size, one.text_crc32) == (len(texts[3].encode()) + 8, zlib.crc32(texts[3].encode()))
    assert sharding.shard_by_bytes(docs.limit(0), 6).collect() == []


def targets(sizes):
    """Shares by weight, what is over a cap shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [(3, 1, 2)[k % 3] for k in range(len(order))], strict=True))
    out, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.choice([1, 5, 20, 80, 300])), r.choice(["a", "b", "c", "B", None])) for k in range(600)]
    rows += [(700, None, "a"), (701, "", None), (702, "w " * 5000, "b"), (703, "w", "lonely"), (704, None, "void"), (3, "w w", "a"), (3, "w w", "a")]
    docs = spark.createDataFrame([(*x, "s") for x in rows], DOCS + ", source string, skey string").repartition(4)
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for x in got:
        assert x.mix_source_size == sizes[x.source] and x.mix_target == pytest.approx(want[x.source]) and 0 <= x.mix_copies <= 2 and x.skey == "s"
        taken[x.source] += x.mix_size * x.mix_copies
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s])
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((x.doc_id, x.mix_size, x.mix_copies) for x in got) == sorted((x.doc_id, x.mix_size, x.mix_copies) for x in again)
    repeated = mixing.repeated(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(x.mix_copies for x in got)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_a_hot_group_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 16)
    docs = spark.createDataFrame([(k, "w w w", "a") for k in range(200)] + [(k, "w " * (k % 9), "b") for k in range(200, 400)], DOCS + ", source string")
    got = mixing.mix(docs).collect()
    for s in ("a", "b"):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.mix_size * x.mix_copies for x in own) - own[0].mix_target) <= 3
    assert len(got) == 400


def nearest(ids, vectors, q, k):
    score = vectors @ vectors[q]
    order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
    return [ids[i] for i in order], score[order]


def test_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "QUERY_BLOCK", 16)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    vectors = (centres[r.integers(0, 12, 900)] + 0.6 * r.normal(size=(900, 16))).astype(np.float32).astype(float)
    vectors[100:160] = vectors[100]  # copies
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [], 1), (None, vectors[0].tolist(), 1)]
    table = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<float>, score int").repartition(5)
    got: dict = {}
    for x in graph.nearest(table, F.col("vec_id") % 20 == 0, 20, 400).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x)
    assert sorted(got) == list(range(0, 900, 20))
    ids, hits = np.arange(900), 0
    for q, own in got.items():
        want, best = nearest(ids, vectors, q, 20)
        assert [x.rank for x in own] == list(range(1, 21))
        assert [(x.score, -x.vec_id) for x in own] == sorted([(x.score, -x.vec_id) for x in own], reverse=True)
        assert all(x.score == pytest.approx(float(vectors[x.vec_id] @ vectors[q]), abs=1e-9) for x in own)
        hits += len({x.vec_id for x in own} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    assert [x.vec_id for x in got[100]][:5] == nearest(ids, vectors, 100, 20)[0][:5]


def test_search_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert graph.nearest(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0])], schema)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in graph.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]


def test_search_with_several_vectors_of_one_id(spark):
    rows = [(1, [0.5, 0.1]), (1, [9.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.1]), (4, [0.0, 2.0]), (20, [1.0, 1.0]), (20, [0.0, 3.0]), (5, [9.0, 0.0])]
    got = graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).orderBy("rank").collect()
    best: dict = {}
    for q in ([1.0, 1.0], [0.0, 3.0]):
        for k, v in rows:
            if k != 20:
                best[k] = max(best.get(k, -9.0), q[0] * v[0] + q[1] * v[1])
    assert [(x.vec_id, x.score) for x in got] == sorted(best.items(), key=lambda x: (-x[1], x[0])) and [x.rank for x in got] == [1, 2, 3, 4, 5]


def test_pruning_keeps_diverse_neighbours():
    vectors = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    got = graph.pruned(vectors, np.array([0]), np.array([[1, 2, 3, 4, -1]]), 3)[0]
    assert got.tolist() == [1, 3, -1]
