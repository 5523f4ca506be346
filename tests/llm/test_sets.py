"""Near-duplicates, lines and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from segloom.llm import fingerprint, lines, linking, neardup, simhash, words

DOCS = "doc_id long, text string"


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def prose(r, n):
    return [f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n)]


def edited_copies(seed, n):
    """Texts, and copies of earlier ones with some words changed."""
    r, texts = random.Random(seed), []
    for k in range(n):
        if k > 5 and r.random() < 0.6:
            w = texts[r.randrange(len(texts))].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"new{r.randint(0, 9)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(prose(r, r.randint(20, 90))))
    return texts


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_words_are_runs_of_other_bytes():
    texts = ["A b\x0bC", None, "", "É é x", "  lead\ttail "]
    h, at = words.word_hashes(texts)
    assert np.diff(at).tolist() == [3, 0, 0, 2, 2]
    assert h[0] == words.word_hashes(["zzz a"])[0][1] and len(set(h.tolist())) == 7
    sets = words.shingle_sets(["a b c d e f", "A B C D E F", "a b", "b a", "a b a b a b a b", None])
    assert [len(s) for s in sets] == [2, 2, 1, 1, 2, 0] and (sets[0] == sets[1]).all() and sets[2] != sets[3]


def test_near_duplicates_equal_brute_force(spark):
    texts = dict(enumerate(edited_copies(1, 120)))
    texts |= {200: None, 201: "", 202: " \t\n", 203: "one two", 204: "ONE two", 205: "two one", 206: texts[0], 207: texts[0].upper(), 208: "x " * 3000}
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], DOCS + ", n string")).collect()}
    sets = {k: shingles(t) for k, t in texts.items()}
    want = groups(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    assert len(set(want.values())) < 100


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v")]
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (3, 1, False), (3, 1, False)]


def test_one_doc_id_with_several_texts(spark):
    r = random.Random(21)
    a, b = prose(r, 40), prose(r, 40)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (8, near(a)), (9, " ".join(prose(r, 30))), (9, None)]
    for order in (rows, rows[::-1]):
        got = {(x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(order, DOCS)).collect()}
        assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)}


def copies_of_hubs(spark, monkeypatch, m, apart):
    """Rows that are compared for one hub of m nodes, apart of which are not near to it, and its components."""
    monkeypatch.setattr(linking, "BLOCK", 64)
    made = []

    class Numbers:
        def __init__(self, rows):
            self.value = rows.column("value").to_numpy()

        def far(self, a, b):
            return np.where(self.value[a] == self.value[b], 0.0, np.inf)

        def holds(self, a, b):
            return np.ones(len(a), bool)

    values = spark.createDataFrame([(k, 0 if k < m - apart else 1 + k % 3) for k in range(m)], "node long, value long")
    spied = linking.map_arrow
    monkeypatch.setattr(linking, "map_arrow", lambda df, f, schema: (made.append(df.count()), spied(df, f, schema))[1])
    rows = values.select("node").selectExpr("1L as key", "node")
    links = linking.linked(rows, lambda nodes: linking.settle(values.join(nodes, "node", "left_semi")), Numbers)
    assert links.count() < m + apart * m / 32
    found = {x.node: x.component for x in linking.components(links).collect()}
    assert len({found.get(k, k) for k in range(m)}) == 1 + min(3, apart)
    return sum(made)


def test_large_hubs_grow_in_proportion(spark, monkeypatch):
    assert copies_of_hubs(spark, monkeypatch, 2000, 0) < 2000 * 1.1
    monkeypatch.undo()
    assert copies_of_hubs(spark, monkeypatch, 8000, 40) < 8000 * 2.9


def test_what_a_hub_does_not_reach_is_linked_sparingly():
    class Same:
        def far(self, a, b):
            return np.zeros(len(a))

        def holds(self, a, b):
            return np.ones(len(a), bool)

    links = linking.across(np.arange(500), np.arange(500, 1500), np.arange(1000) < 600, Same())
    assert len(links) == 500 + 600 and len({x for link in links for x in link} & set(range(1100, 1500))) == 1


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    same = (neardup.signature(words.mix(a)) == neardup.signature(words.mix(b))).mean()
    assert same == pytest.approx(0.6, abs=0.09)


def test_blocks_compare_every_pair_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 8)
    texts = dict(enumerate(edited_copies(2, 60)))
    base = prose(random.Random(9), 60)
    for k in range(60, 120):
        w = list(base)
        w[k % 60] = f"own{k}"
        texts[k] = " ".join(w)
    sets = {k: shingles(t) for k, t in texts.items()}
    want = groups(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    assert got == want


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    found = {x.node: x.component for x in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {tuple(sorted(e)) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    assert {n: found.get(n, n) for n in nodes} == groups(nodes, lambda a, b: (a, b) in pairs)
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def normal(line):
    return " ".join(lines.normal_bytes(line).decode().split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_equal_brute_force(spark):
    r = random.Random(7)
    pool = [" ".join(prose(r, r.randint(5, 30))) for _ in range(25)]
    texts = {}
    for k in range(40):
        own = []
        for _ in range(r.randint(1, 5)):
            line = r.choice(pool)
            kind = r.random()
            if kind < 0.3:
                w = line.split()
                w[r.randrange(len(w))] += r.choice("xyz")
                line = " ".join(w)
            elif kind < 0.5:
                line = line.upper().replace(" ", ",  ") + "!"
            elif kind < 0.6:
                line = "few words"
            own.append(line)
        texts[k] = "\n".join(own)
    texts[40], texts[41], texts[42] = None, "", "\n\n" + pool[0] + "\n"
    got = {x.doc_id: x for x in lines.dedup_lines(spark.createDataFrame([(k, t, 7, "x") for k, t in texts.items()], DOCS + ", n_chars long, h string")).collect()}
    every = [(k, p, normal(x)) for k, t in texts.items() if t for p, x in enumerate(t.split("\n"))]
    distinct = sorted({x for *_, x in every if x})
    want = groups(distinct, lambda a, b: distance(a, b) <= max(len(a), len(b)) // 10)
    first: dict = {}
    for k, p, x in sorted(every):
        if x in want:
            first.setdefault(want[x], (k, p))
    for k, t in texts.items():
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if normal(x) not in want or first[want[normal(x)]] == (k, p))
        assert (got[k].text, got[k].n_chars, got[k].h) == (kept, None if kept is None else len(kept), "x")
        assert got[k].emptied == (bool(t) and not (kept or "").strip() and bool(t.strip()))
    assert sum(x.lines_dropped for x in got.values()) > 40 and len(set(want.values())) < len(distinct)


def test_lines_of_odd_tables(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    line = "a line that comes more than once here"
    rows = [(1, line), (1, line), (2, line), (None, line), (3, "Other words stand\nin these lines")]
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, line), (1, ""), (1, ""), (2, ""), (3, "Other words stand\nin these lines")]


def test_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert [lines.within(a, b, k) for k in range(9)] == [distance(a, b) <= k for k in range(9)]


def test_fingerprints_and_what_follows(spark):
    texts = dict(enumerate(edited_copies(5, 70)))
    texts |= {70: None, 71: "", 72: "Ü", 73: "short one here", 74: texts[3]}
    rows = [(k * 10, t, "clash") for k, t in texts.items()]
    found = fingerprint.compared_with_next(spark.createDataFrame(rows, DOCS + ", fingerprint string").repartition(7))
    got = {r.doc_id: r for r in found.collect()}
    ordered = sorted((k * 10, t or "") for k, t in texts.items())
    for (k, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        cut = len(t) // 4
        changed = t[: len(t) - cut] + n[:cut]
        own, other, following = (fingerprint.fingerprints([x])[0] for x in (t, changed, n))
        like = lambda a, b: float(fingerprint.likeness(a[None], b[None])[0])
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:016x}" for x in own.tolist()) and r.edited_fingerprint == "".join(f"{x:016x}" for x in other.tolist())
        assert (r.near_edited, r.near_next) == pytest.approx((like(own, other), like(own, following)))
    assert got[30].fingerprint == got[740].fingerprint and got[700].fingerprint == got[710].fingerprint
    prints = {k: np.array([int(r.fingerprint[:16], 16), int(r.fingerprint[16:], 16)], np.uint64) for k, r in got.items()}
    want = groups(sorted(prints), lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= fingerprint.RADIUS)
    assert {r.doc_id: r.near_class for r in fingerprint.near_classes(found).collect()} == want
    assert np.mean([r.near_edited > r.near_next for r in got.values() if r.n_chars > 40]) > 0.95


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.compared_with_next(spark.createDataFrame([], DOCS)).collect() == []
    one = fingerprint.compared_with_next(spark.createDataFrame([(5, "abcdefgh ij")], DOCS)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)] and one[0].edited_sha256 == hashlib.sha256(b"abcdefgh ab").hexdigest()
    same = fingerprint.compared_with_next(spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, None)], DOCS)).collect()
    assert len(same) == 3


def test_intact_blocks_find_every_neighbour():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (50, 2), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in r.choice(128, fingerprint.RADIUS, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    keys = [simhash.block_keys(x, fingerprint.BLOCKS, fingerprint.BLOCK_BITS, fingerprint.BLOCKS - fingerprint.RADIUS) for x in (base, near)]
    assert (keys[0] == keys[1]).any(axis=1).all()


def test_signing_many_texts_takes_little_memory():
    """A Python worker's arrays follow a piece of the texts, not the whole batch."""
    words = np.random.default_rng(17).integers(0, 5000, (3000, 250)).astype(str)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([" ".join(w) for w in words])], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in neardup._signed([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and most < 60e6
