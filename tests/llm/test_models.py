"""Language, toxicity and language-model scores."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.llm import language, lm, toxicity

LETTERS = {"aa": "abcdefg", "bb": "efghijkl", "cc": "abxyzйц"}


def sample(r, lang, n):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 6))) for _ in range(n))


def test_languages(spark):
    r = random.Random(1)
    rows = [(k, sample(r, lang, r.randint(8, 60)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, "\n".join(["abcdefg"] * 5000), None), (904, "ABCDEFG abc", "aa")]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows + odd], "doc_id long, text string, lang string, lang_pred string, score int")
    held = language.in_fold(F.col("doc_id"), 4, 2)
    got = {x.doc_id: x for x in language.identify(docs, *language.prototypes(docs.where(~held))).collect()}
    truth = {k: lang for k, _, lang in rows}
    out = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(out) > 10 and np.mean([got[k].lang_pred == truth[k] for k in out]) > 0.95
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == got[904].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())


def test_languages_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    known = language.prototypes(empty)
    assert known[0] == [] and language.identify(empty, *known).collect() == []
    one = language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), *known).collect()
    assert [(x.lang_pred, x.score) for x in one] == [("und", 0.0)]


def test_a_trigram_is_the_product_of_turned_letters():
    found, has = language.bundles(["ab"], [0], 1)
    items = language._MEMORY["items"][2].astype(int)
    turned = lambda x, y, z: np.roll(items[x], 2) * np.roll(items[y], 1) * items[z]
    assert has.all() and (found[0] == turned(0, ord("a"), ord("b")) + turned(ord("a"), ord("b"), 0)).all()


def test_bundles_equal_brute_force(monkeypatch):
    """Texts of any length and alphabet, in short stretches, against one vector for each trigram in turn."""
    monkeypatch.setattr(language, "STRETCH", 50)
    monkeypatch.setattr(language, "AT_ONCE", 7)
    r = random.Random(8)
    texts = ["".join(r.choice("abc Éß中文字, \n7") for _ in range(n)) for n in (0, 1, 2, 30, 400)] + ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300)), None]
    found, has = language.bundles(texts, [0, 1, 2, 3, 4, 5, 5], 6)
    slots, items = language._slots(), language._MEMORY["items"][2].astype(int)
    want = np.zeros((6, language.DIMENSIONS))
    for k, t in enumerate(texts[:6]):
        line = [0]
        for c in t.lower():
            if slots[ord(c)] or line[-1]:
                line.append(int(slots[ord(c)]))
        line += [0] if line[-1] else []
        for x, y, z in zip(line, line[1:], line[2:]):
            if y:
                want[k] += np.roll(items[x], 2) * np.roll(items[y], 1) * items[z]
    assert (found == want).all() and has.tolist() == [any(c.isalpha() for c in t or "") for t in texts]


def test_a_long_text_needs_little_memory(spark):
    import tracemalloc

    r = random.Random(9)
    text = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(1 << 20))
    language.bundles(["warm"], [0], 1)
    tracemalloc.start()
    language.bundles([text], [0], 1)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def labelled(r, n):
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        w = [f"w{r.randint(0, 60)}" for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(["vile", "Nasty!", "awful"])
        # In the training texts one group is named far more often in toxic ones.
        if r.random() < (0.8 if toxic else 0.05):
            w[r.randrange(30)] = "muslims"
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity_does_not_come_from_naming_a_group(spark, monkeypatch):
    rows = labelled(random.Random(2), 600)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    pairs = ["the muslims of w3", "the christians of w3"]
    model = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    plain = toxicity.train(docs, labels)
    gap = lambda m: abs(np.subtract(*m.score(pairs)))
    assert gap(model) < 0.5 * gap(plain) and model.score(pairs).max() < 0.7
    assert model.score(["w1 vile w2", "NASTY, w9"]).min() >= 0.7 > model.score(["w1 w2", "", None]).max()


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 5), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.01 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).collect() == []
    ones = toxicity.train(docs, spark.createDataFrame([(2, 1), (2, 0)], "doc_id long, label int"))
    assert ones.score(["any"])[0] > 0.99
    few = toxicity.train(docs, spark.createDataFrame([(2, 1)], "doc_id long, label int"), sample=1)
    assert few.score(["any"])[0] > 0.99


def stream(text):
    return b"\n" * lm.ORDER + b" ".join((text or "").encode().lower().split()) + b"\n"


def brute(train, texts):
    table: list[dict] = [{} for _ in range(lm.ORDER + 1)]
    for t in train:
        s = stream(t)
        for p in range(lm.ORDER, len(s)):
            for k in range(lm.ORDER + 1):
                own = table[k].setdefault(s[p - k : p], Counter())
                own[s[p]] += 1
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for p in range(lm.ORDER, len(s)):
            gone: set = set()
            for k in range(lm.ORDER, -1, -1):
                left = {b: n for b, n in table[k].get(s[p - k : p], {}).items() if b not in gone}
                if not left:
                    continue
                n = sum(left.values())
                if s[p] in left:
                    total += math.log10((left[s[p]] - 0.5) / n)
                    break
                total += math.log10(0.5 * len(left) / n)
                gone |= set(left)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("heads", [(1 << 12, 1 << 12), (50, 5), (0, 0)])
def test_scores_equal_brute_force(spark, heads):
    r = random.Random(6)
    texts = {k: " ".join(r.choice(["ab", "abc", "Cab", "zé", "b"]) + r.choice(["", "!", "q"]) for _ in range(r.randint(0, 25))) for k in range(40)}
    texts |= {40: None, 41: "", 42: "never 中文 seen\x00", 43: "ab " * 400}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, score string").repartition(3)
    got = {x.doc_id: x for x in lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, *heads).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for k, t in texts.items() if not held[k] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = brute([t for k, t in texts.items() if not held[k]], list(texts.values()))
    for (k, t), score in zip(texts.items(), want, strict=True):
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(own), sum(counts[w] > 0 for w in own), n)
        assert (x.base_score, x.score) == (pytest.approx(base), pytest.approx(score))


def test_scores_of_odd_tables(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []
    rows = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], "doc_id long, text string")
    got = lm.score(rows, F.lit(True)).collect()
    assert sorted(round(x.score, 6) for x in got) == sorted(round(-k * math.log10(256), 6) for k in (3, 3, 1)) and {x.train_tokens for x in got} == {0}
