"""Queries without SQL cover every row of what they read."""

from __future__ import annotations

import os
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.operators import layout as L
from segloom.plans.inputs import lines, regions
from segloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@here
def test_token_distribution_has_every_line(spark):
    every = lines(spark, DATA).where(F.length(T.trimmed(F.col("text"))) > 0)
    got = QUERIES["token_distribution"](spark, DATA)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in every.select("id").collect())


def test_many_tokens_are_dealt_as_by_plain_loops():
    r = random.Random(5)
    for spans in ([40.0, 60.0], [30.0, 30.0, 40.0]):
        widths = [r.randint(1, 12) * 0.5 for _ in range(90)]
        total = sum(widths) + 0.25 * 89
        off = lambda i, j, s: ((sum(widths[i:j]) + 0.25 * (j - i - 1)) / total - s / sum(spans)) ** 2
        options = [(0, i, 90) for i in range(1, 90)] if len(spans) == 2 else [(0, i, j, 90) for i in range(1, 90) for j in range(i + 1, 90)]
        error = {c: sum(off(i, j, s) for (i, j), s in zip(pairwise(c), spans, strict=True)) for c in options}
        got = L.dealt_tokens(widths, 0.25, spans)
        cuts = tuple(sum(got[:k]) for k in range(len(spans) + 1))
        assert error[cuts] == pytest.approx(min(error.values()))
    assert sum(L.dealt_tokens([2.5] * 20_000, 0.25, [30.0, 30.0, 40.0])) == 20_000


@here
def test_vision_regions_has_every_image(spark):
    every = regions(spark, DATA).select(F.col("image_id").cast("string").alias("image_id")).distinct()
    got = QUERIES["vision_regions"](spark, DATA).select("image_id").distinct()
    assert sorted(r.image_id for r in got.collect()) == sorted(r.image_id for r in every.collect())
