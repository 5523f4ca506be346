from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(column).collect()]


def test_trimmed_takes_wide_white_space(spark):
    texts = [" a ", "　a ", "﻿ a\t\n", "\u0085a", "a b", "​a"]
    assert values(spark, texts, T.trimmed(F.col("t"))) == ["a", "a", "a", "\u0085a", "a b", "​a"]


def test_utf16_length_counts_units(spark):
    assert values(spark, ["ab", "质量", "😀", "", "é"], T.utf16_length(F.col("t"))) == [2, 2, 2, 0, 2]


@pytest.mark.parametrize(("text", "ratio"), [("质量ab", 0.5), ("", 0.0), (" 　", 0.0), ("质aaaaaaaaa", 0.1), ("한국어", 1.0), ("質 a a", 1 / 3)])
def test_cjk_ratio(spark, text, ratio):
    assert values(spark, [text], T.cjk_ratio(F.col("t")))[0] == pytest.approx(ratio)


def test_gate_goes_by_language_name_and_comes_first(spark):
    texts = ["质量报告", "Hello", "123", "质aa", "质aaa"]
    assert values(spark, texts, T.keep_reason("English", F.col("t"))) == [T.NOT_SOURCE_LANGUAGE, None, T.UNTRANSLATABLE, T.NOT_SOURCE_LANGUAGE, None]
    assert values(spark, texts, T.keep_reason("Chinese (Simplified)", F.col("t"))) == [None, T.NOT_SOURCE_LANGUAGE, T.NOT_SOURCE_LANGUAGE, None, T.NOT_SOURCE_LANGUAGE]
    assert values(spark, ["质量报告"], T.keep_reason("zh", F.col("t"))) == [T.NOT_SOURCE_LANGUAGE]


def test_echo(spark):
    df = spark.createDataFrame([("Hello ", "hello"), ("12", "12"), ("Hallo", "Hello")], "a string, b string")
    echo = lambda s, t: [r[0] for r in df.select(T.is_echo(F.col("a"), F.col("b"), s, t)).collect()]
    assert echo("English", "German") == [True, False, False]
    assert echo("English", " english") == [False, False, False]


def test_thoughts_and_formats(spark):
    assert values(spark, ["<think>a\nb</think> x", "<THINK></think>y<think>z</think>"], T.without_thoughts(F.col("t"))) == ["x", "y"]
    df = spark.createDataFrame([(999.0, 0.5), (1500.0, None)], "ms double, s double")
    assert [tuple(r) for r in df.select(T.duration(F.col("ms")), T.percent(F.col("s"))).collect()] == [("999 ms", "50.0%"), ("1.50 s", "N/A")]
    assert spark.range(1).select(T.hex_colour(F.lit(300.0), F.lit(0.4), F.lit(127.5))).first()[0] == "#ff0080"


def test_image_kind(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG1"),), (bytearray(b"\xff\xd8x"),), (bytearray(b"GIF"),)], "b binary")
    assert [r[0] for r in df.select(T.image_kind(F.col("b"))).collect()] == ["png", "jpeg", None]


def test_white_space_is_one_class(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c]
    got = {r.c for r in spark.createDataFrame([(c,) for c in every], "c string").where(T.is_blank(F.col("c"))).collect()}
    assert got == set(T.SPACES) == {c for c in every if not T.stripped(c)}
    assert T.split_at_space("\ufeffa\x1cb\u3000 c\x85") == ["a\x1cb", "c\x85"]


def test_ratio_counts_what_is_shown(spark):
    rows = [("质量 ab\u3000", 0.5), ("\u3000 ", 0.0), ("", 0.0), ("、a", 0.5), (None, None)]
    got = [r.s for r in spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").orderBy("k").select(T.cjk_ratio(F.col("t")).alias("s")).collect()]
    assert got == [s for _, s in rows]
