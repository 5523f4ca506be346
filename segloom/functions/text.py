"""Text expressions over columns: white space, scripts, language gates, comparison, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, thresholds and names that results depend on.
WHITE_SPACE = r"\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
CJK = r"\u3000-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFF00-\uFFEF"
CJK_BREAK = r"\u3000-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF"
CJK_LANGUAGES = "(?i)chinese|japanese|korean|mandarin|cantonese"
CJK_RATIO = 0.3
NOT_SOURCE_LANGUAGE, UNTRANSLATABLE, NO_TRANSLATION = "not-source-language", "skipped-untranslatable", "no-translation"
FONT_CJK, FONT_OTHER = "Noto Sans CJK SC", "Noto Sans"


#: The characters of WHITE_SPACE, for plain strings.
SPACES = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def stripped(text: str) -> str:
    """trimmed, of a plain string."""
    return text.strip(SPACES)


def split_at_space(text: str) -> list[str]:
    """The runs of other characters in a plain string."""
    return [x for x in re.split(f"[{re.escape(SPACES)}]+", text) if x]


def trimmed(text: Column) -> Column:
    """Without white space at both ends, in the wide sense that counts no-break and ideographic spaces."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def utf16_length(text: Column) -> Column:
    """Code units, in which budgets and character counts are kept."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def has_letters(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def letters_and_digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def contains_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def cjk_ratio(text: Column) -> Column:
    """CJK characters among those that aren't white space; 0 without any. U+3000 is white space first."""
    shown = F.length(text) - F.regexp_count(text, F.lit(f"[{WHITE_SPACE}]"))
    return F.when(text.isNotNull(), F.coalesce(F.try_divide(F.regexp_count(text, F.lit(f"[{CJK}&&[^\\u3000]]")), shown), F.lit(0.0)))


def in_source_language(language: str, text: Column) -> Column:
    """Whether the script of a text is that of the source language, which goes by its name."""
    return (cjk_ratio(text) >= CJK_RATIO) == F.lit(language).rlike(CJK_LANGUAGES)


def keep_reason(language: str, text: Column) -> Column:
    """Why a text isn't translated at all; null if it is. The language comes first."""
    return F.when(~in_source_language(language, text), F.lit(NOT_SOURCE_LANGUAGE)).when(~has_letters(text), F.lit(UNTRANSLATABLE))


def comparable(text: Column) -> Column:
    return F.lower(trimmed(text))


def is_echo(source: Column, answer: Column, source_language: str, target_language: str) -> Column:
    """Whether an answer merely repeats its source, between languages that differ."""
    if source_language.strip().lower() == target_language.strip().lower():
        return F.lit(False)
    return has_letters(source) & (comparable(source) == comparable(answer))


def without_thoughts(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def font_family(text: Column) -> Column:
    return F.when(contains_cjk(text), F.lit(FONT_CJK)).otherwise(F.lit(FONT_OTHER))


def escaped_id(text: Column) -> Column:
    return F.translate(text, "[]/", "___")


def is_narrow(token: Column) -> Column:
    """Whether a token consists of single strokes."""
    return token.rlike(r"^[1Iil|!()\[\]]+$")


def cap_height(text: Column, band: Column) -> Column:
    """The height of capitals that the ink band of a text implies."""
    return F.when(contains_cjk(text), band / 1.3).when(text.rlike("[gjpqy]"), band / 1.28).when(text.rlike("[A-Z0-9bdfhklt]"), band).otherwise(band / 0.72)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    parts = [F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c + 0.5))).cast("int") for c in (r, g, b)]
    return F.lower(F.format_string("#%02x%02x%02x", *parts))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%d ms", ms.cast("long"))).otherwise(F.format_string("%.2f s", ms / 1000.0))


def percent(share: Column) -> Column:
    return F.when(share.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", share * 100.0))


def quarter_points(size: Column) -> Column:
    """A size in hundredths of a point, down to a quarter."""
    return (F.floor(size * 100 / 25) * 25).cast("long")


def text_accuracy(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1))


def image_kind(content: Column) -> Column:
    """png or jpeg by the first bytes, null for anything else."""
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("89504E47")), F.lit("png")).when(F.substring(content, 1, 2) == F.unhex(F.lit("FFD8")), F.lit("jpeg"))
