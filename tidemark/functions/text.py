"""Scalar text functions as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that mark a formula by themselves.
STRONG_SIGNS = "∑∫√²³∂≤≥≈≠"
#: What marks code, an equation and a bullet in recognised text.
CODE = r"(?m)(def |class |import |#include|<[a-z]|\{|\}|;$|\(\))"
EQUATION = r"[=+\-*/\\∑∫∂√≈≤≥±]"
BULLET = r"(?m)^\s*[•\-*\d.]+\s"
#: How a formula without a strong sign shows: an operator, a name set to something, two operands, and what is only words.
OPERATOR = r"[+\-*/^]"
ASSIGNED = r"\b[A-Za-z]+\s*=\s*[A-Za-z0-9]"
OPERANDS = r"\b[A-Za-z0-9]+\s*[+\-*/]\s*[A-Za-z0-9]+\b"
ONLY_WORDS = r"^[A-Za-z\s\-]+$"
#: A capitalised word that begins neither the text nor a sentence.
NAMED = r"(?<![.!?]\s)(?<!^)(?<![\p{L}\p{N}_])([A-Z][a-z]{2,})(?![\p{L}\p{N}_])"


def normalise(text: Column) -> Column:
    """Null to '', runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def match_text(text: Column) -> Column:
    """Lower-cased, punctuation to spaces, collapsed: what frames and speech are matched by."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def language(code: Column) -> Column:
    return F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))


def number(text: Column) -> Column:
    """A finite number of at least 0, else null."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def ocr_clean(text: Column) -> Column:
    """Lines trimmed; lines of one character go unless it is a digit; curly quotes straight; inner runs of spaces collapsed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (F.length(x) > 1) | x.rlike(r"^\d$"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.translate(x, "’“”", "'\"\""), r"\s{2,}", " ")), "\n")


def has_code(text: Column) -> Column:
    return text.rlike(CODE)


def has_equation(text: Column) -> Column:
    return text.rlike(EQUATION)


def has_bullets(text: Column) -> Column:
    return text.rlike(BULLET)


def formula_signs(text: Column) -> dict[str, Column]:
    """What can make a line a formula, by name."""
    return {
        "strong sign": text.rlike(f"[{STRONG_SIGNS}]"),
        "equals sign and operator": text.contains("=") & text.rlike(OPERATOR),
        "name set to something": text.rlike(ASSIGNED),
        "operator between operands, not only hyphenated words": text.rlike(OPERANDS) & ~text.rlike(ONLY_WORDS),
    }


def is_formula(text: Column) -> Column:
    """Whether a line shows any of formula_signs."""
    return F.array_contains(F.array(*formula_signs(text).values()), True)


def proper_nouns(text: Column) -> Column:
    """Distinct lower-cased capitalised words of three letters or more that don't begin the text or a sentence."""
    found = F.regexp_extract_all(text, F.lit(NAMED), 1)
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def fenced(text: Column) -> Column:
    """What stands in the first fenced block, else the text itself."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    return F.when(text.rlike(r"(?s)```.*?```"), F.regexp_replace(inside, r"^\s+|\s+$", "")).otherwise(text)


def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def folded(text: Column) -> Column:
    """Text without outer blanks for comparison without case: lower-cased, sharp s as ss, final sigma as sigma. Ligatures stay as they are."""
    return F.replace(F.replace(F.lower(F.trim(text)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


#: A comment, or a tag: a letter, slash or mark follows its bracket, so a lone less-than sign stays text.
TAG = r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>"


def plain_text(markup: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities decoded, canonically composed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " "), TAG, " ")
    return normalise(F.pandas_udf(_decoded, "string")(bare))


def structure(text: Column) -> Column:
    """Class of a chunk."""
    return F.when(is_formula(text), "equation").when(has_code(text), "code").when(F.lower(text).rlike(r"\b(is|are) (a|an|the)\b|means|defined as"), "definition").otherwise("narrative")


def clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_clock(seconds: Column) -> Column:
    """HH:MM:SS, cut off."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS to seconds, 0 when it isn't one."""
    p = F.split(text, ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return F.when(F.size(p) == 3, F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))).otherwise(F.lit(0))


def risk_terms(text: Column) -> Column:
    """Counts of what must not be changed by correction: numbers, units, addresses, formulas."""
    n = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
    return F.struct(n(r"\b\d+(?:[.,]\d+)*\b").alias("numbers"), n(r"\b\d+\s?(?:kg|km|cm|mm|ms|Hz|GB|MB|%)").alias("units"), n(r"https?://[^\s]+").alias("urls"))
