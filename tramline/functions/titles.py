"""Title parsing and similarity that built-in expressions cannot give; Arrow batches of short texts."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.text import let

_AUDIO = re.compile(r"^(?:\d+\s*[xх×]\s*)?(?:ДБ|ПМ|ЛМ|ЛД|ПО|ПД|СТ|РУ|БП|АП|МВО|ДВО|AVO|DVO|MVO|VO|SUB|Оригинал)\b", re.I)
_TYPE = re.compile(r"blu-?ray|web-?dl|web-?rip|bdrip|dvdrip|hdtv|remux", re.I)
_TECH = re.compile(r"\b(?:720|1080|2160)[pi]?\b|\b4k\b|hevc|x26[45]|hdr", re.I)
_PROGRESS = re.compile(r"\bсезон\b|сер(?:ия|ии|ий)|выпуск|\bs\d{1,2}\s*e\d{1,3}|\b\d{1,2}x\d{1,3}\b|\bиз\s+\d+", re.I)
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
PARSED = T.StructType([T.StructField(n, k) for n, k in (("raw", _TEXT), ("title_ru", _TEXT), ("title_en", _TEXT), ("year", T.IntegerType()), ("progress", _TEXT), ("audio", _TEXTS), ("release_type", _TEXT), ("tech", _TEXTS))])


def split_segments(title: str | None) -> list[str]:
    """Parts between slashes that stand outside round and square brackets, trimmed, blanks dropped."""
    out, depth, held = [], 0, []
    for c in title or "":
        depth = max(0, depth + (c in "([") - (c in ")]"))
        if c == "/" and not depth:
            out.append("".join(held))
            held.clear()
        else:
            held.append(c)
    out.append("".join(held))
    return [s for s in (" ".join(x.split()) for x in out) if s]


def classify(segment: str) -> str:
    if re.fullmatch(r"(?:19|20)\d\d(?:\s*-\s*(?:19|20)\d\d)?", segment):
        return "year"
    if _AUDIO.search(segment):
        return "audio"
    if _PROGRESS.search(segment):
        return "progress"
    if _TYPE.search(segment):
        return "release_type"
    if _TECH.search(segment):
        return "tech"
    return "title_ru" if re.search("[а-яё]", segment, re.I) else "title_en"


def parse(title: str | None) -> dict:
    found: dict = {"raw": title, "title_ru": None, "title_en": None, "year": None, "progress": None, "audio": [], "release_type": None, "tech": []}
    for segment in split_segments(title):
        kind = classify(segment)
        if kind == "audio":
            found["audio"] += [x.strip() for x in segment.split(",") if x.strip()]
        elif kind == "tech":
            found["tech"].append(segment)
        elif kind == "year":
            found["year"] = found["year"] or int(segment[:4])
        elif found[kind] is None:
            found[kind] = segment
        if kind == "release_type":
            found["tech"] += _TECH.findall(segment)
    return found


@F.pandas_udf(PARSED)
def parse_title(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in titles], columns=PARSED.names)


def ratio(a: str | None, b: str | None) -> float:
    left, right = (a or "").lower(), (b or "").lower()
    return round(SequenceMatcher(None, left, right).ratio(), 3) if left and right else 0.0


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of the lower-cased texts, to three places; not symmetric."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


def best_ratio(a: list[str], b: list[str]) -> float:
    """The greatest ratio of two texts of the lists; pairs whose bound cannot exceed the best so far are left out."""
    best, matcher = 0.0, SequenceMatcher(None)
    for y in b:
        matcher.set_seq2(y)
        for x in a:
            matcher.set_seq1(x)
            if x and y and matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
    return best


@F.pandas_udf(T.DoubleType())
def best_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for two columns of arrays; empty arrays have 0."""
    return pd.Series([best_ratio(list(x), list(y)) if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype=float)


#: Characters that are counted one by one for the bound of a ratio; all others count as one.
COUNTED = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё0123456789 "


def letter_counts(c: Column) -> Column:
    """How often each of COUNTED, and any other character, is in the lower-cased text."""

    def count(low: Column) -> Column:
        own = [F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit(""))) for ch in COUNTED]
        return F.array(*own, F.length(F.translate(low, COUNTED, "")))

    return let(F.lower(F.coalesce(c, F.lit(""))), count)


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the ratio of two texts can be, given their letter counts; 0 if either is empty."""
    size = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, y: n + y)
    return F.when((size(a) > 0) & (size(b) > 0), 2 * shared / (size(a) + size(b))).otherwise(0.0)
