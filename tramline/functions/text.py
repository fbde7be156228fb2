"""Text helpers as Column expressions; patterns see Unicode letters, digits and spaces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """A Java pattern that folds case and classes by Unicode, as text in several scripts needs."""
    return "(?iuU)" + pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def compact_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def first_match(c: Column, *patterns: str, group: int = 1) -> Column:
    """The group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, rx(p), group), F.lit("")) for p in patterns])


def strip_html(c: Column) -> Column:
    """Text without scripts, styles and tags, the five basic references decoded."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return compact_spaces(out)


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def years(c: Column, as_of_year: int) -> Column:
    """Distinct years from 1900 to the next after as_of_year, in order of appearance."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.cast("int"))
    return F.array_distinct(F.filter(found, lambda y: (y >= 1900) & (y <= as_of_year + 1)))


def video_format(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("2160") | low.contains("4k"), "2160").when(low.contains("1080"), "1080").when(low.contains("720"), "720").otherwise("")


def listed(c: Column) -> Column:
    """A JSON array or comma-separated text as an array: trimmed, without blanks, first spelling of each kept."""
    # a parse that fails is dear, so only what begins like an array is parsed, and each text once
    parsed = F.when(F.rlike(c, F.lit(r"^[\x{FEFF}\s]*\[")), F.from_json(c, "array<string>"))
    raw = F.coalesce(parsed, F.split(F.coalesce(c, F.lit("")), ","))
    clean = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    firsts = lambda own, lows: F.filter(own, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)
    return let(clean, lambda own: let(F.transform(own, lambda x: F.lower(x)), lambda lows: firsts(own, lows)))


def unwrapped(c: Column, levels: int = 4) -> Column:
    """Labels of a text that may be JSON inside JSON, up to so many levels: an array, one label, or none."""
    own = compact_spaces(c)
    for _ in range(levels - 1):  # a JSON string holds the next level
        inner = F.from_json(F.concat(F.lit('{"x":'), own, F.lit("}")), "x string").getField("x")
        own = F.when(own.startswith('"'), F.coalesce(inner, own)).otherwise(own)
    labels = F.coalesce(F.from_json(own, "array<string>"), F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.transform(labels, compact_spaces), lambda x: x != "")


# Release types in the order in which the first hit wins.
RELEASE_TYPES = ("blu-ray remux", "bluray remux", "blu-ray", "bluray", "web-dlrip", "web-dl", "webrip", "bdrip", "dvdrip", "hdtv", "remux")


def release_type(c: Column) -> Column:
    low = F.lower(compact_spaces(c))
    return reduce(lambda case, t: case.when(low.contains(t), t), RELEASE_TYPES[1:], F.when(low.contains(RELEASE_TYPES[0]), RELEASE_TYPES[0])).otherwise("")


def haystack(*columns: Column) -> Column:
    return F.lower(F.concat_ws("\n", *[blank_to_null(c) for c in columns]))


# Technical keywords and the patterns that they stand for.
TECH_KEYWORDS = {
    "hdr": r"(?<!\w)hdr(?:10|10\+|\+)?(?!\w)|dolby\s*vision|(?<!\w)dv(?!\w)", "dv": r"dolby\s*vision|(?<!\w)dv(?!\w)",
    "lossless": r"lossless|(?<!\w)flac(?!\w)|(?<!\w)ape(?!\w)|(?<!\w)alac(?!\w)|truehd|dts[\s\-]*hd|pcm", "mp3": r"(?<!\w)mp3(?!\w)",
    "ру": r"(?<!\w)ру(?!\w)|(?<!\w)rus(?!\w)|\bрус(?:ский|ская|ские|ское)?\b|russian", "укр": r"(?<!\w)укр(?!\w)|(?<!\w)ua(?!\w)|\bукраин(?:ский|ская|ские|ское)?\b|ukrainian",
    "2160": r"(?<!\w)2160p?(?!\w)|(?<!\w)4k(?!\w)|(?<!\w)uhd(?!\w)", "1080": r"(?<!\w)1080p?(?!\w)", "720": r"(?<!\w)720p?(?!\w)", "hevc": r"(?<!\w)hevc(?!\w)|(?<!\w)x265(?!\w)|(?<!\w)h265(?!\w)",
    "x265": r"(?<!\w)x265(?!\w)|(?<!\w)h265(?!\w)|(?<!\w)hevc(?!\w)", "web-dl": r"web[\-\s]?dl", "webrip": r"web[\-\s]?rip", "remux": "remux",
}


def keyword_hit(hay: Column, word: Column, tech: Column | None = None) -> Column:
    """Whether a keyword is in a haystack.

    Technical keywords match their patterns in `tech` (hay itself unless given), other words of up to three characters
    match between word boundaries, longer ones anywhere.
    """
    low = F.lower(word)
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), low, F.lit(r"\E(?!\w)"))
    special = F.element_at(F.create_map(*[F.lit(x) for k, p in TECH_KEYWORDS.items() for x in (k, rx(f"(?:{p})"))]), low)
    return F.when(special.isNotNull(), F.rlike(hay if tech is None else tech, special)).when(F.length(low) <= 3, F.rlike(hay, quoted)).otherwise(hay.contains(low))


# Letters that are spelled otherwise before accents are dropped, and the words that are no tokens.
RESPELLED = {"ı": "i", "ş": "s", "ğ": "g", "ç": "c", "ö": "o", "ü": "u", "æ": "ae", "œ": "oe"}
STOP_WORDS = (
    "the", "a", "an", "and", "of", "to", "in", "on", "for", "at", "by", "with",
    "la", "le", "el", "los", "las", "der", "die", "das", "de", "du",
    "и", "в", "во", "на", "по", "с", "со", "к", "ко", "от", "до", "из", "у", "про",
)


def plain(char: str) -> str:
    """A character's compatibility form without its accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@cache
def _folded() -> tuple[str, str, dict[str, str]]:
    """Lower-case characters whose plain form is another one, these forms, and those whose form is several."""
    chars = [chr(c) for c in (*range(0x80, 0x590), *range(0x1E00, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF5F))]
    forms = {c: RESPELLED.get(c, plain(c)) for c in chars if c == c.lower()}
    forms = {c: f for c, f in forms.items() if f != c and re.search("[a-zа-яё0-9]", f)}
    single = {c: f for c, f in forms.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in forms.items() if len(f) > 1}


def normalized(c: Column) -> Column:
    """Lower-cased letters of two scripts and digits with one space between; markup and accents are dropped."""
    single, plain_forms, several = _folded()

    others = r"[^\x00-\x7Fа-ик-я\x{2000}-\x{206F}]"

    def longer(low: Column) -> Column:
        low = F.regexp_replace(low, r"\p{M}+", "")
        spelled = lambda t: reduce(lambda out, x: F.replace(out, F.lit(x[0]), F.lit(x[1])), several.items(), t)
        return let(low, lambda t: F.when(F.translate(t, "".join(several), "") != t, spelled(t)).otherwise(t))

    # most texts have only letters with one plain form
    folded = lambda text: let(F.translate(text, single, plain_forms), lambda t: F.when(F.rlike(t, F.lit(others)), longer(t)).otherwise(t))

    # texts of ASCII, plain Cyrillic letters and common punctuation have nothing to fold
    bare = let(c, lambda t: F.when(F.contains(t, F.lit("<")) | F.contains(t, F.lit("&")), strip_html(t)).otherwise(F.coalesce(t, F.lit(""))))
    low = let(F.lower(bare), lambda t: F.when(F.rlike(t, F.lit(others)), folded(t)).otherwise(t))
    return F.trim(F.regexp_replace(low, "[^a-zа-яё0-9]+", " "))


def raw_tokens(c: Column) -> Column:
    """The words of the normalized text in order, repeats and stop words included."""
    return F.filter(F.split(normalized(c), " "), lambda t: t != "")


def words_of(norm: Column) -> Column:
    """The words of a normalized text in order, without stop words unless it has no others."""
    stop = F.array(*map(F.lit, STOP_WORDS))

    def kept(every: Column) -> Column:
        return let(F.filter(every, lambda t: ~F.array_contains(stop, t)), lambda some: F.when(F.size(some) > 0, some).otherwise(every))

    return let(F.filter(F.split(norm, " "), lambda t: t != ""), kept)


def tokens_of(norm: Column) -> Column:
    """Distinct words of a normalized text, sorted, without stop words unless it has no others."""
    stop = F.array(*map(F.lit, STOP_WORDS))

    def kept(every: Column) -> Column:
        return let(F.array_except(every, stop), lambda some: F.when(F.size(some) > 0, some).otherwise(every))

    return F.sort_array(let(F.array_except(F.split(norm, " "), F.array(F.lit(""))), kept))


def tokens(c: Column) -> Column:
    """The same of any text."""
    return tokens_of(normalized(c))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / most, 3)).otherwise(0.0)
