"""Titles without the marks of a release: cleaned names, their other spellings and search queries, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import progress
from tramline.functions.audio import LABELS
from tramline.functions.text import compact_spaces, let, release_type, rx, strip_html, tokens

# Technical words, studios and groups, and what else is no part of a name.
TECH = (
    "web-dl", "web-dlrip", "webrip", "bdrip", "bluray", "blu-ray", "remux", "dvdrip", "hdtv", "hdtvrip", "iptv", "dvb", "dvbrip", "satrip", "2160p", "1080p", "1080i", "720p", "4k", "uhd",
    "hdr10+", "hdr10", "hdr", "sdr", "hevc", "avc", "x264", "x265", "h264", "h265", "mp3", "flac", "ape", "alac", "fb2", "epub", "mobi", "pdf",
)
TECH_TOKENS = (
    "web-dl", "web-dlrip", "webrip", "bdrip", "bluray", "blu-ray", "remux", "dvdrip", "hdtv", "hdtvrip", "iptv", "dvb", "dvbrip", "satrip", "2160p", "1080p", "1080i", "720p", "4k", "uhd",
    "hdr10+", "hdr10", "hdr", "sdr", "hevc", "avc", "x264", "x265", "h264", "h265", "mp3", "flac", "ape", "alac", "fb2", "epub", "mobi", "pdf",
    "web", "webdl", "webdlrip", "2160", "1080", "720", "rip", "ру", "rus", "sub", "subs", "ст", "дб", "пм", "лм", "пд", "по",
)
GROUPS = (
    "lostfilm", "tvshows?", r"hdrezka(?:\s*studio)?", "coldfilm", "newstudio", "baibako", r"red\s*head\s*sound", r"dragon\s*money\s*studio", r"greb\s*&\s*creative", "dezidenizi", r"le(?:d)?[\s\-]*production",
    "anilibria", "ani(?:dub|star)", "softbox", "dub(?:lik|club)", "ru?dub", r"voice\s*project\s*studio", "reanimedia",
)
SOUND_WORDS = ("subs?", r"dolby\s*vision", "dolby", "vision", "aac", "ac3", "dts")
OTHER_WORDS = ("subs?", r"dolby\s*vision", "dolby", "vision", "aac", "ac3", "dts", "portable", "windows", "linux", "macos", "pc")
EPISODE_WORDS = ("сезон", "сезона", "сезоны", "серия", "серии", "серий", "выпуск", "выпуски", "выпусков", "эпизод", "эпизоды", "эпизодов")

YEARS = r"(?:19|20)\d{2}(?:\s*[-/]\s*(?:(?:19|20)\d{2}|\d{2}))?"
EPISODES = r"(?:\d+\s*сезон\s*:?\s*)?\d+(?:\s*[-,]\s*\d+)*\s*(?:сер(?:ия|ии|ий)|выпуск(?:а|ов)?)(?:\s*из\s*\d+)?|(?:сезон|season)\s*\d+|\d+\s*сезон|s\d{1,2}\s*e\d{1,3}(?:\s*-\s*e\d{1,3})?|\d{1,2}x\d{1,3}(?:\s*-\s*(?:\d{1,2}x)?\d{1,3})?"
COUNTS = r"\d+\s*[xх×](?=\s)"
NUMBERS = r"\d+(?:\s*[-–—:]\s*\d+){2,}"
MOST_WORDS, MOST_CHARS = 8, 120


def _spelled(word: str) -> str:
    """A pattern for a technical word whose hyphens may be spaces or missing."""
    return word.replace("+", r"\+").replace("-", r"[\-\s]?")


_MARK = "|".join([*map(_spelled, sorted(TECH, key=len, reverse=True)), *LABELS])
_GROUP = "|".join(GROUPS)
_GONE = rf"(?<!\w)(?:{_MARK}|{_GROUP}|{'|'.join(OTHER_WORDS)})(?!\w)"
_LABEL = rf"(?:\d+\s*[xх×]\s*)?(?<!\w)(?:{'|'.join(LABELS)})(?!\w)(?:\s*\([^)]*\))?(?:\s*[xх×]\s*\d+)?"


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(rx(pattern)))


def _is(c: Column, pattern: str) -> Column:
    return _has(c, rf"^(?:{pattern})$")


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, rx(pattern), " ")


def edges(c: Column) -> Column:
    """Single spaces, and no signs between parts at either end."""
    return F.regexp_replace(compact_spaces(c), r"^[\s/.\-]+|[\s/.\-]+$", "")


def segments(title: Column) -> Column:
    """The parts between slashes outside brackets."""
    parts = F.split(compact_spaces(strip_html(title)), r"/(?![^()]*\))(?![^\[\]]*\])")
    return F.filter(F.transform(parts, edges), lambda s: s != "")


def bare(part: Column) -> Column:
    """A part without brackets, years, episodes, counts, and technical, studio and audio words."""
    own = _without(_without(part, r"\[[^\]]*\]"), r"\([^)]*\)")
    own = _without(_without(own, rf"(?<![\w\-])(?:{EPISODES})(?!\w)"), rf"(?<!\w){YEARS}(?!\w)")
    own = _without(_without(own, rf"(?<!\w){COUNTS}"), _GONE)
    own = F.regexp_replace(_without(own, r"[^\w&:\-'. /]+"), r"(?:\s+-)+(?=\s|$)", " -")
    return edges(own)


def numeric(c: Column) -> Column:
    """Names such as 12-34-56."""
    return _is(edges(c), NUMBERS)


def short_number(c: Column) -> Column:
    """Names such as 180."""
    return _is(edges(c), r"\d{2,3}")


def group_name(c: Column) -> Column:
    return _is(edges(c), _GROUP)


def usable(c: Column) -> Column:
    """Whether a text can be a name: not blank, nor of technical words, labels, numbers or episodes only."""

    def test(raw: Column) -> Column:
        low = F.lower(raw)
        words = F.filter(F.split(low, r"[\s/\-:,;()\[\]]+"), lambda t: t != "")
        known = F.array(*map(F.lit, TECH_TOKENS))
        plain = F.forall(words, lambda t: F.array_contains(known, t) | F.rlike(t, F.lit(r"^\d+$")))
        told = _is(low, _MARK + "|subs?") | _has(low, rf"\b(?:{'|'.join(EPISODE_WORDS)})\b") | _has(low, r"\bиз\s*\d+\b") | _has(low, r"\b\d+\s*[-–—:]\s*\d+\b")
        number = _is(raw, r"\d{2,3}") & ~raw.isin("720", "1080")
        return (raw != "") & (_is(raw, NUMBERS) | number | ~(told | plain))

    return let(edges(F.coalesce(c, F.lit(""))), test)


def _is_mark(part: Column) -> Column:
    """Years, audio labels, release types and technical words, which are no names."""
    rest = F.regexp_replace(_without(part, _LABEL), r"[\s,;+&|/.\-]+", "")
    tech = F.regexp_replace(_without(part, rf"(?<!\w)(?:{'|'.join(map(_spelled, TECH))}|{'|'.join(SOUND_WORDS)}|sub|\d+)(?!\w)"), r"[\s,;:+/&|()\[\]]+", "")
    number = _is(part, r"\d{2,3}") & ~part.isin("720", "1080")
    return _is(part, YEARS) | (rest == "") | (release_type(part) != "") | ((tech == "") & ~number)


def names(title: Column) -> Column:
    """The bare names of a title's parts in order."""
    own = F.filter(segments(title), lambda s: ~_is_mark(s))
    cleaned_ = F.transform(own, lambda s: F.struct(s.alias("raw"), bare(s).alias("bare"), progress.parts(s).isNotNull().alias("episodes")))
    shown = F.transform(F.filter(cleaned_, lambda x: (x["bare"] != "") | ~x["episodes"]), lambda x: F.when(x["bare"] != "", x["bare"]).otherwise(edges(x["raw"])))
    return F.array_distinct(F.filter(shown, lambda s: s != ""))


def cleaned(title: Column) -> Column:
    """The names of a title, or all that is bare of it if it has none."""
    return let(F.coalesce(title, F.lit("")), lambda t: let(names(t), lambda n: F.when(F.size(n) > 0, F.array_join(n, " / ")).otherwise(bare(strip_html(t)))))


def spellings(title: Column) -> Column:
    """Other names in round brackets after the names of a title: no years, episodes, labels, types or groups."""
    own = F.filter(segments(title), lambda s: ~_is_mark(s))
    inner = F.flatten(F.transform(own, lambda s: F.regexp_extract_all(s, F.lit(r"\(([^()]{1,80})\)"), F.lit(1))))
    fine = F.filter(F.transform(inner, compact_spaces), lambda x: (x != "") & ~_is_mark(x) & progress.parts(x).isNull() & ~group_name(x))
    shown = F.transform(fine, lambda x: let(bare(x), lambda b: F.when(numeric(x) | (b == ""), edges(x)).otherwise(b)))
    return F.array_distinct(F.filter(shown, lambda x: (x != "") & ~group_name(x) & (numeric(x) | usable(x))))


def by_script(title: Column) -> Column:
    """struct(ru, en): the first name of each script, of one script alone if there is one, else mostly of it; blank without."""

    def count(c: Column, letters: str) -> Column:
        return F.length(F.regexp_replace(c, f"[^{letters}]", ""))

    def pick(found: Column) -> Column:
        rows = F.transform(found, lambda n: F.struct(n.alias("n"), count(n, "A-Za-z").alias("latin"), count(n, "А-Яа-яЁё").alias("cyrillic"), (numeric(n) | short_number(n)).alias("number"), usable(n).alias("fine")))
        first = lambda *tests: F.coalesce(*[F.get(F.transform(F.filter(rows, t), lambda r: r["n"]), 0) for t in tests], F.lit(""))
        ru = first(lambda r: (r["cyrillic"] >= 2) & (r["latin"] == 0), lambda r: (r["cyrillic"] >= 2) & (r["cyrillic"] >= r["latin"]) & r["fine"])
        en = first(lambda r: r["number"] | ((r["latin"] >= 3) & (r["cyrillic"] == 0) & r["fine"]), lambda r: (r["latin"] >= 3) & (r["latin"] > r["cyrillic"] * 2) & r["fine"])
        return F.struct(ru.alias("ru"), en.alias("en"))

    return let(names(title), pick)


def named_once(rows: DataFrame, title: str) -> DataFrame:
    """rows with `cleaned`, `ru` and `en` of a title, made once for each distinct title; a null one counts as blank."""
    rows = rows.withColumn(title, F.coalesce(title, F.lit("")))
    # few bytes may be much work, and a given number of partitions is not merged by their sizes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.select(title).distinct().repartition(n, title).select(title, cleaned(F.col(title)).alias("cleaned"), by_script(F.col(title)).alias("s"))
    return rows.join(once, title).select(*rows.columns, "cleaned", "s.ru", "s.en")


def queries(title: Column) -> Column:
    """Search queries for a title, most specific first, distinct.

    The whole and its cleaned form, each bracketed part, the text around it and both together, the halves around a
    colon or a dash, and leading Latin words: the first 5 to 2, or 4 before a colon. Texts of over MOST_WORDS words or
    MOST_CHARS characters and those that are no name are left out; so are the halves of a short word and one more
    around a colon, and single Cyrillic words cut from a longer title.
    """
    latin = lambda c: F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9'\-]*)"), F.lit(1))
    nothing = F.array().cast("array<string>")

    def make(base: Column) -> Column:
        inner = F.regexp_extract_all(base, F.lit(r"\(([^()]{2,80})\)"), F.lit(1))
        around = lambda x: edges(F.replace(base, F.concat(F.lit("("), x, F.lit(")")), F.lit(" ")))
        brackets = F.flatten(F.transform(inner, lambda x: F.array(x, around(x), F.when(around(x) != "", F.concat_ws(" ", around(x), edges(x))))))

        def halves(pattern: str) -> Column:
            left, right = F.regexp_extract(base, f"^(.*?){pattern}(.*)$", 1), F.regexp_extract(base, f"^(.*?){pattern}(.*)$", 2)
            fragment = lambda x: F.when(~((F.size(tokens(x)) == 1) & (F.size(tokens(base)) >= 2) & F.rlike(x, F.lit("[А-Яа-яЁё]")) & ~F.rlike(x, F.lit("[A-Za-z]"))), x)
            stump = F.rlike(edges(F.substring_index(left, "/", -1)), F.lit("^[A-Za-z0-9]{1,3}$")) & (F.size(tokens(right)) == 1) if ":" in pattern else F.lit(False)
            return F.when(F.rlike(base, F.lit(pattern)) & ~stump, F.array(fragment(left), fragment(right))).otherwise(nothing)

        words = latin(base)
        before = F.slice(latin(F.substring_index(base, ":", 1)), 1, 4)
        leading = F.filter(F.transform(F.array(*map(F.lit, (5, 4, 3, 2))), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " "))), lambda x: x.isNotNull())
        prefixes = F.when(F.size(words) < 4, nothing).when(~base.contains(":"), leading).otherwise(F.array(F.substring_index(base, ":", 1), F.when(F.size(before) >= 2, F.array_join(before, " "))))
        found = F.concat(F.array(base, cleaned(base)), brackets, halves(r"\s*:\s*"), halves(r"\s+[-–—]\s+"), prefixes)
        short = lambda x: (F.size(F.split(x, " ")) <= MOST_WORDS) & (F.length(x) <= MOST_CHARS)
        return F.array_distinct(F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), edges), lambda x: short(x) & usable(x)))

    return let(edges(F.coalesce(title, F.lit(""))), make)
