"""Years, seasons and totals that titles and descriptions name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, first_match, years

# How texts name a season and the number of episodes; the first pattern that matches counts.
_SEASONS = (
    r"\b\d+\s*[-–—]\s*(\d+)\s*сезон(?:а|ов|ы)?\b",
    r"\b\d+\s*[-–—]\s*(\d+)\s*season(?:s)?\b",
    r"\b(\d+)\s*сезон(?:а|ов|ы)?\s*:",
    r"\b(\d+)\s*season(?:s)?\s*:",
    r"\b(\d+)\s*сезон(?:а|ов|ы)?\b",
    r"\b(\d+)\s*season(?:s)?\b",
)
_EPISODES = (
    r"\bиз\s*(\d{1,4})\b",
    r"\btotal\s*episodes?\s*[:\-]?\s*(\d{1,4})\b",
    r"\bэпизодов\s*[:\-]?\s*(\d{1,4})\b",
    r"\bсер(?:ия|ии|ий)\s*[:\-]?\s*(\d{1,4})\b",
    r"\bepisodes?\s*[:\-]?\s*(\d{1,4})\b",
)


def joined(*texts: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(compact_spaces(t), F.lit("")) for t in texts])


def season_hint(text: Column) -> Column:
    """The season that a text names, of a range the last; zero does not count."""
    return F.nullif(first_match(text, *_SEASONS).cast("int"), F.lit(0))


def episode_total(text: Column) -> Column:
    return F.nullif(first_match(text, *_EPISODES).cast("int"), F.lit(0))


def filter_years(media: Column, source_text: Column, release_date: Column, as_of_year: int) -> Column:
    """Years of a release: series by the source's first, films by the metadata's first."""
    source, dated = years(F.coalesce(source_text, F.lit("")), as_of_year), F.slice(years(F.coalesce(release_date, F.lit("")), as_of_year), 1, 1)
    return F.when(media == "tv", F.array_distinct(F.concat(source, dated))).otherwise(F.array_distinct(F.concat(dated, source)))


def display_year(media: Column, source_text: Column, release_date: Column, as_of_year: int) -> Column:
    """A year or a range `first-last` for display, or null."""
    source, dated = years(F.coalesce(source_text, F.lit("")), as_of_year), F.slice(years(F.coalesce(release_date, F.lit("")), as_of_year), 1, 1)
    shown = F.when((media == "tv") & (F.size(source) > 0), source).when(F.size(dated) > 0, dated).otherwise(source)
    first, last = F.try_element_at(shown, F.lit(1)).cast("string"), F.try_element_at(shown, F.lit(-1)).cast("string")
    return F.when(first != last, F.concat_ws("-", first, last)).otherwise(first)


def year_gap(candidates: Column, target: Column) -> Column:
    """The least distance of a year to the target, null without years or target."""
    return F.array_min(F.transform(candidates, lambda y: F.abs(y - target)))
