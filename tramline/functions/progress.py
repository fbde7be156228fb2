"""Episode progress of releases: parsing, order and change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, first_match, rx

# The ten forms of progress, each with its groups of season, blocks or start, end and total; the first that matches wins.
PATTERNS = (
    (r"(?:\d+\s*-\s*)?(\d+)\s*сезон:\s*(\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*)\s*(?:сер(?:ия|ии|ий)|выпуск(?:а|ов)?)\s*из\s*(\d+)", 1, 2, 0, 3),
    (r"(?:\d+\s*-\s*)?(\d+)\s*сезон:\s*(\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*)\s*(?:сер(?:ия|ии|ий)|выпуск(?:а|ов)?)", 1, 2, 0, 0),
    (r"s(\d{1,2})\s*e(\d{1,3})\s*-\s*e(\d{1,3})", 1, 2, 3, 0),
    (r"s(\d{1,2})\s*e(\d{1,3})", 1, 2, 0, 0),
    (r"(\d{1,2})x(\d{1,3})\s*-\s*(?:\1x)?(\d{1,3})", 1, 2, 3, 0),
    (r"(\d{1,2})x(\d{1,3})", 1, 2, 0, 0),
    (r"(\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*)\s*(?:сер(?:ия|ии|ий)|выпуск(?:а|ов)?)\s*из\s*(\d+)", 0, 1, 0, 2),
    (r"(\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*)\s*(?:сер(?:ия|ии|ий)|выпуск(?:а|ов)?)", 0, 1, 0, 0),
    (r"(\d+)\s*-\s*(\d+)\s*из\s*(\d+)", 0, 1, 2, 3),
    (r"(\d+)\s*из\s*(\d+)", 0, 1, 0, 2),
)
# How a progress text is found inside a title; the first that matches wins.
SEARCHED = (
    r"(?:\d+\s*-\s*)?\d+\s*сезон:\s*\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*\s*сер(?:ия|ии|ий)\s*из\s*\d+",
    r"(?:\d+\s*-\s*)?\d+\s*сезон:\s*\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*\s*выпуск(?:а|ов)?\s*из\s*\d+",
    r"(?:\d+\s*-\s*)?\d+\s*сезон:\s*\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*\s*сер(?:ия|ии|ий)",
    r"(?:\d+\s*-\s*)?\d+\s*сезон:\s*\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*\s*выпуск(?:а|ов)?",
    r"\d+(?:\s*-\s*\d+)?\s*сер(?:ия|ии|ий)\s*из\s*\d+",
    r"\d+(?:\s*-\s*\d+)?\s*выпуск(?:а|ов)?\s*из\s*\d+",
    r"\d+(?:\s*-\s*\d+)?\s*сер(?:ия|ии|ий)",
    r"\d+(?:\s*-\s*\d+)?\s*выпуск(?:а|ов)?",
    r"s\d{1,2}\s*e\d{1,3}\s*-\s*e\d{1,3}",
    r"s\d{1,2}\s*e\d{1,3}",
    r"\d{1,2}x\d{1,3}\s*-\s*\d{1,2}x\d{1,3}",
    r"\d{1,2}x\d{1,3}\s*-\s*\d{1,3}",
    r"\d{1,2}x\d{1,3}",
    r"\d+\s*-\s*\d+\s*из\s*\d+",
    r"\d+\s*из\s*\d+",
)
STRUCT = "struct<season:int,start:int,end:int,total:int,length:int>"


def parts(c: Column) -> Column:
    """struct(season, start, end, total, length) of a progress text, null if it has none.

    Blocks such as `1-3, 5` count from their first to their last number.
    """
    text = F.replace(F.lower(compact_spaces(c)), F.lit("ё"), F.lit("е"))
    number = lambda p, g: F.regexp_extract(text, rx(p), g).cast("int") if g else F.lit(None).cast("int")
    out = F.lit(None).cast(STRUCT)
    for pattern, season, own, end, total in reversed(PATTERNS):
        numbers = F.regexp_extract_all(F.regexp_extract(text, rx(pattern), own), F.lit(r"(\d+)"), 1)
        last = number(pattern, end) if end else F.element_at(numbers, -1).cast("int")
        found = F.struct(number(pattern, season).alias("season"), F.element_at(numbers, 1).cast("int").alias("start"), last.alias("end"), number(pattern, total).alias("total"), F.length(text).alias("length"))
        out = F.when(F.rlike(text, F.lit(rx(pattern))), found).otherwise(out)
    return out


def extract(c: Column) -> Column:
    """The progress text inside a longer title: season forms first, then blocks, codes and bare counts."""
    text = compact_spaces(c)
    return first_match(text, *[f"({p})" for p in SEARCHED])


def sort_key(p: Column) -> Column:
    """Orders parts by season (none is 0), end, start and length of the text."""
    return F.when(p.isNotNull(), F.struct(F.coalesce(p["season"], F.lit(0)).alias("season"), p["end"].alias("end"), p["start"].alias("start"), p["length"].alias("length")))


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1 between parts; null if either is missing or one ends beyond the other's total.

    A missing season takes the other side's.
    """
    seasons = F.coalesce(left["season"], right["season"], F.lit(0)), F.coalesce(right["season"], left["season"], F.lit(0))
    a = F.struct(seasons[0].alias("s"), left["end"].alias("e"), left["start"].alias("b"))
    b = F.struct(seasons[1].alias("s"), right["end"].alias("e"), right["start"].alias("b"))
    unclear = left.isNull() | right.isNull() | F.coalesce(right["end"] > left["total"], F.lit(False)) | F.coalesce(left["end"] > right["total"], F.lit(False))
    return F.when(unclear, F.lit(None).cast("int")).when(a > b, 1).when(a < b, -1).otherwise(0)


def change(previous: Column, current: Column) -> Column:
    order = compare(current, previous)
    return F.when(order > 0, "up").when(order < 0, "down").when(order == 0, "same").otherwise("unknown")
