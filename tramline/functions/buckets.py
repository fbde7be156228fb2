"""Content buckets of items: anime, dorama or regular, with the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces

# Country and language codes, the animation genre, and scripts.
ANIME_COUNTRIES = ("JP", "CN", "TW", "HK", "KR")
ANIME_LANGUAGES = ("ja", "zh", "ko")
DORAMA_COUNTRIES = ("BN", "CN", "HK", "ID", "JP", "KH", "KR", "LA", "MM", "MO", "MY", "PH", "SG", "TH", "TW", "VN")
DORAMA_LANGUAGES = ("cn", "id", "ja", "ko", "ms", "th", "tl", "vi", "zh")
ANIMATION_GENRE = 16
ASIAN_SCRIPT = "[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-๿]"


def _any(a: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(a, F.array(*map(F.lit, values))), F.lit(False))


def _sum(*weighted: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, weight in weighted:
        out = out + F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0)
    return out


def asian_script(c: Column) -> Column:
    return F.rlike(compact_spaces(c), F.lit(ASIAN_SCRIPT))


def anime_score(genres: Column, countries: Column, language: Column, alias: Column, marker: Column, both_titles: Column) -> Column:
    """alias: a known anime title is named; marker: the title says so; both_titles: it has two languages."""
    return _sum(
        (F.array_contains(genres, ANIMATION_GENRE), 3), (_any(countries, ANIME_COUNTRIES), 2), (language.isin(*ANIME_LANGUAGES), 2),
        (alias, 2), (marker, 2), (alias & both_titles, 1),
    )


def dorama_score(countries: Column, language: Column, original_title: Column, title: Column, source_title: Column) -> Column:
    scripts = F.when(asian_script(original_title), 2).when(asian_script(title) | asian_script(source_title), 1).otherwise(0)
    return _sum((_any(countries, DORAMA_COUNTRIES), 2), (language.isin(*DORAMA_LANGUAGES), 2)) + scripts


def bucket(manual: Column, hint: Column, media: Column, source_animation: Column, genres: Column, strong: Column, linked: Column, anime: Column, dorama: Column) -> Column:
    """struct(bucket, reason): a manual choice, then the source's hint, then animation and signals, then regular.

    hint is the bucket that the source category names; strong means an anime country, language, script or marker.
    """
    chosen = lambda b, r: F.struct(F.lit(b).alias("bucket"), r.alias("reason"))
    animation = source_animation | F.coalesce(F.array_contains(genres, ANIMATION_GENRE), F.lit(False))
    own = F.coalesce(media, F.lit("movie")).isin("tv", "movie") & ~animation
    over = lambda r: F.when(hint == "dorama", "asian_animation_overrides_dorama_hint").otherwise(r)
    named = F.lower(F.trim(manual))
    return (
        F.when(named.isin("anime", "dorama", "regular"), F.struct(named.alias("bucket"), F.lit("manual_bucket_override").alias("reason")))
        .when(hint == "anime", chosen("anime", F.lit("source_category_anime_hint")))
        .when(source_animation & strong & (anime >= 2), chosen("anime", over("asian_animation_invariant")))
        .when(animation & strong & (anime >= 3), chosen("anime", over("asian_animation_genre_invariant")))
        .when((hint == "dorama") & own, chosen("dorama", F.lit("source_category_dorama_hint")))
        .when(own & ~linked & strong & (anime >= 3), chosen("anime", F.lit("anime_fallback_without_link")))
        .when(own & (dorama >= 2), chosen("dorama", F.lit("asian_dorama_signal")))
        .otherwise(chosen("regular", F.lit("default_regular")))
    )
