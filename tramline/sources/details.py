"""Fields of details pages and metadata records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, first_match, rx

#: File lines of a page that are kept.
MOST_FILES = 200
# File name endings.
ENDINGS = "mkv|mp4|avi|m2ts|ts|m4v|mov|wmv|mpg|mpeg|iso|img|flac|mp3|aac|ac3|dts|mka|srt|ass|ssa|sub|idx|exe|bin|cue|zip|rar|7z"


def info_hash(html: Column) -> Column:
    """Forty hex digits, those after a label first, in upper case; empty if there are none."""
    gap = r"(?:</[^>]+>|<[^>]+>|\s|&nbsp;|:)*([A-Fa-f0-9]{40})"
    return F.coalesce(F.upper(first_match(html, r"Инфо[\s\-]*хеш" + gap, r"Info[\s\-]*hash" + gap, r"\b([A-Fa-f0-9]{40})\b")), F.lit(""))


def file_count(html: Column) -> Column:
    return first_match(html, r"Список\s+файлов\s+всего\s*(\d+)", r"Files\s+total\s*(\d+)").cast("int")


def files(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rx(r">([^<>\n\r]{1,260}\.(?:" + ENDINGS + r"))<")), 1)
    return F.slice(F.array_distinct(F.transform(found, compact_spaces)), 1, MOST_FILES)


def imdb_id(text: Column) -> Column:
    return F.lower(first_match(text, r"\b(tt\d{5,10})\b"))


def best_text(tabs: DataFrame, key: str, score: Column, labelled: Column, order: str) -> DataFrame:
    """(key, text) of each page: the tab labelled as the release, else the best score above zero, ties to the first tab."""
    rank = F.struct(labelled.cast("int").alias("l"), score.alias("s"), (-F.col(order)).alias("o"))
    fine = tabs.filter(labelled | (score > 0))
    return fine.groupBy(key).agg(F.max_by("text", rank).alias("text"))


COUNTRY_ORDER = ("RU", "US", "GB")


def age_rating(ratings: Column) -> Column:
    """The first filled rating of array(struct(country, rating)), of the countries in COUNTRY_ORDER first."""
    filled = F.filter(ratings, lambda r: F.coalesce(F.trim(r["rating"]), F.lit("")) != "")
    of = lambda country: F.filter(filled, lambda r: r["country"] == country)
    first = lambda a: F.trim(F.try_element_at(F.transform(a, lambda r: r["rating"]), F.lit(1)))
    return F.coalesce(*[first(of(c)) for c in COUNTRY_ORDER], first(filled))


RECORD = """id long, title string, name string, original_title string, original_name string, original_language string, vote_average double, vote_count int, release_date string, first_air_date string,
    status string, overview string, genres array<struct<id:int>>, origin_country array<string>, production_countries array<struct<iso_3166_1:string>>, number_of_seasons int, number_of_episodes int, external_ids struct<imdb_id:string>"""


def flattened(records: DataFrame, media: str, json: str = "json") -> DataFrame:
    """One flat row for each metadata record in the column `json`, films and series in one schema."""
    row = records.withColumn("r", F.from_json(json, RECORD))
    tv = F.col(media) == "tv"
    filled = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    made = F.transform("r.production_countries", lambda c: c["iso_3166_1"])
    return row.select(
        *[c for c in records.columns if c != json], F.col("r.id").alias("entry_id"), F.coalesce("r.title", "r.name", F.lit("")).alias("title"), F.coalesce("r.original_title", "r.original_name", F.lit("")).alias("original_title"),
        F.lower(F.trim("r.original_language")).alias("language"), F.coalesce("r.vote_average", F.lit(0.0)).alias("rating"), F.coalesce("r.vote_count", F.lit(0)).alias("votes"), F.nullif(F.coalesce("r.release_date", "r.first_air_date", F.lit("")), F.lit("")).alias("release_date"),
        F.nullif(compact_spaces(F.col("r.status")), F.lit("")).alias("status"), compact_spaces(F.col("r.overview")).alias("overview"), F.transform("r.genres", lambda g: g["id"]).alias("genre_ids"),
        F.coalesce(F.when(tv, filled(F.col("r.origin_country"))).otherwise(filled(made)), F.array().cast("array<string>")).alias("countries"), F.col("r.external_ids.imdb_id").alias("imdb_id"),
        F.when(tv, F.col("r.number_of_seasons")).alias("seasons"), F.when(tv, F.col("r.number_of_episodes")).alias("episodes"),
    )
