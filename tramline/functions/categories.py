"""Source categories: names, media types, bucket hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces

# Categories by number, and the sets that decide on them.
CATEGORIES = {
    "1": "Другое - Видеоклипы", "2": "Другое - АудиоКниги", "3": "Музыка - Буржуйская", "4": "Музыка - Русская", "5": "Музыка - Сборники", "6": "Кино - Боевик / Военный", "7": "Кино - Классика", "8": "Кино - Комедия",
    "9": "Кино - Исторический", "10": "Кино - Наше Кино", "11": "Кино - Приключения", "12": "Кино - Детский / Семейный", "13": "Кино - Фантастика", "14": "Кино - Фэнтези", "15": "Кино - Триллер / Детектив", "16": "Кино - Эротика",
    "17": "Кино - Драма", "18": "Кино - Документальный", "20": "Мульт - Аниме", "21": "Мульт - Буржуйский", "22": "Мульт - Русский", "23": "Другое - Игры", "24": "Кино - Ужас / Мистика", "32": "Другое - Программы", "35": "Кино - Мелодрама",
    "37": "Кино - Спорт", "38": "Кино - Театр, Опера, Балет", "39": "Кино - Индийское", "40": "Другое - Дизайн / Графика", "41": "Другое - Библиотека", "42": "Музыка - Классическая", "45": "Сериал - Русский", "46": "Сериал - Буржуйский",
    "47": "Кино - Азиатский", "48": "Кино - Концерт", "49": "Кино - Передачи / ТВ-шоу", "50": "Кино - ТВ-шоу Мир", "1001": "Все сериалы", "1002": "Все фильмы", "1003": "Все мульты", "1004": "Вся музыка", "1006": "Шоу, концерты, спорт",
}
NOT_VIDEO = ("1", "2", "3", "4", "5", "23", "32", "40", "41", "42", "1004")
TV = ("20", "45", "46", "49", "50", "1001")
MOVIE = ("6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "24", "35", "37", "38", "39", "47", "48", "1002")
ANIME, DORAMA, RUSSIAN = ("20",), ("47",), ("10", "45")
NOT_VIDEO_WORDS = ("музыка", "аудиокниг", "игр", "программ", "библиотек", "дизайн", "график")


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "category_id string, category_name string")


def category_id(value: Column) -> Column:
    """The number of a category given by number or name, else the empty text."""
    names = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (v.lower(), k)])
    own = compact_spaces(value)
    return F.when(own.isin(*CATEGORIES), own).otherwise(F.coalesce(F.element_at(names, F.lower(own)), F.lit("")))


def _named(name: Column, *words: str) -> Column:
    low, out = F.lower(compact_spaces(name)), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_not_video(number: Column, name: Column) -> Column:
    return F.when(number != "", number.isin(*NOT_VIDEO)).otherwise(_named(name, *NOT_VIDEO_WORDS))


def is_concert(name: Column) -> Column:
    """Concerts are ignored for every rule."""
    return _named(name, "концерт")


def fallback_countries(number: Column) -> Column:
    """Country codes of a category, for releases whose metadata names none."""
    return F.when(number.isin(*RUSSIAN), F.array(F.lit("RU"))).otherwise(F.array().cast("array<string>"))


def forced_media(number: Column, name: Column) -> Column:
    """tv, movie or other where the category settles it, else the empty text."""
    by_name = F.when(_named(name, "сериал"), "tv").when(_named(name, "кино", "мульт", "фильм"), "movie").otherwise("")
    return F.when(number.isin(*TV), "tv").when(number.isin(*MOVIE), "movie").when(number.isin(*NOT_VIDEO), "other").otherwise(by_name)


def bucket_hint(number: Column, name: Column) -> Column:
    return F.when(number.isin(*ANIME) | (~number.isin(*DORAMA) & _named(name, "аниме")), "anime").when(number.isin(*DORAMA) | _named(name, "азиат"), "dorama").otherwise("")
