"""Countries and languages of items, and rule presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, listed

# Country names for display.
NAMES = {
    "AE": "ОАЭ", "AR": "Аргентина", "AT": "Австрия", "AU": "Австралия", "BE": "Бельгия", "BG": "Болгария", "BR": "Бразилия", "CA": "Канада", "CH": "Швейцария", "CL": "Чили", "CN": "Китай", "CO": "Колумбия", "CZ": "Чехия", "DE": "Германия",
    "DK": "Дания", "EG": "Египет", "ES": "Испания", "FI": "Финляндия", "FR": "Франция", "GB": "Великобритания", "GR": "Греция", "HK": "Гонконг", "HR": "Хорватия", "HU": "Венгрия", "ID": "Индонезия", "IE": "Ирландия", "IL": "Израиль",
    "IN": "Индия", "IR": "Иран", "IS": "Исландия", "IT": "Италия", "JP": "Япония", "KR": "Южная Корея", "KZ": "Казахстан", "LT": "Литва", "LV": "Латвия", "MX": "Мексика", "MY": "Малайзия", "NL": "Нидерланды", "NO": "Норвегия",
    "NZ": "Новая Зеландия", "PH": "Филиппины", "PL": "Польша", "PT": "Португалия", "RO": "Румыния", "RS": "Сербия", "RU": "Россия", "SE": "Швеция", "SG": "Сингапур", "TH": "Таиланд", "TR": "Турция", "TW": "Тайвань", "UA": "Украина",
    "US": "США", "VN": "Вьетнам", "ZA": "ЮАР",
}
PRESET_NAMES = {"world": "🌍 Новинки — мир", "turkey": "🇹🇷 Новинки — Турция", "dorama": "🌸 Новинки — дорамы", "anime": "🍥 Новинки — аниме"}


def codes(c: Column) -> Column:
    """Upper-cased country codes of a JSON or comma-separated text."""
    return F.transform(listed(c), lambda x: F.upper(x))


def effective(manual: Column, stored: Column, category: Column) -> Column:
    """Countries given by hand, else those of the metadata, else those of the source's category."""
    return F.when(F.size(codes(manual)) > 0, codes(manual)).when(F.size(codes(stored)) > 0, codes(stored)).otherwise(codes(category))


def names(array: Column) -> Column:
    """Names of codes; an unknown code stays."""
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.transform(array, lambda c: F.coalesce(F.element_at(table, c), c))


def language(c: Column) -> Column:
    """The primary language of a tag; jp and kr are read as ja and ko."""
    first = F.split(F.replace(F.lower(compact_spaces(c)), F.lit("_"), F.lit("-")), "-")[0]
    return F.when(first == "jp", "ja").when(first == "kr", "ko").otherwise(first)


def preset(key: Column, name: Column) -> Column:
    """The preset that a rule's key or, without one, its name stands for; else the empty text."""
    low, named = F.lower(compact_spaces(key)), F.lower(compact_spaces(name))
    table = F.create_map(*[F.lit(x) for k, v in PRESET_NAMES.items() for x in (v.lower(), k)])
    return F.when(low.isin(*PRESET_NAMES), low).otherwise(F.coalesce(F.element_at(table, named), F.lit("")))
