"""What kind of release a title and category speak of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, rx

# Patterns of releases that are no video, by group.
MUSIC_GENRE = r"(?:pop|rock|hip[\s\-]*hop|rap|jazz|blues|metal|disco|house|techno|trance|edm|folk|country|k[\s\-]*pop|j[\s\-]*pop|r[\s&]*b)"
STRONG = (
    r"pc\s*\(windows\)", "playstation", "ps5", "ps4", "xbox", "nintendo", "switch", "repack", "dlc", "gog", "steam", r"build\s*\d+", r"update\s*v?\d+(?:\.\d+)*", "plugin", "driver", "crack", "mp3", "m4b", "flac", "alac", "ape",
    "lossless", "discography", "vinyl", r"concert\s+recording", "аудиокнига", "дискография", "альбом", "сингл", "саундтрек", "видеоклип(?:ы)?", r"video[\s\-]*clip(?:s)?", "треклист", "ebook", "pdf", "epub", "mobi", "fb2", "magazine",
    "журнал", "комикс", "манга", "аудиоспектакль",
)
SOFTWARE = ("android", "ios", "macos", "linux", "portable", "x64", "x86", "apk", "ipa", "exe", "msi")
SOFTWARE_CONTEXT = ("app", "application", "software", "program", "utility", "installer", "setup", "patch", "mod", "plugin", "driver", r"build\s*\d+", r"update\s*v?\d+(?:\.\d+)*", "версия", "установщик", "программа")
GAME = (r"pc\s*\(windows\)", "windows", "x64", "x86", "portable", "repack", "gog", "steam", "dlc")
GAME_GENRE = ("rpg", "simulator", "strategy", "adventure", "action", "shooter", "racing", "horror", "survival", "arcade", "quest")
BOOK, BOOK_FORMAT = ("book", "книга"), ("pdf", "epub", "mobi", "fb2")
SPORT = (
    "nhl", "nba", "ufc", r"formula\s*1", r"formula\s*2", r"moto\s*gp", "motogp", "boxing", "wrestling", "football", "soccer", "tennis", "biathlon", "ski(?:ing)?", "relay", "хоккей", "футбол", "теннис", "биатлон", r"лыж\w*", "бокс", "мма",
    "баскетбол", r"формула\s*1", r"формула\s*2", "мотогп", r"единоборств\w*", r"эстафет\w*", r"масс[\s\-]?старт", r"спринт\w*", r"гонка\s+преследован\w*", r"индивидуальн\w*\s+гонк\w*", "пасьют",
)
SPORT_CONTEXT = (
    "матч", "чемпионат", "турнир", "live", r"прямая\s+трансляц\w*", "эфир", "обзор", "раунд", "vs", r"grand\s+prix", "gp", "гонка", r"квалификац\w*", "кубок", r"финал\w*", "лига", r"гран[\-\s]?при", "этап", r"спринт\w*", r"практик\w*",
    "race", "qualifying", "sprint", "practice", "relay", r"mass\s*start", "pursuit", "individual", r"world\s+cup", r"эстафет\w*", r"масс[\s\-]?старт", r"гонка\s+преследован\w*", r"индивидуальн\w*\s+гонк\w*", r"кубок\s+мира",
    r"чемпионат\s+мира", "1/8", "1/4", "1/2", r"плей[\-\s]?офф", r"play[\-\s]?off", r"[А-ЯA-Z][^/\n]{1,30}\s[-–]\s[А-ЯA-Z][^/\n]{1,30}",
)
TV = (r"s\d{1,2}e\d{1,3}", "season", "сер(?:ия|ии|ий)", "сезон", "эпизод", "episode")
RUSSIAN_CATEGORY = ("Русский", "Русская", "Русское", "Наше Кино")


def _words(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(c, F.lit(rx(r"\b(?:" + "|".join(patterns) + r")\b")))


def not_video(title: Column) -> Column:
    """True for music, games, software, books and sport by the title alone."""
    text = F.lower(compact_spaces(title))
    music = F.rlike(text, F.lit(rx(rf"/\s*{MUSIC_GENRE}\s*/")))
    formats = "(?:" + "|".join(BOOK_FORMAT) + ")"
    books = [p for b in BOOK for p in (rf"\b{b}\b.+\b{formats}\b", rf"\b{formats}\b.+\b{b}\b")]
    book = F.rlike(text, F.lit(rx("(?:" + "|".join(books) + ")")))
    return (
        music | _words(text, STRONG) | (_words(text, SOFTWARE) & _words(text, SOFTWARE_CONTEXT)) | (_words(text, GAME) & _words(text, GAME_GENRE)) | book | (_words(text, SPORT) & _words(text, SPORT_CONTEXT))
    )


def media_type(title: Column) -> Column:
    return F.when(not_video(title), "other").when(_words(F.lower(F.coalesce(title, F.lit(""))), TV), "tv").otherwise("movie")


def russian(category: Column, title: Column, tracks: Column) -> Column:
    """True for releases in Russian by category, a block of the title or an audio label."""
    named = F.lit(False)
    for word in RUSSIAN_CATEGORY:
        named = named | compact_spaces(category).contains(word)
    block = F.rlike(compact_spaces(title), F.lit(rx(r"(?:^|[ /,;|])(?:ру|rus|russian)(?:[ /,;|]|$)")))
    labels = F.coalesce(F.exists(tracks, lambda t: F.rlike(compact_spaces(t), F.lit(rx(r"(?<!\w)(?:ру|rus|russian)(?!\w)")))), F.lit(False))
    return named | block | labels


# Words of sport titles, events and issues that have no metadata entry.
LOOKUP_SPORT = ("футбол", "хоккей", "теннис", "баскетбол", "биатлон", "бокс", "мма", "ufc", "nhl", "nba", r"formula\s*1", r"formula\s*2", "motogp", r"лыж\w*", r"динамо\s+киев", "бильярд", "снукер", "пирамида")
LOOKUP_EVENT = ("матч", "матчи", r"все\s+матчи", "сезона?", r"20\d{2}/\d{2}", "чемпионат", "лига", "кубок", "турнир", "тур", "раунд", "обзор", r"плей[\-\s]?офф", "vs", r"v\.", "эфир")
LOOKUP_ISSUE = ("выпуск", "выпуски", "выпусков", "эфир", "эфиры")


def skips_lookup(category_id: Column, category: Column, title: Column, imdb_id: Column) -> Column:
    """True for sport and for issues of shows, which no metadata search finds."""
    low, named = F.lower(compact_spaces(title)), F.lower(compact_spaces(category))
    sport = (compact_spaces(category_id) == "37") | named.contains("спорт")
    show = compact_spaces(category_id).isin("49", "50") | named.contains("тв-шоу") | named.contains("передачи")
    player = _words(low, LOOKUP_SPORT)
    skip = sport | (player & (_words(low, LOOKUP_EVENT) | show)) | (show & _words(low, LOOKUP_ISSUE) & (F.coalesce(imdb_id, F.lit("")) == ""))
    return (low != "") & skip
