import random
import re

import pytest
from pyspark.sql import functions as F

from tramline.functions import categories, countries, detection, labels, signatures, text, years
from tramline.operators import aliases, delivery, leases
from tramline.sources import details
from tramline.streaming import observations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "title, want",
    [
        ("Фильм / Film / 2026 / WEBRip (1080p)", "movie"), ("Сериал (1 сезон: 1-3 серии из 8) / 2026", "tv"), ("Show s01e02 / 2026", "tv"), ("Band - Album / Rock / 2020 / MP3", "other"), ("Group - Title / jazz / 2001", "other"),
        ("Game / RPG / Windows / 2024", "other"), ("Editor / Portable / программа", "other"), ("Хоккей / НХЛ / Матч 3", "other"), ("Хоккей, вечная любовь / 2020", "movie"), ("Книга рецептов / 2020 / PDF", "other"), ("Windows of the soul / 2020", "movie"), (None, "movie"),
    ],
)
def test_media_type(spark, title, want):
    assert one(spark, detection.media_type(F.lit(title).cast("string"))) == want


def test_russian(spark):
    none = F.array().cast("array<string>")
    for category, title, tracks, want in (("Сериал - Русский", "x", none, True), ("x", "Фильм / РУ / 2020", none, True), ("x", "Русалка / 2020", none, False), ("x", "y", F.array(F.lit("РУ (Studio)")), True)):
        assert one(spark, detection.russian(F.lit(category), F.lit(title), tracks)) is want


def test_categories(spark):
    df = spark.createDataFrame([("20", ""), ("кино - азиатский", ""), ("", "Мои игры"), ("", "Новые сериалы"), ("", "")], "c string, n string")
    number = categories.category_id(F.when(F.col("c") != "", F.col("c")).otherwise(F.col("n")))
    rows = df.select(number.alias("i"), categories.forced_media(number, F.col("n")).alias("m"), categories.bucket_hint(number, F.col("n")).alias("b"), categories.is_not_video(number, F.col("n")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [("20", "tv", "anime", False), ("47", "movie", "dorama", False), ("", "", "", True), ("", "tv", "", False), ("", "", "", False)]
    assert categories.table(spark).count() == len(categories.CATEGORIES)


def test_labels(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(spark, labels.event_label(none, lit("1-2"), lit("1-3"), none)) == "UPDATE" and one(spark, labels.event_label(lit(" "), lit(""), lit("1-3"), none)) == "NEW"
    assert one(spark, labels.media_badge(lit(""))) == "ITEM" and one(spark, labels.quality_badge(lit(""), lit("x (1080p)"))) == "1080p" and one(spark, labels.quality_badge(lit("SD"), lit(""))) == "SD"
    assert one(spark, labels.route(F.array(*map(lit, ["a", "b", "a", " ", "c", "d"])))) == "a | b +2"
    assert one(spark, labels.rating(lit("IMDb: 7,5 / x"))) == 7.5 and one(spark, labels.rating(lit("8/10"))) == 8.0 and one(spark, labels.rating(lit("x"))) is None
    assert tuple(one(spark, labels.signed_keywords(lit("+hdr, -mp3 x +дб;+")))) == ("hdr,дб", "mp3")
    assert one(spark, labels.text_change(lit("a\nb\n"), lit("b\n c\r\na2"))).asDict() == {"added": ["c", "a2"], "removed": ["a"]}
    assert one(spark, labels.magnet(lit("ab12"), lit("A b/é"))) == "magnet:?xt=urn:btih:AB12&dn=A%20b/%C3%A9" and one(spark, labels.magnet(lit(" "), lit("x"))) == ""
    assert one(spark, labels.shows_rating(lit(7.1), lit(20))) and not one(spark, labels.shows_rating(lit(None).cast("double"), lit(50)))


def test_years(spark):
    lit = F.lit
    assert one(spark, years.season_hint(lit("1-3 сезон: 1-8 серии из 24"))) == 3 and one(spark, years.season_hint(lit("season 2"))) is None and one(spark, years.season_hint(lit("2 season"))) == 2
    assert one(spark, years.episode_total(lit("1 сезон: 1-8 серии из 24"))) == 24 and one(spark, years.episode_total(lit("Episodes: 12"))) == 12
    assert one(spark, years.filter_years(lit("tv"), lit("2019-2021"), lit("2018-01-01"), 2026)) == [2019, 2021, 2018] and one(spark, years.filter_years(lit("movie"), lit("2019"), lit("2018-01-01"), 2026)) == [2018, 2019]
    assert one(spark, years.display_year(lit("tv"), lit("2019-2021"), lit("2018"), 2026)) == "2019-2021" and one(spark, years.display_year(lit("movie"), lit("2019"), lit(""), 2026)) == "2019"
    assert one(spark, years.year_gap(F.array(lit(2019), lit(2024)), lit(2021))) == 2 and one(spark, years.joined(lit("a"), lit(" "), lit("b"))) == "a\nb"


def test_details(spark):
    page = "<td>Инфо хеш:</td><td>" + "ab" * 20 + "</td> Список файлов всего 3 <b>one.mkv</b><i> two  part.srt</i><u>one.mkv</u><a>tt0123456</a>"
    row = spark.createDataFrame([(page,)], "h string").select(details.info_hash(F.col("h")).alias("a"), details.file_count(F.col("h")).alias("n"), details.files(F.col("h")).alias("f"), details.imdb_id(F.col("h")).alias("i")).first()
    assert tuple(row) == ("AB" * 20, 3, ["one.mkv", "two part.srt"], "tt0123456")
    tabs = spark.createDataFrame([(1, 0, "x", 5, False), (1, 1, "y", 9, False), (1, 2, "z", 9, False), (2, 0, "p", 50, False), (2, 1, "q", -3, True), (3, 0, "n", 0, False)], "page int, tab int, text string, score int, named boolean")
    assert {r.page: r.text for r in details.best_text(tabs, "page", F.col("score"), F.col("named"), "tab").collect()} == {1: "y", 2: "q"}
    ratings = F.array(*[F.struct(F.lit(c).alias("country"), F.lit(r).alias("rating")) for c, r in (("DE", "12"), ("US", " "), ("GB", "15"))])
    assert one(spark, details.age_rating(ratings)) == "15"
    rows = spark.createDataFrame([("tv", '{"id": 5, "name": "N", "origin_country": ["JP", " "], "number_of_seasons": 2, "vote_count": 3}'), ("movie", '{"id": 6, "title": "T", "production_countries": [{"iso_3166_1": "US"}], "release_date": ""}')], "media string, json string")
    got = {r.entry_id: r for r in details.flattened(rows, "media").collect()}
    assert (got[5].title, got[5].countries, got[5].seasons, got[5].votes) == ("N", ["JP"], 2, 3) and (got[6].countries, got[6].release_date, got[6].rating) == (["US"], None, 0.0)


def test_aliases(spark):
    items = spark.createDataFrame([(1, "The Great One returns"), (2, "one"), (3, "")], "id long, title string")
    names = spark.createDataFrame([("great one", "A"), ("One", "B"), ("zero", "C"), ("", "D")], "name string, alias string")
    hits = lambda t, n: sorted(map(tuple, aliases.alias_hits(t, "title", n).collect()))
    whole = "The Great One returns"
    # "one" lies in "great one" too
    assert hits(items, names) == [(whole, "A"), (whole, "B"), ("one", "A"), ("one", "B")]
    rng = random.Random(3)
    texts = lambda n, most: [" ".join(rng.choices(["ab", "abc", "b", "Дом", "домик", "é", "xyz", "ab-c"], k=rng.randint(0, most))) for _ in range(n)]
    asked, known = texts(60, 4), texts(25, 3)
    plain = lambda t: " ".join(re.findall("[a-zа-я]+", t.lower().replace("é", "e")))

    def hit(t, e):
        a, b = set(t.split()), set(e.split())
        return bool(t and e) and (e in t or t in e or b <= a or (len(b) >= 2 and len(a & b) >= max(2, len(b) - 1)))

    want = sorted({(t, n) for t in asked for n, e in enumerate(known) if hit(plain(t), plain(e))})
    assert hits(spark.createDataFrame([(t,) for t in asked], "title string"), spark.createDataFrame(list(enumerate(known)), "alias long, name string")) == want and len(want) > 100
    for query, want in (("NCIS", "acronym"), ("The Long Night of Steel Rivers", "long_latin"), ("Dark", "short_common"), ("Совсем другая длинная история", "plain")):
        assert one(spark, aliases.query_class(F.lit(query))) == want
    plan = spark.createDataFrame([(1, ["a", "b", "a"], "tv", 2000), (2, ["x"], "other", None)], "id long, q array<string>, m string, y int")
    steps = [tuple(r) for r in aliases.search_plan(plan, "id", "q", "m", "y").orderBy("id", "step").collect()]
    assert len(steps) == 10 and steps[0] == (1, 0, "a", "tv", 2000) and steps[3] == (1, 3, "a", "tv", None) and steps[8:] == [(2, 0, "x", "movie", None), (2, 1, "x", "tv", None)]
    found = spark.createDataFrame([(1, 10, True, 0, "tv", "auto", 0), (1, 11, True, 0, "tv", "auto", 1), (1, 12, False, None, "movie", "auto", 2), (2, 20, False, 9, "movie", "manual", 0)], "id long, entry_id long, exact boolean, year_gap int, media_type string, source string, pos int")
    assert sorted(map(tuple, aliases.resolve(found, "id", "pos").collect())) == [(1, 10, 128), (2, 20, 1000)]


def test_leases(spark):
    log = spark.createDataFrame([("a", "sending", 10), ("a", "sent", 20), ("a", "failed", 30), ("b", "sending", 100), ("c", "sending", 1000), ("d", "sending", 5), ("d", "failed", 9)], "event_key string, status string, at long")
    assert {r.event_key: r.status for r in leases.claim_states(log, F.lit(1000)).collect()} == {"a": "sent", "b": "stale", "c": "sending", "d": "failed"}
    samples = spark.createDataFrame([("m", 0, 5), ("m", 60, 8), ("m", 120, 2), ("m", 1000, 2)], "metric string, at long, value long")
    assert [r.increase for r in leases.increase(samples, "metric", "at", "value", 900).orderBy("at").collect()] == [0, 3, 5, 2]
    done = spark.createDataFrame([("s", 100), ("s", 200), ("t", 1000)], "source string, at long")
    assert {r.source: r.stalled for r in leases.stalled(done, "source", "at", F.lit(1101)).collect()} == {"s": True, "t": False}


def test_countries(spark):
    lit = F.lit
    assert one(spark, countries.effective(lit(""), lit('["us", "jp"]'), lit("RU"))) == ["US", "JP"] and one(spark, countries.effective(lit("gb"), lit("US"), lit(""))) == ["GB"] and one(spark, countries.effective(lit(None).cast("string"), lit("[]"), lit("RU"))) == ["RU"]
    assert one(spark, countries.names(F.array(lit("JP"), lit("XX")))) == ["Япония", "XX"]
    assert [one(spark, countries.language(lit(x))) for x in ("JP", "en_US", "kr-x", "")] == ["ja", "en", "ko", ""]
    assert [one(spark, countries.preset(lit(k), lit(n))) for k, n in (("World", ""), ("", "🍥 новинки — АНИМЕ"), ("x", "y"))] == ["world", "anime", ""]


def test_unwrapped(spark):
    import json

    labels_ = ["ДБ", "ПМ (Studio)"]
    once = json.dumps(labels_)
    for value, want in ((once, labels_), (json.dumps(once), labels_), (json.dumps(json.dumps(once)), labels_), ("ДБ", ["ДБ"]), ("", []), (None, []), ('["a", " "]', ["a"])):
        assert one(spark, text.unwrapped(F.lit(value).cast("string"))) == want, value


def test_skips_lookup(spark):
    for number, category, title, imdb, want in (
        ("37", "", "Любое", "", True), ("", "Кино - Спорт", "x", "", True), ("", "", "Футбол: матч дня", "", True), ("", "", "Футбол навсегда", "", False), ("49", "", "Шоу (выпуск 5)", "", True),
        ("49", "", "Шоу (выпуск 5)", "tt0000001", False), ("50", "", "Бокс навсегда", "", True), ("37", "", "", "", False),
    ):
        assert one(spark, detection.skips_lookup(F.lit(number), F.lit(category), F.lit(title), F.lit(imdb))) is want, title


def test_small_fields(spark):
    lit = F.lit
    assert [one(spark, categories.is_concert(lit(n))) for n in ("Кино - Концерт", "Музыка", None)] == [True, False, False]
    assert one(spark, categories.fallback_countries(lit("45"))) == ["RU"] and one(spark, categories.fallback_countries(lit("9"))) == []
    none = lit(None).cast("string")
    uid = lambda *a: one(spark, signatures.source_uid(*[none if x is None else lit(x) for x in a]))
    assert uid("12345", "g", "l", "t", "c") == "source:12345" and uid(None, " g ", "l", "t", "c") == "g" and uid("", None, "l", "t", "c") == "l" and len(uid(None, None, " ", "t", "c")) == 40
    parts = lambda *a: signatures.variant_parts(*[none if x is None else lit(x) for x in a])
    old, new = parts("TV", "s01e01", "720", None, "ДБ"), parts("tv", "s01e02", "720", "webrip", "дб")
    assert one(spark, signatures.variant_summary(old)) == "tv | progress=s01e01 | format=720 | release=norelease | audio=дб"
    assert one(spark, signatures.variant_change(old, new)) == "progress s01e01 -> s01e02; release norelease -> webrip" and one(spark, signatures.variant_change(new, new)) == "metadata refresh"
    admin = spark.createDataFrame([(1, True, True, None), (2, False, True, None), (3, True, True, 5), (4, False, False, 1)], "id long, is_active boolean, access_granted boolean, expires_at long")
    assert sorted(r.id for r in admin.filter(delivery.may_receive(lit(10), F.col("id") == 4)).collect()) == [1, 4]
