import datetime as dt
import random

from pyspark.sql import functions as F

from tramline.functions import naming, search, text, times
from tramline.operators import aliases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_queries(spark):
    found = lambda t: one(spark, naming.queries(F.lit(t)))
    assert found("Wolga (Boyfriend on Demand)") == ["Wolga (Boyfriend on Demand)", "Wolga", "Boyfriend on Demand", "Wolga Boyfriend on Demand", "Wolga Boyfriend on", "Wolga Boyfriend"]
    aang = found("The Legend of Aang: The Last One")
    assert aang[0] == "The Legend of Aang: The Last One" and {"The Legend of Aang", "The Last One"} <= set(aang) and not {"The Legend", "The Legend of", "The Legend of Aang The"} & set(aang)
    assert found("Re: Zero") == ["Re: Zero"] and found(None) == [] and found("1080p") == [] and found("180") == ["180"]
    assert found("One Two Three Four Five Six")[1:] == ["One Two Three Four Five", "One Two Three Four", "One Two Three", "One Two"]
    assert found("Ab - Cd") == ["Ab - Cd", "Ab", "Cd"] and "Дом" not in found("Дом: Красный лес")


def test_names(spark):
    clean = lambda t: one(spark, naming.cleaned(F.lit(t)))
    assert clean("Breaking Bad 2008") == "Breaking Bad" and clean("Movie Name 1080p WEB-DL") == "Movie Name" and clean("Title [Some Info] (2023)") == "Title" and clean(None) == ""
    assert clean("Мэтлок (2 сезон: 1-13 серии из 16) / Matlock / 2025 / ПМ (TVShows) / WEB-DL (1080p)") == "Мэтлок / Matlock"
    usable = lambda t: one(spark, naming.usable(F.lit(t)))
    assert not any(map(usable, ("1080p", "WEBRip", "mp3", "FLAC", "", None, "5 серий из 10", "1 сезон", "720", "1080", "ДБ")))
    assert all(map(usable, ("Breaking Bad", "Inception", "180", "12-34-56")))
    pair = lambda t: tuple(one(spark, naming.by_script(F.lit(t))))
    assert pair("Во все тяжкие / Breaking Bad") == ("Во все тяжкие", "Breaking Bad") and pair("Breaking Bad") == ("", "Breaking Bad") and pair("") == ("", "")
    assert pair("180 / 180 / 2026 / СТ / WEBRip (1080p)") == ("", "180")
    other = lambda t: one(spark, naming.spellings(F.lit(t)))
    assert other("Я вернулась! Не помешаю? (1-2 серии из 12) / Tadaima, Ojama Saremasu! / 2026 / ЛМ (Dream Cast, DreamyVoice), СТ / HEVC / WEBRip (1080p)") == []
    assert other("Волга (Boyfriend on Demand) (LostFilm) (2020) / Wolga") == ["Boyfriend on Demand"]
    assert [one(spark, naming.numeric(F.lit(t))) for t in ("12-34-56", "1-2-3", "Breaking Bad", "")] == [True, True, False, False]
    assert [one(spark, naming.short_number(F.lit(t))) for t in ("180", "12", "1080", "1917")] == [True, True, False, False]


def test_row_score(spark):
    lit = F.lit
    base = {"similarity": lit(0.8), "substrings": lit(1), "overlap": lit(0.5), "exact": lit(False), "place": lit(0), "foreign": lit(False), "year_delta": lit(None).cast("int"), "media": lit("tv"), "short": lit(False), "acronym": lit(False)}
    score = lambda **kw: one(spark, search.row_score(base | {k: lit(v) for k, v in kw.items()}))
    assert score() == 1.13 and score(exact=True, place=9) == 1.21 and score(year_delta=0) == 1.13 and score(short=True, overlap=0.0) == 0.74
    assert score(year_delta=3) == round(1.13 - 0.09 - 0.075, 6) and score(year_delta=12, media="movie") == round(1.13 - 0.12 - 0.6 - 0.7, 6)
    assert score(year_delta=1, foreign=True) == round(1.18 - 0.03 - 0.025 + 0.08, 6) and score(year_delta=2, acronym=True) == round(1.13 - 0.06 - 0.05 - 0.24 - 0.42, 6)
    need = lambda *a: one(spark, search.least_row_score(*map(lit, a)))
    assert [need("tv", True, False, False, False), need("tv", True, False, False, True), need("movie", True, True, False, True), need("tv", False, True, True, False)] == [0.30, 0.26, 0.56, 0.70]


def test_release_text_score(spark):
    score = lambda t: one(spark, search.release_text_score(F.lit(t)))
    assert score("") == 0 and score("  ") == 0 and score("hello") == -12
    assert score("Аудио 1: AC3\nПеревод: Любительский\nСубтитры: нет") == 6 + 5 + 2 + 2
    assert score("Премия Оскар за звук") == 2 - 16


def test_times(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    for value in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "Tue, 2 Jan 2024 03:04:05 GMT", "Tue, 2 Jan 2024 05:04:05 +0200"):
        assert one(spark, times.parse(F.lit(value))) == at, value
    assert one(spark, times.parse(F.lit("soon"))) is None
    end = lambda now, a, b, zone: one(spark, times.quiet_end(F.lit(now).cast("timestamp"), F.lit(a), F.lit(b), F.lit(zone)))
    assert end("2024-01-02 22:30:00", 22, 6, "UTC") == dt.datetime(2024, 1, 3, 6) and end("2024-01-02 03:00:00", 22, 6, "UTC") == dt.datetime(2024, 1, 2, 6)
    assert end("2024-01-02 12:00:00", 22, 6, "UTC") == dt.datetime(2024, 1, 2, 12) and end("2024-01-02 20:30:00", 23, 7, "Europe/Moscow") == dt.datetime(2024, 1, 3, 4)
    # the night on which clocks go forward is an hour shorter
    assert end("2024-03-30 22:30:00", 23, 7, "Europe/Berlin") == dt.datetime(2024, 3, 31, 5)


def test_technical_keywords(spark):
    hit = lambda hay, tech, word: one(spark, text.keyword_hit(F.lit(hay), F.lit(word), F.lit(tech)))
    assert hit("x", "dolby vision", "hdr") and not hit("hdr", "x", "hdr") and hit("x", "uhd 4k", "2160") and hit("x", "web dl", "web-dl") and not hit("x", "русалка", "ру") and hit("x", "русский", "ру")


def test_alias_texts_are_looked_up_once(spark, monkeypatch):
    titles = spark.createDataFrame([(f"Red{' ' * n}House: 2",) for n in range(1, 9)], "title string")
    entries = spark.createDataFrame([(n, "red-house" if n % 2 else "RED HOUSE") for n in range(20)], "alias long, name string")
    asked, rarest = [], aliases._rarest
    monkeypatch.setattr(aliases, "_rarest", lambda rows, *rest: asked.append(rows.count()) or rarest(rows, *rest))
    assert aliases.alias_hits(titles, "title", entries).count() == 8 * 20
    assert asked == [1, 1, 1]


def test_alias_pairs_are_made_once(spark):
    """600 titles have all words but one of each of 600 entries, whose rarest such word is in all of them."""
    titles = spark.createDataFrame([(f"archive green river {10_000 + n}",) for n in range(600)], "title string")
    entries = spark.createDataFrame([(n, f"green river {20_000 + n}") for n in range(600)], "alias long, name string")
    context = spark.sparkContext._jsc.sc()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    assert aliases.alias_hits(titles, "title", entries).count() == 600 * 600
    context.listenerBus().waitUntilEmpty()
    assert sum(n for stage, n in stages().items() if stage not in before) < 600 * 600 / 2


def test_alias_word_sets(spark, monkeypatch):
    """Entries of many words, sets that are divided into blocks, and aliases of several texts, against every pair."""
    rng = random.Random(5)
    texts = lambda n, *sizes: [" ".join(rng.sample([f"word{c}" for c in "abcdefg"] + ["a", "ab", "abcdefghij"], rng.choice(sizes))) for _ in range(n)]
    asked, known = texts(60, 1, 3, 5, 9) + ["ordab", "abcdefghijk"], texts(40, 1, 2, 3, 4, 7)
    entries = [(n // 2 if n < 20 else n, name) for n, name in enumerate(known)]

    def hit(t, e):
        a, b = set(t.split()), set(e.split())
        return e in t or t in e or b <= a or (len(b) >= 2 and len(a & b) >= max(2, len(b) - 1))

    want = sorted({(t, n) for t in asked for n, e in entries if hit(t, e)})
    got = lambda: sorted(map(tuple, aliases.alias_hits(spark.createDataFrame([(t,) for t in asked], "title string"), "title", spark.createDataFrame(entries, "alias long, name string")).collect()))
    assert got() == want and len(want) > 200
    for name, value in (("MOST_WORDS", 3), ("PAIRS", 4), ("SIDE", 3)):
        monkeypatch.setattr(aliases, name, value)
    assert got() == want


def test_titles_are_named_once(spark):
    titles = ["Красный дом / Red House / 2001", "Nova (Zeta) / WEBRip (1080p)", "", None]
    rows = spark.createDataFrame([(n, titles[n % 4]) for n in range(40)], "n long, raw string")
    made = naming.named_once(rows, "raw")
    want = rows.select("n", naming.cleaned(F.col("raw")).alias("cleaned"), naming.by_script(F.col("raw")).alias("s")).select("n", "cleaned", "s.ru", "s.en")
    assert sorted(made.select("n", "cleaned", "ru", "en").collect()) == sorted(want.collect())
    assert "Aggregate" in made._jdf.queryExecution().optimizedPlan().toString()
