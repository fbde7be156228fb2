import pytest
from pyspark.sql import functions as F

from tramline.functions import audio, buckets, encoding, scoring
from tramline.operators import review

NO = {
    "query_media": "movie", "candidate_media": "movie", "wanted_media": "movie", "exact": False, "substring": False, "short": False, "one_word_query": False, "long_candidates": False, "latin": False, "cjk_exception": False,
    "derivative": False, "truncated": False, "alias_only": False, "alias_fits": False, "nonfiction": False, "generic_alias": False, "generic": False, "franchise": False, "continuation": False, "revival": False, "long_running": False, "soft_total": False,
    "overlap": 0.9, "similarity": 0.9, "common": 3, "main_overlap": 0.9, "main_similarity": 0.9, "delta": 0, "season": 1, "seasons": 1, "episodes": 10, "candidate_episodes": 10,
}
TV = {"query_media": "tv", "candidate_media": "tv", "wanted_media": "tv"}
CASES = [
    ({}, None), ({"delta": None}, None), ({"query_media": "tv"}, "SOURCE_TV_CANDIDATE_MOVIE"), (TV | {"delta": 40}, "TV_YEAR_DELTA_EXTREME"), (TV | {"delta": 20, "continuation": True, "exact": True}, None),
    (TV | {"delta": 12}, "TV_YEAR_DELTA_LARGE_WEAK_TITLE"), (TV | {"delta": 12, "franchise": True}, None), (TV | {"season": 3, "seasons": 1}, "TV_SEASON_COUNT_TOO_LOW"), (TV | {"season": 3, "seasons": 1, "revival": True}, None),
    (TV | {"candidate_episodes": 16}, "TV_EPISODE_TOTAL_MISMATCH"), (TV | {"candidate_episodes": 15}, None), (TV | {"candidate_episodes": None}, None), ({"delta": 7, "overlap": 0.7, "similarity": 0.8}, "MOVIE_YEAR_DELTA_LARGE_WEAK_TITLE"),
    ({"delta": 22, "exact": True, "substring": True}, "MOVIE_YEAR_DELTA_ABSURD"), ({"latin": True, "overlap": 0.1, "similarity": 0.2, "common": 0}, "LATIN_TITLE_WEAK_MATCH"), ({"alias_only": True, "wanted_media": "tv"}, "ALIAS_ONLY_MEDIA_MISMATCH"),
]


def test_rejections(spark):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in NO.items())
    df = spark.createDataFrame([tuple((NO | a).values()) for a, _ in CASES], schema)
    assert [r.code for r in df.select(scoring.rejection().alias("code")).collect()] == [w for _, w in CASES]
    assert len(scoring.rejections()) == 31


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_audio(spark):
    got = one(spark, audio.variants(F.lit("Фильм / 2x ПМ (Studio, Other) / ДБ x2, дб / оригинал / СУБТИТРЫ")))
    assert [tuple(x) for x in got] == [("ПМ (Studio, Other)", 2), ("ДБ", 3), ("оригинал", 1)]
    assert one(spark, audio.tracks(F.lit("2x ДБ / MVO"))) == ["ДБ", "ДБ", "MVO"] and one(spark, audio.tracks(F.lit(None).cast("string"))) == []
    text = "Видео: x\nАудио 1: AC3, 6 ch - Русский (MVO, Дубляжная) 1-3 Серия\nAudio 2: AC3 (MVO) 5 серии\nАудио 3: нет"
    assert one(spark, audio.episode_ranges(F.lit(text))) == {"mvo": "5", "дубляжная": "1-3"}
    before, after = audio.variants(F.lit("ДБ / 2x ПМ")), audio.variants(F.lit("ПМ / VO"))
    assert [tuple(x) for x in one(spark, audio.change(before, after))] == [("VO", 1), ("ДБ", -1), ("ПМ", -1)]


def test_encoding(spark):
    plain = "Аудио: русский дубляж, субтитры"
    broken = plain.encode("utf-8").decode("cp1251", "ignore")
    assert encoding.repair(plain) == plain and encoding.repair("plain text") == "plain text" and encoding.repair(None) == ""
    word = "Привет мир".replace("р", "г").replace("и", "о")  # letters whose bytes the wrong charset can spell
    assert encoding.repair(word.encode("utf-8").decode("latin-1")) == word
    assert encoding.plausible(broken) < encoding.plausible(plain)
    for charset in ("utf-8", "cp1251", "koi8-r"):
        assert encoding.decode(plain.encode(charset)).lower() == plain.lower() or charset == "koi8-r"
    df = spark.createDataFrame([(plain,), (None,)], "t string")
    assert [r.x for r in df.select(encoding.repaired("t").alias("x")).collect()] == [plain, ""]


@pytest.mark.parametrize(
    "args, want",
    [
        (("Anime", "", "tv", False, [], False, True, 0, 0), ("anime", "manual_bucket_override")), (("", "anime", "tv", False, [], False, True, 0, 0), ("anime", "source_category_anime_hint")),
        (("", "dorama", "tv", True, [], True, True, 2, 0), ("anime", "asian_animation_overrides_dorama_hint")), (("", "", "tv", False, [16], True, True, 3, 0), ("anime", "asian_animation_genre_invariant")),
        (("", "dorama", "movie", False, [], False, True, 0, 0), ("dorama", "source_category_dorama_hint")), (("", "", "tv", False, [], True, False, 4, 5), ("anime", "anime_fallback_without_link")),
        (("", "", "tv", False, [], True, True, 4, 2), ("dorama", "asian_dorama_signal")), (("", "", "other", False, [], True, True, 4, 2), ("regular", "default_regular")),
    ],
)
def test_bucket(spark, args, want):
    cols = [F.array(*map(F.lit, a)).cast("array<int>") if isinstance(a, list) else F.lit(a) for a in args]
    assert tuple(one(spark, buckets.bucket(*cols))) == want


def test_scores(spark):
    countries, none = F.array(F.lit("JP")), F.lit("")
    assert one(spark, buckets.anime_score(F.array(F.lit(16)), countries, F.lit("ja"), F.lit(True), F.lit(False), F.lit(True))) == 10
    assert one(spark, buckets.dorama_score(countries, F.lit("ja"), F.lit("名"), none, none)) == 6 and one(spark, buckets.dorama_score(F.array(F.lit("US")), F.lit("en"), none, none, F.lit("한국"))) == 1


def test_source_health(spark):
    marks = [1, 0, 0, 0, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([(1, 60 * n, bool(ok)) for n, ok in enumerate(marks)] + [(2, 5, False)], "source long, at long, ok boolean")
    rows = sorted(review.source_health(df, 2, 150).filter("source = 1").collect(), key=lambda r: r.at)
    assert [r.fail_streak for r in rows] == [0, 1, 2, 3, 4, 0, 1, 2, 0, 0]
    assert [n for n, r in enumerate(rows) if r.alert] == [2, 7] and [n for n, r in enumerate(rows) if r.recovered] == [5, 8]


def test_changed_only(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "B", "b"), (4, "b", "z"), (5, "C", "q"), (6, "C", "r")], "id long, name string, note string")
    got = review.changed_only(rows, {"name": F.lower("name")}, "id", ["name"]).collect()
    assert sorted(map(tuple, got)) == [(5, "c")]
    live, gone = review.split_archive(rows, F.col("id") > 4, "old")
    assert live.count() == 4 and {r.archive_reason for r in gone.collect()} == {"old"}


def test_match_score(spark):
    lit = F.lit
    base = {"search": lit(0.5), "similarity": lit(0.8), "overlap": lit(0.5), "exact": lit(False), "substring": lit(True), "same_media": lit(True), "same_bucket": lit(False), "anime": lit(False), "candidate_tv": lit(True), "year_delta": lit(None).cast("int"), "season": lit(None).cast("int"), "candidate_seasons": lit(2), "alias_only": lit(False), "short": lit(False)}
    score = lambda **kw: one(spark, scoring.match_score(base | {k: lit(v) for k, v in kw.items()}))
    assert score() == 1.99 and score(year_delta=1) == 2.07 and score(year_delta=5) == 1.53 and score(year_delta=40) == 1.11
    assert score(season=3) == 2.11 and score(season=4) == 1.99 and score(short=True) == 1.87 and score(short=True, exact=True) == 2.54 and score(alias_only=True) == 1.89
