from pyspark.sql import functions as F

from tramline.functions import scoring
from tramline.functions.titles import best_ratio, best_similarity
from tramline.operators import lineage

ITEM = {
    "source_title": "", "cleaned_title": "", "progress": "", "description": "", "category_name": "", "media_type": "movie", "bucket": "regular", "anime_score": 0, "year_text": "", "query": "", "requested_media": "tv", "aliases": None,
}
ENTRY = {
    "media_type": "tv", "title": "", "original_title": None, "match_title": None, "match_original_title": None, "release_date": "", "language": "en", "status": "Ended", "seasons": None, "episodes": None, "search_rank": 0,
}
ITEM_SCHEMA = "source_title string, cleaned_title string, progress string, description string, category_name string, media_type string, bucket string, anime_score int, year_text string, query string, requested_media string, aliases array<string>"
ENTRY_SCHEMA = "media_type string, title string, original_title string, match_title string, match_original_title string, release_date string, language string, status string, seasons int, episodes int, search_rank int"


def _decided(spark, *cases):
    """The features of each (item, entry), given by what differs from the defaults."""
    items = spark.createDataFrame([(n, *(ITEM | i).values()) for n, (i, _) in enumerate(cases)], "n int, " + ITEM_SCHEMA)
    entries = spark.createDataFrame([(n, *(ENTRY | e).values()) for n, (_, e) in enumerate(cases)], "n int, " + ENTRY_SCHEMA)
    pairs = lineage.item_side(items, 2026).select("n", "item").join(lineage.entry_side(entries, 2026).select("n", "entry"), "n")
    rows = lineage.features(pairs).withColumn("code", scoring.rejection()).withColumn("warnings", scoring.warnings())
    return sorted(rows.collect(), key=lambda r: r.n)


def test_predicates(spark):
    later = {"source_title": "Монстр / Monster Hunt / 2024 / 3 сезон: 1-4 серии из 12", "cleaned_title": "Монстр / Monster Hunt", "progress": "3 сезон: 1-4 серии из 12", "query": "Monster Hunt", "year_text": "2024"}
    rows = _decided(
        spark,
        # a later season of a series that began long ago goes on; with too few seasons it does not
        (later, {"title": "Monster Hunt", "release_date": "2003-01-01", "seasons": 2, "episodes": 24}),
        (later, {"title": "Monster Hunt", "release_date": "2003-01-01", "seasons": 1, "episodes": 12}),
        # a revival begins to count anew
        (later, {"title": "Monster Hunt", "release_date": "2024-01-01", "seasons": 1, "episodes": 13}),
        # a franchise's parent under another name of it
        ({"source_title": "Клинок пути: Поезд / Blade Train / 2020 / 1-3 серии из 12", "cleaned_title": "Клинок пути: Поезд / Blade Train", "progress": "1-3 серии из 12", "query": "Клинок пути", "bucket": "anime", "year_text": "2020", "aliases": ["Demon Blade"]}, {"title": "Demon Blade: Infinity", "release_date": "2008-01-01"}),
        # a work about the work
        ({"source_title": "Nova Fall / 2020", "cleaned_title": "Nova Fall", "query": "Nova Fall", "requested_media": "movie", "year_text": "2020"}, {"title": "Nova Fall: The Official Podcast", "media_type": "movie", "release_date": "2020-01-01"}),
        # a soft difference of totals only warns
        ({"source_title": "Nova Fall / 2020 / 1-10 серии из 24", "cleaned_title": "Nova Fall", "progress": "1-10 серии из 24", "query": "Nova Fall", "year_text": "2020"}, {"title": "Nova Fall", "release_date": "2020-01-01", "episodes": 9, "status": "Returning Series"}),
        ({"source_title": "Nova Fall / 2020 / 1-10 серии из 24", "cleaned_title": "Nova Fall", "progress": "1-10 серии из 24", "query": "Nova Fall", "year_text": "2020"}, {"title": "Nova Fall", "release_date": "2020-01-01", "episodes": 9}),
        # the query is cut from a longer title, and so names another work
        ({"source_title": "Red House of Sorrow Returns / 2020", "cleaned_title": "Red House of Sorrow Returns", "query": "Red", "requested_media": "movie", "year_text": "2020"}, {"title": "Red", "media_type": "movie", "release_date": "2020-01-01"}),
    )
    assert [r.code for r in rows] == [None, "TV_YEAR_DELTA_VERY_LARGE", None, None, "DERIVATIVE_SUFFIX_MISMATCH", None, "TV_EPISODE_TOTAL_MISMATCH", "TRUNCATED_PREFIX_QUERY_MATCH"]
    assert [r.continuation for r in rows[:3]] == [True, False, False] and [r.revival for r in rows[:3]] == [False, False, True]
    assert rows[3].franchise and rows[3].delta == 12 and rows[5].warnings == ["episode_total_mismatch_soft"] and rows[6].warnings == []
    assert rows[0].exact and rows[0].similarity == 1.0 and rows[0].season == 3 and rows[0].episodes == 12


def test_blank_and_null_sides_decide_nothing(spark):
    nothing = dict.fromkeys(ITEM)
    (row, other) = _decided(spark, (nothing, dict.fromkeys(ENTRY)), ({"query": "a", "cleaned_title": "a", "source_title": "a"}, {"title": "日本"}))
    assert (row.overlap, row.similarity, row.exact, row.substring, row.delta, row.code) == (0.0, 0.0, False, False, None, None)
    assert (other.overlap, other.exact, other.long_candidates) == (0.0, False, False)


def test_families(spark):
    titles = ["Nova", "Nova 2", "NOVA II", "Nova: Rising", "Nova Rising 3 сезон", "Nova Rising Season 2", "Novarise", "", None, "Nova", "Other 2", "...", "Part 2"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(titles)], "entry_id long, title string")
    rows = {r.entry_id: (r.stem, r.number, r.parent_id, r.family_id) for r in lineage.families(df).collect()}
    assert rows[0] == ("nova", 1, None, 0) and rows[1] == ("nova", 2, 0, 0) and rows[2] == ("nova", 2, 0, 0) and rows[9] == ("nova", 1, 0, 0)
    assert rows[3] == ("nova rising", 1, 0, 0) and rows[4] == ("nova rising", 3, 3, 0) and rows[5] == ("nova rising", 2, 3, 0)
    assert rows[6] == ("novarise", 1, None, 6) and rows[7] == ("", 1, None, 7) and rows[8][3] == 8 and rows[11][3] == 11
    assert rows[10] == ("other", 2, None, 10) and rows[12] == ("part", 2, None, 12)
    assert lineage.families(df.limit(0)).count() == 0


def test_best_ratio_is_the_greatest(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([("".join(rng.choice("abc ") for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(4))] for _ in range(2))
        want = max((SequenceMatcher(None, x, y).ratio() for x in a for y in b if x and y), default=0.0)
        assert abs(best_ratio(a, b) - want) < 1e-12
    df = spark.createDataFrame([(["ab"], ["ab", "x"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.s for r in df.select(best_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, 0.0]


def test_ranking_matches_few_pairs_and_loses_none(spark):
    import random

    from tramline.functions.titles import letter_counts, ratio, ratio_bound
    from tramline.operators import linking

    rng = random.Random(3)
    words = ["nova", "дом", "quest", "über", "sea", "sky", "время", "42", "red", "house", "long", "way"]
    names = [" ".join(rng.sample(words, 4)) for _ in range(60)]
    rows = [(q, c, names[q] + ("" if q % 2 else " x"), names[c], 0.0) for q in range(20) for c in range(60)]
    df = spark.createDataFrame(rows + rows[:9], "q long, c long, a string, b string, overlap double")
    score = {(q, c): round(0.9 * ratio(a, b), 3) for q, c, a, b, _ in rows}
    for top in (1, 3):
        want = sorted((q, c) for q in range(20) for c in sorted(range(60), key=lambda c: (-score[q, c], c))[:top])
        got = linking.ranked(df, "q", "c", F.col("a"), F.col("b"), top)
        assert sorted((r.q, r.c) for r in got.collect()) == want
    assert linking.matched(df, "q", "c", F.col("a"), F.col("b"), 1).count() < 120  # of 1,200 pairs
    bound = df.limit(200).select("a", "b", ratio_bound(letter_counts(F.col("a")), letter_counts(F.col("b"))).alias("m")).collect()
    assert all(ratio(r.a, r.b) <= r.m + 0.0006 for r in bound)
    empty = spark.createDataFrame([(1, 1, "", None, 0.0)], df.schema)
    assert [r.similarity for r in linking.ranked(empty, "q", "c", F.col("a"), F.col("b"), 2).collect()] == [0.0]


def test_texts_are_compared_once(spark, monkeypatch):
    items = spark.range(12).selectExpr(
        "id AS item_id", "if(id % 2 = 0, 'Красный дом / Red House / 2001', 'Nova') AS source_title", "'Red House' AS cleaned_title", "CAST(NULL AS STRING) AS progress", "'' AS description", "'' AS category_name",
        "if(id % 3 = 0, 'tv', 'movie') AS media_type", "'' AS bucket", "0 AS anime_score", "CAST(1990 + id AS STRING) AS year_text", "'Red House' AS query", "'movie' AS requested_media", "CAST(NULL AS ARRAY<STRING>) AS aliases",
    )
    entries = spark.range(10).selectExpr(
        "id AS entry_id", "'movie' AS media_type", "'Red House' AS title", "'' AS original_title", "'' AS match_title", "'' AS match_original_title", "concat(1990 + id, '-01-01') AS release_date", "'en' AS language",
        "'Ended' AS status", "1 AS seasons", "12 AS episodes", "0 AS search_rank",
    )
    pairs = items.select("item_id").crossJoin(entries.select("entry_id"))
    whole = pairs.join(lineage.item_side(items, 2026).select("item_id", "item"), "item_id").join(lineage.entry_side(entries, 2026).select("entry_id", "entry"), "entry_id")
    want = lineage.features(whole, lineage.best_similarity).drop("item", "entry")
    compared, of_texts = [], lineage._of_texts
    monkeypatch.setattr(lineage, "_of_texts", lambda rows, *rest: compared.append(rows.count()) or of_texts(rows, *rest))
    got = lineage.linked(pairs, items, entries, 2026)
    assert compared == [2]
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
