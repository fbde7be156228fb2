import random

from pyspark.sql import functions as F

from tramline.operators import audit, delivery, linking, rules, versions
from tramline.sources import readers
from tramline.streaming import debounce, observations


def test_best_version_equals_ordered_fold(spark):
    rng = random.Random(3)
    rows = [(k, n, rng.choice([None, rng.randint(1, 5)])) for k in range(200) for n in rng.sample(range(50), rng.randint(1, 7))]
    want = {}
    for k in range(200):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        best = own[0]
        for r in own[1:]:
            if best[2] is not None and r[2] is not None and r[2] > best[2]:
                best = r
        want[k] = best[1]
    df = spark.createDataFrame(rows, "k long, at long, p int")
    assert {r.k: r.at for r in versions.best_version(df, "k", F.col("p"), [F.col("at")], ["at", "p"]).collect()} == want


def test_gap_audit_worked_case(spark):
    known = spark.createDataFrame([(1, 4, 100), (1, 2, 50), (2, 9, 1), (None, 1, 1)], "release_id long, progress long, created_at long")
    seen = spark.createDataFrame([(1, 5, 200), (1, 3, 150), (1, 4, 300), (1, 1, 9), (3, 5, 1), (2, None, 1)], "release_id long, progress long, polled_at long")
    sent = spark.createDataFrame([(1, 2, 1, 999)], "release_id long, delivery_count long, delivery_users long, last_delivered_at long")
    got = [(r.progress, r.gap_kind, r.highest_below, r.current_highest, r.delivery_count) for r in audit.in_audit_order(audit.gap_audit(known, seen, sent)).collect()]
    assert got == [(5, "latest_gap", 4, 4, 2), (3, "historical_gap", 2, 4, 2)]


def test_rule_cascade(spark):
    base = {"rule_id": 1, "user_id": 1, "is_enabled": 1, "preset_key": "", "media_type": "any", "year_from": None, "year_to": None, "min_rating": None, "bucket_filter": "any", "formats": [], "genre_ids": [], "countries": [], "excluded": [], "include": [], "exclude": []}
    item = {"item_id": 1, "media_type": "tv", "years": [2020], "video_format": "720", "rating": 7.0, "bucket": "anime", "genres": [16], "countries": ["JP"], "haystack": "title hd\njapan", "tech": "title 720p\nweb-dl", "ignored": False}
    rs = "rule_id long, user_id long, is_enabled int, preset_key string, media_type string, year_from int, year_to int, min_rating double, bucket_filter string, formats array<string>, genre_ids array<int>, countries array<string>, excluded array<string>, include array<string>, exclude array<string>"
    its = "item_id long, media_type string, years array<int>, video_format string, rating double, bucket string, genres array<int>, countries array<string>, haystack string, tech string, ignored boolean"
    cases = [
        ({}, {}, "passed"), ({}, {"ignored": True}, "globally_ignored"), ({"is_enabled": 0}, {}, "disabled"), ({}, {"media_type": "other"}, "media_other_mismatch"), ({"media_type": "movie"}, {}, "media_mismatch:tv"),
        ({"media_type": "other"}, {}, "media_mismatch:tv"), ({"year_from": 2000}, {"years": []}, "year_missing"), ({"year_from": 2021}, {}, "year_mismatch:[2020]"), ({"year_from": 2000, "year_to": 2019}, {"years": [1999, 2018]}, "passed"),
        ({"formats": ["1080"]}, {}, "format_mismatch:720"), ({"min_rating": 5.0}, {"rating": None}, "rating_missing"), ({"min_rating": 8.0}, {}, "rating_mismatch:7.0"), ({"bucket_filter": "only_dorama"}, {}, "bucket_mismatch:anime"),
        ({"bucket_filter": "exclude_anime_dorama"}, {}, "bucket_excluded:anime"), ({"genre_ids": [18]}, {}, "genre_mismatch:[16]"), ({"countries": ["US"]}, {"countries": []}, "country_missing"), ({"countries": ["US"]}, {}, "country_mismatch:['JP']"),
        ({"excluded": ["JP"]}, {}, "excluded_country:['JP']"), ({"include": ["hd", "korea"]}, {}, "passed"), ({"include": ["jap"]}, {}, "include_keyword_mismatch"), ({"exclude": ["japan"]}, {}, "exclude_keyword:japan"),
        ({"preset_key": "world", "excluded": ["JP"]}, {"bucket": "regular", "countries": ["JP", "US"]}, "passed"), ({"preset_key": "world", "excluded": ["JP"]}, {"bucket": "regular"}, "excluded_country:['JP']"),
        ({"preset_key": "world", "excluded": ["JP"]}, {"countries": ["JP", "US"]}, "excluded_country:['JP']"), ({"excluded": ["JP"]}, {"bucket": "regular", "countries": ["JP", "US"]}, "excluded_country:['JP']"),
        ({"include": ["hdr"]}, {}, "include_keyword_mismatch"), ({"include": ["720"], "exclude": ["1080"]}, {}, "passed"), ({"exclude": ["WEB-DL"]}, {}, "exclude_keyword:WEB-DL"),
    ]
    r = spark.createDataFrame([tuple((base | a | {"rule_id": n}).values()) for n, (a, _, _) in enumerate(cases)], rs)
    i = spark.createDataFrame([tuple((item | b | {"item_id": n}).values()) for n, (_, b, _) in enumerate(cases)], its)
    pairs = spark.createDataFrame([(n, n) for n in range(len(cases))] + [(999, 0)], "rule_id long, item_id long")
    got = {x.rule_id: x.reason for x in rules.explain(pairs, r, i).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(cases)} | {999: "missing_rule_or_item"}
    every = r.select("rule_id").crossJoin(i.select("item_id"))
    want = {(x.rule_id, x.item_id) for x in rules.explain(every, r, i).filter("reason = 'passed'").collect()}
    found = rules.match(r, i).collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want)
    heads, members = rules.classes(r.unionByName(r.withColumn("rule_id", F.col("rule_id") + 100)))
    assert members.count() == 2 * len(cases) and heads.count() < len(cases) and {x.class_id for x in members.collect()} == {x.rule_id for x in heads.collect()}
    told = {x.rule_id: x.checks for x in rules.explain(pairs, r, i, with_checks=True).collect()}
    assert [(c.check, c.passed) for c in told[0]] == [(n, True) for n in rules.CHECKS[1:]] and all(c.reason is None for c in told[0])
    assert [tuple(c) for c in told[1]] == [("global_ignore", False, "globally_ignored")] and [tuple(c) for c in told[999]] == [("input", False, "missing_rule_or_item")]
    assert [c.check for c in told[7]] == ["enabled", "media", "year"] and told[7][-1].reason == "year_mismatch:[2020]"


def test_match_counts_a_pair_once(spark):
    """Items of several years, genres and countries meet a rule at several keys."""
    r = spark.createDataFrame([(1, 1, 1, "", "any", 2000, 2010, None, "any", ["720"], [1, 2], ["US", "JP"], [], [], [])], "rule_id long, user_id long, is_enabled int, preset_key string, media_type string, year_from int, year_to int, min_rating double, bucket_filter string, formats array<string>, genre_ids array<int>, countries array<string>, excluded array<string>, include array<string>, exclude array<string>")
    rows = [(n, "tv", years, "720", 7.0, "anime", genres, countries, "", "", False) for n, (years, genres, countries) in enumerate([([2005, 2001, 1990], [2, 1, 3], ["JP", "US"]), ([1999, 2003], [3, 2], ["FR", "US"]), ([1999], [1], ["US"]), (None, [1], ["US"]), ([2002], None, ["US"]), ([2002], [1], None)])]
    i = spark.createDataFrame(rows, "item_id long, media_type string, years array<int>, video_format string, rating double, bucket string, genres array<int>, countries array<string>, haystack string, tech string, ignored boolean")
    assert sorted(x.item_id for x in rules.match(r, i).collect()) == [0, 1]


def test_match_counts_equal_the_counted_pairs(spark):
    """Counts by cells and classes are those of the pairs, with keywords, several years, unknown ratings and repeated rules."""
    rs = "rule_id long, user_id long, is_enabled int, preset_key string, media_type string, year_from int, year_to int, min_rating double, bucket_filter string, formats array<string>, genre_ids array<int>, countries array<string>, excluded array<string>, include array<string>, exclude array<string>"
    its = "item_id long, media_type string, years array<int>, video_format string, rating double, bucket string, genres array<int>, countries array<string>, haystack string, tech string, ignored boolean"
    pick = lambda n, *of: of[n % len(of)]
    rows = [(n, n, pick(n // 7, 1, 1, 1, 0), pick(n, "", "world"), pick(n, "any", "tv", "movie"), pick(n // 3, None, 2000, 2003), pick(n // 5, None, 2004, 2001), pick(n // 2, None, 5.0, 8.0), pick(n, "any", "only_anime", "exclude_anime"), pick(n // 2, [], ["720", "1080"]), pick(n // 4, [], [1, 2]),
             pick(n // 3, [], ["US", "JP"]), pick(n // 6, [], ["JP"]), pick(n // 2, [], ["red", "hdr"], ["blue sky"]), pick(n // 9, [], ["mp3"])) for n in range(60)]
    r = spark.createDataFrame([*rows, *[(row[0] + 100, *row[1:]) for row in rows[:20]]], rs)
    items = [(n, pick(n, "tv", "movie", "other"), pick(n // 2, [2001], [1999, 2002, 2005], [], None), pick(n, "720", "1080", None), pick(n // 3, None, 5.0, 9.0), pick(n, "anime", "regular", None), pick(n // 2, [1], [2, 1, 3], None), pick(n // 5, ["US"], ["JP", "US"], [], None),
              pick(n, "red house", "reddish", "a blue sky"), pick(n // 4, "x", "hdr10 mp3"), n % 17 == 0) for n in range(120)]
    i = spark.createDataFrame(items, its)
    counted = rules.match(r, i).groupBy("rule_id").agg(F.count("*"), F.min("item_id"), F.max("item_id"))
    got = {tuple(x) for x in rules.match_counts(r, i).collect()}
    assert got == {tuple(x) for x in counted.collect()} and len(got) > 20


def test_listed_texts_are_parsed_only_where_they_begin_like_arrays(spark):
    from tramline.functions import text

    cases = {' ["a", "A", null, " b "]': ["a", "b"], "a, B ,b,,": ["a", "B"], "[a": ["[a"], '"a"': ['"a"'], '{"x": 1}': ['{"x": 1}'], "": [], "null": ["null"], '\n[1, [2]]': ["1", "[2]"]}
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "c string")
    assert [x[0] for x in rows.select(text.listed(F.col("c"))).collect()] == [*cases.values(), []]
    plan = rows.select(text.listed(F.col("c")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_group_sizes_count_without_a_join(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, None), (1, None), (None, 5), (None, 5), (2, 5)], "u long, g long")
    sizes = delivery.group_sizes(rows, "u", "g")
    assert {tuple(x) for x in sizes.collect()} == {(1, 5, 2, True), (1, None, 2, False), (None, 5, 2, False), (2, 5, 1, False)}
    assert "Join" not in sizes._jdf.queryExecution().executedPlan().toString()
    assert sorted(x.as_group for x in delivery.grouped(rows, "u", "g").collect()) == [False] * 5 + [True] * 2


def test_origin_totals_count_users_and_items_apart(spark):
    rows = spark.sql("SELECT * FROM VALUES ('live', 1, 7, TIMESTAMP '2020-01-01'), ('live', 1, 8, TIMESTAMP '2020-01-03'), ('live', NULL, 8, NULL), ('claim', 2, NULL, NULL) AS t(origin, user_id, item_id, delivered_at)")
    found = delivery.origin_totals(rows)
    assert {tuple(x) for x in found.collect()} == {("live", 3, 1, 2, "2020-01-03 00:00:00"), ("claim", 1, 1, 0, None)}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_highest_progress_is_an_ordered_fold(spark):
    from tramline.functions import progress

    rows = [(1, 0, "3 серия"), (1, 1, "s01e05"), (1, 2, "s02e01"), (2, 0, "x"), (2, 1, "1-4 из 10"), (2, 2, "1-5 из 10"), (2, 3, "1-3 из 10"), (3, 0, "y"), (4, 0, "s01e01"), (4, 1, "1x01")]
    df = spark.createDataFrame(rows, "k long, at long, p string").withColumn("parts", progress.parts(F.col("p")))
    got = {r.k: r.p for r in versions.highest_progress(df, "k", "parts", ["at"], ["p"]).collect()}
    # the order is cyclic, so the fold's direction decides: from the oldest row on, ties to the newer
    assert got == {1: "s02e01", 2: "1-5 из 10", 3: "y", 4: "1x01"}


def test_cooldown_bounds(spark):
    asked = spark.createDataFrame([(1, 1000), (2, 1000), (3, 1000), (4, 1000), (5, 1000)], "user_id long, at long")
    sent = spark.createDataFrame([(1, 1000), (2, 581), (3, 580), (4, 1001)], "user_id long, delivered_at long")
    assert sorted(r.user_id for r in delivery.outside_cooldown(asked, sent, ["user_id"], "at").collect()) == [3, 4, 5]


def test_claims_and_upsert(spark):
    claims = spark.createDataFrame([(1, "sent", 0, None), (2, "sending", 100, None), (3, "sending", 100, 500), (4, "failed", 1000, 1000)], "id long, status string, claimed_at long, updated_at long")
    assert sorted(r.id for r in delivery.active_claims(claims, F.lit(1200)).collect()) == [1, 3]
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, title string, note string")
    batch = spark.createDataFrame([(1, "", "", 1), (2, "B", None, 1), (2, "C", "", 2), (4, "n", "m", 1)], "id long, title string, note string, at long")
    got = {r.id: tuple(r)[1:] for r in versions.upsert(stored, batch, ["id"], F.col("at"), ("note",)).collect()}
    assert got == {1: ("a", "", "changed"), 2: ("C", "", "changed"), 3: ("c", "z", "untouched"), 4: ("n", "m", "new")}


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n: [(i, " ".join(rng.choices("bcdefghj", k=rng.randint(0, 7)))) for i in range(n)]
    a, b = make(40), make(30)
    want = set()
    for i, x in a:
        for j, y in b:
            s, t = set(x.split()), set(y.split())
            if s and t and round(len(s & t) / max(len(s), len(t)), 3) >= 0.6:
                want.add((i, j, round(len(s & t) / max(len(s), len(t)), 3)))
    got = linking.overlaps(spark.createDataFrame(a, "l long, x string"), spark.createDataFrame(b, "r long, y string"), "l", "r", "x", "y", 0.6)
    assert {tuple(r) for r in got.collect()} == want


def test_confidence(spark):
    cases = [(True, 0.1, 0.0, 1, "high"), (True, 0.1, 0.0, 2, "medium"), (False, 0.95, 0.8, None, "high"), (False, 0.9, 0.6, 0, "medium"), (False, 0.9, 0.6, 5, "low"), (False, 0.6, 0.9, 0, "low"), (False, 0.7, 0.2, 0, "low"), (False, 0.8, 0.4, 3, "medium")]
    df = spark.createDataFrame(cases, "e boolean, s double, o double, y int, want string")
    assert [r.got for r in df.select(linking.confidence(F.col("e"), F.col("s"), F.col("o"), F.col("y")).alias("got")).collect()] == [c[-1] for c in cases]


# a stream drops events that the watermark has passed, so each part below begins after it
EVENTS = [(1, 1000, 1), (1, 1060, 2), (1, 1100, 3), (1, 1200, 4), (2, 1010, 7), (3, 1000, 8), (1, 1219, 5), (1, 1220, 6), (3, 1500, 9), (3, 1500, 10)]
WANT = [(1, 1220, 5), (1, 1340, 6), (2, 1130, 7), (3, 1120, 8), (3, 1620, 10)]


def test_debounce_replay_and_stream_agree(spark, tmp_path):
    schema = "key long, at long, payload long"
    assert sorted(map(tuple, debounce.replay(spark.createDataFrame(EVENTS, schema)).collect())) == WANT
    for n, part in enumerate((EVENTS[:6], EVENTS[6:], [(9, 10_000, 99)], [(9, 20_000, 100)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = debounce.stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        out.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("key < 9").collect())
    assert got == WANT


def test_observation_sink_and_anomalies(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", 5), (2, None, 6)], "release_id long, release_text string, polled_at long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        observations.append_sink(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    schema = "release_id long, anomaly_type string, old_value string, new_value string, status string"
    stored = spark.createDataFrame([(1, "p", "5", "4", "open"), (2, "p", "5", "4", "resolved")], schema)
    found = spark.createDataFrame([(1, "p", "5", "4", None), (2, "p", "5", "4", None), (2, "p", "5", "4", None)], schema)
    assert [r.release_id for r in observations.new_anomalies(found, stored).collect()] == [2]


def test_readers(spark, tmp_path):
    page = """<table><tr class=x><td onclick="cat(45);"><a href="/details.php?id=123456">A <b>title</b> &amp; more</a></td><td class='s'>7</td><td class='s'>1.4 GB</td><td class='s'>today</td><td class="sl_s">12</td>
        <td class="sl_p">x</td><td><a href="/userdetails.php?id=5">bob</a></td></tr><tr><td>none</td></tr><tr><td><a href='/x'>y</a><a href="/details.php?id=99999">Other</a></td></tr></table>"""
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in readers.listing(pages).collect()] == [(1, "123456", "A title & more", 45, 7, "1.4 GB", "today", 12, 0, "bob"), (1, "99999", "Other", None, 0, "", "", 0, 0, "")]
    (tmp_path / "d.json").write_text('[{"source": "m", "media_type": "tv", "entry_id": 5, "year": 2001, "titles": ["A", "B"], "aliases": ["B", ""]}, {"entry_id": 6}]')
    assert sorted((r.entry_id, r.name) for r in readers.dictionary(spark, str(tmp_path / "d.json")).collect()) == [(5, "A"), (5, "B")]
    (tmp_path / "more" / "deep").mkdir(parents=True)
    (tmp_path / "more" / "deep" / "x.json").write_text('{"entries": [{"show_id": 7, "title": " C  D ", "synonyms": ["E"]}, {"movie_id": 8, "names": {"en": "F", "ja": "G"}}, {"title": "no id"}, 3]}')
    (tmp_path / "more" / "one.json").write_text('{"entry_id": 9, "media_type": "Movie", "name": "H", "titles": ["H", "I"]}')
    (tmp_path / "more" / "bad.json").write_text("{not json")
    assert sorted((r.entry_id, r.media_type, r.name) for r in readers.dictionary(spark, str(tmp_path / "more")).collect()) == [(7, "tv", "C D"), (7, "tv", "E"), (8, "movie", "F"), (8, "movie", "G"), (9, "movie", "H"), (9, "movie", "I")]
    spark.range(2).write.parquet(str(tmp_path / "old"))
    wider = readers.read_table(spark, str(tmp_path / "old"), spark.createDataFrame([], "id long, note string").schema)
    assert wider.columns == ["id", "note"] and wider.filter("note IS NULL").count() == 2


def test_explained_pairs_are_dealt_by_rule_and_hashed(spark):
    pairs = spark.range(2000).selectExpr("id % 7 AS rule_id", "id % 60 AS item_id")
    dealt = rules.dealt_by_rule(pairs)
    assert sorted(dealt.collect()) == sorted(pairs.distinct().collect())
    assert dealt.withColumn("at", F.spark_partition_id()).select("rule_id", "at").distinct().count() == 7 and dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = rules.compile_rules(spark.createDataFrame([(1, 1, 1, "any")], "rule_id long, user_id long, is_enabled int, media_type string").selectExpr("*", "'' AS preset_key", "null AS year_from", "null AS year_to", "null AS min_rating", "'any' AS bucket_filter", "0 AS allow_720", "0 AS allow_1080", "0 AS allow_2160", "'' AS country_codes", "'' AS exclude_country_codes", "array() AS genre_ids", "'' AS include_keywords", "'' AS exclude_keywords"))
    i = spark.range(3).selectExpr("id AS item_id", "'tv' AS media_type", "array(2020) AS years", "'' AS video_format", "7D AS rating", "'regular' AS bucket", "array(1) AS genres", "array('JP') AS countries", "'' AS haystack", "'' AS tech", "false AS ignored")
    found = rules.explain(dealt, r, i)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "BroadcastHashJoin" not in plan  # the same plan at every size, the wide side unsorted
    assert found.groupBy("reason").count().filter("reason = 'passed'").first()["count"] == 3


def test_overlaps_read_each_text_once_and_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)] + [f"only{n}" for n in range(200)]
    sides = [[(n, " ".join(rng.sample(words if side else words[:60] + [f"own{k}" for k in range(90)], rng.choice([0, 1, 3, 8, 20, 60])))) for n in range(80)] for side in (0, 1)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    left, right = (spark.createDataFrame(rows, "id long, text string") for rows in sides)
    left = left.select(F.col("id").alias("a"), seen("text").alias("text"))
    found = linking.overlaps(left, right.withColumnRenamed("id", "b"), "a", "b", "text", "text", 0.15).collect()
    want = {}
    for a, x in sides[0]:
        for b, y in sides[1]:
            s, t = set(x.split()), set(y.split())
            if s and t and round(len(s & t) / max(len(s), len(t)), 3) >= 0.15:
                want[a, b] = round(len(s & t) / max(len(s), len(t)), 3)
    assert want and {(r.a, r.b): r.overlap for r in found} == want and len(found) == len(want)
    assert read.value == len(sides[0])  # a filter on the tokens made them, and read the texts, a second time


def test_matching_is_dealt_over_all_partitions(spark):
    pairs = spark.range(60).selectExpr("id % 6 AS q", "id AS c", "0.5D AS overlap", "concat('some text ', id % 6) AS x", "concat('some text ', id) AS y")
    found = linking.matched(pairs, "q", "c", F.col("x"), F.col("y"), 2)
    assert found.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.groupBy("q").count().filter("count >= 2").count() == 6
