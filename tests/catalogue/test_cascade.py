import pytest
from pyspark.sql import functions as F

from tramline.operators import cascade

ITEMS = "item_id long, title_key string, at long, media_type string, external_id string, year int"
CANDIDATES = "item_id long, entry_id long, media_type string, year int, score double, search_score double, place long, reject_code string"


def _linked(spark, items, candidates=(), external=(), resolver=(), entries=range(1, 10), overrides=(), manual=(), reviews=(), memory=(), **kw):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    own = make(items, ITEMS)
    choices = cascade.options(
        own, make([(e,) for e in entries], "entry_id long"), make(external, "item_id long, entry_id long"),
        make(resolver, "item_id long, entry_id long, media_type string, confidence string"), make(candidates, CANDIDATES),
    )
    pairs = "title_key string, entry_id long"
    out = cascade.link_all(own, make(overrides, pairs), make(manual, pairs), choices, make(reviews, "item_id long, rejected_at long"), make(memory, pairs + ", since long"), **kw)
    return {r.item_id: (r.entry_id, r.path, r.n_barred) for r in out.collect()}


def _same(n, scores):
    return [(i, e, "tv", 2000, s, 0.0, e, None) for i in range(1, n + 1) for e, s in scores.items()]


def test_rejections_are_remembered_for_later_items_of_the_title(spark):
    items = [(n, "t", 10 * n, "tv", "", 2000) for n in range(1, 6)] + [(9, "other", 5, "tv", "", 2000)]
    candidates = _same(5, {1: 0.9, 2: 0.8, 3: 0.7}) + [(9, 1, "tv", 2000, 0.9, 0.0, 1, None)]
    # item 1's entry is rejected at once, item 2's only after item 3 has come
    got = _linked(spark, items, candidates, reviews=[(1, 0), (2, 35), (4, 40), (9, 5)])
    assert got == {1: (1, "search", 0), 2: (2, "search", 1), 3: (2, "search", 1), 4: (3, "search", 2), 5: (None, "search_unmatched", 3), 9: (1, "search", 0)}
    with pytest.raises(RuntimeError):
        _linked(spark, items, candidates, reviews=[(1, 0), (2, 0), (3, 0), (4, 0)], most_rounds=2)


def test_each_step(spark):
    items = [(1, "a", 1, "tv", "", 2000), (2, "b", 1, "tv", "tt", 2000), (3, "c", 1, "tv", "tt", 2000), (4, "d", 1, "movie", "", 2000), (5, "e", 1, None, "", None), (6, "f", 1, "tv", "tt", 2000), (7, "g", 1, "tv", "", 2000), (8, "h", 1, "tv", "", 2000)]
    candidates = [(4, 5, "movie", 2003, 0.9, 0.0, 1, None), (4, 6, "movie", 2002, 0.5, 0.0, 2, None), (5, 5, "movie", 1950, 0.5, 0.1, 1, None), (5, 7, "tv", 1950, 0.5, 0.2, 2, None), (6, 8, "tv", 2000, 0.1, 0.0, 1, None), (7, 8, "tv", 2000, 0.1, 0.0, 1, "X")]
    got = _linked(
        spark, items, candidates, external=[(2, 2), (3, 2), (6, 3), (8, 99)], overrides=[("a", None)], manual=[("a", 4)], memory=[("f", 4, 0)],
        resolver=[(3, 4, "tv", "high"), (2, 4, "movie", "high"), (4, 3, "tv", "high"), (6, 4, "tv", "high"), (7, 4, "tv", "low")],
    )
    assert got[1] == (None, "override", 0)  # terminal though nothing was found
    assert got[2] == (2, "external", 0)  # the resolver's media is another
    assert got[3] == (4, "resolver", 0)  # it replaces another external entry
    assert got[4] == (6, "search", 0)  # the first film lies three years off
    assert got[5] == (7, "search", 0)  # equal scores, so the search's own decide; no year, no year rule
    assert got[6] == (8, "search", 1)  # a barred resolver's entry ends the external one too
    assert got[7] == (None, "search_unmatched", 0) and got[8] == (None, "search_unmatched", 0)  # entry 99 cannot be looked up
    assert _linked(spark, []) == {}


def test_cut_keeps_rows(spark):
    from tramline.operators.shared import cut

    assert cut(spark.range(5).withColumn("x", F.col("id") * 2)).count() == 5


def test_rounds_hold_rejected_items_only(spark, monkeypatch):
    held, columns = {}, []
    cut, stored = cascade.cut, cascade.stored
    monkeypatch.setattr(cascade, "cut", lambda df: columns.append(df.columns) or cut(df))
    monkeypatch.setattr(cascade, "stored", lambda df, tag: held.setdefault(tag, stored(df, tag)))
    items = [(n, "t", 10 * n, "tv", "", 2000) for n in range(1, 6)] + [(6, "u", 1, "tv", "", 2000), (7, None, 1, "tv", "", None)]
    # items 2 and 3 get the resolver's entry, which replaces another external one; item 6 has a manual entry
    resolver = [(2, 4, "tv", "high"), (3, 4, "tv", "high"), (4, 5, "tv", "high")]
    got = _linked(spark, items, _same(7, {1: 0.9, 2: 0.8}), external=[(3, 3), (4, 5)], resolver=resolver, manual=[("u", 9)], reviews=[(2, 0), (6, 0), (99, 0)], memory=[("t", 3, 0)])
    assert got == {1: (1, "search", 0), 2: (4, "resolver", 0), 3: (1, "search", 2), 4: (5, "external", 0), 5: (1, "search", 0), 6: (9, "manual", 0), 7: (1, "search", 0)}
    assert {r.item_id for r in held["cascade-rejected"].collect()} == {2}
    assert columns and not any("item_id" in c for c in columns)
