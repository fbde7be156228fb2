import collections
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tramline.llm import mixing


def test_schedule_deviates_by_less_than_one_block():
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 500, "b": 333, "c": 167}, {"a": 2, "b": 3, "c": 90, "d": 5}, {f"s{i}": i + 1 for i in range(40)}):
        period, got = sum(weights.values()), collections.Counter()
        slots = mixing.schedule(weights)
        for t, s in enumerate(slots, 1):
            got[s] += 1
            assert all(abs(got[x] * period - weights[x] * t) < period for x in weights)
        assert got == collections.Counter(weights)


def brute(blocks, weights, period):
    """Slot by slot, starting anew whenever a source has run out."""
    left, out, done = {s: n for s, n in blocks.items() if n}, [], collections.Counter()
    while left:
        slots = mixing.schedule(mixing.whole_weights({s: weights[s] for s in left}, max(period, 4 * len(left))))
        t = 0
        while all(left.values()):
            s = slots[t % len(slots)]
            out.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_mix_is_the_schedule(documents):
    weights = {f"src{i}": 1 + i % 5 for i in range(20)}
    rows = mixing.mix(documents, weights, block_rows=3, period=60).collect()
    assert sorted(r.position for r in rows) == list(range(documents.count()))
    sizes = collections.Counter(r.source for r in documents.collect())
    want = brute({s: -(-n // 3) for s, n in sizes.items()}, weights, 60)
    found = sorted({(r.slot, r.source, r.block) for r in rows})
    assert [x[1:] for x in found] == want and [x[0] for x in found] == list(range(len(want)))
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in ordered] == sorted(r.slot for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())


def test_edges(edge_docs, no_docs):
    rows = mixing.mix(edge_docs, block_rows=2).collect()
    assert sorted(r.position for r in rows) == list(range(10)) and {r.source for r in rows} == {None, "src0"}
    assert mixing.mix(no_docs).count() == 0
    with pytest.raises(ValueError, match="no positive weight"):
        mixing.mix(edge_docs, {"src0": 1.0})


def test_mixed_keeps_rows_in_order(documents, edge_docs, tmp_path, spark):
    place = {r.doc_id: r.position for r in mixing.mix(documents).collect()}
    out = mixing.mixed(documents)
    assert out.columns == documents.columns
    rows = out.collect()
    assert [place[r.doc_id] for r in rows] == list(range(len(rows)))
    assert mixing.mixed(edge_docs).exceptAll(edge_docs).count() == 0


def test_rows_follow_the_given_weights(spark, monkeypatch):
    """No source is a block off its given weight, also far on and between stretches."""
    monkeypatch.setattr(mixing, "STRETCH", 1000, raising=False)
    weights = {"hot": 1 / 3, **{f"s{n:02}": 2 / 57 for n in range(19)}}
    sizes = {s: 3000 if s == "hot" else 400 for s in weights}
    docs = spark.range(sum(sizes.values())).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.expr("CASE WHEN id < 3000 THEN 'hot' ELSE 's' || lpad((id - 3000) div 400, 2, '0') END").alias("source"))
    slots = sorted((r.slot, r.source) for r in mixing.mix(docs, weights, block_rows=1).collect())
    assert [n for n, _ in slots] == list(range(len(slots)))
    exact, got = {s: Fraction(w) for s, w in weights.items()}, collections.Counter()
    total = sum(exact.values())
    for t, (_, s) in enumerate(slots, 1):
        got[s] += 1
        assert all(abs(got[x] - w * t / total) < 1 for x, w in exact.items()), t
        if got[s] == sizes[s]:
            break
    assert t > 8000


def test_many_sources(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.expr("'s' || id % 300").alias("source"))
    assert sorted(r.position for r in mixing.mix(docs).collect()) == list(range(900))


def test_repeated_and_null_ids(spark, monkeypatch):
    """A hot group of one id, or of none, is cut into several windows and keeps gapless positions."""
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 32)
    docs = spark.range(6000).select(F.expr("CASE WHEN id % 3 = 0 THEN 5L WHEN id % 3 = 1 THEN NULL ELSE id END").alias("doc_id"), F.lit("t").alias("text"), F.expr("IF(id < 5000, 'hot', 'b')").alias("source"))
    rows = mixing.mix(docs).collect()
    assert sorted(r.position for r in rows) == list(range(6000))
    assert collections.Counter((r.doc_id, r.source) for r in rows) == collections.Counter((r.doc_id, r.source) for r in docs.collect())
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in ordered] == sorted(r.slot for r in rows)
    sizes = collections.Counter((r.slot, r.source, r.block) for r in rows)
    assert max(sizes.values()) == mixing.BLOCK_ROWS and len({s for s, *_ in sizes}) == len(sizes)
