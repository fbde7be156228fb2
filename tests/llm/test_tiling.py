import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import tiling


def brute_tiles(text, item, width):
    """Textbook greedy string tiling over token lists."""
    a_used, b_used, out = [False] * len(text), [False] * len(item), []
    while True:
        best = None
        for a in range(len(text)):
            for b in range(len(item)):
                k = 0
                while a + k < len(text) and b + k < len(item) and text[a + k] == item[b + k] and not a_used[a + k] and not b_used[b + k]:
                    k += 1
                if k >= width and (best is None or k > best[2]):
                    best = (a, b, k)
        if best is None:
            return out
        a, b, k = best
        a_used[a : a + k] = [True] * k
        b_used[b : b + k] = [True] * k
        out.append(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abcd"), min_size=1, max_size=20), st.integers(2, 4))
def test_tiles_match_textbook(text, item, width):
    got = tiling.Index([(1, " ".join(item))], width).covered(" ".join(text))
    want = brute_tiles(text, item, min(width, len(item)))
    total = sum(t[2] for t in want)
    assert got == ([(1, total / len(item), len(want))] if want else [])


def test_reordered_passage_is_caught():
    words = [f"w{i}" for i in range(30)]
    moved = words[20:] + ["x"] * 5 + words[10:20] + ["y"] + words[:10]
    assert tiling.Index([(1, " ".join(words))]).covered("Z " + ", ".join(moved).upper()) == [(1, 1.0, 3)]


def test_short_items_and_scripts_without_spaces():
    index = tiling.Index([(1, "is it so"), (2, "Warum?"), (3, "今日はとても良い天気です。明日は雨が降るでしょう。"), (4, "")])
    assert index.covered("He asked: IS it, so") == [(1, 1.0, 1)] and index.covered("it is so") == []
    assert index.covered("Und warum nicht") == [(2, 1.0, 1)]
    moved = index.covered("彼は言った、明日は雨が降るでしょう。そして今日はとても良い天気です。")
    assert moved == [(3, 1.0, 2)]
    assert tiling.tokens("今日ab_1 Ünd") == ["今", "日", "ab_1", "ünd"]


def _brute(docs, items, threshold):
    out = []
    for d in docs:
        best, over = (0.0, None), []
        for i, t in items:
            own = tiling.tokens(t)
            share = sum(x[2] for x in brute_tiles(tiling.tokens(d.text), own, min(5, len(own)))) / len(own) if own else 0
            if share > best[0]:
                best = (share, i)
            if share >= threshold:
                over.append(i)
        out.append((d.doc_id, best[1], best[0], over))
    return sorted(out, key=str)


def test_documents(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()][:8]
    rng = random.Random(4)
    rows = [(n, " ".join(rng.sample(t.split(), len(t.split()) // 2) + t.split())) for n, (_, t) in enumerate(items)]
    docs = documents.select("doc_id", "text").filter("length(text) < 700").limit(25).union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 500):
        got = [(r.doc_id, r.tiling.item_id, r.tiling.coverage, r.tiling["items"]) for r in tiling.tiled(docs, bench, block_chars=chars).collect()]
        assert sorted(got, key=str) == _brute(docs.collect(), items, tiling.THRESHOLD)
    clean = tiling.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, _, share, _ in _brute(docs.collect(), items, 0.6) if share < 0.6}


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "c d e f g h"), (4, "f g h a b c d"), (4, "f g h a b c d")], "item_id long, text string")
    rows = {(r.doc_id, r.text): r.tiling for r in tiling.tiled(edge_docs, bench).collect()}
    long = next(v for (i, _), v in rows.items() if i == 5)
    assert long.coverage == 1.0 and long["items"] == [3, 4]
    # the short item stands in three of them
    assert {i: v["items"] for (i, _), v in rows.items() if v.coverage} == {5: [3, 4], 8: [3], 9: [3]}
    assert tiling.tiled(no_docs, bench).count() == 0 and tiling.tiled(edge_docs, bench.limit(0)).count() == 10
    assert tiling.decontaminate(edge_docs, bench).count() == 7
