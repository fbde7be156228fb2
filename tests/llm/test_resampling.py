import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tramline.llm import registry, resampling


def brute_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute(docs, target, percent=5):
    made = [(d, *brute_features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in brute_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in s}
    rows = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]
    got = _got(registry.op13_importance_resampling(spark, f"/root/testdata/{sf}"))
    assert got == brute(docs, target) and any(r[4] for r in got)


def test_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("a b C",), (None,), ("",), ("Ünïcode text",)], "text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = [r.text for r in target.collect()]
    assert _got(resampling.resample(edge_docs, target, 100)) == brute(rows, want, 100)
    assert resampling.resample(no_docs, target).count() == 0
    empty = target.filter("false")
    assert _got(resampling.resample(edge_docs, empty, 100)) == brute(rows, [], 100)
    with pytest.raises(ValueError):
        resampling.resample(edge_docs, target, 101)


def test_pieces_change_nothing(spark, documents, monkeypatch):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = _got(resampling.resample(documents, target))
    monkeypatch.setattr(resampling, "PIECE", 5)
    assert _got(resampling.resample(documents, target)) == whole


def test_words_of_many_kinds(spark):
    texts = ["ÄÖ Ü-İstanbul ǅ x", "A1_b2\x7fc3", "日本語 テキスト", "É É é\x00z", "tab\tnew\nline", "ẞtraße ΑΣ aΣ"] + [" ".join(f"w{i}" for i in range(n)) for n in (1, 2, 3, 4)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    rows = resampling._features(df.select("doc_id", resampling.words(F.col("text")).alias("words"))).filter("bucket IS NOT NULL").groupBy("doc_id").agg(F.collect_list("bucket").alias("b"))
    assert {r.doc_id: sorted(r.b) for r in rows.collect()} == {n: sorted(brute_features(t)[1]) for n, t in enumerate(texts)}


def test_repeated_rows_and_ties_have_ranks_of_their_own(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("one two three four five " * 5).alias("text"))
    target = spark.createDataFrame([("one two",)], "text string")
    got = resampling.resample(docs, target, 50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1501))
    assert _got(spark.createDataFrame(got)) == brute([(r.doc_id, r.text) for r in docs.collect()], ["one two"], 50)


def test_main_path_is_native(spark, documents):
    table = resampling.gains(documents, documents.limit(5))
    for df in (table, resampling.weighed(documents, table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)
    assert "BroadcastHashJoin" in resampling.weighed(documents, table)._jdf.queryExecution().executedPlan().toString()
