import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import periodic, registry


def brute_runs(words):
    """Every maximal stretch of each period, kept if that period is its smallest and it is long enough."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q) and not any(all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lead = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *lead, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_runs_match_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        n, letters = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 12 and rng.random() < 0.7:  # plant a period, at times inside another
            for _ in range(rng.randrange(1, 4)):
                a, p = rng.randrange(n - 6), rng.randrange(1, 9)
                for i in range(a + p, min(n, a + p * rng.randrange(3, 9))):
                    words[i] = words[i - p]
        assert periodic.runs(np.array(words, np.int32)) == brute_runs(words), words


def test_small_grids_and_stretches_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "GRID", 16)
    monkeypatch.setattr(periodic, "STRETCH", 2)
    test_runs_match_brute_force()


def test_nested_and_touching_runs():
    inner = ["a", "b"] * 4 + ["c"]
    words = (inner * 5) + ["x"] * 7 + ["y"]
    number = {w: i for i, w in enumerate("abcxy")}
    found = periodic.runs(np.array([number[w] for w in words], np.int32))
    assert found == brute_runs(words) and (0, 45, 9) in found and (0, 8, 2) in found and (45, 7, 1) in found


@pytest.mark.parametrize("kind", ["one word", "two words", "nearly one word", "long period", "random"])
def test_long_texts_take_near_linear_time(kind):
    n = 400_000
    rng = np.random.default_rng(1)
    words = np.zeros(n, np.int32)
    if kind == "two words":
        words[::2] = 1
    elif kind == "nearly one word":
        words[::1001] = 1
        words[rng.integers(0, n, 50)] = 2
    elif kind == "long period":
        words = np.resize(rng.integers(0, 9, 20_011), n).astype(np.int32)
    elif kind == "random":
        words = rng.integers(0, 3, n).astype(np.int32)
    began = time.perf_counter()
    found = periodic.runs(words)
    assert time.perf_counter() - began < 30
    if kind in ("one word", "two words", "long period"):
        assert (0, n, {"one word": 1, "two words": 2, "long period": 20_011}[kind]) in found


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, registry.op12_harmonic_grid(spark, sf).collect()))
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000]
    short = {r.doc_id for r in docs}
    assert len(short) > 150 and any(g[1] for g in got)
    assert [g for g in got if g[0] in short] == sorted(brute_row(r.doc_id, r.text) for r in docs)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_edges(spark, edge_docs, no_docs):
    rows = {(r.doc_id, r.n_words): (r.runs, r.text) for r in periodic.scan(edge_docs).collect()}
    assert rows[(1, 0)] == ([], "") and rows[(6, 0)] == ([], "") and rows[(None, 2)] == ([], "two words")
    runs, text = rows[(5, 160000)]
    assert [tuple(r) for r in runs] == [(0, 160000, 8)] and text == "a b c d e f g h"
    assert periodic.scan(edge_docs).count() == edge_docs.count() and periodic.scan(no_docs).count() == 0
    assert periodic.planted(no_docs).count() == 0
    # rows without an id, words or text stay as they are
    kept = {r.doc_id: r.text for r in periodic.planted(edge_docs.filter("doc_id IS NULL OR length(trim(text)) = 0 OR text IS NULL")).collect()}
    assert kept[None] == "two words" and kept[1] is None and kept[0] == ""


def test_other_white_space_is_part_of_words(spark):
    docs = spark.createDataFrame([(1, "a b " * 6), (2, "x " * 6), (3, "p\x1cq\n" * 7)], "doc_id long, text string")
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs]) for r in periodic.scan(docs).collect()}
    assert found == {1: (6, [(0, 6, 1)]), 2: (1, []), 3: (7, [(0, 7, 1)])}


def test_planted_rule(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, cast(id % 97 as int)), i -> concat('w', i)), ' ')").alias("text"))
    got = {r.doc_id: r.text.split() for r in periodic.planted(docs).collect()}
    changed = 0
    for r in docs.collect():
        words, h = r.text.split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert got[r.doc_id] == words
    assert changed > 20
