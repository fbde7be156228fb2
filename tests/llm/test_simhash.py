import random

import xxhash

from tramline.llm import simhash
from tramline.llm.components import components


def brute_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _expected(rows):
    prints = [brute_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = brute_components(range(len(rows)), pairs)
    least = {}
    for n, r in enumerate(rows):
        if r.doc_id is not None:
            least[group[n]] = min(r.doc_id, least.get(group[n], r.doc_id))
    return sorted(((r.doc_id, prints[n], least.get(group[n])) for n, r in enumerate(rows)), key=str)


def _found(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


def test_documents(documents):
    assert _found(simhash.near_duplicates(documents)) == _expected(documents.collect())


def test_edges(edge_docs, no_docs):
    assert _found(simhash.near_duplicates(edge_docs)) == _expected(edge_docs.collect())
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_with_and_without_second_cut(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(12)]
    prints = {b for b in base}
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << i for i in random.sample(range(64), random.randint(1, 4))))
    prints = [p - 2**64 if p >> 63 else p for p in prints]
    want = sorted((a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= 3)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for over in (256, 1, 8):
        assert sorted(map(tuple, simhash.links(df, over).collect())) == want


def test_keep_one(documents, edge_docs):
    kept = sorted(r.doc_id for r in simhash.keep_one(documents).collect())
    assert kept == sorted({c for *_, c in _expected(documents.collect())})
    got = simhash.keep_one(edge_docs)
    assert got.columns == edge_docs.columns
    # a component of null ids only keeps a row as well
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted({c for *_, c in _expected(edge_docs.collect())}, key=str)


def test_keep_one_keeps_rows(spark):
    """A unique text stays though its id is repeated, and of equal rows one stays."""
    text, other = "one two three four five", "six seven eight nine ten"
    rows = [(3, text), (5, text), (5, other)]
    for order in ([*rows], rows[::-1]):
        docs = spark.createDataFrame([*order, order[0]], "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(3, text), (5, other)]
    docs = spark.createDataFrame([(None, text), (None, text), (None, other), (4, other), (None, None), (None, "")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, simhash.keep_one(docs).select("doc_id").collect()))) == ["(4,)", "(None,)", "(None,)"]
    many = spark.range(3000).selectExpr("7L AS doc_id", "'same words in every row' AS text").unionByName(docs)
    assert simhash.keep_one(many, split_over=2).count() == 4


def test_components(spark):
    random.seed(5)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (500, 1000), (500, 1000)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = brute_components(nodes, [p for p in pairs if p[0] != p[1]])
    assert dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exploded_index_is_not_broadcast(spark, monkeypatch):
    prints = spark.range(200).selectExpr("id * 7919 AS fp")
    kept, stored = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, tag: kept.append(df) or stored(df, tag))
    for split_over in (256, 1):
        kept.append(simhash.links(prints, split_over))
    for df in kept:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
