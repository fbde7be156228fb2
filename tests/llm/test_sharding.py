import zlib

import xxhash
from pyspark.sql import functions as F

from tramline.llm import sharding


def _check(docs, rows, n):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d.doc_id is None, d.doc_id or 0, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs
    )
    by = {}
    for r in rows:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    fair, largest = sum(r.size for r in rows) / n, max(r.size for r in rows)
    for s in range(n):
        assert abs(sum(r.size for r in by.get(s, [])) - fair) <= 2 * largest
    # shards follow the key order, and equal texts are neighbours in it
    order = [r.text_crc32 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_documents(documents):
    _check(documents.collect(), sharding.shard(documents, 7).collect(), 7)


def _brute(docs, n):
    """All rows in key order; the shard is where the middle of a row falls."""
    keyed = []
    for d in docs:
        data, crc = (d.text or "").encode(), zlib.crc32((d.text or "").encode())
        sub = (42 if d.doc_id is None else xxhash.xxh64_intdigest(d.doc_id.to_bytes(8, "little", signed=True), 42)) % 2**20
        keyed.append(((crc << 20) + sub, d.doc_id is not None, d.doc_id or 0, len(data) + 16, crc))
    keyed.sort()
    total, before, out, slots = sum(k[3] for k in keyed), 0, [], {}
    for _, known, doc_id, size, crc in keyed:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        before += size
        out.append((doc_id if known else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def test_places_match_brute_force(documents, edge_docs):
    for docs, n in ((documents, 7), (documents, 40), (edge_docs, 3)):
        got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, n).collect()]
        assert sorted(got, key=str) == sorted(_brute(docs.collect(), n), key=str)


def test_repeated_and_null_ids_are_divided(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(docs, 10).collect()
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows]
    assert sorted(got, key=str) == sorted(_brute(docs.collect(), 10), key=str)
    assert len({r.shard for r in rows if r.doc_id is None}) >= 5


def test_edges(edge_docs, no_docs):
    _check(edge_docs.collect(), sharding.shard(edge_docs, 3).collect(), 3)
    assert sharding.shard(no_docs, 3).count() == 0


def test_range_search(spark):
    keys = spark.range(-3, 60)
    for splits in ([], [5], [0, 7, 7 + 1, 40], list(range(0, 50, 3))):
        found = keys.select("id", sharding._range_of(F.col("id"), splits).alias("part")).collect()
        assert all(r.part == sum(s <= r.id for s in splits) for r in found)


def test_hot_group_is_divided(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard(docs, 10).collect()
    _check(docs.collect(), rows, 10)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same text")}) >= 6


def test_write(documents, spark, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("text").exceptAll(documents.select("text")).count() == 0 and back.count() == documents.count()
