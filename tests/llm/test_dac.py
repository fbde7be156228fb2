import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramline.llm import dac

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=1500), st.sampled_from([(9, 7, 16), (8, 8, 8, 8), (1, 15, 16), (16, 16)]))
def test_codes(ids, bits):
    codes = dac.Codes(dac.dump(np.array(ids, np.uint64), bits))
    assert len(codes) == len(ids) and codes.all().tolist() == ids
    for i in random.sample(range(len(ids)), min(50, len(ids))):
        assert codes[i] == ids[i]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_too_large():
    with pytest.raises(ValueError):
        dac.dump(np.array([2**16], np.uint64), (8, 8))


@settings(max_examples=200, deadline=None)
@given(st.text("ab,.' \n\t  \x1cé1$<|endoftx>", max_size=30))
def test_words_encode_as_the_whole(text):
    encoder = dac._encoder(PATH)
    texts = [text, None, text + " " + text, "word " + text + ". Word's"]
    for own, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(own or "", add_special_tokens=False).ids


def _expected(docs, key):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d in sorted(docs, key=key):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]
        out.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


def _by_id(d):
    return (d.doc_id is not None, d.doc_id or 0, zlib.crc32((d.text or "").encode()))


def test_documents(spark, documents, edge_docs, no_docs, tmp_path):
    for n, docs in enumerate((documents, edge_docs, no_docs)):
        path = str(tmp_path / str(n))
        dac.write_tokens(docs, path, PATH, segment=3000)
        rows = [tuple(r) for r in dac.read_documents(spark, path).orderBy("start").collect()]
        assert rows == _expected(docs.collect(), _by_id)


def test_random_access_and_order(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    dac.write_tokens(documents, path, PATH, order=(F.col("n_chars"), F.col("doc_id")))
    rows = [tuple(r) for r in dac.read_documents(spark, path).orderBy("start").collect()]
    assert rows == _expected(documents.collect(), lambda d: (d.n_chars, d.doc_id))
    for s in dac.segments(spark, path).collect():
        codes = dac.Codes(bytes(s.payload))
        every = codes.all()
        assert all(codes[i] == every[i] for i in range(0, len(codes), 997))


def test_many_rows_of_one_id(spark, tmp_path):
    docs = spark.range(3000).select(F.expr("IF(id % 3 = 0, id, IF(id % 3 = 1, NULL, 4L))").alias("doc_id"), F.expr("'w' || id % 2").alias("text"))
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dac.write_tokens(docs, path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in dac.read_documents(spark, path).orderBy("start").collect()] == _expected(docs.collect(), _by_id)
    assert dac.segments(spark, path).filter("array_contains(doc_ids, 4)").count() > 1
