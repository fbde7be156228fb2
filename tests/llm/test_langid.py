import collections
import math
import random
import zlib

import numpy as np

from tramline.llm import langid
from tramline.llm.common import id_remainder

SF = "/root/testdata/sf0.01"


def brute_kneser_ney(texts, alphabet):
    """Textbook recursion over dictionaries of strings."""
    n = langid.ORDER
    grams = collections.Counter()
    for t in texts:
        s = "".join(map(chr, langid.codes(t).tolist()))
        grams.update(s[i - n + 1 : i + 1] for i in range(n - 1, len(s)))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    once = {k: sum(c == 1 for c in v.values()) for k, v in levels.items()}
    twice = {k: sum(c == 2 for c in v.values()) for k, v in levels.items()}
    discount = {k: min(0.95, max(0.1, once[k] / (once[k] + 2 * twice[k]))) if once[k] else 0.5 for k in levels}

    def p(g):
        k = len(g)
        if not k:
            return 1 / alphabet
        follow = [c for x, c in levels[k].items() if x[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        return (max(levels[k][g] - discount[k], 0) + discount[k] * len(follow) * p(g[1:])) / sum(follow)

    return p


def test_probabilities_match_textbook():
    random.seed(2)
    texts = {x: ["".join(random.choice(a) for _ in range(40)) for _ in range(6)] for x, a in (("aa", "abc d"), ("bb", "abé x"))}
    counts = {x: langid._merged([k := langid._keys([langid.codes(t) for t in v])[0]], [np.ones(len(k), np.int64)]) for x, v in texts.items()}
    model = langid.build(counts)
    alphabet = 1 + len({chr(c) for v in texts.values() for t in v for c in langid.codes(t)[3:].tolist()})
    for n, x in enumerate(model.languages):
        p = brute_kneser_ney(texts[x], alphabet)
        for g in ("abc ", "abca", "zzzz", "   a", "zzab", "xéab", "é é ", "abzé"):
            key = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g))], np.uint64)
            assert math.isclose(model.log_probabilities(key)[0, n], math.log(p(g)), rel_tol=1e-4), g
        # a distribution over the alphabet and the unknown character
        letters = sorted({c for v in texts.values() for t in v for c in langid.codes(t)[3:].tolist()})
        keys = np.array([(ord("a") << 48) | (ord("b") << 32) | (ord("a") << 16) | c for c in [*letters, 3000]], np.uint64)
        assert abs(np.exp(model.log_probabilities(keys)[:, n].astype(float)).sum() - 1) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = id_remainder(4) != 2
    model = langid.train(docs, may_learn=learn)
    rows = [r for r in langid.predicted(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) > 200 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.06
    other = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю")], "doc_id long, text string")
    assert langid.predicted(other, model).first().rejected and langid.predicted(other, model, reject=True).first().lang_pred == "und"


def test_edges(spark, edge_docs, no_docs):
    model = langid.train(edge_docs)
    assert model.languages == ["en"]
    rows = langid.predicted(edge_docs, model).collect()
    assert len(rows) == 10 and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.predicted(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(edge_docs, langid.train(no_docs)).collect()} == {"und"}
    assert len(langid.codes("𐐀中a")) == 6 and (langid.codes("𝄞—1 ")[3:] == 32).all()


def test_large_models_keep_every_gram(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text", "lang")
    # letters of the upper half make keys that are negative as longs
    docs = docs.unionByName(spark.createDataFrame([(9_000_000 + n, chr(0xAC00 + 7 * n) * 3 + " 丰 กม " + chr(0x4E00 + n) * 2, "xx") for n in range(40)], docs.schema))
    whole = langid.train(docs)
    monkeypatch.setattr(langid, "MOST_CELLS", 20_000)
    large = langid.train(docs)
    keys = np.concatenate([whole.grams[langid.ORDER][0], np.array([(ord("z") << 48) | (ord("q") << 32) | (3000 << 16) | ord("a")], np.uint64)])
    assert large.languages == whole.languages and len(keys) > 20_000
    assert np.allclose(large.log_probabilities(keys), whole.log_probabilities(keys), atol=1e-4)
    assert np.allclose(large.limits, whole.limits, atol=1e-4)
    want, got = ({(r.doc_id, r.lang_pred, round(r.cross_entropy or 0, 3)) for r in langid.predicted(docs, m).collect()} for m in (whole, large))
    assert len(want ^ got) <= 0.02 * len(want)  # roundings


def test_many_languages(spark):
    """No language vanishes, however many there are and however few texts one has."""
    rows = [(n, chr(0x4E00 + n) * 30, f"l{n:03}") for n in range(230)] + [(1000 + n, "shared letters only", f"m{n % 100:03}") for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 330 and all(r.lang_pred == ("m000" if r.lang > "m" else r.lang) for r in langid.predicted(docs, model).collect())


def test_letters_do_not_share_codes():
    letters = [chr(c) for c in range(0x10000) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    assert len({int(langid.codes(c)[-1]) for c in letters}) == len(letters) > 40_000
    assert langid.codes("𠀀")[-1] >= 0xE000


def test_rejection_is_calibrated_on_texts_that_are_not_counted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    learn = id_remainder(4) != 2
    rows = langid.predicted(docs.filter(~learn).filter("lang IS NOT NULL AND length(text) > 20"), langid.train(docs, may_learn=learn)).collect()
    rejected = np.mean([r.rejected for r in rows])
    assert 0 < rejected < 0.03, rejected
