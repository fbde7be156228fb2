import math
import zlib

import numpy as np

from tramline.llm import quality
from tramline.llm.common import id_remainder

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = id_remainder(3) != 1
    model = quality.train(docs, labels, may_learn=learn)
    rows = quality.scored(docs.select("doc_id", "text"), model).filter(~learn).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    right = {q: np.mean([(r.score >= 0.5) == (q == 1) for r in rows if r.quality == q]) for q in (0, 1)}
    assert right[1] > 0.99 and right[0] > 0.9
    share = labels.filter(learn).selectExpr("avg(quality)").first()[0]
    assert abs(model.prior - share) < 0.05  # the prior is estimated without the labels of 0
    assert np.allclose(quality.train(docs, labels.filter("quality = 1"), may_learn=learn).weight, model.weight)
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = quality.train(docs, flipped, may_learn=learn)
    assert np.allclose(again.weight, model.weight) and again.bias == model.bias


def test_risk_and_gradient_match_brute_force():
    rng = np.random.default_rng(4)
    p, u, w, b, prior = rng.normal(0.5, 1, (7, 5)), rng.normal(-0.5, 1, (11, 5)), rng.normal(0, 1, 5), 0.3, 0.4

    def brute(w, b):
        score = lambda x: 1 / (1 + math.exp(-(sum(a * c for a, c in zip(x, w)) + b)))
        over_p = sum(1 - score(x) for x in p) / len(p)
        return prior * over_p, sum(score(x) for x in u) / len(u) - prior * sum(score(x) for x in p) / len(p)

    first, second, of_first, of_second = quality.risk(p, u, w, b, prior)
    assert np.allclose((first, second), brute(w, b))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        up, down = brute(w + step[:5], b + step[5]), brute(w - step[:5], b - step[5])
        assert np.allclose((of_first[k], of_second[k]), [(x - y) / 2e-6 for x, y in zip(up, down)], atol=1e-6)
    # the step where the bracket is negative climbs it
    assert quality.risk(p, u - 9, w * 0 + 1, b, 0.9)[1] < 0


def test_prior_is_estimated_and_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    make = lambda n, sign: np.c_[rng.normal(sign * 1.6, 1, n), rng.normal(0, 1, (n, quality.N_FEATURES - 1))].astype(np.float32)
    positive, unlabelled = make(2000, 1), np.concatenate([make(1400, 1), make(2600, -1)])
    model = quality.fit(positive, unlabelled)
    assert abs(model.prior - 0.35) < 0.12
    test = np.concatenate([make(700, 1), make(1300, -1)])  # the mixture that the prior stands for
    assert ((model.score(test) >= 0.5) == (np.arange(2000) < 700)).mean() > 0.85


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (2, 1), (2, 0), (None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    model = quality.train(edge_docs, labels)
    rows = quality.scored(edge_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert quality.scored(no_docs, model).count() == 0
    for docs, some in ((no_docs, labels), (edge_docs, labels.limit(0)), (no_docs, labels.limit(0))):
        assert all(0 <= r.score <= 1 for r in quality.scored(edge_docs, quality.train(docs, some)).collect())
    assert quality.keep_good(edge_docs, model).columns == edge_docs.columns
