import hashlib
import itertools
import random
import re

import numpy as np

from tramline.llm import secretscan as S

SF = "/root/testdata/sf0.01"


def brute_base(text):
    """The three patterns as they are stated, each match checked afterwards."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for n, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for *_, s in sorted(out)]


def test_base_spans(spark):
    random.seed(1)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    parts = ["pass", "word", "Token", "ſecret", "ToKen", " = ", ":", '"', "AKIA", "ABCD1234ABCD1234", "0123456789abcdef", "ab.cd", "\n", "é", "API_KEY", "apikey", "'"]
    texts += ["".join(random.choices(parts, k=12)) for _ in range(3000)]
    for t in texts:
        assert S._joined(S.base_spans(t or "")) == ",".join(brute_base(t or ""))


def test_viterbi_and_likelihood_match_enumeration():
    rng = np.random.default_rng(3)
    turn = S.ALLOWED + rng.normal(0, 1, (3, 3)) * (S.ALLOWED == 0)
    weights = rng.normal(0, 1, (50, 3))
    features = rng.integers(0, 50, (6, 4, 3))
    lengths = np.array([1, 2, 3, 4, 4, 2])
    tags = np.array([[0, 0, 0, 0], [1, 2, 0, 0], [0, 1, 0, 0], [1, 2, 0, 1], [1, 1, 2, 2], [0, 0, 0, 0]])

    def score(n, path):
        full = [0, *path, 0]
        return sum(weights[features[n, t]].sum(axis=0)[s] for t, s in enumerate(path)) + sum(turn[a, b] for a, b in zip(full, full[1:]))

    def mean():
        return np.mean([score(n, tags[n, :k]) - np.log(sum(np.exp(score(n, p)) for p in itertools.product(range(3), repeat=k))) for n, k in enumerate(lengths)])

    value, grad, turned = S.likelihood(features, tags, lengths, weights, turn)
    assert np.isclose(value, mean())
    for n, k in enumerate(lengths):
        best = max(itertools.product(range(3), repeat=int(k)), key=lambda p: score(n, p))
        assert S.viterbi(weights[features[n, :k]].sum(axis=1).tolist(), turn.tolist()) == list(best)
    for array, own, at in ((weights, grad, (int(features[3, 1, 0]), 1)), (turn, turned, (1, 0)), (turn, turned, (0, 1)), (turn, turned, (1, 2))):
        array[at] += 1e-5
        up = mean()
        array[at] -= 2e-5
        slope = (up - mean()) / 2e-5
        array[at] += 1e-5
        assert np.isclose(slope, own[at], atol=1e-5)


def test_decoding_in_parts_is_viterbi_over_the_whole(spark):
    """Also the emissions by word tables are those of the features."""
    rng = np.random.default_rng(7)
    turn = S.ALLOWED + rng.normal(0, 1, (3, 3)) * (S.ALLOWED == 0)
    own = S.Field((rng.normal(0, 1, (S.DIMENSIONS, 3)) + (0.3, 0, 0)).astype(np.float32), turn)
    words = S.Words(own.weights)
    texts = [(r.text or "")[:2000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    parts = 0
    for t in [*texts, "a", " ", "x1-y2_z3 " * 40]:
        tokens = S.TOKEN.findall(t)
        assert "".join(tokens) == t
        emissions, starts = words.emissions([tokens], [S.file_number(t)])
        assert own.tags(emissions).tolist() == S.viterbi(emissions.tolist(), turn.tolist())
        want = own.weights[S.features(tokens, S.file_number(t))].sum(axis=1)
        got = emissions[starts[0] : starts[0] + len(tokens)]
        assert np.allclose(got[:, :2], want[:, :2], atol=1e-3)
        spaced = np.array([x[:1].isspace() for x in tokens], bool)
        assert np.allclose(got[~spaced, 2], want[~spaced, 2], atol=1e-3) and (got[spaced, 2] < -1e5).all()
        parts += len(own.tags(emissions))
    assert parts > 5000


def _planted(rng, alphabet, n):
    return "".join(rng.choice(list(alphabet), n))


def test_field_finds_kinds_that_it_was_not_taught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    own = S.train(docs.filter("doc_id % 7 <> 0"))
    held = [r.text or "" for r in docs.filter("doc_id % 7 = 0").collect()]
    # the spans of the base patterns, as the field tags them by itself
    words, right, whole, wrong = S.Words(own.weights), 0, 0, 0
    for t, spans in zip(held, S.field_spans(held, own, words)):
        secrets, found = S._hot(t, S.base_spans(t)), {(a, b) for a, b, _ in spans}
        whole += len(secrets)
        right += len(set(secrets) & found)
        wrong += sum(not any(a < y and x < b for x, y in secrets) for a, b in found)
    assert whole > 50 and right > 0.9 * whole and wrong < 0.1 * whole, (right, whole, wrong)
    rng = np.random.default_rng(2)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"upper hex": ("0123456789ABCDEF", 40), "base 62": (upper + lower + digits, 32), "letters": (upper + lower, 24), "upper": (upper + digits, 20)}
    clean = [t for t in held if 200 < len(t) < 3000 and not S.base_spans(t)][:100]
    for name, (alphabet, size) in kinds.items():
        hits = 0
        for t in clean:
            key = _planted(rng, alphabet, size)
            at = t.index(" ", len(t) // 2) if " " in t[len(t) // 2 :] else len(t)
            text = t[:at] + f' bearer "{key}"' + t[at:]
            base = S.base_spans(text)
            hits += f"field:{at + 9}:{at + 9 + size}" in S.scan(text, own)[5].split(",") or any(a <= at + 9 + size and at + 9 <= b for a, b, _ in base)
        assert hits > 0.8 * len(clean), (name, hits)
    assert S.scan("on 2024-01-17 we met 192.168.10.21 at john.doe@example.com", own)[5] == ""
    # hidden kinds are not taught
    assert all(not any(tags) for _, tags in S.labelled("x 0123456789abcdef0 y", ("assign",)))


def test_long_texts_take_linear_time():
    import time

    own, times = S.fit([]), []
    for n in (4_000, 16_000):
        text = "\n".join(f"{k:040x}" for k in range(n))
        began = time.process_time()
        assert S.scan(text, own)[2] == n and len(S.labelled(text)) > 1
        times.append(time.process_time() - began)
    assert times[1] < 12 * times[0]


def test_edges(spark, edge_docs, no_docs):
    for field in (S.train(edge_docs), S.fit([])):
        rows = S.scanned(edge_docs, field).collect()
        assert len(rows) == 10 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert S.scanned(no_docs, S.train(no_docs)).count() == 0
    long = "x1" * 200_000 + " " + "1.2-" * 30_000 + " password=hunter2hunter2"
    assert S.scan(long, S.fit([]))[:4] == (1, 0, 0, 0)
