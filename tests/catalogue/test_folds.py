import random

from pyspark.sql import functions as F

from tramline.operators import audit, folds, review


def test_a_fold_that_is_no_maximum_combines_its_pieces(spark):
    """Rock, paper, scissors: the last that beats the one before, whatever the size of the pieces."""
    rng = random.Random(8)
    beats = {("p", "r"), ("r", "s"), ("s", "p")}
    rows = [(k, n, rng.choice(["r", "p", "s", None]), f"{k}-{n}") for k in range(6) for n in range(rng.choice([1, 5, 300]))] + [(None, 1, "r", "x"), (None, 2, "p", "y")]
    rng.shuffle(rows)

    def fold(mine):
        best = None
        for row in sorted(mine, key=lambda r: r[1]):
            if best is None or (best[2] is None and row[2] is not None) or (row[2], best[2]) in beats or (row[2] is not None and row[2] == best[2]):
                best = row
        return best

    want = {k: fold([r for r in rows if r[0] == k])[3] for k in {r[0] for r in rows}}
    df = spark.createDataFrame(rows, "k long, n long, v string, name string")
    pair = lambda x, y: F.concat(x, y)
    higher = lambda x, y: (x == y) | pair(x, y).isin("pr", "rs", "sp")
    for bits in (1, 3, 8):
        got = {r.k: r.name for r in folds.last_step(df, "k", "v", ["n"], ["name"], higher, bits).collect()}
        assert got == want
    assert folds.last_step(df.limit(0), "k", "v", ["n"], ["name"], higher).count() == 0


def test_greatest_before(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.choice([None, *range(9)])) for k in range(4) for n in range(40)]
    df = spark.createDataFrame(rows, "k long, n long, v long")
    want = []
    for k, n, v in rows:
        before = [x for a, b, x in rows if a == k and b < n and x is not None]
        want.append((k, n, v, max(before, default=None)))
    for bits in (2, 12):
        got = folds.greatest_before(df, "k", "v", ["n"], bits).select("k", "n", "v", "highest_before").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_spaced_and_health_match_a_loop(spark):
    rng = random.Random(5)
    for repeat in (7, 50, 400):
        cycles = [(s, rng.randrange(1500), rng.random() < 0.3) for s in range(4) for _ in range(rng.choice([1, 30, 250]))]
        cycles += cycles[:20]
        want = []
        for s in range(4):
            streak, last = 0, None
            for _, at, ok in sorted(c for c in cycles if c[0] == s):
                recovered = ok and streak >= 2
                streak = 0 if ok else streak + 1
                alert = not ok and streak >= 2 and (last is None or at - last >= repeat)
                last = at if alert else last
                want.append((s, at, ok, streak, alert, recovered))
        df = spark.createDataFrame(cycles, "source long, at long, ok boolean")
        assert sorted(map(tuple, review.source_health(df, 2, repeat).collect())) == sorted(want)
    assert folds.spaced(df.limit(0), "source", "at", 5).count() == 0


def test_repeated_regressions_alert_once(spark):
    seen = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 3), (1, 4, 4), (2, 1, 5), (2, 2, 3), (3, 1, 5), (3, 2, 4)], "k long, n long, p long")
    matched = spark.createDataFrame([(1,), (3,), (1,)], "k long")
    known = spark.createDataFrame([(3, 5, 4)], "k long, old_value long, new_value long")
    rows = audit.holds(audit.regressions(seen, "k", "p", ["n"]), "k", "p", ["n"], matched, known)
    assert sorted((r.k, r.n, r.held, r.alert) for r in rows.collect()) == [(1, 2, True, True), (1, 3, True, False), (1, 4, True, True), (2, 2, False, False), (3, 2, True, False)]


def test_keys_of_few_rows_are_folded_without_summaries(spark, monkeypatch):
    df = spark.range(400).selectExpr("id % 40 AS k", "id AS n", "nullif(id * 37 % 11, 3) AS v", "id AS name")
    higher = lambda x, y: x >= y
    want = {r.k: r.name for r in folds.last_step(df, "k", "v", ["n"], ["name"], higher, 2).collect()}
    monkeypatch.delattr(folds, "numbered")
    assert {r.k: r.name for r in folds.last_step(df, "k", "v", ["n"], ["name"], higher).collect()} == want
