import random

from pyspark.sql import functions as F

from tramline.operators import leases

ENTRIES, TAKES, REPORTS = "entry long, due long, gone_at long", "worker string, at long", "entry long, worker string, at long, done boolean"


def _loop(entries, takes, reports):
    """One entry after the other, along the takes in order."""
    out, order = [], sorted({(at, w) for w, at in takes})
    moments = {}
    for at, w in order:
        moments.setdefault(at, w)
    for entry, due, gone in entries:
        ready, fence = due, 0
        while True:
            lease = next(((at, w) for at, w in sorted(moments.items()) if at >= ready and (gone is None or at < gone)), None)
            if lease is None:
                break
            start, worker = lease
            fence += 1
            again = next((at for at in sorted(moments) if at >= start + 300 and (gone is None or at < gone)), None)
            told = sorted((at, not done) for e, w, at, done in reports if e == entry and w == worker and at >= start and (again is None or at < again))
            if told:
                out.append((entry, fence, worker, start, told[0][0], "released" if told[0][1] else "done"))
                if not told[0][1]:
                    break
                ready = max(told[0][0], start + 1)
            elif again is None:
                out.append((entry, fence, worker, start, None, "open"))
                break
            else:
                out.append((entry, fence, worker, start, start + 300, "expired"))
                ready = start + 300
    return sorted(out)


def test_a_log_of_several_workers_replays_to_single_owners(spark):
    rng = random.Random(6)
    entries = [(e, rng.randrange(3000), rng.choice([None, rng.randrange(6000)])) for e in range(40)]
    takes = [(f"w{rng.randrange(3)}", rng.randrange(500, 5000)) for _ in range(60)] + [("w0", 90_000), ("w9", 90_000)]
    reports = [(rng.randrange(40), f"w{rng.randrange(3)}", rng.randrange(7000), rng.random() < 0.5) for _ in range(600)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, leases.replay_leases(make(entries, ENTRIES), make(takes, TAKES), make(reports, REPORTS)).collect()))
    assert got == _loop(entries, takes, reports) and {r[5] for r in got} == {"done", "released", "expired", "open"}
    # at any moment an entry has one owner
    by = {}
    for entry, fence, _, start, end, _ in got:
        by.setdefault(entry, []).append((fence, start, end))
    for spans in by.values():
        assert [f for f, *_ in spans] == list(range(1, len(spans) + 1))
        assert all(a[2] is not None and a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert leases.replay_leases(make([], ENTRIES), make(takes, TAKES), make(reports, REPORTS)).count() == 0
    assert leases.replay_leases(make(entries, ENTRIES), make([], TAKES), make(reports, REPORTS)).count() == 0


def test_alerts_last_long_enough_on_the_grid(spark):
    times = [("a", 0, 299), ("b", 0, 301), ("c", 0, 200), ("c", 190, 400), ("d", 0, 290), ("d", 300, 700), ("e", 0, 290), ("e", 321, 700), ("f", 5, None), ("f", 100, 200), ("g", 31, 59), (None, 0, 900), ("h", None, 900)]
    rows = leases.alerts(spark.createDataFrame(times, "rule string, since long, until long"), "rule", 300)
    got = sorted((r.rule or "", r.pending_at, r.fires_at, r.ended_at) for r in rows.collect())
    assert got == [("", 0, 300, 900), ("b", 0, 300, 330), ("c", 0, 300, 420), ("d", 0, 300, 300 + 420), ("e", 330, 630, 720), ("f", 30, 330, None)]


def test_stalls(spark):
    df = spark.createDataFrame([("a", 0), ("a", 100), ("a", 1200), ("a", 200_000), ("b", 5), ("b", 5), (None, 7)], "rule string, at long")
    got = sorted((r.rule, r.since, r.until) for r in leases.stalls(df, "rule", "at").collect())
    assert got == [("a", 1001, 1200), ("a", 2101, 200_000), ("a", 200_901, None), ("b", 906, None)]
    assert [tuple(r) for r in leases.recent(df.filter("rule = 'b'").distinct(), "rule", "at", 10).collect()] == [("b", 5, 15)]


def test_a_round_looks_up_takes_alone(spark):
    """What follows a take is found with it, and a round joins neither reports nor withdrawals again."""
    takes = spark.createDataFrame([(100, "w", 500), (90_000, "v", None)], "at long, worker string, reclaim long")
    wanted = spark.createDataFrame([(1, 100), (2, 101), (3, 90_001), (4, -5), (5, None)], "entry long, ready long")
    found = leases._next_take(wanted, leases._spans(takes, 300), 300)
    got = {x.entry: x.take and tuple(x.take) for x in found.collect()}
    assert got == {1: (100, "w", 500), 2: (90_000, "v", None), 3: None, 4: (100, "w", 500), 5: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
