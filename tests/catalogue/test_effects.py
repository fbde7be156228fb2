import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tramline.streaming import effects, holds, observations

SCHEMA = "event_key string, n int"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_that_is_killed_delivers_every_event_once(spark, tmp_path):
    """The effect is cut off after it has written, once by an end of the query; some rows and one whole run fail."""
    source, ledger, out, cp = (str(tmp_path / n) for n in ("in", "ledger", "out", "cp"))
    state = {"kill": True}

    def effect(rows, number):
        fine = rows.filter((F.col("n") % 5 != 2) | (F.col("tries") > 0))
        # the receiver keeps what a run has sent under the run's number
        fine.withColumn("made_in", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")
        if state["kill"]:
            state["kill"] = False
            raise effects.Interrupted("killed in the middle")
        return fine.select("event_key", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    def go():
        query = effects.deliver(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), ledger, cp, effect, seconds=None)
        query.awaitTermination(120)
        return query

    _write(spark, source, [(f"k{i}", i) for i in range(20)] + [("k3", 99), (None, 1)])
    with pytest.raises(Exception):
        go()
    assert effects.ended_runs(spark, ledger) == []
    go()
    _write(spark, source, [(f"k{i}", i) for i in range(15, 30)])
    go()
    like = spark.createDataFrame([], SCHEMA)
    assert effects.retry(spark, like, ledger, effect) == 1001
    sent = spark.read.parquet(out).groupBy("event_key").agg(F.count("*").alias("times")).collect()
    assert sorted(r.event_key for r in sent) == sorted(f"k{i}" for i in range(30)) and {r.times for r in sent} == {1}
    rows = {r.event_key: r for r in effects.outcomes(spark, like, ledger).collect()}
    assert len(rows) == 30 and {r.status for r in rows.values()} == {"sent"} and rows["k3"].n == 3
    assert rows["k2"].tries == 1 and rows["k2"].run == 1000 and rows["k22"].run == 1001


def test_failing_rows_are_given_up_after_their_tries(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], SCHEMA)

    def effect(rows, number):
        if number == 1000:
            raise ValueError("down")
        return rows.filter("event_key <> 'a'").select("event_key", F.lit(number > 0).alias("ok"), F.lit("no").alias("error"))

    status = lambda: {r.event_key: (r.status, r.tries, r.n) for r in effects.outcomes(spark, batch, folder).collect()}
    effects.run(batch, 0, folder, effect)
    assert status() == {"a": ("open", 0, 1), "b": ("open", 0, 1)}
    effects.run(batch.limit(0), 1000, folder, effect)  # a run that raises loses nothing
    assert status() == {"a": ("open", 1, 1), "b": ("open", 1, 1)}
    effects.run(batch, 2000, folder, effect)  # repeated events are not new
    assert status() == {"a": ("given_up", 2, 1), "b": ("sent", 2, 1)}
    assert effects.retry(spark, batch, folder, effect) == 2001 and status()["a"] == ("given_up", 2, 1)
    effects.run(batch, 2000, folder, effect)  # the same run again, in place
    assert status()["b"] == ("sent", 2, 1)


def test_cycles_lose_no_rows(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    _write(spark, source, [("a", 1), ("b", 2)])

    def cycle(rows, number):
        seen.append(sorted(r.event_key for r in rows.collect()))
        if len(seen) == 1:
            raise ValueError("bad cycle")

    start = lambda: observations.cycles(spark.readStream.schema(SCHEMA).parquet(source), cycle, str(tmp_path / "cp"), str(tmp_path / "ledger"), None)
    query = start()
    query.awaitTermination(60)
    assert query.exception() is None and seen == [["a", "b"]]
    _write(spark, source, [("c", 3)])
    start().awaitTermination(60)
    assert seen == [["a", "b"], ["a", "b", "c"]]


PROFILES = "user_id long, at long, start_hour int, end_hour int, zone string"
DELIVERIES = "user_id long, event_key string, at long"


def _brute(deliveries, profiles):
    out = []
    for user, key, at in deliveries:
        t, checks = at, 0
        while True:
            mine = [p for p in profiles if p[0] == user and p[1] <= t]
            last = max(mine, key=lambda p: (p[1], p[2] is not None, p[2] or 0, p[3] is not None, p[3] or 0, p[4] or ""), default=None)
            end = holds.window_end(t, *last[2:]) if last else t
            if end <= t:
                break
            t, checks = end, checks + 1
        out.append((user, key, at, t, checks))
    return sorted(out)


def _case(seed, n=120):
    rng = random.Random(seed)
    base = int(datetime(2024, 3, 29, tzinfo=timezone.utc).timestamp())  # summer time begins within the days that follow
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "", None]
    hours = [*range(24), None]
    profiles = [(rng.randrange(5), base + rng.randrange(-40, 400_000), rng.choice(hours), rng.choice(hours), rng.choice(zones)) for _ in range(60)]
    return [(rng.randrange(6), f"e{i}", base + rng.randrange(400_000)) for i in range(n)], profiles


def test_holds_match_brute_force(spark):
    for seed in (1, 2):
        deliveries, profiles = _case(seed)
        got = holds.release(spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame(profiles, PROFILES))
        assert sorted(map(tuple, got.collect())) == _brute(deliveries, profiles)
    assert holds.release(spark.createDataFrame([], DELIVERIES), spark.createDataFrame([], PROFILES)).count() == 0


def test_window_ends():
    at = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    assert holds.window_end(at(2024, 1, 1, 23, 30), 22, 7, "UTC") == at(2024, 1, 2, 7)
    assert holds.window_end(at(2024, 1, 1, 3), 22, 7, "") == at(2024, 1, 1, 7)
    assert holds.window_end(at(2024, 1, 1, 7), 22, 7, "UTC") == at(2024, 1, 1, 7) and holds.window_end(5, 3, 3, "UTC") == 5 and holds.window_end(5, None, 3, "UTC") == 5
    assert holds.window_end(at(2024, 3, 31, 0, 30), 1, 8, "Europe/Berlin") == at(2024, 3, 31, 6)  # the clock goes forward meanwhile


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_of_holds_agrees_with_its_batch_twin(spark, tmp_path, rocksdb):
    """A week of events and the profiles of their users, in files out of order, against release()."""
    sf = "/root/testdata/sf0.001"
    from tramline.plans.views import frame

    end = 1704067200 + 7 * 86400
    events = frame(spark, sf, "timed_events").filter(F.col("happened") < end).select("user_id", F.col("event_id").cast("string").alias("event_key"), F.col("happened").alias("at"))
    profiles = frame(spark, sf, "quiet_profiles").withColumnRenamed("since", "at")
    rows = profiles.select(F.lit("profile").alias("kind"), "user_id", F.lit(None).cast("string").alias("event_key"), "at", "start_hour", "end_hour", "zone")
    rows = rows.unionByName(events.withColumn("kind", F.lit("delivery")), allowMissingColumns=True)
    day = F.floor(F.col("at") / 86400)
    days = sorted(r.d for r in rows.select(day.alias("d")).distinct().collect())
    for n, some in enumerate([days[:3], days[3:6], days[6:]]):
        rows.filter(day.isin(some)).orderBy(F.xxhash64("user_id", "at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("profile", -1, None, end + 90 * 86400, None, None, "UTC")], rows.schema)  # moves the watermark to the end
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = holds.stream(source, "40 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    got = sorted(map(tuple, spark.read.schema(holds.OUT).parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, holds.release(events, profiles).collect()))
    assert got == want and max(r[4] for r in want) >= 2 and len(want) > 150
