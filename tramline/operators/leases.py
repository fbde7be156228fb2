"""Claims under leases, as a fold over their log, and windowed alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.operators.delivery import CLAIM_LEASE_S
from tramline.operators.folds import greatest_before
from tramline.operators.shared import cut


def claim_states(log: DataFrame, as_of: Column) -> DataFrame:
    """(event_key, status, at) of each key: sent if ever sent, else its last state; `stale` if a sending lease ran out.

    log(event_key, status, at); of states at one moment `failed` yields to `sending` and that to `sent`.
    """
    weight = F.when(F.col("status") == "sent", 2).when(F.col("status") == "sending", 1).otherwise(0)
    rank = F.struct((F.col("status") == "sent").cast("int").alias("sent"), F.col("at").alias("at"), weight.alias("w"))
    last = log.groupBy("event_key").agg(F.max_by(F.struct("status", "at"), rank).alias("s")).select("event_key", "s.status", "s.at")
    return last.withColumn("status", F.when((F.col("status") == "sending") & (F.col("at") <= as_of - CLAIM_LEASE_S), "stale").otherwise(F.col("status")))


def increase(samples: DataFrame, metric: str, at: str, value: str, seconds: int) -> DataFrame:
    """samples with `increase`: how much a counter grew over the seconds up to each sample; a fall is a restart from 0."""
    own = Window.partitionBy(metric).orderBy(at)
    before = F.lag(value).over(own)
    rows = samples.withColumn("step", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))
    return rows.withColumn("increase", F.sum("step").over(own.rangeBetween(-(seconds - 1), 0))).drop("step")


def stalled(finishes: DataFrame, source: str, at: str, as_of: Column, seconds: int = 900) -> DataFrame:
    """(source, last, stalled): whether the last finished cycle lies more than the seconds back."""
    return finishes.groupBy(source).agg(F.max(at).alias("last")).withColumn("stalled", as_of - F.col("last") > seconds)


#: Seconds for which an entry of a queue is leased, and the length of the time buckets in which takes are looked up.
QUEUE_LEASE_S = 300


#: Spans of takes up to this number are broadcast to those who look a take up.
FEW_SPANS = 20_000


def _spans(takes: DataFrame, bucket_s: int) -> tuple[DataFrame, DataFrame]:
    """What _next_take() looks up, made once: (bucket, takes, after) of each time bucket, and (first_bucket, very_first) in one row.

    takes(at, worker) may have more columns, which are found with them.
    """
    more = [c for c in takes.columns if c not in ("at", "worker")]
    buckets = takes.groupBy(F.floor(F.col("at") / bucket_s).alias("bucket")).agg(F.array_sort(F.collect_set(F.struct("at", "worker", *more))).alias("takes"))
    # buckets of takes are as many as time is long; each day of them is one window, the days are another
    day = F.floor(F.col("bucket") * bucket_s / 86_400)
    first = F.element_at("takes", 1)
    rows = buckets.withColumn("day", day)
    days = rows.groupBy("day").agg(F.min(first).alias("day_first"))
    days = days.withColumn("next_day", F.lead("day_first").over(Window.partitionBy(F.lit(0)).orderBy("day")))
    rows = rows.withColumn("after", F.lead(first).over(Window.partitionBy("day").orderBy("bucket"))).join(days.select("day", "next_day"), "day")
    rows = cut(rows.select("bucket", "takes", F.coalesce("after", "next_day").alias("after")))
    # a bucket without takes stands in the last one that has some: each spans up to the next one's start
    spans = rows.withColumn("to", F.coalesce(F.floor(F.col("after.at") / bucket_s) - 1, F.col("bucket")))
    least = cut(rows.orderBy("bucket").limit(1).select(F.col("bucket").alias("first_bucket"), F.element_at("takes", 1).alias("very_first")))
    covered = cut(spans.select(F.explode(F.sequence("bucket", "to")).alias("bucket"), "takes", "after"))
    return F.broadcast(covered) if covered.count() <= FEW_SPANS else covered, least


def _next_take(wanted: DataFrame, spans: tuple[DataFrame, DataFrame], bucket_s: int) -> DataFrame:
    """wanted(ready, ...) with the first take at or after ready as `take`; null where none follows."""
    covered, least = spans
    own = wanted.withColumn("bucket", F.floor(F.col("ready") / bucket_s))
    found = own.join(covered, "bucket", "left").join(F.broadcast(least), F.col("bucket") < F.col("first_bucket"), "left")
    later = F.get(F.filter("takes", lambda t: t["at"] >= F.col("ready")), F.lit(0))
    take = F.when(F.col("very_first").isNotNull(), F.col("very_first")).otherwise(F.coalesce(later, F.col("after")))
    return found.select(*wanted.columns, take.alias("take"))


def replay_leases(entries: DataFrame, takes: DataFrame, reports: DataFrame, lease_s: int = QUEUE_LEASE_S, most_leases: int = 1000) -> DataFrame:
    """(entry, fence, worker, leased_at, ended_at, outcome) of every lease that several workers get on a queue's entries.

    entries(entry, due, gone_at), gone_at null or the moment at which an entry is withdrawn; takes(worker, at): at that moment the worker leases every entry that is due and not under a
    lease; of takes at one moment the smallest worker's counts. reports(entry, worker, at, done): a worker's first report
    on an entry within its lease ends it, with outcome done, or released so that the next take may have it. A lease
    without a report runs out after lease_s and the next take reclaims the entry under the next fencing number; a report
    that comes later but before the reclaim still counts, one after it is fenced off. A lease that nobody reclaims is
    open and has no end.

    Each round gives one more lease to the entries that are not done. Who may reclaim after a take depends on the take alone
    and is looked up once; an entry carries its own reports along, so a round needs no more than the join on time, and no
    task holds the log of a queue or of a worker.
    """
    takes = cut(takes.select("at", "worker").distinct())
    again = _next_take(takes.withColumn("ready", F.col("at") + lease_s), _spans(takes, lease_s), lease_s)
    spans = _spans(again.select("at", "worker", F.col("take.at").alias("reclaim")), lease_s)
    # of reports at one moment done counts
    told = F.struct(F.col("at").alias("told_at"), (~F.col("done")).alias("released"), F.col("worker").alias("by"))
    said = reports.groupBy("entry").agg(F.array_sort(F.collect_set(told)).alias("said"))
    once = entries.filter("entry IS NOT NULL").groupBy("entry").agg(F.min("due").alias("ready"), F.min("gone_at").alias("gone_at"))
    now = cut(once.join(said, "entry", "left").withColumn("fence", F.lit(0)))
    gone, reclaim = F.col("gone_at"), F.col("take.reclaim")
    out = None
    for _ in range(most_leases):
        held = _next_take(now, spans, lease_s).filter(F.col("take").isNotNull() & (gone.isNull() | (F.col("take.at") < gone)))
        held = held.select("entry", "fence", "gone_at", "said", F.col("take.worker").alias("worker"), F.col("take.at").alias("leased_at"), F.when(gone.isNull() | (reclaim < gone), reclaim).alias("reclaimed"))
        until = F.col("reclaimed")
        heard = F.filter("said", lambda x: (x["by"] == F.col("worker")) & (x["told_at"] >= F.col("leased_at")) & (until.isNull() | (x["told_at"] < until)))
        rows = held.withColumn("heard", F.get(heard, F.lit(0)))
        outcome = F.when(F.col("heard").isNull(), F.when(until.isNull(), "open").otherwise("expired")).when(F.col("heard.released"), "released").otherwise("done")
        ended = F.when(F.col("heard").isNotNull(), F.col("heard.told_at")).when(until.isNotNull(), F.col("leased_at") + lease_s)
        rows = rows.select("entry", (F.col("fence") + 1).alias("fence"), "worker", "leased_at", ended.alias("ended_at"), outcome.alias("outcome"), "gone_at", "said")
        # what was told before a lease cannot count for a later one
        goes_on = F.col("outcome").isin("expired", "released")
        rows = cut(rows.withColumn("said", F.when(goes_on, F.filter("said", lambda x: x["told_at"] >= F.col("leased_at")))))
        lease = rows.drop("gone_at", "said")
        out = lease if out is None else out.unionByName(lease)
        # a take gives an entry once, so one that is released at once waits for a later take
        now = rows.filter(goes_on).select("entry", F.greatest("ended_at", F.col("leased_at") + 1).alias("ready"), "gone_at", "said", "fence")
        if now.isEmpty():
            return out
    raise RuntimeError(f"entries are still leased after {most_leases} leases")


def alerts(holds: DataFrame, rule: str, for_s: int, grid_s: int = 30) -> DataFrame:
    """(rule, pending_at, fires_at, ended_at) of holds(rule, since, until), half-open times in which a rule's condition holds.

    Conditions are seen at multiples of grid_s only. Times that touch or overlap on that grid are one island; it fires
    for_s after its first sight if it lasts so long, and ends at the first sight without it. A null until never ends.
    """
    first, last = F.ceil(F.col("since") / grid_s) * grid_s, F.ceil(F.col("until") / grid_s) * grid_s
    far = F.lit(1 << 60)
    seen = holds.filter("since IS NOT NULL").select(F.col(rule), first.cast("long").alias("a"), F.coalesce(last.cast("long"), far).alias("b")).filter("a < b").distinct()
    rows = greatest_before(seen, rule, "b", ["a", "b"])
    begins = F.when(F.col("highest_before").isNull() | (F.col("a") > F.col("highest_before")), F.col("a"))
    rows = greatest_before(rows.select(rule, "a", "b", begins.alias("begins")), rule, "begins", ["a", "b"])
    islands = rows.groupBy(rule, F.coalesce("begins", "highest_before").alias("pending_at")).agg(F.max("b").alias("b"))
    fires = islands.withColumn("fires_at", F.col("pending_at") + F.ceil(F.lit(for_s) / grid_s) * grid_s).filter("fires_at < b")
    return fires.select(rule, "pending_at", F.col("fires_at").cast("long").alias("fires_at"), F.when(F.col("b") < far, F.col("b")).alias("ended_at"))


def stalls(finishes: DataFrame, rule: str, at: str, seconds: int = 900) -> DataFrame:
    """(rule, since, until): when the last of the finishes lies more than the seconds back."""
    along = Window.partitionBy(rule, "piece").orderBy(at)
    rows = finishes.select(rule, at).dropna().distinct().withColumn("piece", F.floor(F.col(at) / 86_400))
    pieces = rows.groupBy(rule, "piece").agg(F.min(at).alias("first")).withColumn("next_first", F.lead("first").over(Window.partitionBy(rule).orderBy("piece"))).drop("first")
    rows = rows.withColumn("then", F.lead(at).over(along)).join(pieces, [rule, "piece"])
    until = F.coalesce("then", "next_first")
    rows = rows.select(rule, (F.col(at) + seconds + 1).alias("since"), until.alias("until"))
    return rows.filter(F.col("until").isNull() | (F.col("since") < F.col("until")))


def recent(events: DataFrame, rule: str, at: str, seconds: int = 900) -> DataFrame:
    """(rule, since, until): when one of the events lies at most the seconds back, as a counter then has grown."""
    return events.select(rule, F.col(at).alias("since"), (F.col(at) + seconds).alias("until")).dropna()


def metrics(spark, database_up: bool, users: DataFrame, rules: DataFrame, health: DataFrame) -> DataFrame:
    """(name, type, value): gauges of the database, users, enabled rules and the source.

    health has one row: fail_streak, last_success_at, last_failed_at and status; a missing one counts as 0 and not ok.
    """
    up = spark.range(1).select(F.lit(1.0 if database_up else 0.0).alias("database_up"))
    n_users, n_rules = users.agg(F.count("*").cast("double").alias("users_total")), rules.filter("is_enabled = 1").agg(F.count("*").cast("double").alias("enabled_rules_total"))
    source = health.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("double").alias(f"source_{c}") for c in ("fail_streak", "last_success_at", "last_failed_at")], F.coalesce(F.max((F.col("status") == "ok").cast("double")), F.lit(0.0)).alias("source_status"))
    out = None
    for one in (up, n_users, n_rules, source):
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit("gauge").alias("type"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
        out = rows if out is None else out.unionAll(rows)
    return out
