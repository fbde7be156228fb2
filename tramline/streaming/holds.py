"""Deliveries held in their user's quiet hours and checked again when they end.

A delivery that falls into its user's quiet window waits for the window's end. The profile that holds then decides anew,
so a window that was moved in the meantime holds it further. Everything goes by event time: a profile counts from its
own moment on, and a delivery is decided when the watermark has passed it, so arrival order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window

from tramline.functions.signatures import local_hour, quiet
from tramline.functions.times import quiet_end
from tramline.operators.shared import cut

OUT = "user_id long, event_key string, at long, released_at long, checks int"


def _once(profiles: DataFrame) -> DataFrame:
    """Profiles with `until`, the moment of their user's next; of several at one moment the greatest counts."""
    last = profiles.filter("user_id IS NOT NULL AND at IS NOT NULL").groupBy("user_id", "at").agg(F.max(F.struct(F.col("start_hour"), F.col("end_hour"), F.col("zone"))).alias("p"))
    until = F.lead("at").over(Window.partitionBy("user_id").orderBy("at"))
    return last.select("user_id", F.col("at").alias("since"), until.alias("until"), "p.start_hour", "p.end_hour", F.coalesce(F.nullif(F.trim("p.zone"), F.lit("")), F.lit("UTC")).alias("zone"))


def release(deliveries: DataFrame, profiles: DataFrame, most_checks: int = 1000) -> DataFrame:
    """(user_id, event_key, at, released_at, checks) of deliveries(user_id, event_key, at) under profiles(user_id, at, start_hour, end_hour, zone).

    Times are epoch seconds, hours local ones of the zone; a null hour or equal ones mean never quiet, a blank zone is UTC.
    A user without a profile is never quiet. checks counts how often a delivery was found in a quiet window. Each round
    moves what is held to the end of its window by one join; only what a changed profile still holds goes on.
    """
    spans = cut(_once(profiles))
    now = deliveries.filter("user_id IS NOT NULL AND at IS NOT NULL").select("user_id", "event_key", "at", F.col("at").alias("released_at"), F.lit(0).alias("checks"))
    out = None
    for _ in range(most_checks):
        rows = now.alias("d").join(spans.alias("p"), (F.col("d.user_id") == F.col("p.user_id")) & (F.col("released_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("released_at") < F.col("until"))), "left")
        moment = F.timestamp_seconds("released_at")
        inside = F.coalesce(quiet(local_hour(moment, F.col("zone")), F.col("start_hour"), F.col("end_hour")), F.lit(False))
        end = F.unix_seconds(quiet_end(moment, F.col("start_hour"), F.col("end_hour"), F.col("zone")))
        rows = cut(rows.select("d.user_id", "event_key", "at", F.when(inside, end).otherwise(F.col("released_at")).alias("released_at"), (F.col("checks") + inside.cast("int")).alias("checks"), inside.alias("held")))
        done = rows.filter("NOT held").drop("held")
        out = done if out is None else out.unionByName(done)
        now = rows.filter("held").drop("held")
        if now.isEmpty():
            return out
    raise RuntimeError(f"deliveries are still held after {most_checks} checks")


def window_end(at: int, start: int | None, end: int | None, zone: str | None) -> int:
    """The same for one moment in plain Python: the end of the quiet window around it, or itself."""
    if start is None or end is None or start == end:
        return at
    local = datetime.fromtimestamp(at, timezone.utc).astimezone(ZoneInfo((zone or "").strip() or "UTC"))
    inside = start <= local.hour < end if start < end else local.hour >= start or local.hour < end
    if not inside:
        return at
    day = local + timedelta(days=1) if start > end and local.hour >= start else local
    return int(day.replace(hour=end, minute=0, second=0, microsecond=0).astimezone(timezone.utc).timestamp())


class Holding(StatefulProcessor):
    """State of a user: the profiles that may still count, and the deliveries that wait, each with the moment it waits for."""

    def init(self, handle) -> None:
        self.handle = handle
        self.profiles = handle.getListState("profiles", "at long, start_hour int, end_hour int, zone string")
        self.waiting = handle.getListState("waiting", "event_key string, at long, due long, checks int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the API's names
        profiles, waiting = [], []
        plain = lambda v: None if pd.isna(v) else int(v)
        for frame in rows:
            for row in frame.itertuples(index=False):
                if row.kind == "profile":
                    profiles.append((int(row.at), plain(row.start_hour), plain(row.end_hour), row.zone or ""))
                else:
                    waiting.append((row.event_key, int(row.at), int(row.at), 0))
        if profiles:
            self.profiles.appendList(profiles)
        if waiting:
            self.waiting.appendList(waiting)
            for due in {w[2] for w in waiting}:
                self.handle.registerTimer(due * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        passed = max(now, timerValues.getCurrentWatermarkInMs() // 1000 - 1)
        low = lambda p: (p[0], *((v is not None, v or 0) for v in p[1:3]), p[3])
        profiles = sorted((tuple(p) for p in self.profiles.get()), key=low)
        waiting, out, due_next = [], [], set()
        for event_key, at, due, checks in (tuple(w) for w in self.waiting.get()):
            if due > now:
                waiting.append((event_key, at, due, checks))
                continue
            while due <= passed:  # all that counts up to the watermark is known
                holds = [p for p in profiles if p[0] <= due]
                end = window_end(due, *holds[-1][1:]) if holds else due
                if end == due:
                    out.append((key[0], event_key, at, due, checks))
                    break
                due, checks = end, checks + 1
            else:
                waiting.append((event_key, at, due, checks))
                due_next.add(due)
        for due in due_next:
            self.handle.registerTimer(due * 1000)
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        # what was overtaken before the earliest moment that is still open can no longer count
        since = max((p[0] for p in profiles if p[0] <= now), default=None)
        kept = [p for p in profiles if since is None or p[0] >= since]
        self.profiles.put(kept) if kept else self.profiles.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_key", "at", "released_at", "checks"])

    def close(self) -> None:
        pass


def stream(rows: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """release() over a stream (kind, user_id, event_key, at, start_hour, end_hour, zone) of profiles and deliveries.

    kind is profile or delivery. A delivery goes out when the watermark passes its moment, or the end of its last window.
    Needs the RocksDB state store.
    """
    timed = rows.filter("user_id IS NOT NULL AND at IS NOT NULL").withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", watermark)
    return timed.groupBy("user_id").transformWithStateInPandas(Holding(), OUT, "Append", "EventTime")
