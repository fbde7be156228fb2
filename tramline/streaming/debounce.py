"""Debounced events: the last payload goes out once a key has been quiet long enough.

The first event of a key sets its deadline to DELAY_S later. Each later event replaces the payload and moves the
deadline to DELAY_S after it, MOST_MOVES times at most. Events that arrive at or after a deadline start a new entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELAY_S, MOST_MOVES = 120, 2


def step(state: tuple[int, int, int] | None, at: int, payload: int) -> tuple[tuple[int, int, int], tuple[int, int] | None]:
    """State (deadline, moves, payload) after an event, and the entry (deadline, payload) that it finds due."""
    if state is None:
        return (at + DELAY_S, 0, payload), None
    deadline, moves, last = state
    if at >= deadline:
        return (at + DELAY_S, 0, payload), (deadline, last)
    if moves < MOST_MOVES:
        return (at + DELAY_S, moves + 1, payload), None
    return (deadline, moves, payload), None


#: Seconds of a piece of a key's history that one window sorts.
PIECE_S = 86_400


def sessions(events: DataFrame) -> DataFrame:
    """events(key, at, payload) with `session`, the time at which their key began after a pause of DELAY_S or more.

    After such a pause every entry is due, so sessions do not depend on each other. Pauses are found inside pieces of
    time and between the ends of pieces, so no window holds a whole key.
    """
    rows = events.select("key", "at", "payload").filter("key IS NOT NULL AND at IS NOT NULL").withColumn("piece", F.floor(F.col("at") / PIECE_S))
    inside = Window.partitionBy("key", "piece").orderBy("at", "payload")
    pieces = Window.partitionBy("key").orderBy("piece")
    ends = rows.groupBy("key", "piece").agg(F.max("at").alias("last")).withColumn("before", F.lag("last").over(pieces)).drop("last")
    rows = rows.join(ends, ["key", "piece"]).withColumn("pause", F.col("at") - F.coalesce(F.lag("at").over(inside), F.col("before")))
    starts = F.when(F.col("pause").isNull() | (F.col("pause") >= DELAY_S), F.col("at"))
    rows = rows.withColumn("own", F.max(starts).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a piece that goes on without a pause takes the last start of the pieces before it
    carried = rows.groupBy("key", "piece").agg(F.max("own").alias("latest"))
    carried = carried.withColumn("carried", F.max("latest").over(pieces.rowsBetween(Window.unboundedPreceding, -1))).drop("latest")
    return rows.join(carried, ["key", "piece"]).select("key", "at", "payload", F.coalesce("own", "carried").alias("session"))


def replay(events: DataFrame) -> DataFrame:
    """(key, due_at, payload) of events(key, at, payload) over the whole history, in order of at and payload.

    Each session is folded in sorted order with a state of three numbers; a key's sessions lie in many tasks.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.key, row.session) != own:
                    if state:
                        out.append((own[0], state[0], state[2]))
                    own, state = (row.key, row.session), None
                state, due = step(state, row.at, row.payload)
                if due:
                    out.append((row.key, *due))
            yield pd.DataFrame(out, columns=["key", "due_at", "payload"])
        if state:
            yield pd.DataFrame([(own[0], state[0], state[2])], columns=["key", "due_at", "payload"])

    rows = sessions(events).repartition("key", "session").sortWithinPartitions("key", "session", "at", "payload")
    return rows.mapInPandas(fold, "key long, due_at long, payload long")


def stream(events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """The same over a stream events(key, at, payload) by event time: entries go out when the watermark passes them."""
    state_type = "deadline long, moves long, payload long"

    def update(key, batches, state):
        now, out = state.get if state.exists else None, []
        rows = sorted((a, p) for pdf in batches for a, p in zip(pdf["at"].tolist(), pdf["payload"].tolist()))
        if state.hasTimedOut and now:
            out.append((key[0], now[0], now[2]))
            now = None
        for at, payload in rows:
            now, due = step(tuple(map(int, now)) if now else None, at, payload)
            if due:
                out.append((key[0], *due))
        if now:
            state.update(now)
            state.setTimeoutTimestamp(max(int(now[0]) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "due_at", "payload"])

    timed = events.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", watermark)
    return timed.groupBy("key").applyInPandasWithState(update, "key long, due_at long, payload long", state_type, "append", "EventTimeTimeout")
