"""Mixes sources to target weights by Pfair scheduling.

Rows of a source are dealt into blocks of equal row count. With weight w, block k of a source is released at floor(k/w)
and due at ceil((k+1)/w); earliest deadline first over the released blocks keeps every source less than one block off
its share at every slot. Weights are taken as the exact fractions they are, without rounding, so this holds for tables of
any length and skew. The driver schedules blocks, not rows, in stretches that it writes out one after the other. When a
source runs out, a new phase begins with the weights of those that are left: every row is placed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import new_path, stored

#: Stands for a null source.
NO_SOURCE = "\u0000"
#: Rows of a block, and slots that the driver holds at once.
BLOCK_ROWS = 16
STRETCH = 200_000
#: Rows that one window sorts, on average, and the most windows of a source.
WINDOW_ROWS = 1024
MOST_WINDOWS = 100_000
#: A window of so many times the average is cut again: rows that repeat an id, or have none, fall into one.
HOT = 16


def whole_weights(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Integers of sum `period` near the weights, by largest remainders, each one at least."""
    total = sum(weights.values())
    exact = {s: w * (period - len(weights)) / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The smallest integers in exactly the ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    divisor = math.gcd(*out.values())
    return {s: w // divisor for s, w in out.items()}


def schedule(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one hyperperiod: earliest deadline first among released blocks, ties by name."""
    return list(islice(slots_of(weights), sum(weights.values())))


def slots_of(weights: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot without end."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        assert deadline > t, "a block missed its deadline"
        yield s
        heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
        t += 1


def dealt(sizes: Mapping[str, int], weights: Mapping[str, float], block_rows: int, period: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, slot, position of the block's first row) of all blocks by slot; a phase ends with a source."""
    left, done, slot, position = {s: -(-n // block_rows) for s, n in sizes.items() if n}, dict.fromkeys(sizes, 0), 0, 0
    while left:
        own = {s: weights[s] for s in left}
        for s in slots_of(exact_weights(own) if period is None else whole_weights(own, max(period, 4 * len(left)))):
            block = done[s]
            yield s, block, slot, position
            done[s] += 1
            slot += 1
            left[s] -= 1
            position += min(block_rows, sizes[s] - block * block_rows)
            if not left[s]:
                del left[s]
                break


def _placed(spark, slots: Iterator[tuple[str, int, int, int]]) -> DataFrame:
    """The blocks' places as a table in the shared folder; the driver holds one stretch at a time."""
    path, kinds = new_path(spark, "mix-slots"), {"from": pa.string(), "block": pa.int64(), "slot": pa.int64(), "start": pa.int64()}
    more = True
    while more:
        some = list(islice(slots, STRETCH))
        more = len(some) == STRETCH
        columns = zip(*some) if some else [()] * 4
        stretch = pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))
        spark.createDataFrame(stretch).write.mode("append").parquet(path)
    return spark.read.schema("from string, block long, slot long, start long").parquet(path)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, alpha: float = 0.5, block_rows: int = BLOCK_ROWS, period: int | None = None, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, block, slot, position (from 0, gapless), then the columns of carry.

    weights maps sources to positive target weights and must name each source of the table (a null source is "\\0");
    without it a source weighs its row count to the power alpha. A period rounds the weights to so many slots, after
    which the schedule repeats; without one they hold exactly. Inside a source the order is a seeded hash of doc_id,
    then doc_id and text; equal rows follow each other, unless one id repeats so often that its rows are cut into pieces
    by a draw. Null ids and texts are ordered first, nothing is dropped, an empty table gives no rows, and other columns
    are ignored.
    """
    if clash := set(carry) & {"doc_id", "source", "block", "slot", "position", "bucket", "piece", "pieces", "draw", "crc", "from", "windows", "nth", "before", "run", "place"}:
        raise ValueError(f"these columns cannot be carried: {sorted(clash)}")
    rows = docs.select("doc_id", "source", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("from"), F.xxhash64("doc_id", F.lit(seed)).alias("draw"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), *carry)
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("from").count().collect()}
    if weights is None:
        weights = {s: n**alpha for s, n in sizes.items()}
    if missing := sorted(s for s in sizes if weights.get(s, 0) <= 0):
        raise ValueError(f"no positive weight for {missing}")
    places = _placed(spark, dealt(sizes, weights, block_rows, period))

    # a source is cut into windows by its own size, so those of a hot one hold no more rows than others
    cuts = {s: min(MOST_WINDOWS, max(1, n // WINDOW_ROWS)) for s, n in sizes.items()}
    windows = spark.createDataFrame(sorted(cuts.items()), "from string, windows int")
    usual = spark.createDataFrame([(s, max(WINDOW_ROWS, sizes[s] // n)) for s, n in sorted(cuts.items())], "from string, usual long")
    rows = rows.join(F.broadcast(windows), "from").withColumn("bucket", F.pmod("draw", "windows")).drop("windows")
    sizes_of = rows.groupBy("from", "bucket").count()
    hot = sizes_of.join(F.broadcast(usual), "from").filter(F.col("count") > F.col("usual") * HOT).select("from", "bucket", F.ceil(F.col("count") / F.col("usual")).alias("pieces"))
    # there is at most one for each HOT times WINDOW_ROWS rows
    hot = spark.createDataFrame(hot.toArrow()) if not hot.isEmpty() else None
    rows = rows.withColumn("piece", F.lit(0).cast("long"))
    if hot is not None:
        drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("pieces", F.lit(1)))
        # written, so that each row draws once
        rows = stored(rows.join(F.broadcast(hot), ["from", "bucket"], "left").withColumn("piece", drawn).drop("pieces"), "mix-drawn")
    key = ["from", "bucket", "piece"]
    counts = rows.groupBy(*key).count()
    before = Window.partitionBy("from").orderBy("bucket", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # each window gets the places of its own run of blocks, so rows are not shuffled again to find theirs
    runs = counts.select(*key, "before", F.explode(F.expr(f"sequence(before div {block_rows}, (before + count - 1) div {block_rows})")).alias("block"))
    runs = runs.join(places, ["from", "block"]).groupBy(*key, "before").agg(F.sort_array(F.collect_list(F.struct("block", "slot", "start"))).alias("run"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id", "crc")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(runs, key)
    rows = rows.withColumn("nth", F.col("before") + F.col("nth") - 1).withColumn("block", F.expr(f"nth div {block_rows}"))
    rows = rows.withColumn("place", F.expr(f"element_at(run, cast(block - before div {block_rows} + 1 as int))"))
    return rows.select("doc_id", "source", "block", "place.slot", (F.col("place.start") + F.pmod("nth", F.lit(block_rows))).alias("position"), *carry)


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The rows and columns of docs in the order of the mix: partitions and rows follow position.

    Nulls, ties and repeated rows are placed as by mix; every row stays, an empty table gives none.
    """
    names = docs.columns
    # the carried row keeps columns of any name apart from those of the mix
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{n}`") for n in names]).alias("whole"))
    # written once, so that range boundaries are drawn without computing the mix again
    placed = stored(mix(rows, weights, carry=("whole",), **options).select("position", "whole"), "mix-rows")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("whole.*")
