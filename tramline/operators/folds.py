"""Ordered folds over keys of any size: pieces of a history are folded side by side, and their summaries combined.

Rows are sorted once across the cluster and numbered; a piece is a run of rows of a key whose numbers share their upper
bits. No task holds a key: what is folded at once is a piece, or the summaries of PIECE pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tramline.operators.shared import cut

#: Bits of a row's number that count inside a piece, and pieces inside a piece of pieces.
BITS = 8


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `number`, which grows along the given order."""
    return cut(rows.orderBy(*order).withColumn("number", F.monotonically_increasing_id()))


def _along(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of other, which has one row for each of the keys at most; null keys meet as well."""
    named = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = rows.join(named, reduce(lambda a, b: a & b, same), "left")
    return out.drop(*[f"_{k}" for k in keys])


def last_step(rows: DataFrame, key: str, value: str, order: list[str], keep: list[str], higher: Callable[[Column, Column], Column], bits: int = BITS) -> DataFrame:
    """(key, keep): the row at which the fold of a key ends, moving on to each row x for which higher(x, best) holds.

    The first row begins; a row whose value is null is only ever replaced, and a value by no null. higher may be any
    relation of two values, also one that is no order: where null, the best stays. The summary of a piece is what the
    fold would end with for each value that it may come in with, so its size is the number of distinct values of the key.
    A key of no more rows than a piece has is folded as it is.
    """
    kept, orders = F.struct(*[F.col(c) for c in keep]), [f"order_{n}" for n in range(len(order))]
    rows = rows.select(key, F.col(value).alias("value"), *[F.col(c).alias(o) for c, o in zip(order, orders)], kept.alias("kept"))
    long = cut(rows.groupBy(key).count().filter(F.col("count") > 1 << bits).select(key, F.lit(True).alias("long")))
    if long.isEmpty():
        return _whole_fold(rows, key, orders, higher)
    rows = _along(rows, long, key)
    short = _whole_fold(rows.filter("long IS NULL"), key, orders, higher)
    return short.unionByName(_pieces_fold(rows.filter("long").drop("long"), key, orders, higher, bits))


def _whole_fold(rows: DataFrame, key: str, orders: list[str], higher: Callable[[Column, Column], Column]) -> DataFrame:
    """The fold of last_step() for keys of few rows, each in one go."""
    kept_type, value_type = rows.schema["kept"].dataType, rows.schema["value"].dataType
    state = lambda kept, value, begun: F.struct(kept.alias("kept"), value.alias("value"), begun.alias("begun"))

    def step(best: Column, x: Column) -> Column:
        moves = F.when(~best["begun"], True).when(best["value"].isNull(), x["value"].isNotNull()).when(x["value"].isNull(), False).otherwise(F.coalesce(higher(x["value"], best["value"]), F.lit(False)))
        return F.when(moves, state(x["kept"], x["value"], F.lit(True))).otherwise(best)

    own = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*orders, "kept", "value"))).alias("rows"))
    ended = F.aggregate("rows", state(F.lit(None).cast(kept_type), F.lit(None).cast(value_type), F.lit(False)), step)
    return own.select(key, ended["kept"].alias("kept")).select(key, "kept.*")


def _pieces_fold(rows: DataFrame, key: str, orders: list[str], higher: Callable[[Column, Column], Column], bits: int) -> DataFrame:
    """The fold of last_step() for keys of any size, by the summaries of their pieces."""
    rows = numbered(rows, key, *orders, F.col("kept"))
    kept_type, key_type = rows.schema["kept"].dataType, rows.schema[key].dataType
    values = rows.filter("value IS NOT NULL").groupBy(key).agg(F.collect_set("value").alias("values"))
    rows = _along(rows, values, key).withColumn("values", F.coalesce("values", F.array().cast(T.ArrayType(rows.schema["value"].dataType))))
    # -1: no row yet, 0: a row without a value, n: a row with the n-th value
    which = F.when(F.col("value").isNull(), 0).otherwise(F.array_position("values", F.col("value"))).cast("int")
    none = F.lit(None).cast(kept_type)
    state = lambda i, k, changed: F.struct(i.cast("int").alias("i"), k.alias("kept"), changed.alias("changed"))

    def summary(start: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(-1), F.size("values")), start)

    def step(best: Column, x: Column) -> Column:
        get = lambda i: F.try_element_at("values", F.greatest(i, F.lit(1)))
        moves = F.when(best["i"] == -1, True).when(best["i"] == 0, x["i"] > 0).when(x["i"] == 0, False).otherwise(F.coalesce(higher(get(x["i"]), get(best["i"])), F.lit(False)))
        return F.when(moves, state(x["i"], x["kept"], F.lit(True))).otherwise(best)

    def over(best: Column, piece: Column) -> Column:
        then = F.element_at(piece["ends"], best["i"] + 2)
        return F.when(then["changed"], then).otherwise(best)

    pieces = rows.groupBy(key, F.shiftright("number", bits).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("number", which.alias("i"), "kept"))).alias("rows"), F.any_value("values").alias("values"))
    pieces = pieces.select(key, "piece", "values", summary(lambda s: F.aggregate("rows", state(s, none, F.lit(False)), step)).alias("ends"))
    pieces = cut(pieces)
    while pieces.groupBy(key).count().filter("count > 1").limit(1).count():
        groups = pieces.groupBy(key, F.shiftright("piece", bits).alias("piece")).agg(F.sort_array(F.collect_list(F.struct(F.col("piece").alias("number"), "ends"))).alias("pieces"), F.any_value("values").alias("values"))
        pieces = cut(groups.select(key, "piece", "values", summary(lambda s: F.aggregate("pieces", state(s, none, F.lit(False)), over)).alias("ends")))
    ended = F.element_at("ends", 1)["kept"]
    return pieces.select(F.col(key).cast(key_type).alias(key), ended.alias("kept")).select(key, "kept.*")


def greatest_before(rows: DataFrame, key: str, value: str, order: list[str], bits: int = 12) -> DataFrame:
    """rows with `highest_before`, the greatest value of the rows of their key that come before them."""
    rows = numbered(rows, key, *order).withColumn("piece", F.shiftright("number", bits))
    inside = Window.partitionBy(key, "piece").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(key, "piece").agg(F.max(value).alias("most"))
    before = F.max("most").over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select(key, "piece", before.alias("carried"))
    return _along(rows.withColumn("own", F.max(value).over(inside)), carried, key, "piece").withColumn("highest_before", F.greatest("own", "carried")).drop("own", "carried", "piece", "number")


def streaks(cycles: DataFrame, source: str, at: str, ok: str, piece_s: int = 86_400) -> DataFrame:
    """cycles with `nth` (unique with piece), `fail_streak` and `before`, the streak that the cycle before had.

    A piece is piece_s seconds of a source; of cycles at one moment the failed come first. A piece's summary is its
    number of cycles, and the failures after its last good one.
    """
    rows = cycles.withColumn("piece", F.floor(F.col(at) / piece_s))
    own = Window.partitionBy(source, "piece").orderBy(at, ok)
    rows = rows.withColumn("nth", F.row_number().over(own))
    good = F.max(F.when(F.col(ok), F.col("nth"))).over(Window.partitionBy(source, "piece").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("good", good)
    pieces = rows.groupBy(source, "piece").agg(F.count("*").alias("n"), F.max("good").alias("last_good"))
    along = Window.partitionBy(source).orderBy("piece")
    pieces = pieces.withColumn("through", F.sum("n").over(along))
    # failures since the last good cycle of the pieces before
    since = F.max(F.when(F.col("last_good").isNotNull(), F.col("through") - F.col("n") + F.col("last_good"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(source, "piece", (F.col("through") - F.col("n") - F.coalesce(since, F.lit(0))).alias("carried"))
    rows = rows.join(pieces, [source, "piece"])
    rows = rows.withColumn("fail_streak", F.when(F.col("good").isNotNull(), F.col("nth") - F.col("good")).otherwise(F.col("nth") + F.col("carried")).cast("long"))
    before = F.coalesce(F.lag("fail_streak").over(Window.partitionBy(source, "piece").orderBy("nth")), F.col("carried"))
    return rows.withColumn("before", before).drop("good", "carried")


def spaced(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, at) of the events that are taken when each key's first is, and then the first seconds or more after the last.

    An event points to the one that would follow it. Pointers are found inside buckets of that many seconds, of which the
    next or the first one after it holds the target; then the events that are reached from a key's first are marked by
    pointers of twice the length in each round.
    """
    points = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at")).distinct().withColumn("bucket", F.floor(F.col("at") / seconds))
    points = cut(points)
    along = Window.partitionBy("key").orderBy("bucket")
    firsts = points.groupBy("key", "bucket").agg(F.min("at").alias("first_at"))
    next_two = [F.lead(F.struct("bucket", "first_at"), n).over(along).alias(f"then_{n}") for n in (1, 2)]
    later = firsts.select("key", "bucket", *next_two)
    # of the following buckets the first that does not lie before the target's end
    beyond = F.when(F.col("then_1.bucket") > F.col("bucket") + 1, F.col("then_1.first_at")).otherwise(F.col("then_2.first_at"))
    later = later.select("key", "bucket", beyond.alias("beyond"))
    targets = points.select("key", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + seconds).alias("t"), F.col("at").alias("asks"), F.lit(None).cast("long").alias("there"))
    both = targets.unionByName(points.select("key", "bucket", F.col("at").alias("t"), F.lit(None).cast("long").alias("asks"), F.col("at").cast("long").alias("there")))
    following = Window.partitionBy("key", "bucket").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumn("near", F.min("there").over(following)).filter("asks IS NOT NULL").select("key", (F.col("bucket") - 1).alias("bucket"), F.col("asks").alias("at"), "near")
    jumps = near.join(later, ["key", "bucket"]).select("key", "at", F.coalesce("near", "beyond").alias("to")).filter("to IS NOT NULL")
    jumps, taken = cut(jumps), cut(points.groupBy("key").agg(F.min("at").alias("at")))
    while True:
        more = taken.join(jumps, ["key", "at"]).select("key", F.col("to").alias("at"))
        grown = cut(taken.unionByName(more).distinct())
        if grown.count() == taken.count():
            break
        step = jumps.select("key", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps, taken = cut(jumps.join(step, ["key", "to"]).select("key", "at", F.col("then").alias("to"))), grown
    return taken.select(F.col("key").alias(key), F.col("at").alias(at))
