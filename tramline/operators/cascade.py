"""The whole cascade by which an item gets its dictionary entry, with rejections that are remembered.

A reviewer who rejects an item's entry bars that entry for later items of the same title, so what an item gets depends
on what earlier ones got. The choice is made for all rejected items at once and repeated for the titles whose bars it
changed, until none do: every round settles at least one more rejected item of each such title, in order of time. All
other items bar nothing, so they are chosen once, under the bars that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.shared import cut, stored

EXTERNAL, RESOLVER, SEARCH = "external", "resolver", "search"
MOST_YEARS_OFF = 2

_OPTION = ("item_id", "title_key", "at", "kind", "entry_id", "rank")
_STEPS = (SEARCH, EXTERNAL, RESOLVER)


def options(items: DataFrame, entries: DataFrame, external: DataFrame, resolver: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, title_key, at, kind, entry_id, rank) of every entry that an item may get unless it is barred.

    items: item_id, title_key, at, media_type, external_id, year. An entry that entries (entry_id) lacks cannot be looked
    up and is no option. external and resolver hold (item_id, entry_id), resolver also media_type and confidence: only high
    ones count, and only if their media is the item's where that is known. candidates hold item_id, entry_id, media_type,
    year, score, search_score, place and reject_code; rejected ones are no options, nor films over MOST_YEARS_OFF from the
    item's year if it has no external id. Of several external or resolver entries the smallest counts.
    """
    own = items.select("item_id", "title_key", "at", F.col("media_type").alias("own_media"), (F.coalesce("external_id", F.lit("")) != "").alias("has_id"), F.col("year").alias("own_year"))
    known = entries.select("entry_id").distinct()
    once = lambda d: d.groupBy("item_id").agg(F.min("entry_id").alias("entry_id"))
    out = lambda d, kind, rank: d.select("item_id", "title_key", "at", F.lit(kind).alias("kind"), "entry_id", rank.alias("rank"))
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("search_score"), F.lit(0).cast("long").alias("place"))

    named = own.join(once(external.join(known, "entry_id")), "item_id")
    agrees = ~F.coalesce(F.col("own_media").isin("tv", "movie"), F.lit(False)) | (F.col("own_media") == F.coalesce("media_type", F.lit("tv")))
    fine = resolver.filter("confidence = 'high'").join(own.select("item_id", "own_media"), "item_id").filter(agrees)
    resolved = own.join(once(fine.join(known, "entry_id")), "item_id")
    near = (F.col("media_type") != "movie") | F.col("has_id") | F.coalesce(F.abs(F.col("own_year") - F.col("year")) <= MOST_YEARS_OFF, F.lit(True))
    searched = candidates.filter("reject_code IS NULL AND entry_id IS NOT NULL").join(own, "item_id").filter(F.coalesce(near, F.lit(True)))
    rank = F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("search_score", F.lit(0.0)).cast("double").alias("search_score"), (-F.col("place")).cast("long").alias("place"))
    return out(named, EXTERNAL, nothing).unionByName(out(resolved, RESOLVER, nothing)).unionByName(out(searched, SEARCH, rank))


def ordered(choices: DataFrame) -> DataFrame:
    """(item_id, title_key, at, entry_id, n, turn) of options(): an item takes the entry of the greatest turn that is not barred.

    The first turn is the resolver's, or the external entry's where no other one replaces it; the searched entries come
    next, best first. A replaced external entry has no turn: where the resolver's is barred, the item goes on to the
    search. n is the number of options that the row stands for.
    """
    item = ["item_id", "title_key", "at"]
    turn = lambda step, *rank: F.struct(F.lit(_STEPS.index(step)).alias("step"), *rank, (-F.col("entry_id")).alias("smaller"))
    of = lambda kind: F.struct(F.lit(kind).alias("kind"), F.max(F.when(F.col("kind") == kind, F.col("entry_id"))).alias("entry_id"), F.count_if(F.col("kind") == kind).alias("n"))
    first = choices.filter(F.col("kind") != SEARCH).groupBy(*item).agg(of(EXTERNAL).alias("ext"), of(RESOLVER).alias("res"))
    replaced = F.col("res.entry_id").isNotNull() & ~F.coalesce(F.col("ext.entry_id") == F.col("res.entry_id"), F.lit(False))
    first = first.select(*item, F.when(replaced, RESOLVER).otherwise(EXTERNAL).alias("taken"), F.inline(F.array("ext", "res"))).filter("n > 0")
    none = [F.lit(0.0).alias("score"), F.lit(0.0).alias("search_score"), F.lit(0).cast("long").alias("place")]
    first = first.select(*item, "entry_id", "n", F.when(F.col("kind") == F.col("taken"), F.when(F.col("kind") == RESOLVER, turn(RESOLVER, *none)).otherwise(turn(EXTERNAL, *none))).alias("turn"))
    return choices.filter(F.col("kind") == SEARCH).select(*item, "entry_id", F.lit(1).cast("long").alias("n"), turn(SEARCH, "rank.score", "rank.search_score", "rank.place").alias("turn")).unionByName(first)


def chosen(rows: DataFrame, bars: DataFrame, *carry: str) -> DataFrame:
    """(item_id, title_key, at, carried columns, entry_id, path, n_barred) of the items of ordered() under bars (title_key, entry_id, since).

    A bar counts for items after since; an entry has one bar of a title.
    """
    rows = rows.join(bars, ["title_key", "entry_id"], "left").withColumn("barred", F.coalesce(F.col("since") < F.col("at"), F.lit(False)))
    found = rows.groupBy("item_id", "title_key", "at", *carry).agg(F.max(F.when(~F.col("barred"), F.col("turn"))).alias("turn"), F.sum(F.when(F.col("barred"), F.col("n")).otherwise(0)).alias("n_barred"))
    path = F.when(F.col("turn").isNull(), "search_unmatched")
    for n, step in enumerate(_STEPS):
        path = path.when(F.col("turn.step") == n, step)
    return found.select("item_id", "title_key", "at", *carry, (-F.col("turn.smaller")).alias("entry_id"), path.alias("path"), "n_barred")


def _bars(rows: DataFrame, memory: DataFrame, most_rounds: int) -> DataFrame:
    """(title_key, entry_id, since) of memory and of what the rejected items add to it; rows are those of ordered() with rejected_at.

    An item's own bar never counts for itself. A round keeps all bars with what they were before it; those of a title that
    the last round left alone stay, those of the others are found anew over what was remembered.
    """
    least = lambda d: d.groupBy("title_key", "entry_id").agg(*[F.min(n).alias(n) for n in ("remembered", "before", "since")])
    bars = cut(least(memory.select("title_key", "entry_id", F.col("since").alias("remembered"), F.lit(None).cast("long").alias("before"), "since")))
    every, live = rows, bars.withColumn("live", F.lit(True))
    for _ in range(most_rounds):
        now = chosen(rows, live.filter("live").select("title_key", "entry_id", "since"), "rejected_at").filter("entry_id IS NOT NULL")
        new = now.select("title_key", "entry_id", F.greatest("at", "rejected_at").alias("since"))
        last = live.select("title_key", "entry_id", "remembered", F.col("since").alias("before"), F.when(F.col("live"), F.col("remembered")).otherwise(F.col("since")).alias("since"))
        both = cut(least(last.unionByName(new, allowMissingColumns=True)))
        changed = cut(both.filter(~F.col("before").eqNullSafe(F.col("since"))).select("title_key").distinct())
        bars = both.filter("since IS NOT NULL")
        if changed.isEmpty():
            return bars.select("title_key", "entry_id", "since")
        live = bars.join(changed.withColumn("live", F.lit(True)), "title_key", "left").withColumn("live", F.coalesce("live", F.lit(False)))
        rows = every.join(changed, "title_key", "left_semi")
    raise RuntimeError(f"rejections have not settled in {most_rounds} rounds")


def link_all(items: DataFrame, overrides: DataFrame, manual: DataFrame, choices: DataFrame, reviews: DataFrame, memory: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(item_id, entry_id, path, n_barred) for every item: override, manual, external, resolver, search or search_unmatched.

    overrides and manual hold (title_key, entry_id); both are terminal, an entry of null too. choices are those of
    options(); reviews(item_id, rejected_at) tells which items' entries a reviewer rejects, from the moment on; memory
    holds (title_key, entry_id, since) from before. n_barred counts the item's options that were barred.

    Raises if most_rounds do not suffice, which is one more than a title may have rejected items.
    """
    once = lambda d, n: d.groupBy("title_key").agg(F.min("entry_id").alias(n), F.lit(True).alias(f"has_{n}"))
    fixed = items.select("item_id", "title_key").join(once(overrides, "override"), "title_key", "left").join(once(manual, "manual"), "title_key", "left")
    has = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    rejected = reviews.groupBy("item_id").agg(F.min("rejected_at").alias("rejected_at"))
    rows = stored(ordered(choices), "cascade-options")
    decided = overrides.select("title_key").unionByName(manual.select("title_key")).distinct()
    bars = _bars(stored(rows.filter("turn IS NOT NULL").join(rejected, "item_id").join(decided, "title_key", "left_anti"), "cascade-rejected"), memory, most_rounds)
    now = chosen(rows.join(decided, "title_key", "left_anti"), bars)
    out = fixed.join(now.select("item_id", "entry_id", "path", "n_barred"), "item_id", "left")
    path = F.when(has("override"), "override").when(has("manual"), "manual").otherwise(F.coalesce("path", F.lit("search_unmatched")))
    entry = F.when(has("override"), F.col("override")).when(has("manual"), F.col("manual")).otherwise(F.col("entry_id"))
    return out.select("item_id", entry.alias("entry_id"), path.alias("path"), F.coalesce("n_barred", F.lit(0)).alias("n_barred"))
