"""Review queue, link cascade, archive, and the source's health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.text import blank_to_null, compact_spaces
from tramline.operators.folds import spaced, streaks
from tramline.operators.shared import cut

FINAL = ("confirmed", "replaced", "rejected", "unmatched", "skipped")


def review_state(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, status): the first final status of each item, else pending; nothing changes after a final one."""
    final = F.col("status").isin(*FINAL)
    rank = F.struct(*order)
    done = events.groupBy(key).agg(F.min_by("status", F.when(final, rank)).alias("first"), F.max(final).alias("final"))
    return done.select(key, F.when(F.col("final"), F.col("first")).otherwise("pending").alias("status"))


def link(items: DataFrame, key: str, overrides: DataFrame, manual: DataFrame, external: DataFrame, candidates: DataFrame, rejected: DataFrame, order: list[Column]) -> DataFrame:
    """(key, entry_id, path): stored override, manual choice, external id, then the best candidate that is not rejected.

    overrides, manual and external hold (key, entry_id), an override of null being final too; candidates hold key,
    entry_id, reject_code and what order reads; rejected holds remembered (key, entry_id).
    """
    once = lambda d, n: d.groupBy(key).agg(F.min("entry_id").alias(n), F.lit(True).alias(f"has_{n}"))
    fine = candidates.filter("reject_code IS NULL").join(rejected, [key, "entry_id"], "left_anti")
    best = fine.groupBy(key).agg(F.max_by("entry_id", F.struct(*order)).alias("search"))
    known = external.join(rejected, [key, "entry_id"], "left_anti")
    out = items.select(key).join(once(overrides, "override"), key, "left").join(once(manual, "manual"), key, "left").join(once(known, "external"), key, "left").join(best, key, "left")
    has = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    path = F.when(has("override"), "override").when(has("manual"), "manual").when(has("external"), "external").when(F.col("search").isNotNull(), "search").otherwise("search_unmatched")
    entry = F.when(has("override"), F.col("override")).when(has("manual"), F.col("manual")).when(has("external"), F.col("external")).otherwise(F.col("search"))
    return out.select(key, entry.alias("entry_id"), path.alias("path"))


def migrate_deliveries(losers: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries (user_id, item_id) to add to keepers: those of their losers (item_id, keeper_id) that they lack."""
    moved = deliveries.join(losers, "item_id").select("user_id", F.col("keeper_id").alias("item_id")).distinct()
    return moved.join(deliveries.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def split_archive(items: DataFrame, condition: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(live, archived) items: archived ones carry `archive_reason`."""
    hit = F.coalesce(condition, F.lit(False))
    return items.filter(~hit), items.filter(hit).withColumn("archive_reason", F.lit(reason))


def archive(items: DataFrame, plan: DataFrame, deliveries: DataFrame, snapshot: str, fields: list[str], at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live items, archived items, archived deliveries) after a plan (item_id, reason, merged_into).

    An archived delivery keeps what its audit snapshot (a struct column) says of the item, and what the item says where
    the snapshot is blank. Of several plans for an item the smallest by reason counts; plans for unknown items do nothing.
    """
    once = plan.groupBy("item_id").agg(F.min(F.struct(compact_spaces(F.col("reason")).alias("reason"), "merged_into")).alias("p")).select("item_id", "p.*")
    once = once.withColumn("archive_reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("archive"))).drop("reason")
    live = items.join(once.select("item_id"), "item_id", "left_anti")
    gone = items.join(once, "item_id").withColumn("archived_at", at)
    own = gone.select("item_id", "archive_reason", "merged_into", "archived_at", *[F.col(f).alias(f"item_{f}") for f in fields])
    said = [F.coalesce(blank_to_null(F.col(f"{snapshot}.{f}")), F.col(f"item_{f}")).alias(f) for f in fields]
    sent = deliveries.join(own, "item_id").select(*[c for c in deliveries.columns if c not in (snapshot, *fields)], *said, "archive_reason", "merged_into", "archived_at")
    return live, gone, sent


def find_any(wanted: DataFrame, live: DataFrame, archived: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """(item_id, found_id, origin, kept columns) of wanted ids: the live item, else the one that its last archived form was merged into, else that form."""
    last = archived.groupBy("item_id").agg(F.max_by(F.struct("merged_into", *keep), F.struct(*order)).alias("a"))
    now = live.select(F.col("item_id").alias("own"), F.struct(*keep).alias("l"))
    merged = now.select(F.col("own").alias("into"), F.col("l").alias("m"))
    rows = wanted.select("item_id").distinct().join(now, F.col("item_id") == F.col("own"), "left").join(last, "item_id", "left").join(merged, F.col("a.merged_into") == F.col("into"), "left")
    origin = F.when(F.col("own").isNotNull(), "live").when(F.col("into").isNotNull(), "merged").when(F.col("a").isNotNull(), "archived")
    pick = lambda c: F.when(F.col("own").isNotNull(), F.col(f"l.{c}")).when(F.col("into").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    found = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("into").isNotNull(), F.col("into")).otherwise(F.col("item_id"))
    return rows.filter(origin.isNotNull()).select("item_id", found.alias("found_id"), origin.alias("origin"), *[pick(c) for c in keep])


def changed_only(rows: DataFrame, recomputed: dict[str, Column], key: str, unique: list[str]) -> DataFrame:
    """Rows whose recomputed columns differ, with the new values, but for those that would clash on `unique`.

    A row clashes if its new unique columns are held by another row, or are the new ones of a row with a smaller key.
    """
    new = rows.select(key, *[F.col(c).alias(f"old_{c}") for c in recomputed], *[v.alias(c) for c, v in recomputed.items()], *[c for c in unique if c not in recomputed])
    differs = F.lit(False)
    for c in recomputed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    moved = new.filter(differs)
    held = rows.select(F.col(key).alias("held_by"), *unique).join(moved.select(F.col(key).alias("held_by")), "held_by", "left_anti").select(*unique)
    first = F.row_number().over(Window.partitionBy(*unique).orderBy(key))
    return moved.join(held, unique, "left_anti").withColumn("first", first).filter("first = 1").select(key, *recomputed)


def source_health(cycles: DataFrame, threshold: int, repeat_s: int) -> DataFrame:
    """cycles(source long, at long, ok boolean) with `fail_streak`, `alert` and `recovered`.

    A failed cycle alerts once its streak reaches the threshold, but not within repeat_s of the alert before, which may
    lie in an earlier streak; a good cycle after a streak of the threshold or more has recovered. Of cycles at one moment
    the failed come first. No window or task holds a source: see folds.
    """
    rows = cut(streaks(cycles.select("source", "at", "ok").dropna(), "source", "at", "ok"))
    may = rows.filter(~F.col("ok") & (F.col("fail_streak") >= threshold))
    # of cycles at the moment of an alert the first has it
    moments = spaced(may, "source", "at", repeat_s)
    alerts = may.join(moments, ["source", "at"]).groupBy("source", "at", "piece").agg(F.min("nth").alias("nth")).drop("at").withColumn("alert", F.lit(True))
    recovered = F.col("ok") & (F.col("before") >= threshold)
    return rows.join(alerts, ["source", "piece", "nth"], "left").select("source", "at", "ok", "fail_streak", F.coalesce("alert", F.lit(False)).alias("alert"), recovered.alias("recovered"))


def redeem(invites: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """asked(code, user_id, asked_at) with `granted`: the first uses of a code that is known and not expired."""
    place = F.row_number().over(Window.partitionBy("code").orderBy("asked_at", "user_id"))
    rows = asked.withColumn("place", place).join(invites.select("code", "uses_left", "expires_at"), "code", "left")
    fine = (F.col("place") <= F.col("uses_left")) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return rows.withColumn("granted", F.coalesce(fine, F.lit(False))).drop("place", "uses_left", "expires_at")
