"""Audits: observed progress that no version has, and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.operators.folds import greatest_before


def gap_audit(versions: DataFrame, observed: DataFrame, delivered: DataFrame) -> DataFrame:
    """Progress that was observed but is no known version, though a lower one is.

    versions(release_id, progress, created_at), observed(release_id, progress, polled_at) and delivered(release_id,
    delivery_count, delivery_users, last_delivered_at); progress is an orderable key, null ids and progress are left
    out. `gap_kind` is latest_gap above all known progress, else historical_gap.
    """
    known = versions.filter("release_id IS NOT NULL AND progress IS NOT NULL").select("release_id", "progress").distinct()
    seen = observed.filter("release_id IS NOT NULL AND progress IS NOT NULL").groupBy("release_id", "progress").agg(F.max("polled_at").alias("polled_at"))
    # distinct progress of both sides in one window, so a release with many gaps is sorted once and not compared pair by pair
    both = known.withColumn("known", F.lit(True)).join(seen, ["release_id", "progress"], "full")
    own = Window.partitionBy("release_id").orderBy("progress")
    step = F.when(F.col("known"), F.col("progress"))
    both = both.withColumn("highest_below", F.max(step).over(own)).withColumn("current_highest", F.max(step).over(Window.partitionBy("release_id")))
    out = both.filter("known IS NULL AND highest_below IS NOT NULL").join(delivered, "release_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    kind = F.when(F.col("progress") > F.col("current_highest"), "latest_gap").otherwise("historical_gap")
    return out.select("release_id", "progress", kind.alias("gap_kind"), "highest_below", "current_highest", "polled_at", zero("delivery_count"), zero("delivery_users"), "last_delivered_at")


def in_audit_order(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.col("gap_kind") != "latest_gap", F.desc("delivery_users"), F.desc("delivery_count"), F.desc("polled_at"), "release_id", "progress")


def regressions(observed: DataFrame, key: str, progress: str, order: list[str]) -> DataFrame:
    """Observations below the highest progress that their key had before, with it as `highest_before`."""
    return greatest_before(observed, key, progress, order).filter(F.col(progress) < F.col("highest_before"))


def holds(found: DataFrame, key: str, progress: str, order: list[str], matched: DataFrame, open_anomalies: DataFrame) -> DataFrame:
    """regressions() with `held`, `recorded` and `alert`.

    A regression of a key that users are matched to (matched: key) holds the delivery. The first of each (key, old, new)
    is recorded as an anomaly, and alerts, unless open_anomalies (key, old_value, new_value) has it; repeats do neither.
    """
    users = matched.select(key).distinct().withColumn("held", F.lit(True))
    rows = found.join(users, key, "left").withColumn("held", F.coalesce("held", F.lit(False)))
    same = [key, "highest_before", progress]
    known = open_anomalies.select(F.col(key), F.col("old_value").alias("highest_before"), F.col("new_value").alias(progress)).distinct().withColumn("known", F.lit(True))
    first = rows.filter("held").groupBy(*same).agg(F.min(F.struct(*order)).alias("first")).join(known, same, "left").filter("known IS NULL").drop("known")
    rows = rows.join(first, same, "left")
    new = F.col("held") & F.coalesce(F.col("first") == F.struct(*order), F.lit(False))
    return rows.withColumn("recorded", new).withColumn("alert", new).drop("first")
