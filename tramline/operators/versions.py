"""Versions of releases: timelines, best version, retention and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import progress
from tramline.operators.folds import last_step


def timeline(versions: DataFrame, keys: list[str], newest: Column, keep: list[str]) -> DataFrame:
    """One row for each key: its newest row's columns `keep` and `version_duplicates`, the rows it stands for."""
    best = versions.groupBy(*keys).agg(F.count("*").alias("version_duplicates"), F.max_by(F.struct(*keep), newest).alias("best"))
    return best.select(*keys, "version_duplicates", *[F.col(f"best.{c}").alias(c) for c in keep])


def retention(versions: DataFrame, group: list[str], signature: str, newest: Column, keep_last: int) -> DataFrame:
    """versions with `version_rank` (1: the version with the newest member) and `archive` for ranks over keep_last.

    A group's versions are ranked after their members are reduced to one row each, so a hot group's window holds its
    versions, not its rows.
    """
    heads = versions.groupBy(*group, signature).agg(F.max(newest).alias("newest"))
    ranked = heads.withColumn("version_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("newest"), signature))).drop("newest")
    return versions.join(ranked, [*group, signature]).withColumn("archive", F.col("version_rank") > keep_last)


def duplicates(versions: DataFrame, keys: list[str], score: Column, order: list[Column], id_col: str) -> DataFrame:
    """(id, keeper_id) of every row that loses to a better one of the same keys; order breaks ties of score, largest first.

    Rows that tie on all of these are told apart by their ids, the largest kept; rows of one id too lose to one of them.
    """
    rank = F.struct(score.alias("s"), *[c.alias(f"o{n}") for n, c in enumerate(order)], F.col(id_col).alias("id"))
    keepers = versions.groupBy(*keys).agg(F.max(rank).alias("top"))
    # rows that are equal in rank and id are combined first: all of them but one lose
    rows = versions.withColumn("own", rank).groupBy(*keys, "own").agg(F.count("*").alias("n"))
    lost = rows.join(keepers, keys).withColumn("lost", F.col("n") - F.when(F.col("own") == F.col("top"), 1).otherwise(0)).filter("lost > 0")
    return lost.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "lost"))).select(F.col("own.id").alias(id_col), F.col("top.id").alias("keeper_id"), *keys)


def best_version(versions: DataFrame, key: str, progress_key: Column, recency: list[Column], keep: list[str]) -> DataFrame:
    """One row for each key: the furthest progress, ties to the newest; the newest row where its progress is unknown.

    This equals a fold over the rows from new to old that prefers further progress when both sides have one.
    """
    newest = F.struct(*[c.alias(f"r{n}") for n, c in enumerate(recency)])
    row = F.struct(*keep)
    best = versions.select(key, row.alias("row"), newest.alias("newest"), progress_key.alias("progress")).groupBy(key).agg(
        F.max_by("row", "newest").alias("last"), F.max_by("progress", "newest").alias("last_progress"), F.max_by("row", F.struct("progress", "newest")).alias("furthest")
    )
    chosen = F.when(F.col("last_progress").isNull(), F.col("last")).otherwise(F.col("furthest"))
    return best.select(key, chosen.alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in keep])


def highest_progress(rows: DataFrame, key: str, parts: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row for each key: the row that a fold in order ends with, moving on to each row of higher or equal progress.

    Comparison of progress is no total order, so this is a fold over a key's sorted rows and not a maximum. A row whose
    progress cannot be compared with the best so far is passed over, unless the best has none. Pieces of a key's history
    are folded apart and combined, see folds.
    """
    return last_step(rows, key, parts, order, keep, lambda x, best: progress.compare(x, best) >= 0)


def quality_score(*weighted: tuple[Column, int]) -> Column:
    """Sum of the weights whose condition holds."""
    out = F.lit(0)
    for condition, weight in weighted:
        out = out + F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0)
    return out


def upsert(stored: DataFrame, batch: DataFrame, key: list[str], newest: Column, clearable: tuple[str, ...] = ()) -> DataFrame:
    """The table after a batch: the batch's newest row of each key, blank fields keeping what was stored.

    Columns of clearable take the new value even if blank. `change` is new, changed, same or untouched.
    """
    columns = [c for c in stored.columns if c not in key]
    fresh = batch.groupBy(*key).agg(F.max_by(F.struct(*columns), newest).alias("new"))
    both = stored.select(*key, F.struct(*columns).alias("old")).join(fresh, key, "full")
    blank = lambda c: F.col(f"new.{c}").isNull() | (F.trim(F.col(f"new.{c}").cast("string")) == "")
    merged = {c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(blank(c) & F.lit(c not in clearable), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in columns}
    same = F.lit(True)
    for c in columns:
        same = same & merged[c].eqNullSafe(F.col(f"old.{c}"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "untouched").when(same, "same").otherwise("changed")
    return both.select(*key, *[v.alias(c) for c, v in merged.items()], change.alias("change"))
