"""Selections and summaries over items, users and deliveries: reviews, rematches, repairs, listings and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.text import compact_spaces, listed


def _word(c: Column) -> Column:
    return F.lower(compact_spaces(c))


def needs_review(confidence: Column, entry_id: Column, enabled: bool = True) -> Column:
    """Linked items of low confidence, where reviews are switched on."""
    return F.lit(enabled) & (_word(confidence) == "low") & F.coalesce(entry_id != 0, F.lit(False))


# Link paths that only an operator changes.
STICKY_PATHS = ("stored_override", "manual_override", "admin_override")


def needs_relink(entry_id: Column, path: Column, confidence: Column) -> Column:
    """Linked items whose confidence is low or unknown, but for those that an operator has linked."""
    return F.coalesce(entry_id != 0, F.lit(False)) & ~_word(path).isin(*STICKY_PATHS) & _word(confidence).isin("", "low")


def clamped(limit: int | None, default: int, most: int) -> int:
    """A limit as it is used: the default for none or 0, between 1 and most."""
    return max(1, min(int(limit or default), most))


def newest(rows: DataFrame, published: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first; unknown times count as 0 and order breaks ties, largest first."""
    ranked = rows.orderBy(F.desc(F.coalesce(F.col(published), F.lit(0))), *[F.desc(c) for c in order])
    return (ranked.offset(offset) if offset else ranked).limit(limit)


def for_rematch(items: DataFrame, release: str, entry_id: str, published: str, order: list[str], limit: int | None = 50, only_unmatched: bool = True) -> DataFrame:
    """The newest items with a release id, without a link unless all are asked for; 500 at most."""
    rows = items.filter(F.trim(F.coalesce(F.col(release).cast("string"), F.lit(""))) != "")
    rows = rows.filter(F.col(entry_id).isNull()) if only_unmatched else rows
    return newest(rows, published, order, clamped(limit, 50, 500))


def last_of_releases(items: DataFrame, release: Column, published: str, order: list[str], limit: int) -> DataFrame:
    """The newest item of each release, and of these the newest `limit`."""
    rank = F.struct(F.coalesce(F.col(published), F.lit(0)), *[F.col(c) for c in order])
    heads = items.withColumn("release_of", release).groupBy("release_of").agg(F.max_by(F.struct(*items.columns), rank).alias("item"))
    return newest(heads.select("item.*"), published, order, limit)


def matched_last(matches: DataFrame, items: DataFrame, published: str, limit: int) -> DataFrame:
    """(rule_id, item_id, place): the newest items of each rule among its matches (rule_id, item_id).

    The rank is limited, so Spark drops all but the best few of each rule before its shuffle.
    """
    rows = matches.join(items.select("item_id", F.coalesce(F.col(published), F.lit(0)).alias("at")), "item_id")
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("at"), F.desc("item_id")))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("rule_id", "item_id", "place")


def release_users(deliveries: DataFrame, release: str) -> DataFrame:
    """(release, user_id, last_delivered_at, place): users of each release, the last served first, ties to the smaller id."""
    last = deliveries.filter(F.col(release).isNotNull()).groupBy(release, "user_id").agg(F.max("delivered_at").alias("last_delivered_at"))
    place = F.row_number().over(Window.partitionBy(release).orderBy(F.desc("last_delivered_at"), "user_id"))
    return last.withColumn("place", place)


def repair_candidates(gaps: DataFrame, order: list[Column], latest_only: bool = True, with_users_only: bool = True) -> DataFrame:
    """One gap of each release, the first by order; gaps above all known progress and with served users unless all count."""
    rows = gaps.filter("gap_kind = 'latest_gap'") if latest_only else gaps
    rows = rows.filter("delivery_users > 0") if with_users_only else rows
    first = F.row_number().over(Window.partitionBy("release_id").orderBy(*order))
    return rows.filter("release_id IS NOT NULL").withColumn("first", first).filter("first = 1").drop("first")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def cleanup_summary(plan: DataFrame, group: list[str], version: str) -> DataFrame:
    """One row: groups with something to archive, versions and items to archive of a plan of (group, version, archive)."""
    versions = plan.filter("archive").groupBy(*group, version).agg(F.count("*").alias("items"))
    return versions.groupBy(*group).agg(F.count("*").alias("versions"), F.sum("items").alias("items")).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("versions"), F.lit(0)).alias("versions_to_archive"), F.coalesce(F.sum("items"), F.lit(0)).alias("items_to_archive")
    )


def known_countries(items: DataFrame, countries: str, static: list[str]) -> DataFrame:
    """(code): the distinct upper-case codes of a list column and of a static list."""
    spark = items.sparkSession
    own = items.select(F.explode(listed(F.col(countries))).alias("code")).select(F.upper("code").alias("code"))
    return own.unionByName(spark.createDataFrame([(c.upper(),) for c in static], "code string")).distinct()


def skipped_users(decisions: DataFrame, most_named: int = 5) -> DataFrame:
    """(reason, n, named): how many users each reason skipped, and the smallest few of their ids as an array."""
    users = decisions.groupBy("reason", "user_id").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("reason").orderBy("user_id"))
    counts = users.groupBy("reason").agg(F.count("*").alias("n"))
    named = users.withColumn("place", place).filter(F.col("place") <= most_named).groupBy("reason").agg(F.sort_array(F.collect_list("user_id")).alias("named"))
    return counts.join(named, "reason")


# Words of a routing command, with the bucket and countries that they stand for.
ROUTES = {
    "anime": ("anime", ()), "аниме": ("anime", ()), "dorama": ("dorama", ()), "дорама": ("dorama", ()), "дорамы": ("dorama", ()),
    "world": ("regular", ()), "мир": ("regular", ()), "regular": ("regular", ()), "обычное": ("regular", ()),
    "turkey": ("regular", ("TR",)), "turkish": ("regular", ("TR",)), "турция": ("regular", ("TR",)), "tr": ("regular", ("TR",)),
}
BUCKETS = ("", "anime", "dorama", "regular")


def route(word: Column) -> Column:
    """struct(bucket, countries) of a routing word, null if it is none."""
    arms = F.create_map(*[x for w, (b, codes) in ROUTES.items() for x in (F.lit(w), F.struct(F.lit(b).alias("bucket"), F.array(*map(F.lit, codes)).cast("array<string>").alias("countries")))])
    return F.try_element_at(arms, _word(word))


def routed(items: DataFrame, key: str, commands: DataFrame, order: list[str]) -> DataFrame:
    """items with manual_bucket and manual_countries after the last of the commands (key, bucket, countries); an unknown bucket counts as none."""
    last = commands.groupBy(key).agg(F.max_by(F.struct("bucket", "countries"), F.struct(*order)).alias("to"))
    bucket = _word(F.col("to.bucket"))
    out = items.join(last, key, "left").withColumn("manual_bucket", F.when(F.col("to").isNull(), F.col("manual_bucket")).when(bucket.isin(*BUCKETS), bucket).otherwise(""))
    codes = F.array_join(F.transform(listed(F.col("to.countries")), F.upper), ",")
    return out.withColumn("manual_countries", F.when(F.col("to").isNull(), F.col("manual_countries")).otherwise(codes)).drop("to")


def bootstrap(new_items: DataFrame, matches: DataFrame, deliveries: DataFrame, first_run: bool) -> DataFrame:
    """(user_id, item_id) to record as delivered without a message: on the first run all matches of new items that are not yet."""
    rows = matches.join(new_items.select("item_id"), "item_id", "left_semi").select("user_id", "item_id").distinct()
    rows = rows if first_run else rows.limit(0)
    return rows.join(deliveries.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
