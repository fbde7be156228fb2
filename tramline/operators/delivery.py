"""Delivery facts and the gates in front of a delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLAIM_LEASE_S, QUEUE_LEASE_S, COOLDOWN_S = 900, 300, 420


def facts(live: DataFrame, archive: DataFrame, claims: DataFrame) -> DataFrame:
    """Live, archived and actively claimed deliveries as one bag with the column `origin`; missing columns are null."""
    named = [d.withColumn("origin", F.lit(n)) for n, d in (("live", live), ("archive", archive), ("claim", claims))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def active_claims(claims: DataFrame, as_of: Column) -> DataFrame:
    """Sent claims, and those being sent whose lease has not run out."""
    touched = F.coalesce("updated_at", "claimed_at")
    return claims.filter((F.col("status") == "sent") | ((F.col("status") == "sending") & (touched > as_of - CLAIM_LEASE_S)))


def may_receive(as_of: Column, admin: Column | None = None) -> Column:
    """Active users with access that has not expired; administrators always, where a condition names them."""
    own = F.col("is_active") & F.col("access_granted") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return own if admin is None else F.coalesce(admin, F.lit(False)) | own


def not_delivered(candidates: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(delivered.select(*keys), keys, "left_anti")


def outside_cooldown(candidates: DataFrame, delivered: DataFrame, keys: list[str], at: str, seconds: int = COOLDOWN_S) -> DataFrame:
    """Candidates without a delivery of the same keys in the seconds before their time `at`, that moment included.

    Times are cut into buckets as long as the cooldown; a delivery can only bar its own bucket and the next, so the
    range condition becomes an equality join.
    """
    bucket = lambda c: F.floor(c / seconds)
    a = candidates.withColumn("bucket", bucket(F.col(at))).alias("a")
    b = delivered.select(*[F.col(k).alias(f"d_{k}") for k in keys], F.col("delivered_at")).withColumn("d_bucket", F.explode(F.array(bucket(F.col("delivered_at")), bucket(F.col("delivered_at")) + 1))).alias("b")
    on = (F.col("a.bucket") == F.col("b.d_bucket")) & (F.col("b.delivered_at") <= F.col(f"a.{at}")) & (F.col("b.delivered_at") > F.col(f"a.{at}") - seconds)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.d_{k}"))
    return a.join(b, on, "left_anti").drop("bucket")


def latest(facts_: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The last fact of each key by order, ties left to none: order must be unique inside a key."""
    best = facts_.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in keep])


def group_sizes(deliveries: DataFrame, user: str, group: str) -> DataFrame:
    """(user, group, n, as_group): how many deliveries of one user share a group; two or more go out as one message."""
    known = F.col(user).isNotNull() & F.col(group).isNotNull()
    return deliveries.groupBy(user, group).agg(F.count("*").alias("n")).withColumn("as_group", known & (F.col("n") >= 2))


def grouped(deliveries: DataFrame, user: str, group: str) -> DataFrame:
    """deliveries with `as_group`: two or more of one user share a group and go out as one message."""
    sizes = group_sizes(deliveries.filter(F.col(group).isNotNull()), user, group).drop("n")
    return deliveries.join(sizes, [user, group], "left").withColumn("as_group", F.coalesce("as_group", F.lit(False)))


def origin_totals(every: DataFrame) -> DataFrame:
    """(origin, n, users, items, last_at) of facts(): rows, distinct users and items, and the last delivered_at as text.

    Users and items are counted apart, each after its rows are combined, so no task holds every user with every item.
    """
    users = every.groupBy("origin", "user_id").agg(F.count("*").alias("n"), F.max("delivered_at").alias("last"))
    users = users.groupBy("origin").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"), F.max("last").alias("last"))
    items = every.select("origin", "item_id").distinct().groupBy("origin").agg(F.count("item_id").alias("items"))
    return users.join(items, "origin").select("origin", "n", "users", "items", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def sliding_rate(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """events with `recent`: how many of the same key fall into the seconds up to each."""
    own = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds - 1), 0)
    return events.withColumn("recent", F.count(tie).over(own))
