"""Chains of equal ids through several id spaces, and points of dictionary entries found by them or by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.shared import cut


def chains(links: DataFrame, target: str, most_steps: int = 16) -> DataFrame:
    """(space, id, target_id, steps, n_targets) for every id that a chain of links connects to an id of the target space.

    links(space_a, id_a, space_b, id_b) hold in both directions; rows with a null and repeated ones count for nothing
    more. Of several target ids the one of the shortest chain counts, of these the smallest; n_targets tells how many
    were equally near, so more than one marks a conflict. Target ids stand for themselves in 0 steps.

    Each round moves one link on from the ids that the round before reached, by one join; ids once reached stay.
    """
    links = links.dropna(subset=["space_a", "id_a", "space_b", "id_b"])
    there = links.select(F.col("space_a").alias("space"), F.col("id_a").alias("id"), F.col("space_b").alias("to_space"), F.col("id_b").alias("to_id"))
    back = links.select(F.col("space_b").alias("space"), F.col("id_b").alias("id"), F.col("space_a").alias("to_space"), F.col("id_a").alias("to_id"))
    edges = cut(there.unionByName(back).filter("space <> to_space OR id <> to_id").distinct())
    known = edges.filter(F.col("space") == target).select("space", "id").distinct()
    known = cut(known.select("space", "id", F.array("id").alias("targets"), F.lit(0).alias("steps")))
    newest = known
    for step in range(1, most_steps + 1):
        moved = newest.join(edges, ["space", "id"]).select(F.col("to_space").alias("space"), F.col("to_id").alias("id"), F.explode("targets").alias("target"))
        fresh = moved.join(known.select("space", "id"), ["space", "id"], "left_anti").distinct()
        newest = cut(fresh.groupBy("space", "id").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.lit(step).alias("steps")))
        if newest.isEmpty():
            break
        known = cut(known.unionByName(newest))
    return known.select("space", "id", F.element_at("targets", 1).alias("target_id"), "steps", F.size("targets").alias("n_targets"))


def points(exact: Column, prefix: Column, year_gap: Column, tv: Column, manual: Column, season: Column, entry_season: Column) -> Column:
    """Points of a dictionary entry: title, year, media, source, and the season that the title and the entry name.

    An exact title counts before a prefix. A season that the title names counts for an entry of that season and against
    one of another, and a little for an entry that names none.
    """
    # The points.
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    title = F.when(F.coalesce(exact, F.lit(False)), 100).when(F.coalesce(prefix, F.lit(False)), 50).otherwise(0)
    year = F.when(year_gap == 0, 25).when(year_gap == 1, 15).when(year_gap == 2, 5).otherwise(0)
    seasons = F.when(season == entry_season, 60).when(season != entry_season, -80).when(season.isNotNull(), 5).otherwise(0)
    return title + year + yes(tv, 3) + yes(manual, 1000) + seasons
