"""Links releases to a metadata dictionary: exact and prefix lookup, and ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.text import token_overlap, tokens
from tramline.functions.titles import letter_counts, ratio_bound, similarity
from tramline.operators.shared import cut


def exact_then_prefix(items: DataFrame, entries: DataFrame, title: Column, entry_title: Column, words: int = 4) -> DataFrame:
    """items joined to entries by equal titles, else by their first words; `route` is exact, prefix or none.

    Of several entries the one with the smallest entry_id wins.
    """
    prefix = lambda c: F.array_join(F.slice(F.split(c, " "), 1, words), " ")
    exact = entries.groupBy(entry_title.alias("title_key")).agg(F.min("entry_id").alias("exact_id"))
    starts = entries.filter(F.size(F.split(entry_title, " ")) >= words).groupBy(prefix(entry_title).alias("prefix_key")).agg(F.min("entry_id").alias("prefix_id"))
    out = items.withColumn("title_key", title).withColumn("prefix_key", F.when(F.size(F.split(title, " ")) >= words, prefix(title)))
    out = out.join(exact, "title_key", "left").join(starts, "prefix_key", "left")
    route = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("prefix_id").isNotNull(), "prefix").otherwise("none")
    return out.select(*items.columns, F.coalesce("exact_id", "prefix_id").alias("entry_id"), route.alias("route"))


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, least: float) -> DataFrame:
    """(left_id, right_id, overlap) of pairs whose distinct tokens overlap to at least `least` of the larger set.

    Each side's tokens are made once and stored. A set of n tokens must share one of its first n - ceil(least * n) + 1
    in any order of all tokens; here those come first that the other side lacks, then those that would bring the fewest
    pairs. Only tokens of both sides are listed, so a set that has too few of them to reach the bound asks nothing. The
    first tokens meet in the equality join, and only with sets of a near enough size; the tokens that a pair shares
    there are counted with what each side has left, and only pairs that can still reach the bound fetch their whole
    sets. Ids are unique on each side. The overlap is rounded to three digits before it is compared.
    """
    least_exact = least - 0.0005
    # stored before they are filtered, as a filter on them would make the tokens twice
    a, b = (cut(d.select(F.col(i).alias("id"), tokens(F.col(t)).alias("tokens"))).filter(F.size("tokens") > 0) for d, i, t in ((left, left_id, left_text), (right, right_id, right_text)))
    size = F.size("tokens")
    ends = lambda d: F.broadcast(d.agg(F.min(size).alias("least_n"), F.max(size).alias("most_n")))
    fits = (size >= F.col("least_n") * least_exact) & (size * least_exact <= F.col("most_n"))
    a, b = a.join(ends(b), fits).select("id", "tokens"), b.join(ends(a), fits).select("id", "tokens")
    counted = lambda d, name: d.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias(name))
    often = cut(counted(a, "left_n").join(counted(b, "right_n"), "token").select("token", (F.col("left_n") * F.col("right_n")).alias("count")))

    def heads(d: DataFrame) -> DataFrame:
        rare = d.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(often, "token")
        listed = rare.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("by_rarity"))
        known = F.size("by_rarity")
        listed = listed.withColumn("asked", (known - F.ceil(F.col("n") * least_exact) + 1).cast("int")).filter("asked > 0")
        return listed.select("id", "n", known.alias("known"), F.posexplode(F.slice("by_rarity", 1, F.col("asked"))).alias("place", "t")).select("id", "n", "known", "place", F.col("t.token").alias("token"))

    near = (F.col("token") == F.col("right_token")) & (F.col("right_n") >= F.col("n") * least_exact) & (F.col("n") >= F.col("right_n") * least_exact)
    other = heads(b).select(F.col("token").alias("right_token"), *[F.col(c).alias(f"right_{c}") for c in ("id", "n", "known", "place")])
    # after the last shared token of the join no more than the shorter rest of the two can be shared
    met = heads(a).join(other, near).groupBy("id", "right_id", "n", "right_n", "known", "right_known").agg(F.count("*").alias("shared"), F.max("place").alias("last"), F.max("right_place").alias("right_last"))
    can = F.col("shared") + F.least(F.col("known") - F.col("last"), F.col("right_known") - F.col("right_last")) - 1
    pairs = met.filter(can >= F.greatest("n", "right_n") * least_exact).select("id", "right_id")
    pairs = pairs.join(b.select(F.col("id").alias("right_id"), F.col("tokens").alias("right_tokens")), "right_id").join(a, "id")
    found = pairs.select(F.col("id").alias(left_id), F.col("right_id").alias(right_id), token_overlap(F.col("tokens"), F.col("right_tokens")).alias("overlap"))
    return found.filter(F.col("overlap") >= least)


def top_ranked(candidates: DataFrame, query: str, candidate: str, top: int) -> DataFrame:
    """The best `top` candidates of each query by their similarity and token overlap, ties to the smaller candidate."""
    scored = candidates.withColumn("score", F.round(0.9 * F.col("similarity") + 0.7 * F.col("overlap"), 3))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), candidate))
    return scored.withColumn("place", place).filter(F.col("place") <= top)


def matched(candidates: DataFrame, query: str, candidate: str, query_text: Column, candidate_text: Column, top: int) -> DataFrame:
    """The candidates, with `similarity`, that may be among the best `top` of their query; all others cannot be.

    candidates have `overlap`; texts depend on their ids alone. Letter counts bound each pair's similarity from above.
    The `top` pairs of each query by that bound are matched first, and of the rest only those whose bound reaches the
    least score found there.
    """
    once = candidates.dropDuplicates([query, candidate])
    counts = lambda d, key, text, name: d.select(key, text.alias("text")).dropDuplicates([key]).select(key, letter_counts(F.col("text")).alias(name))
    rows = once.join(counts(once, query, query_text, "_a"), query).join(counts(once, candidate, candidate_text, "_b"), candidate)
    bound = F.least(F.lit(1.0), ratio_bound(F.col("_a"), F.col("_b")) + 0.001)
    rows = cut(rows.withColumn("_most", 0.9 * bound + 0.7 * F.col("overlap") + 0.001).drop("_a", "_b").withColumn("_place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_most"), candidate))))
    # matching is slow and its rows are few, so they are dealt over all partitions instead of a few by their size
    dealt = lambda d: d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = cut(dealt(rows.filter(F.col("_place") <= top)).withColumn("similarity", similarity(query_text, candidate_text)))
    least = first.groupBy(query).agg(F.min(F.round(0.9 * F.col("similarity") + 0.7 * F.col("overlap"), 3)).alias("_least"))
    rest = dealt(rows.filter(F.col("_place") > top).join(least, query).filter(F.col("_most") >= F.col("_least")).drop("_least")).withColumn("similarity", similarity(query_text, candidate_text))
    return first.unionByName(rest).drop("_most", "_place")


def ranked(candidates: DataFrame, query: str, candidate: str, query_text: Column, candidate_text: Column, top: int) -> DataFrame:
    """top_ranked() for texts; an `overlap` that candidates bring is taken as it is, and repeated pairs count once."""
    once = candidates if "overlap" in candidates.columns else candidates.withColumn("overlap", token_overlap(tokens(query_text), tokens(candidate_text)))
    return top_ranked(matched(once, query, candidate, query_text, candidate_text, top), query, candidate, top)


def confidence(exact: Column, sim: Column, overlap: Column, year_gap: Column) -> Column:
    """high, medium or low; an unknown year gap passes the year conditions."""
    near = lambda n: F.coalesce(year_gap <= n, F.lit(True))
    far = F.coalesce(year_gap >= 4, F.lit(False))
    return (
        F.when(exact & near(1), "high")
        .when(exact & near(2), "medium")
        .when((sim >= 0.93) & (overlap >= 0.75) & near(2), "high")
        .when((sim >= 0.86) & (overlap >= 0.52) & near(2), "medium")
        .when(far | (sim < 0.62) | ((sim < 0.76) & (overlap < 0.34)), "low")
        .otherwise("medium")
    )


def evidence(exact: Column, sim: Column, overlap: Column, year_gap: Column) -> Column:
    """What a confidence rests on, in words; an unknown year gap is left out."""
    number = lambda c: F.format_string("%.3f", F.bround(c.cast("double"), 3))
    said = [F.concat(F.lit("exact="), exact.cast("int").cast("string")), F.concat(F.lit("similarity="), number(sim)), F.concat(F.lit("overlap="), number(overlap))]
    return F.concat_ws(", ", *said, F.when(year_gap.isNotNull(), F.concat(F.lit("year_delta="), year_gap.cast("string"))))
