"""Scores and checks of candidate links, as expressions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_score(f: dict[str, Column]) -> Column:
    """Linear score of a candidate, to three places.

    f: search, similarity, overlap, exact, substring, same_media, same_bucket, anime, candidate_tv, year_delta, season,
    candidate_seasons, alias_only, short.
    """
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    gap = f["year_delta"]
    score = F.coalesce(f["search"], F.lit(0.0)) + 0.90 * f["similarity"] + 0.70 * f["overlap"]
    score = score + yes(f["exact"], 0.55) + yes(f["substring"], 0.18) + yes(f["same_media"], 0.24) + yes(f["same_bucket"], 0.10) + yes(f["anime"] & f["candidate_tv"], 0.08)
    score = score - F.when(gap.isNull(), 0.0).otherwise(F.least(gap, F.lit(12)) * 0.06) + yes(gap <= 1, 0.14) - yes(gap >= 5, 0.16)
    score = score + yes((f["season"] >= 2) & (f["candidate_seasons"] > 0) & (f["candidate_seasons"] + 1 >= f["season"]) & f["candidate_tv"], 0.12)
    return F.round(score - yes(f["alias_only"], 0.10) - yes(f["short"] & ~f["exact"], 0.12), 3)


#: Features that a rejection rule may read. Strings: query_media, candidate_media, wanted_media; booleans: exact, substring,
#: short, one_word_query, long_candidates, latin, cjk_exception, derivative, truncated, alias_only, alias_fits, nonfiction,
#: generic_alias, generic, franchise, continuation, revival, long_running, soft_total; numbers: overlap, similarity, common,
#: main_overlap, main_similarity, delta, season, seasons (wanted, candidate's), episodes, candidate_episodes.
#: operators.lineage.features computes them all.
def rejections(c=F.col) -> list[tuple[str, Column]]:
    """(code, condition) in the order in which the first that holds rejects a candidate; null conditions do not hold."""
    ov, sim, common, delta = c("overlap"), c("similarity"), c("common"), c("delta")
    exact, sub, short, generic = c("exact"), c("substring"), c("short"), c("generic")
    fr, cont = c("franchise"), c("continuation")
    tv, movie = (c("query_media") == "tv") & (c("candidate_media") == "tv"), c("candidate_media") == "movie"
    guarded = short & c("one_word_query") & ~exact & c("long_candidates") & (common <= 1)
    main, main_sim, alias = c("main_overlap"), c("main_similarity"), c("alias_only")
    early, later = F.coalesce(c("season"), F.lit(1)) < 2, c("season") >= 2
    single = (F.coalesce(c("season"), F.lit(1)) == 1) & (F.coalesce(c("seasons"), F.lit(1)) == 1)
    off, wanted = F.when(c("candidate_episodes") > 0, F.abs(c("candidate_episodes") - c("episodes"))), c("episodes")
    seasons = F.when(c("seasons") > 0, c("seasons"))  # a total of 0 is unknown
    # The codes, their order and the thresholds.
    return [
        ("SOURCE_TV_CANDIDATE_MOVIE", (c("query_media") == "tv") & movie),
        ("SHORT_COMMON_QUERY_TOKEN_MISMATCH", guarded),
        ("SHORT_COMMON_QUERY_LOW_SIMILARITY", short & c("one_word_query") & ~exact & c("long_candidates") & (sim < 0.985) & ~sub),
        ("TRUNCATED_PREFIX_QUERY_MATCH", short & c("truncated") & (main < 0.67) & (main_sim < 0.88)),
        ("DERIVATIVE_SUFFIX_MISMATCH", ~exact & sub & c("derivative")),
        ("LATIN_TITLE_WEAK_MATCH_TV", c("latin") & tv & (ov < 0.18) & (sim < 0.50) & (common < 2) & ~sub & ~c("cjk_exception")),
        ("LATIN_TITLE_WEAK_MATCH", c("latin") & ~tv & (ov < 0.28) & (sim < 0.58) & (common < 2) & ~sub),
        ("ALIAS_ONLY_MEDIA_MISMATCH", alias & (c("candidate_media") != c("wanted_media"))),
        ("ALIAS_ONLY_WEAK_MAIN_TITLE", alias & ~c("alias_fits") & (main < 0.34) & (main_sim < 0.58)),
        ("ALIAS_ONLY_NONFICTION_WEAK_MATCH", alias & c("nonfiction") & (main < 0.60)),
        ("ALIAS_ONLY_GENERIC_PARENTHETICAL", alias & c("generic_alias")),
        ("SOURCE_TV_MOVIE_YEAR_MISMATCH", (c("query_media") == "tv") & movie & (delta >= 2)),
        ("TV_YEAR_DELTA_EXTREME", tv & (delta >= 35)),
        ("TV_YEAR_DELTA_VERY_LARGE", tv & (delta >= 20) & ~cont),
        ("TV_YEAR_DELTA_LARGE_WEAK_TITLE", tv & (delta >= 10) & ~exact & ~fr & ~cont),
        ("TV_YEAR_DELTA_MEDIUM_WEAK_TITLE", tv & (delta >= 8) & (ov < 0.70) & (sim < 0.84) & ~fr & ~cont),
        ("TV_SHORT_COMMON_YEAR_DELTA_LARGE", tv & early & short & (delta >= 3) & ~fr),
        ("TV_SHORT_COMMON_YEAR_DELTA_EXACTNESS", tv & early & short & (delta >= 2) & ~exact & ~fr),
        ("TV_LATER_SEASON_COMMON_YEAR_DELTA", tv & later & short & (delta >= 6) & ~exact & (ov < 0.85) & (sim < 0.90) & ~fr & ~cont),
        ("TV_SEASON_COUNT_TOO_LOW", tv & later & (seasons + 1 < c("season")) & ~c("revival") & ~c("long_running")),
        ("TV_SEASON_COUNT_FAR_TOO_LOW_COMMON_QUERY", tv & short & (c("season") >= 3) & (seasons + 2 < c("season")) & ~exact & ~c("revival") & ~c("long_running")),
        ("TV_EPISODE_TOTAL_MISMATCH", tv & single & (wanted >= 8) & (off >= F.greatest(F.lit(4), F.floor(wanted * 0.60))) & ~c("soft_total")),
        ("TV_EPISODE_TOTAL_MISMATCH_COMMON_QUERY", tv & short & single & (wanted >= 6) & (off >= F.greatest(F.lit(4), F.floor(wanted * 0.75))) & ~exact),
        ("MOVIE_GENERIC_YEAR_DELTA_LARGE", movie & generic & (delta >= 5)),
        ("MOVIE_GENERIC_YEAR_DELTA_WEAK_TITLE", movie & generic & (delta >= 3) & (ov < 0.95) & (sim < 0.98)),
        ("MOVIE_YEAR_DELTA_LARGE_WEAK_TITLE", movie & (delta >= 6) & ~exact & (ov < 0.72) & (sim < 0.84)),
        ("MOVIE_YEAR_DELTA_EXTREME_NO_EXACT", movie & (delta >= 10) & ~exact),
        ("MOVIE_YEAR_DELTA_WEAK_SUBSTRING", movie & (delta >= 8) & (ov < 0.60) & ~sub),
        ("MOVIE_YEAR_DELTA_ABSURD", movie & (delta >= 20)),
        ("TV_GENERIC_YEAR_DELTA_LARGE", tv & generic & (delta >= 6) & ~cont),
        ("TV_GENERIC_YEAR_DELTA_WEAK_TITLE", tv & generic & (delta >= 4) & (ov < 0.90) & (sim < 0.96) & ~cont),
    ]


def rejection(c=F.col) -> Column:
    """The first code that rejects a candidate, else null."""
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(code)) for code, condition in rejections(c)])


def warnings(c=F.col) -> Column:
    """What is odd about a candidate that is not rejected for it."""
    far = F.abs(c("candidate_episodes") - c("episodes")) >= F.greatest(F.lit(4), F.floor(c("episodes") * 0.60))
    single = (F.coalesce(c("season"), F.lit(1)) == 1) & (F.coalesce(c("seasons"), F.lit(1)) == 1)
    soft = single & c("soft_total") & (c("episodes") >= 8) & (c("candidate_episodes") > 0) & far
    return F.when(F.coalesce(soft, F.lit(False)), F.array(F.lit("episode_total_mismatch_soft"))).otherwise(F.array().cast("array<string>"))
