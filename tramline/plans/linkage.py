"""Queries that link items to the dictionary by computed features: families, features, validation and the cascade.

Their oracles compute the same from the raw titles: SQL() holds the expressions that several of them share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import scoring, years
from tramline.operators import cascade, idchains, lineage
from tramline.plans.registered import query
from tramline.plans.views import AS_OF_YEAR

#: Features of the oracle, in the order of their columns.
FLAGS = (
    "exact", "substring", "short", "one_word_query", "long_candidates", "latin", "derivative", "alias_only", "nonfiction", "generic", "truncated", "cjk_exception", "alias_fits", "generic_alias",
    "franchise", "continuation", "revival", "long_running", "soft_total",
)
NUMBERS = ("overlap", "similarity", "common", "main_overlap", "main_similarity", "delta", "season", "seasons", "episodes", "candidate_episodes")


def char_likeness(a: Column, b: Column) -> Column:
    """The greatest share of common characters of two arrays of texts: a likeness that SQL can express as well."""
    letters = lambda t: F.array_distinct(F.split(t, ""))
    like = lambda x, y: F.size(F.array_intersect(letters(x), letters(y))) / F.size(F.array_union(letters(x), letters(y)))
    return F.coalesce(F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: like(x, y))))), F.lit(0.0))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), 'йё', 'ие'), '[^a-zа-я0-9]+', ' ', 'g'))"


def _words(norm: str) -> str:
    every = f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"
    kept = f"list_filter({every}, lambda w: w NOT IN ('the', 'of', 'and', 'a', 'to'))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {every} END"


def _short(clean: str) -> str:
    latin = f"len(regexp_extract_all({clean}, '[A-Za-z][A-Za-z0-9''\\-]*'))"
    return f"(len({_words(_norm(clean))}) <= 2 OR length({clean}) <= 14 OR {latin} <= 2 AND length({clean}) <= 18)"


def _generic(clean: str) -> str:
    return f"(NOT regexp_matches({clean}, '[A-Za-z]') AND regexp_matches({clean}, '[А-Яа-яЁё]') AND len({_words(_norm(clean))}) BETWEEN 1 AND 5)"


def _form(x: str) -> str:
    return f"{{'low': lower({x}), 'norm': {_norm(x)}, 'words': {_words(_norm(x))}, 'raw': list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '')}}"


def _forms(*texts: str) -> str:
    return f"list_transform(list_filter(list_distinct([{', '.join(texts)}]), lambda t: t <> ''), lambda t: {_form('t')})"


def _pairs(a: str, b: str, of: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: {of})))"


def _best(a: str, b: str, of: str) -> str:
    return f"coalesce(list_max({_pairs(a, b, of)}), 0)"


def _some(a: str, b: str, of: str) -> str:
    return f"coalesce(list_bool_or({_pairs(a, b, of)}), FALSE)"


def _one(a: str, of: str) -> str:
    return f"(len(list_filter({a}, lambda p: {of})) > 0)"


_DISTINCT = "list_distinct({0}.words)"
_SHARED = "len(list_intersect(x.words, y.words))"
_OVERLAP = f"CASE WHEN len(x.words) > 0 AND len(y.words) > 0 THEN {_SHARED}::DOUBLE / greatest(len(list_distinct(x.words)), len(list_distinct(y.words))) ELSE 0 END"
_HOLDS = "(x.norm <> '' AND y.norm <> '' AND (contains(x.norm, y.norm) OR contains(y.norm, x.norm))) OR (x.low <> '' AND y.low <> '' AND (contains(x.low, y.low) OR contains(y.low, x.low)))"
_LETTERS = "list_distinct(string_split({0}.norm, ''))"
_LIKE = f"CASE WHEN x.norm = '' OR y.norm = '' THEN 0 ELSE len(list_intersect({_LETTERS.format('x')}, {_LETTERS.format('y')}))::DOUBLE / len(list_distinct(list_concat({_LETTERS.format('x')}, {_LETTERS.format('y')}))) END"
_REST = "trim(regexp_replace(substr(y.low, 1, instr(y.low, x.low) - 1) || substr(y.low, instr(y.low, x.low) + length(x.low)), ' +', ' ', 'g'))"
_DERIVED = f"x.low <> '' AND contains(y.low, x.low) AND regexp_matches(trim({_REST}, ' :-–—'), '(^| )({'|'.join(lineage.DERIVATIVE_ENDS)})$')"

#: The view's cleaned title is what cleaning leaves of its source title, and its queries are clean.
FEATURES_SQL = f"""WITH item AS (
    SELECT i.*, progress <> '' OR media_type = 'tv' AS tv, bucket = 'anime' OR anime_score >= 2 AS anime, {_forms('query', 'cleaned_title')} AS titles, {_forms('cleaned_title')} AS main, {_norm('query')} AS q, {_words(_norm('query'))} AS qw,
        list_filter(string_split({_norm('query')}, ' '), lambda w: w <> '') AS qr, {_forms('spelling')} AS other, list_transform(list_filter(string_split(cleaned_title, ' / '), lambda t: t <> ''), lambda t: {_form('t')}) AS parts,
        {_forms('source_title', 'cleaned_title')} AS sources, {_short('query')} OR {_short('cleaned_title')} AS short, regexp_matches(source_title, '/ *[A-Za-z]') AS latin_original,
        ({_generic('query')} OR {_generic('cleaned_title')}) AS generic_title, {_generic('query')} AS generic_query, {_short('query')} AS short_query,
        CASE WHEN progress LIKE '% сезон%' THEN CAST(substr(progress, 1, 1) AS INT) END AS season, CASE WHEN progress LIKE '% из %' THEN CAST(regexp_extract(progress, 'из ([0-9]+)', 1) AS INT) END AS episodes,
        TRY_CAST(year_text AS INT) AS year FROM {{link_items}} i),
    entry AS (SELECT e.*, {_forms('title', 'original_title')} AS forms, lower(status) IN ('returning series', 'in production', 'planned', 'pilot') AS active, CAST(substr(release_date, 1, 4) AS INT) AS entry_year FROM {{link_entries}} e),
    pair AS (SELECT i.*, e.entry_id, e.media_type AS candidate_media, e.forms, e.active, e.language, e.seasons, e.episodes AS candidate_episodes, e.search_rank, regexp_matches(e.original_title, '[一-鿿]') AS asian, abs(i.year - e.entry_year) AS delta,
        {_some('i.titles', 'e.forms', "x.norm <> '' AND x.norm = y.norm")} AS exact, {_some('i.titles', 'e.forms', _HOLDS)} AS substring, {_best('i.titles', 'e.forms', _OVERLAP)} AS overlap, {_best('i.titles', 'e.forms', _SHARED)} AS common,
        {_best('i.titles', 'e.forms', _LIKE)} AS similarity, {_best('i.main', 'e.forms', _OVERLAP)} AS main_overlap, {_best('i.main', 'e.forms', _LIKE)} AS main_similarity, {_some('i.titles', 'e.forms', _DERIVED)} AS derivative,
        list_min(list_transform(i.titles, lambda t: len(list_distinct(t.raw)))) = 1 AS one_word_query, len(e.forms) > 0 AND NOT {_one('e.forms', 'len(list_distinct(p.raw)) <= 1')} AS long_candidates
        FROM {{link_pairs}} JOIN item i USING (item_id) JOIN entry e USING (entry_id)),
    known AS (SELECT *, tv AND candidate_media = 'tv' AS both_tv, main_overlap >= 0.62 OR main_similarity >= 0.64 AS near, exact OR main_overlap >= 0.72 OR main_similarity >= 0.92 OR substring AS strong,
        season >= 2 AS later, NOT regexp_matches(query, '[A-Za-z]') AS no_latin, {_one('parts', 'p.norm = q')} AS is_part, {_one('forms', 'p.norm = q')} AS equal_title FROM pair)
    SELECT item_id, entry_id, CASE WHEN tv THEN 'tv' ELSE 'movie' END AS query_media, candidate_media, requested_media AS wanted_media, both_tv, exact, substring, short, one_word_query, long_candidates, NOT no_latin AS latin, derivative,
        q <> '' AND {_one('other', 'p.norm = q')} AND NOT {_one('main', 'p.norm = q')} AS alias_only, contains(lower(category_name), 'документ') AS nonfiction, short AND generic_title AND NOT latin_original AS generic,
        len(qr) > 0 AND NOT is_part AND (exact AND equal_title AND NOT {_one('forms', "starts_with(p.norm, q || ' ')")} AND {_one('list_concat(parts, other)', "p.norm <> '' AND p.norm <> q AND len(p.raw) >= len(qr) + 2 AND p.raw[1:len(qr)] = qr AND p.words[1:len(qw)] = qw")}
            OR NOT equal_title AND {_one('forms', 'contains(p.norm, q) AND p.norm <> q')} AND {_one('list_concat(parts, other)', "p.norm <> '' AND p.norm <> q AND len(p.raw) >= len(qr) + 2 AND contains(' ' || p.norm || ' ', ' ' || q || ' ')")}) AS truncated,
        NOT exact AND NOT substring AND q <> '' AND (is_part OR {_one('other', 'p.norm = q')}) AND language = 'ja' AND asian AND len(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9]*')) >= 3 AND coalesce(search_rank, 0) = 0 AND coalesce(delta <= 1, FALSE)
            AND (coalesce(abs(seasons - season) <= 1 AND seasons > 0, FALSE) OR coalesce(candidate_episodes = episodes, FALSE)) AS cjk_exception,
        both_tv AND equal_title AND (delta IS NULL OR delta <= 1) AND (coalesce(seasons = season, TRUE) AND coalesce(abs(candidate_episodes - episodes) <= greatest(2, floor(episodes * 0.2)), TRUE) OR coalesce(seasons >= season, TRUE) AND coalesce(candidate_episodes >= episodes, TRUE)) AS alias_fits,
        generic_query AND len(qw) = 1 AND {_one('other', 'len(list_intersect(qw, p.words)) = len(list_distinct(qw)) AND len(list_distinct(p.words)) > len(list_distinct(qw))')} AS generic_alias,
        both_tv AND anime AND short_query AND len(list_distinct(qw)) BETWEEN 1 AND 2 AND {_one('sources', 'len(list_intersect(qw, p.words)) = len(list_distinct(qw)) AND len(list_distinct(p.words)) > len(list_distinct(qw))')}
            AND alias_name <> '' AND {_norm('alias_name')} <> q AND {_one('forms', f"contains(' ' || p.norm || ' ', ' ' || {_norm('alias_name')} || ' ')")} AS franchise,
        coalesce(later, FALSE) AND coalesce(CASE WHEN seasons IS NULL THEN active AND (anime AND near OR latin_original) AND (near OR substring) WHEN seasons = 1 AND active AND (anime OR latin_original) AND candidate_episodes >= 60 AND (near OR substring) THEN TRUE
            WHEN seasons < 2 THEN FALSE ELSE (strong OR anime AND near) AND seasons + 1 >= season END, FALSE) AS continuation,
        coalesce(exact AND delta <= 1 AND later AND seasons = 1 AND (episodes IS NULL OR coalesce(candidate_episodes, 0) = 0 OR abs(candidate_episodes - episodes) <= greatest(2, floor(episodes * 0.35))) AND (overlap >= 0.72 OR similarity >= 0.92), FALSE) AS revival,
        coalesce(both_tv AND (anime OR latin_original) AND seasons = 1 AND candidate_episodes >= greatest(episodes * 3, 60) AND episodes IS NOT NULL AND (exact OR substring OR near), FALSE) AS long_running,
        both_tv AND (exact OR substring OR overlap >= 0.45 OR similarity >= 0.68 OR main_overlap >= 0.40 OR main_similarity >= 0.68) AND (delta IS NULL OR delta <= 1) AND (anime OR active) AS soft_total,
        overlap, similarity, common, main_overlap, main_similarity, delta, season, seasons, episodes, candidate_episodes FROM known"""


def linked(get) -> DataFrame:
    """The pairs of the views with all their features."""
    items = get("link_items").withColumn("aliases", F.when(F.col("alias_name") != "", F.array("alias_name")))
    entries = get("link_entries").withColumn("match_title", F.lit("")).withColumn("match_original_title", F.lit(None).cast("string"))
    return lineage.linked(get("link_pairs"), items, entries, AS_OF_YEAR + 30, char_likeness)


_ROUNDED = ("overlap", "similarity", "main_overlap", "main_similarity")


@query("SELECT item_id, entry_id, query_media, candidate_media, " + ", ".join(f"CAST({f} AS INT) AS {f}" for f in FLAGS) + ", " + ", ".join(f"CAST(round(1000000 * {n}) AS BIGINT) AS {n}" if n in _ROUNDED else f"CAST({n} AS INT) AS {n}" for n in NUMBERS) + f" FROM ({FEATURES_SQL})")
def link_features(get):
    numbers = [F.round(F.col(n) * 1000000).cast("long").alias(n) if n in _ROUNDED else F.col(n).cast("int").alias(n) for n in NUMBERS]
    return linked(get).select("item_id", "entry_id", "query_media", "candidate_media", *[F.col(f).cast("int").alias(f) for f in FLAGS], *numbers)


_CODE_SQL = """CASE WHEN query_media = 'tv' AND candidate_media = 'movie' THEN 'SOURCE_TV_CANDIDATE_MOVIE'
    WHEN short AND one_word_query AND NOT exact AND long_candidates AND common <= 1 THEN 'SHORT_COMMON_QUERY_TOKEN_MISMATCH'
    WHEN short AND one_word_query AND NOT exact AND long_candidates AND similarity < 0.985 AND NOT substring THEN 'SHORT_COMMON_QUERY_LOW_SIMILARITY'
    WHEN short AND truncated AND main_overlap < 0.67 AND main_similarity < 0.88 THEN 'TRUNCATED_PREFIX_QUERY_MATCH'
    WHEN NOT exact AND substring AND derivative THEN 'DERIVATIVE_SUFFIX_MISMATCH'
    WHEN latin AND tv AND overlap < 0.18 AND similarity < 0.50 AND common < 2 AND NOT substring AND NOT cjk_exception THEN 'LATIN_TITLE_WEAK_MATCH_TV'
    WHEN latin AND NOT tv AND overlap < 0.28 AND similarity < 0.58 AND common < 2 AND NOT substring THEN 'LATIN_TITLE_WEAK_MATCH'
    WHEN alias_only AND candidate_media <> wanted_media THEN 'ALIAS_ONLY_MEDIA_MISMATCH'
    WHEN alias_only AND NOT alias_fits AND main_overlap < 0.34 AND main_similarity < 0.58 THEN 'ALIAS_ONLY_WEAK_MAIN_TITLE'
    WHEN alias_only AND nonfiction AND main_overlap < 0.60 THEN 'ALIAS_ONLY_NONFICTION_WEAK_MATCH'
    WHEN alias_only AND generic_alias THEN 'ALIAS_ONLY_GENERIC_PARENTHETICAL'
    WHEN tv AND delta >= 35 THEN 'TV_YEAR_DELTA_EXTREME' WHEN tv AND delta >= 20 AND NOT continuation THEN 'TV_YEAR_DELTA_VERY_LARGE'
    WHEN tv AND delta >= 10 AND NOT exact AND NOT franchise AND NOT continuation THEN 'TV_YEAR_DELTA_LARGE_WEAK_TITLE'
    WHEN tv AND delta >= 8 AND overlap < 0.70 AND similarity < 0.84 AND NOT franchise AND NOT continuation THEN 'TV_YEAR_DELTA_MEDIUM_WEAK_TITLE'
    WHEN tv AND coalesce(season, 1) < 2 AND short AND delta >= 3 AND NOT franchise THEN 'TV_SHORT_COMMON_YEAR_DELTA_LARGE'
    WHEN tv AND coalesce(season, 1) < 2 AND short AND delta >= 2 AND NOT exact AND NOT franchise THEN 'TV_SHORT_COMMON_YEAR_DELTA_EXACTNESS'
    WHEN tv AND season >= 2 AND short AND delta >= 6 AND NOT exact AND overlap < 0.85 AND similarity < 0.90 AND NOT franchise AND NOT continuation THEN 'TV_LATER_SEASON_COMMON_YEAR_DELTA'
    WHEN tv AND season >= 2 AND seasons > 0 AND seasons + 1 < season AND NOT revival AND NOT long_running THEN 'TV_SEASON_COUNT_TOO_LOW'
    WHEN tv AND single AND episodes >= 8 AND candidate_episodes > 0 AND abs(candidate_episodes - episodes) >= greatest(4, floor(episodes * 0.60)) AND NOT soft_total THEN 'TV_EPISODE_TOTAL_MISMATCH'
    WHEN tv AND short AND single AND episodes >= 6 AND candidate_episodes > 0 AND abs(candidate_episodes - episodes) >= greatest(4, floor(episodes * 0.75)) AND NOT exact THEN 'TV_EPISODE_TOTAL_MISMATCH_COMMON_QUERY'
    WHEN candidate_media = 'movie' AND generic AND delta >= 5 THEN 'MOVIE_GENERIC_YEAR_DELTA_LARGE'
    WHEN candidate_media = 'movie' AND generic AND delta >= 3 AND overlap < 0.95 AND similarity < 0.98 THEN 'MOVIE_GENERIC_YEAR_DELTA_WEAK_TITLE'
    WHEN candidate_media = 'movie' AND delta >= 6 AND NOT exact AND overlap < 0.72 AND similarity < 0.84 THEN 'MOVIE_YEAR_DELTA_LARGE_WEAK_TITLE'
    WHEN candidate_media = 'movie' AND delta >= 10 AND NOT exact THEN 'MOVIE_YEAR_DELTA_EXTREME_NO_EXACT' WHEN candidate_media = 'movie' AND delta >= 8 AND overlap < 0.60 AND NOT substring THEN 'MOVIE_YEAR_DELTA_WEAK_SUBSTRING'
    WHEN candidate_media = 'movie' AND delta >= 20 THEN 'MOVIE_YEAR_DELTA_ABSURD' WHEN tv AND generic AND delta >= 6 AND NOT continuation THEN 'TV_GENERIC_YEAR_DELTA_LARGE'
    WHEN tv AND generic AND delta >= 4 AND overlap < 0.90 AND similarity < 0.96 AND NOT continuation THEN 'TV_GENERIC_YEAR_DELTA_WEAK_TITLE' END"""
_SINGLE_SQL = "coalesce(season, 1) = 1 AND coalesce(seasons, 1) = 1"
VALIDATION_SQL = f"""SELECT item_id, entry_id, code, warned, main_overlap, similarity, delta FROM (SELECT *, {_CODE_SQL} AS code,
    coalesce(single AND soft_total AND episodes >= 8 AND candidate_episodes > 0 AND abs(candidate_episodes - episodes) >= greatest(4, floor(episodes * 0.60)), FALSE) AS warned
    FROM (SELECT *, both_tv AS tv, {_SINGLE_SQL} AS single FROM ({FEATURES_SQL})))"""


@query(f"SELECT item_id, entry_id, code, CASE WHEN warned THEN 'episode_total_mismatch_soft' ELSE '' END AS warnings FROM ({VALIDATION_SQL})")
def link_validation(get):
    return linked(get).select("item_id", "entry_id", scoring.rejection().alias("code"), F.array_join(scoring.warnings(), ",").alias("warnings"))


_STEM_SQL = r"regexp_replace(norm, ' (?:(?:season|сезон|part|часть) )?(?:[0-9]{1,2}|ii|iii|iv|v|vi|vii|viii|ix|x)$| [0-9]{1,2} (?:season|сезон|part|часть)$', '')"
_MARK_SQL = r"regexp_extract(norm, ' (?:(?:season|сезон|part|часть) )?([0-9]{1,2}|ii|iii|iv|v|vi|vii|viii|ix|x)$', 1)"


@query(f"""WITH t AS (SELECT entry_id, {_norm('title')} AS norm FROM {{family_entries}}),
    s AS (SELECT entry_id, {_STEM_SQL} AS stem, CASE WHEN {_MARK_SQL} <> '' THEN coalesce(TRY_CAST({_MARK_SQL} AS INT), list_position(['ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], {_MARK_SQL}) + 1)
        WHEN regexp_matches(norm, ' [0-9]{{1,2}} (?:season|сезон|part|часть)$') THEN CAST(regexp_extract(norm, ' ([0-9]{{1,2}}) (?:season|сезон|part|часть)$', 1) AS INT) ELSE 1 END AS number FROM t),
    firsts AS (SELECT stem AS head, arg_min(entry_id, number::BIGINT * 1000000000 + entry_id) AS first_id FROM s WHERE stem <> '' GROUP BY stem),
    held AS (SELECT s.entry_id, length(head) AS level, first_id FROM s JOIN firsts ON stem = head OR starts_with(stem, head || ' '))
    SELECT s.entry_id, s.stem, CAST(s.number AS INT) AS number, (SELECT arg_max(first_id, level) FROM held h WHERE h.entry_id = s.entry_id AND first_id <> s.entry_id) AS parent_id,
    coalesce((SELECT arg_min(first_id, level) FROM held h WHERE h.entry_id = s.entry_id), s.entry_id) AS family_id FROM s""")
def title_families(get):
    return lineage.families(get("family_entries"))


#: Items in order of time inside each title; what is barred is a list of (entry, since) that grows along it.
@query("""WITH RECURSIVE external AS (SELECT item_id, item_id % 6 AS entry_id FROM {cascade_items} WHERE item_id % 5 = 0 AND item_id % 6 < 5),
    resolver AS (SELECT item_id, (item_id + 1) % 6 AS entry_id FROM {cascade_items} WHERE item_id % 4 = 1 AND (item_id + 1) % 6 < 5 AND item_id % 8 <> 1 AND (media_type = '' OR media_type = CASE WHEN item_id % 3 = 0 THEN 'movie' ELSE 'tv' END)),
    found AS (SELECT c.item_id, list(c.entry_id ORDER BY c.score DESC, c.search_score DESC, c.place) AS entries FROM {cascade_candidates} c JOIN {cascade_items} i USING (item_id)
        WHERE c.reject_code IS NULL AND (c.media_type <> 'movie' OR i.external_id <> '' OR coalesce(abs(i.year - c.year) <= 2, TRUE)) GROUP BY c.item_id),
    ordered AS (SELECT i.item_id, i.title_key, i.happened, external.entry_id AS ext, resolver.entry_id AS res, coalesce(entries, []) AS entries, row_number() OVER (PARTITION BY i.title_key ORDER BY i.happened, i.item_id) AS rn
        FROM {cascade_items} i LEFT JOIN external USING (item_id) LEFT JOIN resolver USING (item_id) LEFT JOIN found USING (item_id)),
    memory AS (SELECT c_custkey AS title_key, CASE WHEN c_custkey % 9 = 0 THEN [{'e': c_custkey % 5, 's': 0}] ELSE []::STRUCT(e BIGINT, s BIGINT)[] END AS bars FROM customer),
    step AS (
        SELECT title_key, 0::BIGINT AS rn, NULL::BIGINT AS item_id, NULL::BIGINT AS entry_id, '' AS path, 0::BIGINT AS n_barred, bars FROM memory
        UNION ALL
        SELECT title_key, rn, item_id, entry_id, path, n_barred, CASE WHEN entry_id IS NOT NULL AND item_id % 3 = 0 THEN list_append(bars, {'e': entry_id, 's': happened + item_id % 4 * 40}) ELSE bars END FROM (
            SELECT *, CASE path WHEN 'resolver' THEN res WHEN 'external' THEN ext WHEN 'search' THEN open[1] END AS entry_id,
                len(list_filter(entries, lambda e: list_contains(barred, e))) + CASE WHEN list_contains(barred, ext) THEN 1 ELSE 0 END + CASE WHEN list_contains(barred, res) THEN 1 ELSE 0 END AS n_barred FROM (
                SELECT *, CASE WHEN res IS NOT NULL AND NOT (ext_ok AND ext = res) AND NOT list_contains(barred, res) THEN 'resolver' WHEN ext_ok AND (res IS NULL OR ext = res) THEN 'external' WHEN len(open) > 0 THEN 'search' ELSE 'search_unmatched' END AS path FROM (
                    SELECT *, ext IS NOT NULL AND NOT list_contains(barred, ext) AS ext_ok, list_filter(entries, lambda e: NOT list_contains(barred, e)) AS open FROM (
                        SELECT o.*, s.bars, list_transform(list_filter(s.bars, lambda b: b.s < o.happened), lambda b: b.e) AS barred FROM step s JOIN ordered o ON s.title_key = o.title_key AND o.rn = s.rn + 1)))))
    SELECT item_id, CASE WHEN title_key % 20 = 0 THEN CASE WHEN title_key % 40 = 0 THEN NULL ELSE title_key % 5 END WHEN title_key % 10 = 1 THEN title_key % 4 ELSE entry_id END AS entry_id,
        CASE WHEN title_key % 20 = 0 THEN 'override' WHEN title_key % 10 = 1 THEN 'manual' ELSE path END AS path, CASE WHEN title_key % 20 = 0 OR title_key % 10 = 1 THEN 0 ELSE n_barred END AS n_barred FROM step WHERE rn > 0""")
def link_cascade(get):
    items = get("cascade_items").withColumnRenamed("happened", "at")
    own, even = F.col("item_id"), lambda c, n: F.col(c) % n
    entries = items.sparkSession.range(5).withColumnRenamed("id", "entry_id")
    external = items.filter(own % 5 == 0).select("item_id", (own % 6).alias("entry_id"))
    resolver = items.filter(own % 4 == 1).select("item_id", ((own + 1) % 6).alias("entry_id"), F.when(own % 3 == 0, "movie").otherwise("tv").alias("media_type"), F.when(own % 8 == 1, "low").otherwise("high").alias("confidence"))
    titles = get("customer").select(F.col("c_custkey").alias("title_key"))
    overrides = titles.filter("title_key % 20 = 0").select("title_key", F.when(even("title_key", 40) != 0, even("title_key", 5)).alias("entry_id"))
    manual = titles.filter("title_key % 10 = 1").select("title_key", even("title_key", 4).alias("entry_id"))
    reviews = items.filter(own % 3 == 0).select("item_id", (F.col("at") + own % 4 * 40).alias("rejected_at"))
    memory = titles.filter("title_key % 9 = 0").select("title_key", even("title_key", 5).alias("entry_id"), F.lit(0).cast("long").alias("since"))
    choices = cascade.options(items, entries, external, resolver, get("cascade_candidates"))
    return cascade.link_all(items, overrides, manual, choices, reviews, memory)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT space_a AS s, id_a AS i, space_b AS t, id_b AS j FROM {id_links} UNION ALL SELECT space_b, id_b, space_a, id_a FROM {id_links})),
    r AS (SELECT DISTINCT s, i, i AS target, 0 AS steps FROM e WHERE s = 'tm' UNION SELECT e.t, e.j, r.target, r.steps + 1 FROM r JOIN e ON e.s = r.s AND e.i = r.i WHERE r.steps < 8),
    near AS (SELECT s, i, min(steps) AS steps FROM r GROUP BY s, i)
    SELECT r.s AS space, r.i AS id, min(r.target) AS target_id, CAST(r.steps AS INT) AS steps, CAST(count(DISTINCT r.target) AS INT) AS n_targets FROM r JOIN near ON near.s = r.s AND near.i = r.i AND near.steps = r.steps GROUP BY r.s, r.i, r.steps""")
def id_chains(get):
    return idchains.chains(get("id_links"), "tm", 8)


@query(f"""WITH p AS (SELECT item_id, entry_id, lower(i.query) = lower(e.title) AS exact, starts_with(lower(e.title), lower(i.query) || ' ') AND len(string_split(i.query, ' ')) >= 2 AS prefix, abs(TRY_CAST(i.year_text AS INT) - CAST(substr(e.release_date, 1, 4) AS INT)) AS gap, e.media_type = 'tv' AS tv,
        e.entry_id % 10 = 0 AS manual, CASE WHEN i.progress LIKE '%% сезон%%' THEN 2 END AS season, e.seasons FROM {{link_pairs}} JOIN {{link_items}} i USING (item_id) JOIN {{link_entries}} e USING (entry_id)),
    s AS (SELECT item_id, entry_id, CASE WHEN exact THEN 100 WHEN prefix THEN 50 ELSE 0 END + CASE gap WHEN 0 THEN 25 WHEN 1 THEN 15 WHEN 2 THEN 5 ELSE 0 END + CASE WHEN tv THEN 3 ELSE 0 END + CASE WHEN manual THEN 1000 ELSE 0 END
        + CASE WHEN season = seasons THEN 60 WHEN season <> seasons THEN -80 WHEN season IS NOT NULL THEN 5 ELSE 0 END AS points FROM p)
    SELECT item_id, arg_min(entry_id, (-points, entry_id)) AS entry_id, CAST(max(points) AS INT) AS points FROM s GROUP BY item_id""".replace("%%", "%"))
def lexicon_best(get):
    items = get("link_items").select("item_id", F.lower("query").alias("q"), "year_text", years.season_hint(F.col("progress")).alias("season"))
    entries = get("link_entries").select("entry_id", F.lower("title").alias("t"), F.substring("release_date", 1, 4).cast("int").alias("year"), "media_type", "seasons")
    rows = get("link_pairs").join(items, "item_id").join(entries, "entry_id")
    prefix = F.startswith("t", F.concat(F.col("q"), F.lit(" "))) & (F.size(F.split("q", " ")) >= 2)
    own = idchains.points(F.col("q") == F.col("t"), prefix, F.abs(F.col("year_text").try_cast("int") - F.col("year")), F.col("media_type") == "tv", F.col("entry_id") % 10 == 0, F.col("season"), F.col("seasons"))
    best = rows.withColumn("points", own).groupBy("item_id").agg(F.max_by(F.struct("entry_id", "points"), F.struct("points", -F.col("entry_id"))).alias("b"))
    return best.select("item_id", "b.entry_id", "b.points")
