"""Domain views over the driver's tables: the same mapping for Spark and for the oracle.

Each text is a SELECT that both engines run; {name} stands for a table or an earlier view.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
#: The moment that all queries take as now, in epoch seconds, and its year.
AS_OF, AS_OF_YEAR = 996_710_400, 2001

#: Letters of one script and those of the other that stand for them in some titles.
LATIN, CYRILLIC = "abcdefghijklmnoprstuvyz", "абцдефгхийклмнопрстувыз"

#: Names of works that items and dictionary entries share.
_EN = "CASE {0} % 6 WHEN 0 THEN 'Red House' WHEN 1 THEN 'Dragon Quest' WHEN 2 THEN 'The Office of Time' WHEN 3 THEN 'Nova' WHEN 4 THEN 'Silent Sea and Sky' ELSE 'Zeta' END"
_RU = "CASE {0} % 6 WHEN 0 THEN 'Красный дом' WHEN 1 THEN 'Поиск дракона' WHEN 2 THEN 'Контора времени' WHEN 3 THEN 'Нова' WHEN 4 THEN '' ELSE 'Зета' END"
_WORK = """SELECT p_partkey, p_size, {en} AS base, concat({en}, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ' 2' WHEN 2 THEN ' Rising' WHEN 3 THEN ' II' ELSE ' Returns Home' END) AS en, {ru} AS ru, {next} AS next_name,
        CASE p_partkey % 7 WHEN 0 THEN 'Zeta Nova' WHEN 1 THEN 'Nova' WHEN 2 THEN 'Новая Зета' WHEN 3 THEN 'Long Way to Zeta' ELSE '' END AS spelling,
        CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '2 сезон: 1-3 серии из 12' ELSE '1-10 серии из 24' END AS progress, p_partkey % 6 <> 4 AND p_partkey % 5 = 0 AS local FROM {{part}}""".format(en=_EN.format("p_partkey"), ru=_RU.format("p_partkey"), next=_EN.format("(p_partkey + 1)"))

VIEWS = {
    "link_items": f"""SELECT p_partkey AS item_id, concat_ws(' / ', nullif(ru, ''), CASE WHEN local THEN NULL WHEN spelling <> '' THEN concat(en, ' (', spelling, ')') ELSE en END, '2001', nullif(progress, ''), CASE WHEN NOT local THEN 'WEBRip (1080p)' END) AS source_title,
        concat_ws(' / ', nullif(ru, ''), CASE WHEN NOT local THEN en END) AS cleaned_title, CASE WHEN local THEN '' ELSE spelling END AS spelling, progress, '' AS description, CASE WHEN p_partkey % 11 = 0 THEN 'Документальное кино' ELSE 'Кино' END AS category_name, CASE WHEN p_size % 4 = 0 THEN 'tv' ELSE 'movie' END AS media_type,
        CASE WHEN p_partkey % 3 = 0 THEN 'anime' ELSE 'regular' END AS bucket, CAST(p_partkey % 5 AS INT) AS anime_score, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(1975 + p_partkey % 50 AS STRING) END AS year_text,
        CASE p_size % 4 WHEN 0 THEN en WHEN 1 THEN base WHEN 2 THEN CASE WHEN spelling <> '' THEN spelling ELSE en END ELSE CASE WHEN ru <> '' THEN ru ELSE base END END AS query,
        CASE WHEN p_partkey % 8 < 5 THEN 'tv' ELSE 'movie' END AS requested_media, CASE WHEN p_partkey % 2 = 0 THEN next_name ELSE '' END AS alias_name FROM ({_WORK})""",
    "link_entries": f"""SELECT s_suppkey AS entry_id, concat({_EN.format("s_suppkey")}, CASE CAST(FLOOR(s_suppkey / 6) AS BIGINT) % 8 WHEN 0 THEN '' WHEN 1 THEN ' 2' WHEN 2 THEN ' Rising' WHEN 3 THEN ': Podcast' WHEN 4 THEN ' - The Recap' WHEN 5 THEN ' Stories' WHEN 6 THEN ' Returns to the Long House' ELSE ' II' END) AS title,
        CASE s_suppkey % 4 WHEN 0 THEN {_RU.format("s_suppkey")} WHEN 1 THEN '赤い家' ELSE '' END AS original_title, CASE WHEN s_suppkey % 4 = 1 THEN 'ja' ELSE 'en' END AS language, CASE WHEN s_suppkey % 3 = 0 THEN 'Returning Series' ELSE 'Ended' END AS status,
        CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE CAST(s_suppkey % 5 AS INT) END AS seasons, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 5 = 1 AND s_suppkey % 4 < 3 THEN 12 ELSE CAST(s_suppkey * 7 % 90 AS INT) END AS episodes, concat(CAST(1975 + s_suppkey % 50 AS STRING), '-03-01') AS release_date,
        CASE WHEN s_suppkey % 10 < 7 THEN 'tv' ELSE 'movie' END AS media_type, CAST(s_suppkey % 3 AS INT) AS search_rank FROM {{supplier}}""",
    "progress_steps": """SELECT l_partkey AS release_id, l_orderkey, l_linenumber, l_suppkey, l_shipdate, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(1 + l_suppkey % 2 AS INT) END AS season, CAST(1 AS INT) AS start_no,
        CAST(1 + l_linenumber + l_suppkey % 5 AS INT) AS end_no, CASE WHEN l_suppkey % 3 = 0 THEN CAST(5 + l_linenumber AS INT) END AS total, NOT (l_returnflag = 'A' AND l_linenumber < 3) AS known FROM {lineitem}""",
    "timed_events": """SELECT event_id, user_id, event_type, value, CAST(1704067200 + (day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS happened FROM {events}""",
    "long_turns": """SELECT conv_id, turn, role, replace(replace(replace(text, '. ', concat('.', chr(10))), ', ', concat(',', chr(10))), 'a ', CASE WHEN turn % 3 = 0 THEN concat('<a & "b">', chr(10)) ELSE 'a ' END) AS text FROM {conversations}""",
    "id_links": """SELECT 'an' AS space_a, p_partkey AS id_a, 'ml' AS space_b, CAST(floor(p_partkey / 2) AS BIGINT) AS id_b FROM {part} WHERE p_partkey % 5 <> 0
        UNION ALL SELECT 'ml' AS space_a, p_partkey AS id_a, 'tv' AS space_b, CAST(floor(p_partkey / 2) AS BIGINT) + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS id_b FROM {part} WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'tm' AS space_a, p_partkey * 2 AS id_a, 'tv' AS space_b, p_partkey AS id_b FROM {part} WHERE p_size % 2 = 0
        UNION ALL SELECT 'an' AS space_a, p_partkey AS id_a, 'tm' AS space_b, p_partkey + 1 AS id_b FROM {part} WHERE p_partkey % 11 = 0
        UNION ALL SELECT 'tv' AS space_a, p_partkey AS id_a, 'tm' AS space_b, p_partkey * 2 + 5 AS id_b FROM {part} WHERE p_size % 10 = 0""",
    "worker_takes": """SELECT DISTINCT CONCAT('w', CAST(user_id % 4 AS STRING)) AS worker, CAST(floor((1704067200 + (day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60) / 600) * 600 + user_id % 4 * 13 AS BIGINT) AS taken FROM {events}""",
    "worker_reports": """SELECT event_id AS entry, CONCAT('w', CAST(w AS STRING)) AS worker, happened + 120 + (event_id * 37 + w * 211) % 4000 AS told, (event_id + w) % 5 < 3 AS done FROM (SELECT event_id, happened, w FROM {timed_events} CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1 AS w UNION ALL SELECT 2 AS w UNION ALL SELECT 3 AS w) v)
        WHERE (event_id * 3 + w) % 7 < 5""",
    "quiet_profiles": """SELECT DISTINCT user_id, CAST(1704067200 + (day(ts) - 1) * 86400 + user_id * 3607 % 86400 AS BIGINT) AS since, CASE WHEN user_id % 10 = 9 AND day(ts) > 9 THEN NULL ELSE CAST((user_id + day(ts) * 5) % 24 AS INT) END AS start_hour,
        CAST((user_id + day(ts) * 5 + 8) % 24 AS INT) AS end_hour, CASE user_id % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Etc/GMT-5' ELSE 'Europe/Moscow' END AS zone FROM {events}""",
    "cascade_items": """SELECT o_orderkey AS item_id, o_custkey AS title_key, CAST(year(o_orderdate) * 372 + month(o_orderdate) * 31 + day(o_orderdate) AS BIGINT) AS happened, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'movie' ELSE 'tv' END AS media_type, CASE WHEN o_orderkey % 6 = 0 THEN 'tt1' ELSE '' END AS external_id,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(1992 + o_orderkey % 7 AS INT) END AS year, o_orderdate FROM {orders}""",
    "cascade_candidates": """SELECT l_orderkey AS item_id, l_suppkey % 5 AS entry_id, CASE WHEN l_linestatus = 'O' THEN 'tv' ELSE 'movie' END AS media_type, CAST(1992 + l_partkey % 8 AS INT) AS year, l_quantity AS score, CAST(l_partkey % 3 AS DOUBLE) AS search_score,
        l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS place, CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'X' END AS reject_code FROM {lineitem}""",
    "link_pairs": "SELECT DISTINCT l_partkey AS item_id, l_suppkey AS entry_id FROM {lineitem}",
    "family_entries": f"""SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 17 = 0 THEN '***' ELSE concat(p_type, ' ', {_EN.format("p_partkey")}, CASE p_size % 9 WHEN 0 THEN '' WHEN 1 THEN ' 2' WHEN 2 THEN ' II' WHEN 3 THEN ' Season 3' WHEN 4 THEN ' Rising' WHEN 5 THEN ' Rising 2'
        WHEN 6 THEN ' Rising: Part 4' WHEN 7 THEN ', часть 5' ELSE ' - 6 сезон' END) END AS title FROM {{part}}""",
    "titles": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(lower(text), '{LATIN}', '{CYRILLIC}') ELSE text END AS text FROM {{documents}}",
    "names": f"""SELECT item_id, text FROM {{benchmark}} UNION ALL SELECT item_id + 100000 AS item_id, translate(lower(text), '{LATIN}', '{CYRILLIC}') AS text FROM {{benchmark}}""",
    "aliases": f"""SELECT s_suppkey AS alias, concat(CASE WHEN s_suppkey % 5 = 0 THEN 'The ' ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN translate(lower(s_name), '{LATIN}', '{CYRILLIC}') ELSE s_name END,
        CASE WHEN s_suppkey % 3 = 0 THEN ' и Café' WHEN s_suppkey % 7 = 0 THEN ' of the Ærø' ELSE '' END) AS name FROM {{supplier}}""",
    "mentions": f"""SELECT DISTINCT concat('Из архива: ', CASE WHEN s_suppkey % 2 = 0 THEN translate(lower(s_name), '{LATIN}', '{CYRILLIC}') ELSE lower(s_name) END,
        CASE l_linenumber % 4 WHEN 0 THEN ' и café' WHEN 1 THEN ', 2 сезон' WHEN 2 THEN 'x' ELSE ' de <b>CAFE</b>' END) AS title FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey
        UNION SELECT DISTINCT substr(s_name, 1, 12 + CAST(s_suppkey % 6 AS INT)) AS title FROM {{supplier}}""",
    "entries": """SELECT p_partkey AS entry_id, concat(p_brand, ' ', p_type, ' ', p_name, CASE WHEN p_partkey % 4 = 0 THEN ' Café' ELSE '' END) AS name FROM {part}""",
    "listings": """SELECT DISTINCT p_partkey AS item_id, l_linenumber % 4 AS kind, CASE l_linenumber % 4 WHEN 0 THEN upper(concat(p_brand, ' / ', p_type, ' - ', p_name)) WHEN 1 THEN concat(p_brand, ' ', p_type, ' ', p_name, ' — 2 сезон')
        WHEN 2 THEN concat('<i>', p_brand, '</i> ', p_type, ' ', p_name, ' cafe') ELSE concat('Other ', p_name) END AS title FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "releases": """SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 0 THEN 'ДБ, ПМ (Studio)' WHEN 1 THEN '2x ПМ (LostFilm)' WHEN 2 THEN 'ДБ' WHEN 3 THEN 'СТ' WHEN 4 THEN 'MVO, AVO' ELSE '' END AS audio,
        CASE p_size % 5 WHEN 0 THEN 'WEBRip (1080p)' WHEN 1 THEN 'BDRip' WHEN 2 THEN 'WEB-DL 2160p HDR' WHEN 3 THEN 'HDTV' ELSE '' END AS release_type,
        CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '1-3 серии из 8' ELSE '2 сезон: 5 серия' END AS progress,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(1990 + p_size % 30 AS STRING) END AS year, p_name AS title_en, CASE WHEN p_partkey % 5 < 2 THEN 'Красный дом' ELSE '' END AS title_ru FROM {part}""",
    "lists": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('["', event_type, '", "X", "x", " "]') WHEN 1 THEN concat(event_type, ', B ,b,', CAST(user_id AS STRING)) WHEN 2 THEN props WHEN 3 THEN '' WHEN 4 THEN '[]' ELSE concat('["', event_type, ' ", null, "', CAST(user_id AS STRING), '"]') END AS raw,
        event_type, user_id, props FROM {events}""",
    "progresses": """SELECT event_id, event_id % 10 AS form, 1 + event_id % 3 AS season, 2 + user_id % 9 AS first, 12 + event_id % 7 AS last, 30 + user_id % 5 AS total FROM {events}""",
    "users": """SELECT c_custkey AS user_id, c_name AS user_name, c_custkey % 10 <> 0 AS is_active, c_custkey % 7 <> 0 AS access_granted,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 996710400 + (c_custkey % 11 - 3) * 86400 END AS expires_at,
        c_custkey % 24 AS quiet_start, (c_custkey + 8) % 24 AS quiet_end FROM {customer}""",
    "rules": """SELECT c_custkey AS rule_id, c_custkey AS user_id, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 END AS is_enabled, CASE WHEN c_custkey % 3 = 1 THEN 'world' ELSE '' END AS preset_key,
        CASE c_custkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'movie' WHEN 2 THEN 'tv' ELSE 'other' END AS media_type,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1985 + c_custkey % 20 AS INT) END AS year_from,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1990 + c_custkey % 25 AS INT) END AS year_to,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS allow_720,
        CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 ELSE 0 END AS allow_1080,
        CASE WHEN c_mktsegment IN ('FURNITURE', 'AUTOMOBILE') THEN 1 ELSE 0 END AS allow_2160,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 8 AS DOUBLE) END AS min_rating,
        CASE c_custkey % 7 WHEN 1 THEN 'only_anime' WHEN 2 THEN 'exclude_dorama' WHEN 3 THEN 'exclude_anime_dorama' ELSE 'any' END AS bucket_filter,
        CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE CONCAT('c', CAST(c_nationkey % 6 AS STRING), ', C', CAST(c_nationkey % 4 AS STRING)) END AS country_codes,
        CASE WHEN c_nationkey % 3 = 0 THEN 'C5' ELSE NULL END AS exclude_country_codes, CAST(c_custkey % 6 AS INT) AS genre,
        CASE WHEN c_custkey % 8 = 0 THEN 'ar, lin' ELSE '' END AS include_keywords, CASE WHEN c_custkey % 11 = 0 THEN 'zz,red' ELSE '' END AS exclude_keywords FROM {customer}""",
    "items": """SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_size % 5 = 0 THEN 'other' WHEN p_size % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type,
        CASE WHEN p_size < 17 THEN '720' WHEN p_size < 34 THEN '1080' WHEN p_size < 48 THEN '2160' ELSE '' END AS video_format,
        CAST(1980 + p_partkey % 35 AS INT) AS year, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 10 AS DOUBLE) END AS rating,
        CASE p_partkey % 9 WHEN 0 THEN 'anime' WHEN 1 THEN 'dorama' ELSE 'regular' END AS bucket, CAST(p_size % 6 AS INT) AS genre,
        CASE WHEN p_partkey % 12 = 0 THEN '' ELSE CONCAT('C', CAST(p_partkey % 6 AS STRING)) END AS country, p_type AS category FROM {part}""",
    "versions": """SELECT l_partkey AS release_id, CASE WHEN l_linestatus = 'O' THEN 'tv' ELSE 'movie' END AS media, CAST(l_linenumber AS BIGINT) AS progress, l_returnflag AS audio,
        l_shipdate AS published, l_orderkey AS created, l_suppkey AS version_id, l_linenumber AS line, l_quantity AS quantity FROM {lineitem}""",
    "facts": """SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS delivered_at,
        CASE l_returnflag WHEN 'N' THEN 'live' WHEN 'R' THEN 'archive' ELSE 'claim' END AS origin, o_orderkey AS event_id, l_linenumber AS line, l_suppkey AS version_id
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "observed": """SELECT user_id AS release_id, CAST(FLOOR(value) AS BIGINT) % 9 + 1 AS progress, ts AS polled_at, event_id, event_type FROM {events}""",
}


@cache
def _uses(name: str) -> tuple[str, ...]:
    return tuple(n for n in (*TABLES, *VIEWS) if "{" + n + "}" in VIEWS[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: frame(spark, sf_dir, n) for n in _uses(name)})


def sql(name: str) -> str:
    """The same as a subquery for the oracle."""
    if name in TABLES:
        return name
    return "(" + VIEWS[name].format(**{n: sql(n) for n in _uses(name)}) + ")"


def with_views(text: str) -> str:
    """An oracle text in which {view} is replaced by its subquery."""
    for name in VIEWS:
        text = text.replace("{" + name + "}", sql(name))
    return text
