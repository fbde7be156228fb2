"""Queries over ordered histories: the ledger of effects, the holds of quiet hours, and folds that combine pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import labels
from tramline.operators import audit, leases, versions
from tramline.operators.shared import shared_folder
from tramline.plans.registered import query
from tramline.streaming import effects, holds


def _flaky(rows: DataFrame, number: int) -> DataFrame:
    """An effect that fails for some events once, for a few always, and for the whole of one run."""
    if number == 3 * effects.PER_BATCH:
        raise ValueError("the receiver is down")
    ok = ~((F.col("event_id") % 10 == 3) & (F.col("tries") == 0)) & (F.col("event_id") % 50 != 7)
    return rows.select("event_key", ok.alias("ok"), F.when(~ok, "refused").alias("error"))


@query("""WITH keyed AS (SELECT concat(user_id, ':', event_type) AS event_key, event_id, CAST(floor((day(ts) - 1) / 6) AS INT) AS n FROM events),
    first AS (SELECT event_key, n, min(event_id) AS event_id FROM keyed k WHERE n = (SELECT min(n) FROM keyed m WHERE m.event_key = k.event_key) GROUP BY event_key, n),
    tried AS (SELECT *, t, n + t = 3 OR event_id % 50 = 7 OR event_id % 10 = 3 AND t = 0 AS failed FROM first, unnest([0, 1, 2]) AS u(t) WHERE n + t <= 4),
    last AS (SELECT event_key, event_id, n, coalesce(min(t) FILTER (WHERE NOT failed), max(t)) AS tries, min(t) FILTER (WHERE NOT failed) IS NOT NULL AS ok FROM tried GROUP BY ALL)
    SELECT event_key, event_id, CAST((n + tries) * 1000 AS INT) AS run, CAST(tries AS INT) AS tries, CASE WHEN ok THEN 'sent' WHEN tries + 1 < 3 THEN 'open' ELSE 'given_up' END AS status FROM last""")
def deliveries_once(get):
    events = get("events").select(F.concat_ws(":", "user_id", "event_type").alias("event_key"), "event_id", F.floor((F.day("ts") - 1) / 6).alias("n"))
    folder = f"{shared_folder(events.sparkSession)}/ledger-{uuid.uuid4().hex}"
    for n in range(5):
        effects.run(events.filter(F.col("n") == n).drop("n"), n * effects.PER_BATCH, folder, _flaky)
    return effects.outcomes(events.sparkSession, events.drop("n"), folder).select("event_key", "event_id", "run", "tries", "status")


@query("""WITH RECURSIVE p AS (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY since) AS until, CASE zone WHEN 'UTC' THEN 0 WHEN 'Etc/GMT-5' THEN 5 ELSE 3 END * 3600 AS ahead FROM {quiet_profiles}),
    h AS (SELECT user_id, event_id, happened, happened AS t, 0 AS checks, FALSE AS done FROM {timed_events}
        UNION ALL
        SELECT user_id, event_id, happened, CASE WHEN inside THEN local - local % 86400 + CASE WHEN start_hour > end_hour AND hour >= start_hour THEN 86400 ELSE 0 END + end_hour * 3600 - ahead ELSE t END, checks + CASE WHEN inside THEN 1 ELSE 0 END, NOT inside FROM (
            SELECT *, coalesce(start_hour <> end_hour AND CASE WHEN start_hour < end_hour THEN hour >= start_hour AND hour < end_hour ELSE hour >= start_hour OR hour < end_hour END, FALSE) AS inside FROM (
                SELECT h.*, p.start_hour, p.end_hour, p.ahead, t + p.ahead AS local, (t + p.ahead) // 3600 % 24 AS hour FROM h LEFT JOIN p ON p.user_id = h.user_id AND h.t >= p.since AND (p.until IS NULL OR h.t < p.until) WHERE NOT done)))
    SELECT user_id, CAST(event_id AS VARCHAR) AS event_key, happened AS "at", t AS released_at, checks FROM h WHERE done""")
def quiet_holds(get):
    deliveries = get("timed_events").select("user_id", F.col("event_id").cast("string").alias("event_key"), F.col("happened").alias("at"))
    return holds.release(deliveries, get("quiet_profiles").withColumnRenamed("since", "at"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS rn FROM {progress_steps}),
    s AS (SELECT release_id, rn, season, start_no, end_no, total, known, l_orderkey, l_linenumber, l_suppkey FROM o WHERE rn = 1
        UNION ALL
        SELECT s.release_id, o.rn, CASE WHEN moves THEN o.season ELSE s.season END, CASE WHEN moves THEN o.start_no ELSE s.start_no END, CASE WHEN moves THEN o.end_no ELSE s.end_no END, CASE WHEN moves THEN o.total ELSE s.total END, CASE WHEN moves THEN o.known ELSE s.known END,
            CASE WHEN moves THEN o.l_orderkey ELSE s.l_orderkey END, CASE WHEN moves THEN o.l_linenumber ELSE s.l_linenumber END, CASE WHEN moves THEN o.l_suppkey ELSE s.l_suppkey END
        FROM s JOIN o ON o.release_id = s.release_id AND o.rn = s.rn + 1, LATERAL (SELECT CASE WHEN NOT o.known THEN FALSE WHEN NOT s.known THEN TRUE WHEN coalesce(s.end_no > o.total, FALSE) OR coalesce(o.end_no > s.total, FALSE) THEN FALSE
            ELSE (coalesce(o.season, s.season, 0), o.end_no, o.start_no) >= (coalesce(s.season, o.season, 0), s.end_no, s.start_no) END AS moves))
    SELECT release_id, l_orderkey, l_linenumber, l_suppkey FROM s WHERE rn = (SELECT max(rn) FROM o WHERE o.release_id = s.release_id)""")
def highest_progress(get):
    parts = F.struct("season", F.col("start_no").alias("start"), F.col("end_no").alias("end"), "total")
    rows = get("progress_steps").withColumn("parts", F.when(F.col("known"), parts))
    return versions.highest_progress(rows, "release_id", "parts", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("""WITH r AS (SELECT * FROM (SELECT event_id, release_id, progress, polled_at, max(progress) OVER (PARTITION BY release_id ORDER BY polled_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM {observed}) WHERE progress < highest_before),
    h AS (SELECT *, release_id IN (SELECT item_id FROM {facts} WHERE user_id % 9 = 0) AS held FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY release_id, highest_before, progress, held ORDER BY polled_at, event_id) AS nth FROM h)
    SELECT event_id, release_id, progress, highest_before, held, held AND nth = 1 AND NOT (release_id % 4 = 0 AND highest_before = 9 AND progress = 1) AS alert FROM n""")
def anomaly_holds(get):
    found = audit.regressions(get("observed"), "release_id", "progress", ["polled_at", "event_id"])
    matched = get("facts").filter("user_id % 9 = 0").select(F.col("item_id").alias("release_id"))
    already = get("observed").filter("release_id % 4 = 0").select("release_id", F.lit(9).cast("long").alias("old_value"), F.lit(1).cast("long").alias("new_value"))
    rows = audit.holds(found, "release_id", "progress", ["polled_at", "event_id"], matched, already)
    return rows.select("event_id", "release_id", "progress", "highest_before", "held", "alert")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id AS entry, happened + 120 AS due, happened + 7200 AS gone_at FROM {timed_events}), takes AS MATERIALIZED (SELECT taken, min(worker) AS worker FROM {worker_takes} GROUP BY taken),
    told AS MATERIALIZED (SELECT entry, worker, list({'t': told, 'r': NOT done} ORDER BY told, NOT done) AS said FROM {worker_reports} GROUP BY entry, worker),
    moments AS MATERIALIZED (SELECT due AS t FROM e UNION SELECT told FROM {worker_reports} UNION SELECT taken + 300 FROM takes UNION SELECT taken + 1 FROM takes), next AS MATERIALIZED (SELECT t, taken, worker FROM moments ASOF JOIN takes ON taken >= t),
    l AS (SELECT entry, gone_at, 0 AS fence, ''::VARCHAR AS worker, NULL::BIGINT AS leased_at, due AS ended_at, 'released' AS outcome FROM e
        UNION ALL
        SELECT entry, gone_at, fence + 1, worker, leased_at, CASE WHEN len(heard) > 0 THEN heard[1].t WHEN reclaimed IS NOT NULL THEN leased_at + 300 END,
            CASE WHEN len(heard) = 0 THEN CASE WHEN reclaimed IS NULL THEN 'open' ELSE 'expired' END WHEN heard[1].r THEN 'released' ELSE 'done' END FROM (
            SELECT *, coalesce(list_filter(said, lambda x: x.t >= leased_at AND (reclaimed IS NULL OR x.t < reclaimed)), []) AS heard FROM (
                SELECT p.entry, p.gone_at, p.fence, n.worker, n.taken AS leased_at, CASE WHEN m.taken < p.gone_at THEN m.taken END AS reclaimed, said
                FROM l p JOIN next n ON n.t = greatest(p.ended_at, coalesce(p.leased_at + 1, 0)) LEFT JOIN next m ON m.t = n.taken + 300 LEFT JOIN told ON told.entry = p.entry AND told.worker = n.worker WHERE p.outcome IN ('released', 'expired') AND n.taken < p.gone_at)))
    SELECT entry, fence, worker, leased_at, ended_at, outcome FROM l WHERE fence > 0""")
def queue_leases(get):
    entries = get("timed_events").select(F.col("event_id").alias("entry"), (F.col("happened") + 120).alias("due"), (F.col("happened") + 7200).alias("gone_at"))
    return leases.replay_leases(entries, get("worker_takes").withColumnRenamed("taken", "at"), get("worker_reports").withColumnRenamed("told", "at"))


#: Islands on a grid of thirty seconds: {0} are the half-open times of each rule.
_ISLANDS_SQL = """SELECT rule, min(a) AS pending_at, max(b) AS b FROM (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY a, b) AS island FROM (
    SELECT *, max(b) OVER (PARTITION BY rule ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
        SELECT DISTINCT rule, CAST(ceil(since / 30.0) * 30 AS BIGINT) AS a, coalesce(CAST(ceil(until / 30.0) * 30 AS BIGINT), 1152921504606846976) AS b FROM ({0})) WHERE a < b)) GROUP BY rule, island"""


@query("SELECT rule, pending_at, pending_at + 300 AS fires_at, CASE WHEN b < 1152921504606846976 THEN b END AS ended_at FROM (" + _ISLANDS_SQL.format("""
    SELECT concat('stalled:', user_id) AS rule, happened + 21601 AS since, lead(happened) OVER (PARTITION BY user_id ORDER BY happened) AS until FROM (SELECT DISTINCT user_id, happened FROM {timed_events})
    UNION ALL SELECT concat('failures:', event_type), happened, happened + 900 FROM {timed_events} WHERE value < 20""") + ") WHERE pending_at + 300 < b")  # fmt: skip
def alert_times(get):
    finishes = get("timed_events").select(F.concat(F.lit("stalled:"), "user_id").alias("rule"), "happened")
    failures = get("timed_events").filter("value < 20").select(F.concat(F.lit("failures:"), "event_type").alias("rule"), "happened")
    times = leases.stalls(finishes, "rule", "happened", 21_600).unionByName(leases.recent(failures, "rule", "happened", 900))
    return leases.alerts(times, "rule", 300)


_SPLIT_SQL = r"list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '\r\n|\r|\n'), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '')"
_ESCAPED_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_MOST = 400


#: A message's first line shows two characters less, as it loses its spaces.
@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, {_SPLIT_SQL.format('text')} AS now, {_SPLIT_SQL.format('before')} AS past FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {{long_turns}})),
    l AS (SELECT conv_id, turn, role, len(past) > 0 AS changed, list_concat(list_concat(list_transform(now, lambda x: CASE WHEN len(past) > 0 AND NOT list_contains(past, x) THEN {{'m': '{labels.ADDED}', 't': x, 'b': TRUE}} ELSE {{'m': '{labels.SAME}', 't': x, 'b': FALSE}} END),
        CASE WHEN len(list_filter(past, lambda x: NOT list_contains(now, x))) > 0 THEN [{{'m': '', 't': '', 'b': FALSE}}] ELSE [] END), list_transform(list_filter(past, lambda x: NOT list_contains(now, x)), lambda x: {{'m': '{labels.REMOVED}', 't': x, 'b': FALSE}})) AS lines FROM t WHERE len(now) > 0),
    h AS MATERIALIZED (SELECT *, CASE WHEN changed THEN '{labels.CHANGED}' ELSE '{labels.UNCHANGED}' END AS head, length(role) + 1 AS own FROM l),
    s AS (SELECT conv_id, turn, 0 AS i, 0 AS number, 0 AS held, 0 AS n, FALSE AS cut_off FROM h
        UNION ALL
        SELECT conv_id, turn, i + 1, CASE WHEN held = 0 OR too_long THEN number + 1 ELSE number END, CASE WHEN held = 0 AND too_long THEN 0 WHEN held = 0 OR too_long THEN 1 ELSE held + 1 END,
            CASE WHEN held = 0 AND too_long THEN 0 WHEN held > 0 AND too_long THEN alone ELSE body END, held = 0 AND too_long FROM (
            SELECT *, CASE WHEN number <= CASE WHEN held = 0 THEN 0 ELSE 1 END THEN length(regexp_replace(head, '</?b>', '', 'g')) ELSE {len(labels.CONTINUED) - 7} END + own + 2 + CASE WHEN size = 0 THEN n ELSE body END > {_MOST} AS too_long FROM (
                SELECT *, greatest(size - 2, 0) AS alone, CASE WHEN n = 0 THEN greatest(size - 2, 0) ELSE n + 1 + size END AS body FROM (
                    SELECT s.conv_id, s.turn, s.i, s.number, s.held, s.n, h.head, h.own, length(h.lines[s.i + 1].m) + length(h.lines[s.i + 1].t) AS size FROM s JOIN h ON h.conv_id = s.conv_id AND h.turn = s.turn WHERE s.i < len(h.lines))))),
    shown AS (SELECT s.conv_id, s.turn, s.i, s.number, h.role, h.head, h.lines[s.i] AS x, CASE WHEN s.cut_off THEN greatest({labels.LEAST_SHOWN}, {_MOST} - h.own - CASE WHEN s.number = 1 THEN length(regexp_replace(head, '</?b>', '', 'g')) ELSE {len(labels.CONTINUED) - 7} END) END AS room FROM s JOIN h ON h.conv_id = s.conv_id AND h.turn = s.turn WHERE s.i > 0),
    cut AS (SELECT *, CASE WHEN room IS NOT NULL AND length(x.m) + length(x.t) - 2 > room THEN rtrim(substr(x.t, 1, room - length(x.m))) ELSE x.t END AS said FROM shown)
    SELECT conv_id, turn, CAST(number AS INT) AS number, CASE WHEN number = 1 THEN any_value(head) ELSE '{labels.CONTINUED}' END || ' ' || any_value(role) || chr(10) || chr(10) || string_agg(x.m || CASE WHEN x.b THEN '<b>' || {_ESCAPED_SQL.format('said')} || '</b>' ELSE {_ESCAPED_SQL.format('said')} END, chr(10) ORDER BY i) AS message
    FROM cut GROUP BY conv_id, turn, number""")
def text_messages(get):
    rows = get("long_turns").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    sent = labels.release_messages(F.col("role"), F.col("text"), F.col("before"), _MOST)
    return rows.select("conv_id", "turn", F.posexplode(sent).alias("at", "message")).select("conv_id", "turn", (F.col("at") + 1).cast("int").alias("number"), "message")
