"""Queries: sessions, bursts, runs and other computations over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import ordered as od
from palimpsest.operators import relations as rel
from palimpsest.plans.common import EDGES, MEMORIES, MESSAGES, Registry, edges, memories, messages, r

_reg = Registry()
_GAPS = f"""WITH {MEMORIES}, x AS (SELECT id, user_id, created_at, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id))) / 1e6 AS gap FROM m WHERE created_at IS NOT NULL)"""


@_reg.add(_GAPS + " SELECT id, sum(CASE WHEN coalesce(gap > 7200, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id) AS session FROM x")
def session_by_gap(spark, folder):
    return od.sessions(memories(spark, folder).select("id", "user_id", "created_at"), "user_id", "created_at", "id").select("id", "session")


_ADAPT = """, p AS (SELECT user_id, gap, lead(gap) OVER (PARTITION BY user_id ORDER BY gap) AS nxt FROM x WHERE gap > 0), j AS (SELECT *, (nxt - gap) / gap AS jump FROM p),
b AS (SELECT user_id, count(*) AS gaps, max(struct_pack(j := coalesce(jump, -1), g := -gap, mid := (gap + nxt) / 2 * (1 - 1 / 24.0::DOUBLE))).mid AS mid FROM j GROUP BY 1),
t AS (SELECT u.user_id, coalesce(CASE WHEN gaps >= 10 AND mid BETWEEN 300 AND 28800 THEN mid ELSE 7200 END, 7200) AS threshold, coalesce(gaps, 0) AS gaps FROM (SELECT DISTINCT user_id FROM x) u LEFT JOIN b USING (user_id))"""


@_reg.add(_GAPS + _ADAPT + " SELECT user_id, round(threshold, 6) AS threshold, gaps FROM t")
def session_adaptive_gap(spark, folder):
    return od.adaptive_gaps(memories(spark, folder).select("id", "user_id", "created_at"), "user_id", "created_at", "id").select("user_id", r("threshold").alias("threshold"), "gaps")


@_reg.add(_GAPS + _ADAPT + ", w AS (SELECT x.user_id, sum(CASE WHEN coalesce(gap > threshold, true) THEN 1 ELSE 0 END) OVER (PARTITION BY x.user_id ORDER BY created_at, id) AS session FROM x JOIN t USING (user_id)) SELECT user_id, max(session) AS sessions FROM w GROUP BY 1")
def session_adaptive(spark, folder):
    s = od.adaptive_sessions(memories(spark, folder).select("id", "user_id", "created_at"), "user_id", "created_at", "id")
    return s.groupBy("user_id").agg(F.max("session").alias("sessions"))


@_reg.add(f"""WITH {MESSAGES}, c AS (SELECT *, source_app AS k FROM s WHERE msg_type = 'content'), x AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR k IS DISTINCT FROM lag(k) OVER w THEN 1 ELSE 0 END AS ch FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ts, msg_id)),
y AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS run FROM x) SELECT session_id, run, k AS source_app, string_agg(coalesce(content, ''), ' ' ORDER BY ts, msg_id) AS text, count(*) AS rows FROM y GROUP BY ALL""")
def runs_same_source(spark, folder):
    c = messages(spark, folder, "msg_type = 'content'").select("session_id", "ts", "msg_id", "source_app", "content")
    return od.runs(c, "session_id", "ts", "msg_id", "source_app", "content").select("session_id", "run", "source_app", "text", "rows")


_ASKS = "coalesce(ends_with(rtrim(content), '?'), false)"


@_reg.add(f"""WITH {MESSAGES}, x AS (SELECT session_id, msg_id, {_ASKS} AS q, lag({_ASKS}) OVER w AS pq, lag(msg_id) OVER w AS pm FROM s WHERE msg_type = 'content' WINDOW w AS (PARTITION BY session_id ORDER BY ts, msg_id))
SELECT session_id, pm AS question, msg_id AS answer FROM x WHERE pq AND NOT q""")
def question_links(spark, folder):
    c = messages(spark, folder, "msg_type = 'content'").select("session_id", "ts", "msg_id", "content")
    return od.question_links(c, "session_id", "ts", "msg_id", "content")


_W = "list_distinct([w for w in string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+') if length(w) >= 4])"


@_reg.add(f"""WITH {MESSAGES}, x AS (SELECT session_id, msg_id, {_W} AS w, lag({_W}) OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS p FROM s WHERE msg_type = 'content')
SELECT session_id, msg_id, round(len(list_intersect(w, p)) / (len(w) + len(p) - len(list_intersect(w, p)))::DOUBLE, 6) AS overlap FROM x WHERE len(w) + len(p) > 0 AND len(list_intersect(w, p)) / (len(w) + len(p) - len(list_intersect(w, p)))::DOUBLE >= 0.1""")
def topic_threads(spark, folder):
    c = messages(spark, folder, "msg_type = 'content'").select("session_id", "ts", "msg_id", rel.tokens(F.coalesce("content", F.lit("")), 4).alias("w"))
    x = c.withColumn("p", F.lag("w").over(Window.partitionBy("session_id").orderBy("ts", "msg_id"))).where("p is not null and size(w) + size(p) > 0")
    return x.withColumn("overlap", rel.jaccard(F.col("w"), F.col("p"))).where("overlap >= 0.1").select("session_id", "msg_id", r("overlap").alias("overlap"))


@_reg.add(f"""WITH {EDGES}, x AS (SELECT uuid, activation_timestamps AS a, last_activated AS n FROM g WHERE last_activated IS NOT NULL AND activation_timestamps IS NOT NULL)
SELECT uuid, len([t for t in a if t > n - INTERVAL 24 HOUR and t <= n]) >= 5 AS burst, len([t for t in a if t > n - INTERVAL 7 DAY and t <= n]) >= 3 AND len([t for t in a if t > n - INTERVAL 14 DAY and t <= n - INTERVAL 7 DAY]) >= 3 AS weekly FROM x""")
def ltp_patterns(spark, folder):
    g = edges(spark, folder, "last_activated is not null and activation_timestamps is not null")
    now = F.col("last_activated")
    return g.select("uuid", od.bursts(F.col("activation_timestamps"), now).alias("burst"), od.weekly(F.col("activation_timestamps"), now).alias("weekly"))


@_reg.add(f"""WITH {MESSAGES}, x AS (SELECT session_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, msg_id))) / 1e6 AS gap FROM s WHERE ts IS NOT NULL)
SELECT session_id, round(CASE WHEN count(*) < 3 OR avg(gap) FILTER (gap > 0) IS NULL THEN 1.0 ELSE stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0) END, 6) AS burstiness FROM x GROUP BY 1""")
def burstiness(spark, folder):
    return od.burstiness(messages(spark, folder), "session_id", "ts", "msg_id").select("session_id", r("burstiness").alias("burstiness"))


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT user_id, id, created_at, (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1e6 AS gap FROM m WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)),
y AS (SELECT *, sum(CASE WHEN coalesce(gap > 1800, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id) AS session FROM x)
SELECT user_id, session, count(*) AS members, epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) AS end_us FROM y GROUP BY ALL HAVING count(*) >= 2""")
def time_clusters(spark, folder):
    t = od.time_clusters(memories(spark, folder).select("user_id", "id", "created_at"), "user_id", "created_at", "id")
    return t.select("user_id", "session", "members", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@_reg.add(f"""WITH {MEMORIES}, e AS (SELECT user_id, epoch_us(created_at) AS t, unnest(list_distinct([lower(e.text) for e in entities if e.text is not null])) AS entity FROM m WHERE created_at IS NOT NULL), l AS (SELECT user_id, max(epoch_us(created_at)) AS now FROM m GROUP BY 1),
x AS (SELECT user_id, entity, count(*) AS memories, round(0.6 * exp(-(any_value(now) - max(t)) / 86400000000.0::DOUBLE) + 0.4 * least(count(*) / 10.0::DOUBLE, 1), 6) AS confidence FROM e JOIN l USING (user_id) GROUP BY ALL) SELECT * FROM x WHERE memories >= 3 AND confidence >= 0.3""")
def entity_patterns(spark, folder):
    m = memories(spark, folder, "created_at is not null")
    rows = rel.entity_rows(m, "user_id", "created_at")
    now = m.groupBy("user_id").agg(F.max("created_at").alias("now"))
    x = rows.groupBy("user_id", "entity").agg(F.count("*").alias("memories"), F.max("created_at").alias("last")).where("memories >= 3").join(now, "user_id")
    recent = F.exp(-(F.unix_micros("now") - F.unix_micros("last")) / 86_400_000_000.0)
    return x.select("user_id", "entity", "memories", r(0.6 * recent + 0.4 * F.least(F.col("memories") / 10.0, F.lit(1.0))).alias("confidence")).where("confidence >= 0.3")


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT user_id, id, experience_type, lag(experience_type) OVER w AS prev, robot_id, lag(robot_id) OVER w AS prev_robot FROM m WINDOW w AS (PARTITION BY user_id ORDER BY created_at NULLS FIRST, id))
SELECT user_id, count(*) FILTER (prev IS NOT NULL AND experience_type <> prev) AS topic_switches, count(*) FILTER (robot_id <> prev_robot) AS robot_switches FROM x GROUP BY 1""")
def behaviour_changes(spark, folder):
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("created_at"), "id")
    x = memories(spark, folder).select("user_id", "experience_type", "robot_id", F.lag("experience_type").over(w).alias("prev"), F.lag("robot_id").over(w).alias("prev_robot"))
    return x.groupBy("user_id").agg(F.count_if(F.col("experience_type") != F.col("prev")).alias("topic_switches"), F.count_if(F.col("robot_id") != F.col("prev_robot")).alias("robot_switches"))


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT user_id, id, importance::DOUBLE AS v, row_number() OVER w AS n, first_value(importance::DOUBLE) OVER w AS top, lag(importance::DOUBLE) OVER w AS b FROM m WHERE importance IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY importance DESC, id)),
y AS (SELECT *, max(CASE WHEN coalesce(v / top < 0.25 OR (n >= 3 AND v / b < 0.40), false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY v DESC, id) AS gone FROM x) SELECT user_id, count(*) AS kept FROM y WHERE gone = 0 GROUP BY 1""")
def prune_by_score_gap(spark, folder):
    m = memories(spark, folder, "importance is not null").select("user_id", "id", F.col("importance").cast("double").alias("importance"))
    return od.cut_by_gap(m, "user_id", "importance", "id").groupBy("user_id").agg(F.count("*").alias("kept"))


@_reg.add("""WITH x AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events)
SELECT user_id, event_id, n, round(running, 4) AS running FROM x WHERE n <= 5""")
def running_totals(spark, folder):
    from palimpsest.runtime import table

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events")
    return e.select("user_id", "event_id", F.row_number().over(w).alias("n"), r(F.sum("value").over(w), 4).alias("running")).where("n <= 5")


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT user_id, id, importance::DOUBLE AS v, avg(importance::DOUBLE) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a FROM m WHERE created_at IS NOT NULL)
SELECT id, round(v, 6) AS importance, round(a, 6) AS usual FROM x WHERE abs(v - a) > 0.3 OR v > 0.7""")
def salience_spikes(spark, folder):
    w = Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(-20, -1)
    x = memories(spark, folder, "created_at is not null").select("id", F.col("importance").cast("double").alias("v"), F.avg(F.col("importance").cast("double")).over(w).alias("a"))
    return x.where((F.abs(F.col("v") - F.col("a")) > 0.3) | (F.col("v") > 0.7)).select("id", r("v").alias("importance"), r("a").alias("usual"))


@_reg.add(f"""WITH {MESSAGES}, x AS (SELECT session_id, msg_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM s WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY ts, msg_id)),
y AS (SELECT *, sum(CASE WHEN coalesce(gap > 86400, true) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS session FROM x)
SELECT session_id, session, count(*) AS members, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM y GROUP BY ALL HAVING count(*) >= 2""")
def time_clusters_messages(spark, folder):
    """Messages of a session no more than a day apart: the test messages stand further apart than half an hour."""
    t = od.time_clusters(messages(spark, folder, "ts is not null").select("session_id", "msg_id", "ts"), "session_id", "ts", "msg_id", gap_seconds=86_400)
    return t.select("session_id", "session", "members", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
