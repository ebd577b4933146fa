"""Queries: scalar functions, sources and sinks, streams, mutations, the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.functions import scoring as sc
from palimpsest.functions import strings as st
from palimpsest.operators import filters as fl
from palimpsest.operators import mutations as mu
from palimpsest.plans import planner
from palimpsest.plans.common import AS_OF_SQL, FACTS, HOT_TENANT, MEMORIES, MESSAGES, Registry, as_of, facts, memories, messages, r
from palimpsest.runtime import table
from palimpsest.sources import tabular as tb
from palimpsest.streaming import messages as ms

_reg = Registry()
_M = f"WITH {MEMORIES} "


@_reg.add(_M + "SELECT id, contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'rollback') AS folded, regexp_matches(content, '(^|[^A-Za-z0-9_])(?i:robot)([^A-Za-z0-9_]|$)') AS word FROM m WHERE content IS NOT NULL")
def scalar_contains(spark, folder):
    c = F.col("content")
    return memories(spark, folder, "content is not null").select("id", st.contains_folded(c, "Rollback").alias("folded"), st.contains_word(c, "robot").alias("word"))


_HIT = ["regexp_matches(content, '" + p.replace("'", "''") + "')" for p, _, _ in st.TYPE_PATTERNS]
_DETECT = " ".join(f"WHEN {h} THEN '{kind}'" for h, (_, kind, _) in zip(_HIT, st.TYPE_PATTERNS))
_TRUST = " ".join(f"WHEN {h} THEN {value}" for h, (_, _, value) in zip(_HIT, st.TYPE_PATTERNS))


@_reg.add(_M + f"SELECT CASE {_DETECT} ELSE 'Observation' END AS detected, CASE {_TRUST} ELSE 0.5 END::DOUBLE AS confidence, count(*) AS n FROM m WHERE content IS NOT NULL GROUP BY ALL")
def scalar_type_detection(spark, folder):
    kind, confidence = st.detected_type(F.col("content"))
    return memories(spark, folder, "content is not null").groupBy(kind.alias("detected"), confidence.alias("confidence")).agg(F.count("*").alias("n"))


_PART = "CASE WHEN h < 5 THEN 'Night' WHEN h < 8 THEN 'EarlyMorning' WHEN h < 12 THEN 'Morning' WHEN h < 17 THEN 'Afternoon' WHEN h < 21 THEN 'Evening' ELSE 'Night' END"


@_reg.add(_M + f", x AS (SELECT hour(created_at AT TIME ZONE 'UTC') AS h FROM m WHERE created_at IS NOT NULL) SELECT {_PART} AS part, count(*) AS n FROM x GROUP BY 1")
def scalar_day_part(spark, folder):
    return memories(spark, folder, "created_at is not null").groupBy(st.day_part(F.col("created_at")).alias("part")).agg(F.count("*").alias("n"))


@_reg.add("SELECT p_partkey, substr(regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g'), 1, 63) AS name FROM part")
def scalar_identifier(spark, folder):
    return table(spark, folder, "part").select("p_partkey", st.identifier(F.col("p_name")).alias("name"))


@_reg.add()
def scalar_checksum(spark, folder):
    return memories(spark, folder, "content is not null").select("id", st.checksum(F.col("content")).alias("crc"))


@_reg.add(_M + r", x AS (SELECT id, regexp_extract_all(content, '(?:^|[^0-9-])(\d{4}-\d{2}-\d{2})', 1) AS d FROM m), y AS (SELECT id, len(list_filter(d, lambda z: try_cast(z AS DATE) IS NOT NULL)) AS dates FROM x) SELECT id, dates FROM y WHERE dates > 0")
def scalar_dates(spark, folder):
    return memories(spark, folder).select("id", F.size(st.explicit_dates(F.col("content"))).alias("dates")).where("dates > 0")


@_reg.add("""WITH p(phrase) AS (VALUES ('yesterday'), ('3 days ago'), ('2 weeks ago'), ('1 month ago'), ('last friday'), ('next monday'), ('last year'), ('nothing')), b AS (SELECT DATE '2024-05-15' AS d)
SELECT phrase, strftime(CASE phrase WHEN 'yesterday' THEN d - 1 WHEN '3 days ago' THEN d - 3 WHEN '2 weeks ago' THEN d - 14 WHEN '1 month ago' THEN DATE '2024-04-15' WHEN 'last friday' THEN DATE '2024-05-10' WHEN 'next monday' THEN DATE '2024-05-20' WHEN 'last year' THEN DATE '2023-05-15' END, '%Y-%m-%d') AS day FROM p, b""")
def scalar_relative_date(spark, folder):
    p = spark.createDataFrame([(x,) for x in ("yesterday", "3 days ago", "2 weeks ago", "1 month ago", "last friday", "next monday", "last year", "nothing")], "phrase string")
    return p.select("phrase", F.date_format(st.relative_date(F.col("phrase"), F.lit("2024-05-15").cast("date")), "yyyy-MM-dd").alias("day"))


@_reg.add("""SELECT item_id, CASE WHEN starts_with(lower(query_text), 'when') OR contains(lower(query_text), ' when ') OR contains(lower(query_text), 'what date') OR contains(lower(query_text), 'what day') OR contains(lower(query_text), 'what time') THEN 'when'
WHEN regexp_matches(lower(query_text), 'how long|how many (days|weeks|months|years)') THEN 'duration' WHEN regexp_matches(lower(query_text), 'before or after|first or|earlier or later|which came first|in what order| before the | before we | after the | after we | prior to ') THEN 'ordering'
WHEN regexp_matches(lower(query_text), 'yesterday|today|last week|last month|last year|this week|this month|this year|most recent|latest|earliest|recently') THEN 'specific' ELSE 'none' END AS intent FROM eval_items""")
def scalar_temporal_intent(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", st.temporal_intent(F.col("query_text")).alias("intent"))


@_reg.add()
def scalar_geohash(spark, folder):
    m = memories(spark, folder, F.size("geo_location") >= 2)
    return m.select("id", geo.geohash(F.get("geo_location", 0), F.get("geo_location", 1), 6).alias("cell"))


@_reg.add(_M + f"SELECT CASE WHEN importance > 0.8 THEN 'lz4' WHEN access_count > 10 THEN 'none' WHEN (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000 > 30 AND importance < 0.5 THEN 'summarize' ELSE 'hybrid' END AS strategy, count(*) AS n FROM m WHERE importance IS NOT NULL AND access_count IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def scalar_compression_strategy(spark, folder):
    m = memories(spark, folder, "importance is not null and access_count is not null and created_at is not null")
    return m.groupBy(st.compression_strategy(F.col("importance"), F.col("access_count"), sc.days_between(as_of(), F.col("created_at"))).alias("strategy")).agg(F.count("*").alias("n"))


@_reg.add(_M + "SELECT id, coalesce(robot_id, metadata['robot_id'], 'none') AS robot, metadata['client'] AS client FROM m")
def scalar_map_access(spark, folder):
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return memories(spark, folder).select("id", F.coalesce("robot_id", get("robot_id"), F.lit("none")).alias("robot"), get("client").alias("client"))


@_reg.add("SELECT event_id, json_extract_string(props, '$.' || list_extract(json_keys(props), 1)) IS NOT NULL AS has_first FROM events WHERE props IS NOT NULL AND len(json_keys(props)) > 0")
def scalar_json(spark, folder):
    e = table(spark, folder, "events").where("props is not null")
    keys = F.json_object_keys("props")
    return e.where(F.size(keys) > 0).select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.get(keys, 0)).isNotNull().alias("has_first"))


@_reg.add(_M + """, f AS (SELECT sha256(content) AS h, min(id) AS id FROM m WHERE content IS NOT NULL GROUP BY 1) SELECT id, user_id, len(tags) AS tags FROM m WHERE content IS NULL OR id IN (SELECT id FROM f)""")
def source_interchange_round_trip(spark, folder):
    m = memories(spark, folder)
    return tb.import_interchange(tb.export_interchange(m), m.where("content is null")).select("id", "user_id", F.size("tags").alias("tags"))


@_reg.add("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_size > 25 AND p_brand LIKE 'Brand#1%' ORDER BY p_partkey LIMIT 1000")
def source_dataset_query(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return tb.query_dataset(spark, p.orderBy("id"), "size > :least AND brand LIKE :brand", {"least": 25, "brand": "Brand#1%"}).select("id", "name", "size")


@_reg.add("""SELECT list_concat(CASE WHEN p_partkey % 7 = 0 THEN ['unknown other'] ELSE [] END, CASE WHEN p_partkey % 5 = 0 THEN ['missing name'] ELSE [] END) AS violations, count(*) AS n FROM part GROUP BY 1""")
def source_dataset_validation(spark, folder):
    schema = tb.dataset_schema([("id", "i64", False), ("name", "text", False), ("score", "f64", True)])
    rows = table(spark, folder, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.lit(1)).alias("other"))).alias("row"))
    return tb.validated(rows, schema).groupBy("violations").agg(F.count("*").alias("n"))


@_reg.add()
def source_json_lines(spark, folder):
    return tb.flattened(table(spark, folder, "documents").where("source = 'robot_log'"), "doc_id", "text")


@_reg.add()
def source_markdown(spark, folder):
    headings, links, plain = tb.markdown_parts(F.col("text"))
    d = table(spark, folder, "documents").select("doc_id", F.size(headings).alias("headings"), F.size(links).alias("links"), F.length(plain).alias("plain"))
    return d.where("headings > 0")


@_reg.add(f"WITH {MEMORIES}, l AS (SELECT id, unnest([1, 2]) AS k, importance FROM m), x AS (SELECT id, k, CASE WHEN k = 2 AND importance < 0.2 THEN 'forget' ELSE 'remember' END AS op FROM l), y AS (SELECT id, arg_max(op, k) AS op, max(k) AS lsn FROM x GROUP BY 1) SELECT id, lsn FROM y WHERE op <> 'forget'")
def log_replay(spark, folder):
    m = memories(spark, folder).select("id", "importance").withColumn("lsn", F.explode(F.array(F.lit(1), F.lit(2))))
    log = m.select("id", "lsn", F.when((F.col("lsn") == 2) & (F.col("importance") < 0.2), "forget").otherwise("remember").alias("op"))
    return tb.latest_of_log(log, "id", "lsn").select("id", "lsn")


@_reg.add(f"WITH {MESSAGES} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, msg_type, count(*) AS n FROM s WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windowed_counts(spark, folder):
    got = ms.replay(spark, folder, "stream_messages", lambda s: ms.windowed_counts(s.where("ts is not null"), "3650 days").select(F.unix_micros("window.start").alias("start_us"), "msg_type", "n"), mode="update")
    return got.groupBy("start_us", "msg_type").agg(F.max_by("n", "_batch").alias("n"))


@_reg.add()
def stream_extraction(spark, folder):
    return ms.replay(spark, folder, "stream_messages", ms.session_extractor).groupBy("session_id").agg(F.sum("messages").alias("messages"), F.sum("duplicates").alias("duplicates"))


@_reg.add(f"WITH {MESSAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id, lower(trim(content)) ORDER BY ts, msg_id) AS k FROM s WHERE msg_type = 'content' AND length(trim(content)) > 0) SELECT session_id, count(*) AS memories FROM x WHERE k = 1 GROUP BY 1")
def stream_batch_extraction(spark, folder):
    return ms.extracted(messages(spark, folder, "msg_type = 'content'")).groupBy("session_id").agg(F.count("*").alias("memories"))


_WORDS = "len([w for w in string_split_regex(content, '\\s+') if w <> ''])"
_IMP = f"least(greatest(0.5::DOUBLE + CASE WHEN {_WORDS} > 50 THEN 0.1 WHEN {_WORDS} < 10 THEN -0.1 ELSE 0 END + CASE WHEN contains(content, '?') THEN 0.15 ELSE 0 END + CASE WHEN contains(content, '```') OR contains(content, 'fn ') OR contains(content, 'def ') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(content), 'error') OR contains(lower(content), 'failed') THEN 0.2 ELSE 0 END, 0), 1)"


@_reg.add(f"WITH {MESSAGES} SELECT msg_id, round({_IMP}, 6) AS importance FROM s WHERE msg_type = 'content' AND content IS NOT NULL")
def stream_importance(spark, folder):
    m = messages(spark, folder, "msg_type = 'content' and content is not null")
    return m.select("msg_id", r(ms.importance(F.col("content"), F.lit("conversation"))).alias("importance"))


@_reg.add(f"""WITH {MESSAGES} SELECT msg_id, coalesce([CASE WHEN contains(lower(t), 'error') THEN 'Error' WHEN contains(lower(t), 'decision') THEN 'Decision' WHEN contains(lower(t), 'learning') THEN 'Learning' WHEN contains(lower(t), 'discovery') THEN 'Discovery' END
for t in tags if contains(lower(t), 'error') OR contains(lower(t), 'decision') OR contains(lower(t), 'learning') OR contains(lower(t), 'discovery')][1], CASE WHEN msg_type = 'content' THEN 'Conversation' ELSE 'Observation' END) AS memory_type FROM s WHERE msg_type IN ('content', 'sensor', 'event')""")
def stream_memory_type(spark, folder):
    m = messages(spark, folder, "msg_type in ('content', 'sensor', 'event')")
    return m.select("msg_id", ms.memory_type(F.col("tags"), ms.mode(F.col("msg_type"))).alias("memory_type"))


_CUT = "msg_type IN ('flush', 'close') OR (msg_type = 'event' AND coalesce(event_name IN ('error', 'decision', 'task_complete', 'session_end'), false))"


@_reg.add(f"""WITH {MESSAGES}, a AS (SELECT *, coalesce(sum(CASE WHEN {_CUT} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM s),
b AS (SELECT *, (row_number() OVER (PARTITION BY session_id, f ORDER BY ts, msg_id) - 1) // 50 AS k FROM a) SELECT session_id, count(DISTINCT (f, k)) AS batches FROM b GROUP BY 1""")
def stream_triggers(spark, folder):
    return ms.batches_by_count(messages(spark, folder)).groupBy("session_id").agg(F.max("batch").cast("long").alias("batches"))


@_reg.add(f"WITH {MEMORIES}, i AS (SELECT id, content FROM m WHERE user_id = '{HOT_TENANT}' AND content IS NOT NULL), o AS (SELECT content FROM m WHERE user_id <> '{HOT_TENANT}') SELECT min(id) AS id FROM i WHERE content NOT IN (SELECT content FROM o WHERE content IS NOT NULL) GROUP BY content")
def mutate_remember(spark, folder):
    m = memories(spark, folder)
    return mu.remember(m.where(F.col("user_id") != HOT_TENANT), m.where(F.col("user_id") == HOT_TENANT)).select("id")


@_reg.add(_M + ", o AS (SELECT external_id, arg_min(content, id) AS old FROM m WHERE external_id IS NOT NULL GROUP BY 1) SELECT external_id, CASE WHEN ends_with(external_id, '0') THEN 'changed' ELSE old END AS content, CASE WHEN ends_with(external_id, '0') AND old <> 'changed' THEN 1 ELSE 0 END AS revisions FROM o")
def mutate_upsert(spark, folder):
    m = memories(spark, folder)
    change = m.where(F.col("external_id").endswith("0")).select("external_id", F.lit("changed").alias("content"))
    return mu.upsert(m, change, as_of()).select("external_id", "content", F.size("history").alias("revisions"))


@_reg.add(_M + f"SELECT count(*) AS n FROM m WHERE coalesce(metadata['forgotten'] = 'true', false) OR coalesce(importance < 0.2, false)")
def mutate_forget(spark, folder):
    return mu.forget(memories(spark, folder), F.col("importance") < 0.2).where(fl.forgotten()).agg(F.count("*").alias("n"))


@_reg.add(_M + f", x AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 1e6 AS age FROM m) SELECT CASE WHEN tier = 'Working' AND importance >= 0.35 AND age >= 1800 THEN 'Session' WHEN tier = 'Session' AND importance >= 0.5 AND age >= 86400 THEN 'LongTerm' ELSE tier END AS tier, count(*) AS n FROM x GROUP BY 1")
def mutate_promote(spark, folder):
    age = sc.days_between(as_of(), F.col("created_at")) * 86_400
    value = F.col("importance").cast("double")
    return memories(spark, folder).groupBy(mu.promoted_tier(F.round(value, 6), age).alias("tier")).agg(F.count("*").alias("n"))


_NOW = "TIMESTAMPTZ '2024-06-01 00:00:00+00'"


@_reg.add(_M + f""", x AS (SELECT id, importance::DOUBLE AS v, floor((epoch_us({_NOW}) - epoch_us(created_at)) / 3600000000.0::DOUBLE) / 24 AS age, coalesce(len(relations.related_memories), 0) AS k FROM m WHERE NOT coalesce(metadata['forgotten'] = 'true', false)),
p AS (SELECT id, v * (1 - age / 14.0::DOUBLE) * (1 + least(k / 10.0::DOUBLE, 0.5)) AS priority FROM x WHERE age >= 0 AND age <= 14 AND v >= 0.3) SELECT id, round(priority, 6) AS priority FROM p ORDER BY p.priority DESC, id LIMIT 50""")
def mutate_replay_candidates(spark, folder):
    now = F.lit("2024-06-01 00:00:00+00:00").cast("timestamp")
    return mu.replay_candidates(memories(spark, folder), now).select("id", r("priority").alias("priority"))


@_reg.add(f"WITH {FACTS}, s AS (SELECT DISTINCT id AS fact_id, 'mem_new' AS memory_id FROM f WHERE fact_type = 'Procedure') SELECT f.id, support_count + CASE WHEN s.fact_id IS NULL THEN 0 ELSE 1 END AS support_count, round(1 - (1 - confidence::DOUBLE) * CASE WHEN s.fact_id IS NULL THEN 1 ELSE 0.9::DOUBLE END, 6) AS confidence FROM f LEFT JOIN s ON s.fact_id = f.id")
def mutate_reinforce_facts(spark, folder):
    f = facts(spark, folder)
    support = f.where("fact_type = 'Procedure'").select(F.col("id").alias("fact_id"), F.lit("mem_new").alias("memory_id"))
    return mu.reinforce_facts(f, support).select("id", "support_count", r("confidence").alias("confidence"))


_VEC = "v AS (SELECT DISTINCT ON (vec_id) vec_id, memory_id, vector::DOUBLE[] AS x FROM memory_vectors WHERE model = 'mini-enc-v2' AND len(vector) = 128 AND len(list_filter(vector, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(vector, lambda y: y <> 0)) > 0)"


def _vectors(spark, folder):
    """Usable vectors of the main model; redelivered rows stay, since only the best vector of a memory counts."""
    v = table(spark, folder, "memory_vectors").where("model = 'mini-enc-v2'")
    good = (F.size("vector") == 128) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.where(good).select("vec_id", "memory_id", "vector")


@_reg.add(f"""WITH {MEMORIES}, {_VEC}, q AS (SELECT x AS y FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)), c AS (SELECT id, updated_at FROM m WHERE user_id = '{HOT_TENANT}' AND importance >= 0.2 AND experience_type <> 'Intention'),
b AS (SELECT memory_id, max(list_cosine_similarity(x, y)) AS s FROM v, q WHERE memory_id IN (SELECT id FROM c) GROUP BY 1) SELECT id, round(s, 6) AS similarity FROM c JOIN b ON memory_id = id ORDER BY s DESC, updated_at DESC, id LIMIT 10""")
def planner_conjunctive(spark, folder):
    v = _vectors(spark, folder)
    query = [float(x) for x in v.agg(F.min_by("vector", "vec_id")).first()[0]]
    plan = planner.Plan(HOT_TENANT, [fl.between("importance", 0.2), F.col("experience_type") != "Intention"], vector=(query, 10))
    return planner.execute(plan, table(spark, folder, "memories"), v).select("id", r("similarity").alias("similarity"))


@_reg.add(f"WITH {MEMORIES}, a AS (SELECT min(id) AS id FROM m WHERE user_id = '{HOT_TENANT}' AND len(entities) > 2), n AS (SELECT DISTINCT lower(e.text) AS name FROM (SELECT unnest(entities) AS e FROM m WHERE id = (SELECT id FROM a)) WHERE e.text IS NOT NULL) SELECT id FROM m WHERE user_id = '{HOT_TENANT}' AND id <> (SELECT id FROM a) AND list_has_any([lower(e.text) for e in entities if e.text is not null], (SELECT list(name) FROM n)) ORDER BY updated_at DESC NULLS LAST, id LIMIT 20")
def planner_graph(spark, folder):
    m = table(spark, folder, "memories")
    anchor = m.where((F.col("user_id") == HOT_TENANT) & (F.size("entities") > 2)).agg(F.min("id")).first()[0]
    return planner.execute(planner.Plan(HOT_TENANT, shares_with=anchor, limit=20), m).select("id")


@_reg.add("""SELECT * FROM (VALUES ('yesterday', '2024-05-14'), ('2 weeks ago', '2024-05-01'), ('1 month ago', '2024-04'), ('last month', '2024-04'), ('next month', '2024-06'), ('last year', '2023'), ('3 years ago', '2021'), ('last friday', '2024-05-10'), ('nothing', NULL)) t(phrase, period)""")
def scalar_relative_period(spark, folder):
    p = spark.createDataFrame([(x,) for x in ("yesterday", "2 weeks ago", "1 month ago", "last month", "next month", "last year", "3 years ago", "last friday", "nothing")], "phrase string")
    return p.select("phrase", st.relative_period(F.col("phrase"), F.lit("2024-05-15").cast("date")).alias("period"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
