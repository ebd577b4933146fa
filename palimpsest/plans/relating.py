"""Queries: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators import filters as fl
from palimpsest.operators import relations as rel
from palimpsest.plans.common import AS_OF_SQL, EDGES, FACTS, MEMORIES, MESSAGES, Registry, as_of, edges, facts, memories, messages, r
from palimpsest.runtime import table

_reg = Registry()
_M, _G, _F = f"WITH {MEMORIES} ", f"WITH {EDGES} ", f"WITH {FACTS} "
_NAMES = "list_distinct([lower(e.text) for e in entities if e.text is not null])"
_NEG = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in rel.NEGATIONS) + ")"
_POS = "len([w for w in string_split_regex(lower({c}), '[^a-z'']+') if w in " + _NEG + "]) % 2 = 0"
_TOK = "list_distinct([w for w in string_split_regex(lower({c}), '[^a-z0-9]+') if length(w) >= 2])"
_JAC = "CASE WHEN len({a}) + len({b}) - len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


@_reg.add(f"""WITH {MEMORIES}, e AS (SELECT id, user_id, unnest({_NAMES}) AS entity FROM m), a AS (SELECT * FROM e WHERE id IN (SELECT id FROM m WHERE ends_with(id, '00')))
SELECT a.id AS anchor, e.id, count(*) AS shared FROM a JOIN e ON a.user_id = e.user_id AND a.entity = e.entity AND a.id <> e.id GROUP BY ALL""")
def join_shares_entity(spark, folder):
    m = memories(spark, folder)
    return rel.sharing_entities(m, m.where(F.col("id").endswith("00")))


@_reg.add(f"""WITH {MEMORIES}, e AS (SELECT id, user_id, unnest({_NAMES}) AS entity FROM m), k AS (SELECT user_id, entity, count(*) - 1 AS n FROM e GROUP BY ALL), l AS (SELECT e.id, sum(n) AS links FROM e JOIN k USING (user_id, entity) GROUP BY 1) SELECT id, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (id)""")
def join_entity_links(spark, folder):
    """The links of all memories; ``join_shares_entity`` lists those of the anchors that its SQL names."""
    return rel.entity_links(memories(spark, folder))


@_reg.add(_M + f"SELECT id, len(list_intersect({_NAMES}, ['merkle tree', 'bloom filter', 'error budget'])) AS matched, round(matched / 3.0, 6) AS score FROM m WHERE matched > 0")
def join_entity_overlap(spark, folder):
    return rel.matching_entities(memories(spark, folder), ["Merkle Tree", "bloom filter", "Error Budget"]).select("id", "matched", r("score").alias("score"))


_VALID = "coalesce(coalesce(valid_from, created_at) <= {t}, true) AND coalesce(valid_until > {t}, true) AND purged_at IS NULL"


@_reg.add(_F + f"SELECT id, round(confidence::DOUBLE, 6) AS confidence FROM f WHERE {_VALID.format(t=AS_OF_SQL)}")
def as_of_facts(spark, folder):
    return rel.facts_as_of(table(spark, folder, "facts"), as_of()).select("id", r("confidence").alias("confidence"))


@_reg.add(_F + f"SELECT id FROM f WHERE {_VALID.format(t=AS_OF_SQL)} ORDER BY confidence DESC NULLS LAST, id LIMIT 25")
def as_of_facts_top(spark, folder):
    return rel.facts_as_of(table(spark, folder, "facts"), as_of(), 25).select("id")


@_reg.add(f"""WITH {FACTS}, t AS (SELECT k AS key, TIMESTAMPTZ '2024-01-01 00:00:00+00' + to_days(CAST(30 * k AS INTEGER)) AS moment FROM range(0, 24) x(k))
SELECT key, count(*) AS facts FROM t, f WHERE {_VALID.format(t='moment')} GROUP BY 1""")
def as_of_facts_many(spark, folder):
    t = spark.range(24).select(F.col("id").alias("key"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * (30 * 86_400_000_000)).alias("at"))
    return rel.facts_as_of_many(facts(spark, folder, "purged_at is null"), t).groupBy("key").agg(F.count("*").alias("facts"))


@_reg.add(f"WITH {FACTS}, x AS (SELECT DISTINCT id, confidence, unnest(source_memories) AS memory_id FROM f) SELECT memory_id, count(*) AS facts, round(max(confidence)::DOUBLE, 6) AS confidence FROM x WHERE memory_id IS NOT NULL GROUP BY 1")
def join_fact_sources(spark, folder):
    return rel.fact_support(facts(spark, folder)).select("memory_id", "facts", r("confidence").alias("confidence"))


@_reg.add(f"""WITH {FACTS}, x AS (SELECT id, user_id, {_TOK.format(c='fact')} AS w, {_POS.format(c='fact')} AS pos, list_distinct(related_entities) AS al FROM f),
p AS (SELECT a.id, b.id AS id_b, {_JAC.format(a='a.w', b='b.w')} AS overlap FROM x a JOIN x b ON a.user_id = b.user_id AND a.id < b.id AND a.pos <> b.pos WHERE len(list_intersect(a.al, b.al)) > 0)
SELECT id, id_b, round(overlap, 6) AS overlap FROM p WHERE overlap >= 0.3""")
def join_contradictions(spark, folder):
    return rel.contradictions(facts(spark, folder), 0.3).select("id", "id_b", r("overlap").alias("overlap"))


_TYPES = ", ".join(f"('{a}', '{b}', '{x}', {c})" for (a, b), (x, c) in rel.LINEAGE_TYPES.items())


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT id, user_id, experience_type AS ty, epoch_us(created_at) AS t, {_NAMES} AS n FROM m WHERE created_at IS NOT NULL), k(a, b, relation, confidence) AS (VALUES {_TYPES})
SELECT x.id AS cause, y.id AS effect, relation, confidence::DOUBLE AS confidence, round({_JAC.format(a='x.n', b='y.n')}, 6) AS overlap
FROM x JOIN y_x y ON x.user_id = y.user_id AND x.t <= y.t AND y.t - x.t <= 7 * 86400000000 AND x.id <> y.id JOIN k ON k.a = x.ty AND k.b = y.ty WHERE {_JAC.format(a='x.n', b='y.n')} >= 0.3""".replace("y_x y", "x y"))
def join_lineage_inference(spark, folder):
    return rel.inferred_lineage(memories(spark, folder)).select("cause", "effect", "relation", "confidence", r("overlap").alias("overlap"))


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT id, user_id, experience_type AS ty, epoch_us(created_at) AS t, {_NAMES} AS n FROM m WHERE created_at IS NOT NULL), k(a, b, relation, confidence) AS (VALUES {_TYPES})
SELECT x.id AS cause, y.id AS effect, relation, confidence::DOUBLE AS confidence, round({_JAC.format(a='x.n', b='y.n')}, 6) AS overlap
FROM x JOIN y_x y ON x.user_id = y.user_id AND x.t <= y.t AND y.t - x.t <= 60 * 86400000000 AND x.id <> y.id JOIN k ON k.a = x.ty AND k.b = y.ty WHERE {_JAC.format(a='x.n', b='y.n')} >= 0.1""".replace("y_x y", "x y"))
def join_lineage_wide(spark, folder):
    """With bounds that the test tables meet: sixty days, a tenth of the entities."""
    return rel.inferred_lineage(memories(spark, folder), 60, 0.1).select("cause", "effect", "relation", "confidence", r("overlap").alias("overlap"))


@_reg.add(_M + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id, lower(substr(content, 1, 200)) ORDER BY importance DESC NULLS LAST, id) AS n FROM m WHERE content IS NOT NULL) WHERE n = 1")
def dedup_heads(spark, folder):
    return rel.head_duplicates(memories(spark, folder)).select("id")


@_reg.add(_M + "SELECT user_id, count(*) AS memories, count(*) FILTER (tier = 'Working') AS working, count(*) FILTER (tier = 'Session') AS session, count(*) FILTER (tier = 'LongTerm') AS long_term, round(avg(importance::DOUBLE), 6) AS importance FROM m GROUP BY 1")
def stats_memories(spark, folder):
    tier = lambda t: F.count_if(F.col("tier") == t)
    return memories(spark, folder).groupBy("user_id").agg(
        F.count("*").alias("memories"), tier("Working").alias("working"), tier("Session").alias("session"), tier("LongTerm").alias("long_term"), r(F.avg(F.col("importance").cast("double"))).alias("importance")
    )


@_reg.add(f"""WITH {EDGES}, {MEMORIES}, a AS (SELECT user_id, count(*) AS edges, round(avg(strength::DOUBLE), 6) AS strength FROM g GROUP BY 1), b AS (SELECT user_id, count(DISTINCT uuid) AS entities FROM graph_entities GROUP BY 1),
c AS (SELECT user_id, count(DISTINCT episode_id) AS episodes FROM m WHERE episode_id IS NOT NULL GROUP BY 1), u AS (SELECT user_id FROM a UNION SELECT user_id FROM b UNION SELECT user_id FROM c)
SELECT user_id, coalesce(entities, 0) AS entities, coalesce(edges, 0) AS edges, coalesce(episodes, 0) AS episodes, strength FROM u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def stats_graph(spark, folder):
    return rel.graph_stats(table(spark, folder, "graph_entities"), edges(spark, folder), memories(spark, folder, "episode_id is not null")).withColumn("strength", r("strength"))


@_reg.add(f"WITH {EDGES}, x AS (SELECT from_entity AS entity, tier, uuid FROM g UNION SELECT to_entity, tier, uuid FROM g) SELECT entity, count(*) AS edges, count(*) FILTER (tier = 'L1') AS l1, count(*) FILTER (tier = 'L2') AS l2, count(*) FILTER (tier = 'L3') AS l3, round(count(*) FILTER (tier <> 'L1') / count(*)::DOUBLE, 6) AS consolidated FROM x GROUP BY 1")
def stats_entity_density(spark, folder):
    g = edges(spark, folder).select("from_entity", "to_entity", "tier")
    x = g.select(F.explode(F.array_distinct(F.array("from_entity", "to_entity"))).alias("entity"), "tier")
    n = lambda t: F.count_if(F.col("tier") == t)
    return x.groupBy("entity").agg(F.count("*").alias("edges"), n("L1").alias("l1"), n("L2").alias("l2"), n("L3").alias("l3"), r(F.count_if(F.col("tier") != "L1") / F.count("*")).alias("consolidated"))


@_reg.add(_G + "SELECT from_entity AS hub, count(DISTINCT to_entity) AS spokes, round(avg(strength::DOUBLE), 6) AS strength FROM g GROUP BY 1 HAVING count(DISTINCT to_entity) >= 5")
def agg_hubs(spark, folder):
    g = edges(spark, folder).groupBy(F.col("from_entity").alias("hub")).agg(F.countDistinct("to_entity").alias("spokes"), r(F.avg(F.col("strength").cast("double"))).alias("strength"))
    return g.where("spokes >= 5")


@_reg.add(f"""WITH {EDGES}, t AS (SELECT sum(activation_count) + count(*) AS n, sum(activation_count) AS act FROM g), c AS (SELECT DISTINCT ON (uuid) uuid, mention_count AS k FROM graph_entities),
x AS (SELECT g.uuid, activation_count + 1.0::DOUBLE AS f, greatest(a.k, activation_count) + 1.0::DOUBLE AS ma, greatest(b.k, activation_count) + 1.0::DOUBLE AS mb, t.n::DOUBLE AS n FROM g JOIN c a ON a.uuid = from_entity JOIN c b ON b.uuid = to_entity, t WHERE activation_count IS NOT NULL)
SELECT uuid, round(least(greatest(log2(f * n / (ma * mb)) / log2(n / f), -1), 1), 6) AS npmi FROM x""")
def agg_npmi(spark, folder):
    g = edges(spark, folder)
    total = g.agg((F.sum("activation_count") + F.count("*")).alias("n")).first()[0] or 0
    c = fl.once(table(spark, folder, "graph_entities"), "uuid").select("uuid", "mention_count")
    x = g.select("uuid", "from_entity", "to_entity", "activation_count").where("activation_count is not null")
    x = x.join(c.select(F.col("uuid").alias("from_entity"), F.col("mention_count").alias("a")), "from_entity").join(c.select(F.col("uuid").alias("to_entity"), F.col("mention_count").alias("b")), "to_entity")
    return x.select("uuid", r(sc.npmi(F.col("activation_count"), F.col("a"), F.col("b"), F.lit(float(total)))).alias("npmi"))


@_reg.add(f"WITH {FACTS} SELECT fact_type, count(*) AS facts, round(avg(confidence::DOUBLE), 6) AS confidence, sum(support_count) AS support FROM f WHERE purged_at IS NULL GROUP BY 1")
def stats_facts(spark, folder):
    return facts(spark, folder, "purged_at is null").groupBy("fact_type").agg(F.count("*").alias("facts"), r(F.avg(F.col("confidence").cast("double"))).alias("confidence"), F.sum("support_count").alias("support"))


@_reg.add(f"""WITH {FACTS}, x AS (SELECT DISTINCT user_id, id, support_count, confidence, unnest(related_entities) AS entity FROM f), d AS (SELECT user_id, entity, count(*) AS df FROM x WHERE entity IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1),
u AS (SELECT d.* FROM d JOIN t USING (user_id) WHERE df < greatest(5.0, n * 0.2)), p AS (SELECT x.user_id, x.id, any_value(support_count) AS s, any_value(confidence) AS c, arg_min(entity, df || '' || entity) AS bad, min(struct_pack(df := df, entity := entity)).entity AS topic FROM x JOIN u USING (user_id, entity) GROUP BY ALL)
SELECT user_id, topic, count(*) AS facts, sum(s) AS support, round(avg(c::DOUBLE), 6) AS confidence FROM p GROUP BY ALL""".replace("arg_min(entity, df || '' || entity) AS bad, ", ""))
def agg_narratives(spark, folder):
    f = facts(spark, folder).withColumn("confidence", F.col("confidence").cast("double"))
    return rel.narratives(f).select("user_id", "topic", "facts", "support", r("confidence").alias("confidence"))


def _heat():
    rich = sum(((F.coalesce(F.size(c), F.lit(0)) > 0).cast("int") for c in ("tags", "entities")), F.lit(0)) + sum((F.col(c).isNotNull().cast("int") for c in ("episode_id", "robot_id", "parent_id")), F.lit(0))
    days = F.floor(sc.days_between(as_of(), F.col("created_at")))
    return sc.heat(F.col("access_count"), rich, days)


@_reg.add(_M + f"""SELECT id, round(access_count * ln(1 + (coalesce(len(tags), 0) > 0)::INT + (coalesce(len(entities), 0) > 0)::INT + (episode_id IS NOT NULL)::INT + (robot_id IS NOT NULL)::INT + (parent_id IS NOT NULL)::INT)
/ (1 + 0.1 * floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000)), 6) AS heat FROM m WHERE access_count > 0""")
def agg_heat(spark, folder):
    return memories(spark, folder, "access_count > 0").select("id", r(_heat()).alias("heat"))


@_reg.add(f"WITH {MESSAGES} SELECT session_id, count(*) AS messages, count(DISTINCT msg_type) AS kinds, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 AS seconds FROM s GROUP BY 1")
def stats_sessions(spark, folder):
    span = F.floor((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1_000_000)
    return messages(spark, folder).groupBy("session_id").agg(F.count("*").alias("messages"), F.countDistinct("msg_type").alias("kinds"), span.alias("seconds"))


@_reg.add(f"WITH {MESSAGES} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, msg_type, count(*) AS n FROM s GROUP BY ALL")
def agg_hourly(spark, folder):
    return messages(spark, folder).groupBy(F.window("ts", "1 hour").start.alias("h"), "msg_type").agg(F.count("*").alias("n")).select(F.unix_micros("h").alias("hour_us"), "msg_type", "n")


@_reg.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stats_events(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"), r(F.avg("value")).alias("mean"))


@_reg.add(_M + "SELECT coalesce(user_id, 'all') AS user_id, coalesce(tier, 'all') AS tier, count(*) AS n FROM m WHERE tier IS NOT NULL GROUP BY ROLLUP (user_id, tier)")
def agg_rollup(spark, folder):
    return memories(spark, folder, "tier is not null").rollup("user_id", "tier").agg(F.count("*").alias("n")).select(F.coalesce("user_id", F.lit("all")).alias("user_id"), F.coalesce("tier", F.lit("all")).alias("tier"), "n")


@_reg.add(f"""WITH {FACTS}, x AS (SELECT user_id, related_entities, epoch_us(created_at) AS t, id, confidence::DOUBLE AS v FROM f), y AS (SELECT unnest(list_distinct(related_entities)) AS entity, t, id, v FROM x WHERE v IS NOT NULL),
z AS (SELECT entity, list(v ORDER BY t, id) AS l FROM y WHERE entity IS NOT NULL GROUP BY 1) SELECT entity, len(l) AS signals, round(list_reduce(l, lambda a, b: a * 0.8 + b * 0.2), 6) AS ema FROM z""")
def agg_feedback_ema(spark, folder):
    rows = facts(spark, folder, "confidence is not null").select(F.explode(F.array_distinct("related_entities")).alias("entity"), F.struct(F.col("created_at"), F.col("id"), F.col("confidence").cast("double").alias("v")).alias("s")).where("entity is not null")
    lists = rows.groupBy("entity").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return lists.select("entity", F.size("l").alias("signals"), r(rel.ema(F.transform("l", lambda s: s["v"]), 0.2)).alias("ema"))


@_reg.add(f"WITH {MESSAGES}, x AS (SELECT session_id, importance::DOUBLE AS v, row_number() OVER (PARTITION BY session_id ORDER BY ts, msg_id) - 1 AS k FROM s WHERE importance IS NOT NULL) SELECT session_id, count(*) AS signals, round(regr_slope(v, k), 6) AS slope FROM x GROUP BY 1 HAVING count(*) >= 3")
def agg_feedback_trend(spark, folder):
    from pyspark.sql import Window

    x = messages(spark, folder, "importance is not null").select("session_id", F.col("importance").cast("double").alias("v"), (F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "msg_id")) - 1).alias("k"))
    return x.groupBy("session_id").agg(F.count("*").alias("signals"), r(F.regr_slope("v", "k")).alias("slope")).where("signals >= 3")


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT experience_type, date_trunc('month', created_at AT TIME ZONE 'UTC') AS mo, importance FROM m WHERE created_at IS NOT NULL)
SELECT strftime(mo, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (experience_type = 'Error') AS errors, count(*) FILTER (importance > 0.5) AS important FROM x GROUP BY 1""")
def agg_consolidation_report(spark, folder):
    m = memories(spark, folder, "created_at is not null")
    return m.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("experience_type") == "Error").alias("errors"), F.count_if(F.col("importance") > 0.5).alias("important"))


@_reg.add(_M + "SELECT outcome_type, count(*) AS n, round(avg(reward::DOUBLE), 6) AS reward, count(DISTINCT user_id) AS users FROM m WHERE reward IS NOT NULL GROUP BY 1")
def stats_outcomes(spark, folder):
    return memories(spark, folder, "reward is not null").groupBy("outcome_type").agg(F.count("*").alias("n"), r(F.avg(F.col("reward").cast("double"))).alias("reward"), F.countDistinct("user_id").alias("users"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
