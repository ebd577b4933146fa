"""Queries: ranking stages, retrieval modes, triggers, shape analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import filters as fl
from palimpsest.operators import graphs as gr
from palimpsest.operators import ranking as rk
from palimpsest.operators import vectors as vc
from palimpsest.plans.common import EDGES, HOT_TENANT, MEMORIES, MESSAGES, Registry, edges, memories, messages, r
from palimpsest.runtime import table

_reg = Registry()
_M = f"WITH {MEMORIES} "


@_reg.add(_M + "SELECT id, round(CASE WHEN experience_type IN ('Decision', 'Learning') THEN importance::DOUBLE ELSE importance::DOUBLE * 0.7 END, 6) AS score FROM m WHERE importance IS NOT NULL AND experience_type IS NOT NULL")
def rank_prefer_types(spark, folder):
    m = memories(spark, folder, "importance is not null and experience_type is not null")
    return m.select("id", r(rk.prefer_types(F.col("importance").cast("double"), ["Decision", "Learning"])).alias("score"))


@_reg.add(_M + ", x AS (SELECT id, importance::DOUBLE AS v, length(content) / avg(length(content)) OVER (PARTITION BY user_id) AS q, count(*) OVER (PARTITION BY user_id) AS n FROM m WHERE importance IS NOT NULL) SELECT id, round(v * coalesce(CASE WHEN n < 5 THEN 1.0 WHEN q > 1.5 THEN 0.9 WHEN q < 0.8 THEN 1.05 ELSE 1.0 END, 1.0), 6) AS score FROM x")
def rank_length_specificity(spark, folder):
    m = memories(spark, folder, "importance is not null").select("id", "user_id", "content", F.col("importance").cast("double").alias("score"))
    return rk.length_specificity(m, "user_id", "score", "content").select("id", r("score").alias("score"))


@_reg.add(_M + ", x AS (SELECT id, importance::DOUBLE AS v, list_distinct([lower(e.text) for e in entities if e.text is not null]) AS n FROM m WHERE importance IS NOT NULL) SELECT id, round(CASE WHEN coalesce(len(n), 0) = 0 THEN v WHEN len(list_intersect(n, ['merkle tree', 'bloom filter'])) / len(n) < 0.20 THEN v * 0.85 WHEN len(list_intersect(n, ['merkle tree', 'bloom filter'])) / len(n) > 0.50 THEN v * 1.10 ELSE v END, 6) AS score FROM x")
def rank_entity_concentration(spark, folder):
    m = memories(spark, folder, "importance is not null")
    return m.select("id", r(rk.entity_concentration(F.col("importance").cast("double"), F.array(F.lit("merkle tree"), F.lit("bloom filter")))).alias("score"))


@_reg.add(_M + ", x AS (SELECT id, user_id, importance::DOUBLE AS v, coalesce(created_at BETWEEN TIMESTAMPTZ '2024-03-01 00:00:00+00' AND TIMESTAMPTZ '2024-04-01 00:00:00+00', false) AS i FROM m WHERE importance IS NOT NULL), y AS (SELECT *, count(*) FILTER (i) OVER (PARTITION BY user_id) AS n FROM x) SELECT id, round(CASE WHEN n >= 2 AND NOT i THEN v * 0.5 ELSE v END, 6) AS score FROM y")
def rank_time_demotion(spark, folder):
    m = memories(spark, folder, "importance is not null").select("id", "user_id", "created_at", F.col("importance").cast("double").alias("score"))
    low, high = (F.lit(f"2024-0{k}-01 00:00:00+00:00").cast("timestamp") for k in (3, 4))
    return rk.demote_outside(m, "user_id", "score", "created_at", low, high).select("id", r("score").alias("score"))


@_reg.add(_M + "SELECT id, round((contains(lower(coalesce(content, '')), 'robot')::INT * 1.0::DOUBLE + contains(lower(coalesce(content, '')), 'warehouse')::INT * 1.0::DOUBLE + contains(lower(coalesce(content, '')), 'stale')::INT * 0.5::DOUBLE + contains(lower(coalesce(content, '')), 'lost')::INT * 0.2::DOUBLE) / 2.7::DOUBLE, 6) AS score FROM m")
def rank_linguistic_match(spark, folder):
    return memories(spark, folder).select("id", r(rk.linguistic_match(F.col("content"), ["robot", "warehouse"], ["stale"], ["lost"])).alias("score"))


@_reg.add(f"WITH {MESSAGES}, x AS (SELECT session_id, msg_type, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 3.6e9::DOUBLE AS age FROM s) SELECT session_id, round(sum(exp(-age / 720) * CASE WHEN msg_type = 'event' THEN 1.0 ELSE 1.0 END) * 24 / 720, 6) AS velocity, count(*) AS events FROM x WHERE age <= 720 GROUP BY 1")
def rank_learning_velocity(spark, folder):
    m = messages(spark, folder)
    now = F.lit(m.agg(F.max("ts")).first()[0])
    return rk.learning_velocity(m, "session_id", "ts", "msg_type", now, 720.0).select("session_id", r("velocity").alias("velocity"), "events")


@_reg.add("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def trigger_context(spark, folder):
    d = table(spark, folder, "documents")
    tasks = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 3, F.array(F.lit("Map Merger"), F.lit("absent"))).otherwise(F.array(F.lit("absent"))).alias("keywords"), F.lit(1).alias("priority"))
    return rk.context_triggers(tasks, "The retry loop and the map merger stalled in staging").select(F.col("id").alias("doc_id"))


@_reg.add(_M + f""", o AS (SELECT id, parent_id, importance::DOUBLE AS v FROM m), f AS (SELECT * FROM o WHERE ends_with(id, 'a')), e AS (SELECT id, v, 0 AS k FROM f UNION ALL SELECT id, least(v * 1.1, 1), 1 FROM o WHERE id IN (SELECT parent_id FROM f) UNION ALL SELECT id, least(v * 1.05, 1), 2 FROM o WHERE parent_id IN (SELECT id FROM f))
SELECT id, round(arg_min(v, k), 6) AS importance, ['found', 'parent', 'child'][min(k) + 1] AS via FROM e GROUP BY id""")
def expand_hierarchy(spark, folder):
    m = memories(spark, folder)
    return rk.expand_hierarchy(m.where(F.col("id").endswith("a")), m).select("id", r("importance").alias("importance"), "via")


@_reg.add(_M + "SELECT id, round(reward::DOUBLE, 6) AS reward FROM m WHERE reward BETWEEN 0 AND 1 ORDER BY m.reward DESC, created_at DESC, id LIMIT 30")
def mode_action_outcome(spark, folder):
    return rk.by_outcome(memories(spark, folder, "reward >= 0.0 and reward <= 1.0")).limit(30).select("id", r("reward").alias("reward"))


_NEAR = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(h.lat - geo_location[1]) / 2), 2) + cos(radians(geo_location[1])) * cos(radians(h.lat)) * pow(sin(radians(h.lon - geo_location[2]) / 2), 2))))"


@_reg.add(f"WITH {MEMORIES}, h AS (SELECT geo_location[1] AS lat, geo_location[2] AS lon FROM m WHERE len(geo_location) >= 2 ORDER BY id LIMIT 1) SELECT id, round({_NEAR}, 3) AS metres FROM m, h WHERE len(geo_location) >= 2 AND {_NEAR} <= 2000000")
def mode_spatial(spark, folder):
    m = memories(spark, folder)
    centre = m.where(F.size("geo_location") >= 2).agg(F.min_by("geo_location", "id")).first()[0]
    return rk.spatial(m, centre[0], centre[1], 2_000_000.0).select("id", r("metres", 3).alias("metres"))


@_reg.add(_M + "SELECT mission_id, id FROM m WHERE mission_id IS NOT NULL")
def mode_mission(spark, folder):
    return memories(spark, folder, "mission_id is not null").orderBy("mission_id", "created_at", "id").select("mission_id", "id")


@_reg.add(_M + ", x AS (SELECT user_id, experience_type, id, row_number() OVER (PARTITION BY user_id, experience_type ORDER BY importance DESC NULLS LAST, id) AS place FROM m WHERE experience_type IN ('Decision', 'Learning', 'Context', 'Pattern', 'Error')) SELECT user_id, experience_type, id, place FROM x WHERE place <= 3")
def context_summary(spark, folder):
    return rk.context_summary(memories(spark, folder)).select("user_id", "experience_type", "id", "place")


@_reg.add(f"""WITH {MEMORIES}, e AS (SELECT uuid, user_id, name, lower(name) AS low, coalesce(salience::DOUBLE, 0) AS s FROM (SELECT DISTINCT ON (uuid) * FROM graph_entities) WHERE name IS NOT NULL), a AS (SELECT DISTINCT user_id, x.text AS asked FROM (SELECT user_id, unnest(entities) AS x FROM m) WHERE x.text IS NOT NULL),
w AS (SELECT DISTINCT uuid, user_id, name, s, unnest(string_split_regex(low, '[^\\p{{L}}\\p{{Nd}}]+')) AS word FROM e), r AS (SELECT a.user_id, asked, uuid, name, s, CASE WHEN asked = name THEN 1.0 ELSE 0.9 END AS score FROM a JOIN e ON a.user_id = e.user_id AND lower(asked) = low
UNION ALL SELECT a.user_id, asked, uuid, name, s, 0.7 FROM a JOIN w ON a.user_id = w.user_id AND lower(asked) = word WHERE length(asked) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, asked ORDER BY score DESC, s DESC, length(name), uuid) AS n FROM r) SELECT user_id, asked, uuid, name, score::DOUBLE AS score FROM k WHERE n = 1""")
def entity_resolution(spark, folder):
    e = fl.once(table(spark, folder, "graph_entities"), "uuid")
    asked = memories(spark, folder).select("user_id", F.explode("entities").alias("e")).select("user_id", F.col("e.text").alias("asked")).where("asked is not null")
    return rk.resolve_entities(asked, e)


@_reg.add()
def entity_extraction(spark, folder):
    n = memories(spark, folder).select(F.explode(rk.proper_nouns(F.col("content"))).alias("name"))
    return n.groupBy("name").agg(F.count("*").alias("n")).where("n >= 3")


@_reg.add(f"""WITH {EDGES}, t AS (SELECT DISTINCT concat_ws('>', x.from_entity, x.to_entity, y.to_entity) AS gap, x.from_entity AS a, y.to_entity AS c FROM g x JOIN g y ON x.to_entity = y.from_entity WHERE x.from_entity <> y.to_entity AND x.strength::DOUBLE >= 0.7 AND y.strength::DOUBLE >= 0.7 AND NOT EXISTS (SELECT 1 FROM g z WHERE (z.from_entity = x.from_entity AND z.to_entity = y.to_entity) OR (z.from_entity = y.to_entity AND z.to_entity = x.from_entity))),
n AS (SELECT count(*)::DOUBLE AS n FROM t), e AS (SELECT gap, a AS entity FROM t UNION SELECT gap, c FROM t), o AS (SELECT x.gap, count(DISTINCT y.gap) AS k FROM e x JOIN e y ON x.entity = y.entity AND x.gap <> y.gap GROUP BY 1) SELECT t.gap, round(coalesce(k, 0) / n, 6) AS impact FROM t LEFT JOIN o USING (gap), n""")
def gap_impact(spark, folder):
    t = gr.open_triads(edges(spark, folder), 0.7).select(F.concat_ws(">", "a", "b", "c").alias("gap"), F.array("a", "c").alias("entities")).distinct()
    return rk.gap_impact(t).select("gap", r("impact").alias("impact"))


@_reg.add()
def retrieval_competition(spark, folder):
    e = table(spark, folder, "embeddings")
    top = vc.top_k(e, [float(x) for x in e.agg(F.min_by("embedding", "vec_id")).first()[0]], 20)
    c = top.join(e, "vec_id").select(F.lit(1).alias("query"), F.col("vec_id").alias("id"), F.col("similarity").alias("strength"), F.col("embedding").alias("vector"))
    return c.groupBy("query").applyInPandas(lambda p: rk.compete(p, 0.5), "id long, strength double").select("id", r("strength").alias("strength"))  # twenty rows


@_reg.add()
def decay_scale_learning(spark, folder):
    m = memories(spark, folder, "accessed_at is not null").select("user_id", F.unix_micros("accessed_at").alias("us"))
    return m.groupBy("user_id").applyInPandas(rk.decay_scales, "user_id string, scale double")


@_reg.add()
def shape_persistence(spark, folder):
    """When the components of all embeddings merge."""
    return rk.deaths(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).select(r("death").alias("death"))


@_reg.add()
def shape_mapper(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", 0).cast("double").alias("value"), F.col("embedding").alias("vector"))
    return rk.mapper(e, rk.intervals_for(e.count()))


_CALL = "the backup of the retry loop and the privacy review ran in staging"


@_reg.add(f"""WITH {MEMORIES}, v AS (SELECT DISTINCT ON (vec_id) * FROM memory_vectors WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if x IS NULL OR isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0),
q AS (SELECT vector::DOUBLE[] AS q FROM v WHERE model = 'mini-enc-v2' ORDER BY vec_id LIMIT 1), n AS (SELECT memory_id AS id, max(round(list_cosine_similarity(vector::DOUBLE[], q), 9)) AS s FROM v, q WHERE dimensions = len(q) GROUP BY 1),
w AS (SELECT id, coalesce(len([t for t in tags if length(trim(t)) > 0 AND contains('{_CALL}', lower(trim(t)))]) > 0, false) AS by_keyword FROM m) SELECT id, by_keyword FROM w LEFT JOIN n USING (id) WHERE by_keyword OR coalesce(s >= 0.75, false)""")
def trigger_context_match(spark, folder):
    """Memories as tasks, their tags as keywords, the vector of a known memory as that of the context."""
    from palimpsest.operators import recall as rc
    from palimpsest.plans.recalling import _asked_vector

    m = memories(spark, folder)
    tasks = m.select("id", F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.trim(t)).alias("keywords"), F.lit(1).alias("priority"))
    near = rc.by_similarity(m, table(spark, folder, "memory_vectors"), _asked_vector(spark, folder), 1_000_000)
    return rk.context_matches(tasks, _CALL, near).select("id", "by_keyword")


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
