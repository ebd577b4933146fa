"""Queries: facts, their duplicates and contradictions, facts in time, lineage, gaps, feedback, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import filters as fl
from palimpsest.operators import graphs as gr
from palimpsest.operators import knowledge as kn
from palimpsest.operators import mutations as mu
from palimpsest.operators import recall as rc
from palimpsest.operators.vectors import cosine
from palimpsest.plans.common import AS_OF_SQL, EDGES, FACTS, HOT_TENANT, MEMORIES, Registry, as_of, edges, facts, memories, r
from palimpsest.plans.recalling import _IMPORTANT, _USABLE
from palimpsest.plans.relating import _heat
from palimpsest.runtime import table

_reg = Registry()
_M, _G, _F = f"WITH {MEMORIES} ", f"WITH {EDGES} ", f"WITH {FACTS} "
_q = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_l = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_PLANTED = f"""p AS (SELECT id, user_id, fact, related_entities FROM f UNION ALL SELECT id || '~', user_id, 'not ' || fact, related_entities FROM f WHERE ends_with(id, '3') UNION ALL SELECT id || '+', user_id, fact || ' again', related_entities FROM f WHERE ends_with(id, '5')),
o AS (SELECT user_id, fact, list_sort(list_distinct(coalesce(related_entities, []))) AS al, min(id) AS id FROM p WHERE fact IS NOT NULL GROUP BY ALL),
x AS (SELECT *, [w for w in string_split_regex(lower(fact), '[^\\p{{L}}\\p{{N}}]+') if length(w) >= 2] AS w, list_distinct([t for t in string_split_regex(lower(fact), '\\s+') if t <> '']) AS tk,
len([t for t in string_split_regex(lower(fact), '\\s+') if t in {_q(kn.NEGATION_MARKERS)}]) % 2 = 0 AS pos FROM o),
c AS (SELECT a.id, b.id AS id_b, a.pos AS pa, b.pos AS pb, a.tk AS ta, b.tk AS tb, a.w AS wa, b.w AS wb FROM x a JOIN x b ON a.user_id = b.user_id AND a.id < b.id WHERE len(list_intersect(a.al, b.al)) > 0 OR (len(a.al) = 0 AND len(b.al) = 0)),
d AS (SELECT *, round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(wa), lambda v: (len(list_filter(wa, lambda z: z = v)) * len(list_filter(wb, lambda z: z = v)))::DOUBLE))
/ (sqrt(list_sum(list_transform(list_distinct(wa), lambda v: pow(len(list_filter(wa, lambda z: z = v)), 2)))) * sqrt(list_sum(list_transform(list_distinct(wb), lambda v: pow(len(list_filter(wb, lambda z: z = v)), 2))))) END, 9) AS cosine FROM c)"""


def _planted(spark, folder):
    """The facts with a negated copy of some and a reworded copy of others, so that there is something to find."""
    f = facts(spark, folder).select("id", "user_id", "fact", "related_entities")
    negated = f.where(F.col("id").endswith("3")).select(F.concat("id", F.lit("~")), "user_id", F.concat(F.lit("not "), "fact"), "related_entities")
    return f.union(negated).union(f.where(F.col("id").endswith("5")).select(F.concat("id", F.lit("+")), "user_id", F.concat("fact", F.lit(" again")), "related_entities"))


@_reg.add(f"WITH {FACTS}, {_PLANTED} SELECT id, id_b, round(cosine, 6) AS cosine FROM d WHERE pa <> pb AND cosine >= 0.8")
def facts_contradicting(spark, folder):
    return kn.contradictions(_planted(spark, folder)).select("id", "id_b", r("cosine").alias("cosine"))


@_reg.add(f"""WITH {FACTS}, {_PLANTED}, n AS (SELECT * FROM d WHERE pa = pb AND cosine >= 0.8 AND len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))::DOUBLE >= 0.3),
b AS (SELECT id, id_b AS match, cosine FROM n UNION ALL SELECT id_b, id, cosine FROM n) SELECT id, match, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, match) AS k FROM b) WHERE k = 1""")
def facts_duplicate(spark, folder):
    return kn.duplicate_facts(_planted(spark, folder)).select("id", "match", r("cosine").alias("cosine"))


@_reg.add()
def facts_consolidated(spark, folder):
    """Memories of all types, with every two of their entities. Tested against brute force on a fixture."""
    old = table(spark, folder, "memories").where(F.col("created_at") <= as_of() - F.make_dt_interval(days=F.lit(kn.HOT_AGE_DAYS)))
    rows = fl.once(old.select("id", "user_id", "content", "importance", "created_at", _heat().alias("heat"), F.transform("entities", lambda e: e["text"]).alias("names")))
    return kn.consolidated(rows, as_of(), heat=F.col("heat"), names=F.col("names")).withColumn("confidence", r("confidence"))


_TOLD = f"""s AS (SELECT id, user_id, created_at, [e.text for e in entities if e.text is not null] AS al, [trim(x) for x in string_split_regex(content, '[.!?]') if trim(x) <> ''] AS l FROM m WHERE created_at IS NOT NULL AND content IS NOT NULL),
t AS (SELECT id, user_id, created_at, al, unnest(l) AS event, unnest(range(len(l))) AS place FROM s), u AS (SELECT *, [a for a in al if contains(lower(event), lower(a))][1] AS entity, TRY_CAST(regexp_extract(event, '\\b((?:19|20)\\d{{2}})\\b', 1) AS INT) AS y,
[p for p in {_l(kn.PLANNING)} if contains(lower(event), p)] AS pl, [p for p in {_l(kn.OCCURRED)} if contains(lower(event), p)] AS oc, [p for p in {_l(kn.PAST_VERBS)} if contains(lower(event), p)] AS vb FROM t),
w AS (SELECT *, CASE WHEN len(pl) > 0 THEN 'Planned' WHEN len(oc) + len(vb) > 0 THEN 'Occurred' WHEN y < year(created_at AT TIME ZONE 'UTC') THEN 'Historical' END AS event_type FROM u),
k AS (SELECT *, CASE event_type WHEN 'Planned' THEN 0.8::DOUBLE WHEN 'Occurred' THEN 0.75 ELSE 0.85 END AS confidence, CASE WHEN event_type = 'Historical' THEN y::VARCHAR ELSE list_concat(pl, oc)[1] END AS relative_time FROM w WHERE entity IS NOT NULL AND event_type IS NOT NULL)"""


@_reg.add(f"WITH {MEMORIES}, {_TOLD} SELECT id, place, entity, event, event_type, relative_time, round(confidence, 6) AS confidence FROM k")
def facts_temporal(spark, folder):
    return kn.temporal_facts(memories(spark, folder)).select("id", "place", "entity", "event", "event_type", "relative_time", r("confidence").alias("confidence"))


@_reg.add(f"WITH {MEMORIES}, {_TOLD} SELECT id, place, event_type FROM k WHERE created_at <= {AS_OF_SQL} ORDER BY confidence DESC, created_at DESC, id, place LIMIT 50")
def as_of_temporal_facts(spark, folder):
    return kn.told_by(kn.temporal_facts(memories(spark, folder)), as_of(), 50).select("id", "place", "event_type")


_ANTI = "[m for m in {l} if contains(lower({c}), m)]".replace("{l}", _l(kn.OPPOSITION_MARKERS))
_CROSS = " OR ".join(
    f"(contains(lower(a.fact), '{p}') AND contains(lower(b.fact), '{n}') AND NOT contains(lower(a.fact), '{n}') AND NOT contains(lower(b.fact), '{p}')) OR (contains(lower(a.fact), '{n}') AND contains(lower(b.fact), '{p}') AND NOT contains(lower(a.fact), '{p}') AND NOT contains(lower(b.fact), '{n}'))"
    for p, n in ((p.replace("'", "''"), n.replace("'", "''")) for p, n in kn.OPPOSITES)
)


@_reg.add(f"WITH {FACTS} SELECT a.id, b.id AS next, (len({_ANTI.format(c='a.fact')}) > 0) <> (len({_ANTI.format(c='b.fact')}) > 0) OR {_CROSS} AS opposed FROM f a JOIN f b ON b.id = a.superseded_by")
def facts_opposed(spark, folder):
    """Each superseded fact against the one that took its place."""
    f = facts(spark, folder).select("id", "fact", "superseded_by")
    b = f.select(F.col("id").alias("superseded_by"), F.col("fact").alias("new"))
    return f.join(b, "superseded_by").select("id", F.col("superseded_by").alias("next"), kn.opposed(F.col("fact"), F.col("new")).alias("opposed"))


@_reg.add(f"""WITH {FACTS}, x AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(last_reinforced)) / 86400000000.0::DOUBLE AS d FROM f), y AS (SELECT *, confidence::DOUBLE * CASE WHEN d <= 90 THEN 1.0 ELSE pow(0.5::DOUBLE, (d - 90) / (180.0::DOUBLE + 30.0::DOUBLE * support_count)) END AS left_over FROM x)
SELECT id, epoch_us(CASE WHEN purged_at IS NULL AND left_over < 0.4 THEN {AS_OF_SQL} ELSE purged_at END) AS purged_us, CASE WHEN purged_at IS NULL AND left_over < 0.4 THEN 'decayed' ELSE purge_reason END AS purge_reason FROM y""")
def mutate_purge_facts(spark, folder):
    return mu.purge_facts(facts(spark, folder), as_of(), 0.4).select("id", F.unix_micros("purged_at").alias("purged_us"), "purge_reason")


@_reg.add("WITH m AS (SELECT DISTINCT ON (id) * FROM memories), g AS (SELECT DISTINCT unnest(relations.related_memories) AS cause, id AS effect FROM m) SELECT cause, count(DISTINCT effect) AS branches FROM g WHERE cause IS NOT NULL GROUP BY 1 HAVING count(DISTINCT effect) > 1")
def lineage_branches(spark, folder):
    cites = memories(spark, folder).select(F.explode(F.array_distinct("relations.related_memories")).alias("cause"), F.col("id").alias("effect"), F.lit("cites").alias("relation")).where("cause is not null")
    return kn.branches(cites).select("cause", "branches")


@_reg.add("WITH m AS (SELECT DISTINCT ON (id) * FROM memories), l AS (SELECT DISTINCT id, unnest(relations.related_memories) AS cause FROM m) SELECT 'cites' AS relation, CASE WHEN cause IN (SELECT id FROM m) THEN 'known' ELSE 'forgotten' END AS source, count(*) AS edges, round(avg(CASE WHEN cause IN (SELECT id FROM m) THEN 1.0 ELSE 0.5 END), 6) AS confidence FROM l WHERE cause IS NOT NULL GROUP BY ALL")
def lineage_stats(spark, folder):
    m = memories(spark, folder)
    cites = m.select(F.col("id").alias("effect"), F.explode(F.array_distinct("relations.related_memories")).alias("cause")).where("cause is not null")
    known = cites.join(m.select(F.col("id").alias("cause"), F.lit(True).alias("k")), "cause", "left")
    e = known.select("cause", "effect", F.lit("cites").alias("relation"), F.when(F.col("k"), "known").otherwise("forgotten").alias("source"), F.when(F.col("k"), 1.0).otherwise(0.5).alias("confidence"))
    return kn.lineage_stats(e).withColumn("confidence", r("confidence"))


@_reg.add("""WITH m AS (SELECT DISTINCT ON (id) * FROM memories), g AS (SELECT parent_id AS cause, id AS effect FROM m WHERE parent_id IS NOT NULL)
SELECT cause, effect, CASE WHEN ends_with(effect, '7') THEN 'supersedes' ELSE 'contains' END AS relation, CASE WHEN ends_with(effect, '7') THEN 'explicit' WHEN ends_with(effect, '5') THEN 'confirmed' ELSE 'inferred' END AS source, CASE WHEN right(effect, 1) IN ('5', '7') THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM g WHERE NOT ends_with(effect, '3')
UNION ALL SELECT 'root', min(id), 'branch', 'explicit', 1.0 FROM m""")
def lineage_edits(spark, folder):
    m = memories(spark, folder)
    e = m.where("parent_id is not null").select(F.col("parent_id").alias("cause"), F.col("id").alias("effect"), F.lit("contains").alias("relation"), F.lit("inferred").alias("source"), F.lit(0.6).alias("confidence"))
    of = lambda end, action, relation: e.where(F.col("effect").endswith(end)).select(F.lit(action).alias("action"), "cause", "effect", F.lit(relation).alias("relation"))
    branch = m.agg(F.min("id").alias("effect")).select(F.lit("branch"), F.lit("root"), "effect", F.lit("branch"))
    return kn.lineage_edited(e, of("3", "reject", None).union(of("5", "confirm", None)).union(of("7", "add", "supersedes")).union(branch))


@_reg.add(_G + """, e AS (SELECT uuid, max(coalesce(salience::DOUBLE, 0)) AS s FROM graph_entities GROUP BY 1), t AS (SELECT x.from_entity AS a, x.to_entity AS b, y.to_entity AS c, x.strength::DOUBLE + y.strength::DOUBLE AS w FROM g x JOIN g y ON x.to_entity = y.from_entity WHERE x.from_entity <> y.to_entity AND x.strength::DOUBLE >= 0.6 AND y.strength::DOUBLE >= 0.6
AND NOT EXISTS (SELECT 1 FROM g z WHERE (z.from_entity = x.from_entity AND z.to_entity = y.to_entity) OR (z.from_entity = y.to_entity AND z.to_entity = x.from_entity))),
s AS (SELECT DISTINCT from_entity AS hub, to_entity AS spoke FROM g WHERE from_entity <> to_entity), h AS (SELECT hub, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT DISTINCT least(from_entity, to_entity) AS x, greatest(from_entity, to_entity) AS y FROM g WHERE from_entity <> to_entity),
l AS (SELECT a.hub, count(*) AS k FROM p JOIN s a ON a.spoke = p.x JOIN s b ON b.spoke = p.y AND b.hub = a.hub GROUP BY 1), q AS (SELECT from_entity AS hub, avg(strength::DOUBLE) AS w FROM g GROUP BY 1),
d AS (SELECT DISTINCT from_entity AS s, to_entity AS d FROM g WHERE strength >= 0.5), r AS (SELECT x.s AS a, x.d AS b, y.d AS d FROM d x JOIN d y ON x.d = y.s WHERE x.s <> y.d AND x.s <> x.d AND x.d <> y.d)
SELECT 'triad' AS kind, concat_ws(':', a, b, c) AS key, a AS missing_from, c AS missing_to, round(least(greatest(w / 2 * 0.4::DOUBLE + 0.5::DOUBLE * 0.4 + (ea.s + ec.s) / 2 * 0.2::DOUBLE, 0), 1), 6) AS confidence FROM t JOIN e ea ON ea.uuid = a JOIN e ec ON ec.uuid = c
UNION ALL SELECT 'diamond', concat_ws(':', r.a, r.b, z.b, r.d), r.b, z.b, 0.7 FROM r JOIN r z ON r.a = z.a AND r.d = z.d AND r.b < z.b WHERE NOT EXISTS (SELECT 1 FROM g y WHERE (y.from_entity = r.b AND y.to_entity = z.b) OR (y.from_entity = z.b AND y.to_entity = r.b))
UNION ALL SELECT 'star', h.hub, NULL, NULL, round((n * (n - 1) / 2.0::DOUBLE - coalesce(k, 0)) / greatest(n * (n - 1) / 2.0::DOUBLE, 1) * q.w, 6) FROM h LEFT JOIN l USING (hub) JOIN q USING (hub) WHERE coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE) <= 0.3""")
def gap_detection(spark, folder):
    g = edges(spark, folder)
    e = table(spark, folder, "graph_entities")
    return kn.gaps(gr.open_triads(g, 0.6), gr.diamond_gaps(g, 0.5), gr.star_gaps(g, 5, 0.3), e, g).withColumn("confidence", r("confidence"))


@_reg.add()
def feedback_momentum(spark, folder):
    """Rewards of memories as signals of their episode's first memory; tested against a plain fold."""
    m = memories(spark, folder, "reward is not null and episode_id is not null")
    return kn.momentum(m.select(F.col("episode_id").alias("id"), F.col("experience_type").alias("kind"), F.col("created_at").alias("at"), F.col("reward").alias("value"), F.coalesce("importance", F.lit(0.5)).alias("confidence")), as_of()).select("id", "signals", r("ema").alias("ema"), r("stability").alias("stability"), r("decayed").alias("decayed"))


@_reg.add(f"""WITH {MEMORIES}, o AS (SELECT id, CASE outcome_type WHEN 'success' THEN 'helpful' WHEN 'failure' THEN 'misleading' ELSE 'neutral' END AS outcome FROM m WHERE outcome_type IS NOT NULL), c AS (SELECT id, count(*) AS n, count(*) FILTER (outcome = 'helpful') AS up, count(*) FILTER (outcome = 'misleading') AS down FROM o GROUP BY 1),
x AS (SELECT m.id, coalesce(n, 0) AS n, coalesce(down, 0) AS down, access_count, least(coalesce(importance::DOUBLE, 0) + 0.025::DOUBLE * coalesce(up, 0), 1) * pow(0.9::DOUBLE, coalesce(down, 0)) AS v FROM m LEFT JOIN c ON c.id = m.id) SELECT id, round(CASE WHEN down > 0 THEN greatest(v, 0.05) ELSE v END, 6) AS importance, coalesce(access_count, 0) + n AS access_count FROM x""")
def mutate_reinforce_recall(spark, folder):
    m = memories(spark, folder)
    o = m.where("outcome_type is not null").select("id", F.when(F.col("outcome_type") == "success", "helpful").when(F.col("outcome_type") == "failure", "misleading").otherwise("neutral").alias("outcome"))
    return kn.reinforced(m, o).withColumn("importance", r("importance"))


@_reg.add(f"""WITH {MEMORIES}, {_USABLE}, c AS (SELECT m.user_id, m.created_at AS moment, v.vec_id AS id, vector::DOUBLE[] AS v FROM v JOIN m ON m.id = v.memory_id WHERE model = 'mini-enc-v2'), t AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY moment NULLS FIRST, id) AS b FROM c),
s AS (SELECT id, round(list_cosine_similarity(v, b), 9) AS similarity FROM t WHERE b IS NOT NULL) SELECT id, round(similarity, 6) AS similarity, similarity > 0.8 AS repeated, similarity < 0.3 AS changed FROM s""")
def context_turns(spark, folder):
    v = rc.usable_vectors(table(spark, folder, "memory_vectors").where("model = 'mini-enc-v2'")).select("vec_id", "memory_id", "vector")
    c = v.join(memories(spark, folder).select("id", "user_id", "created_at"), F.col("memory_id") == F.col("id")).select("user_id", F.col("created_at").alias("at"), F.col("vec_id").alias("id"), "vector")
    return kn.context_turns(c, cosine(F.col("vector"), F.col("before"))).withColumn("similarity", r("similarity"))


@_reg.add(_M + f""", x AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000.0::DOUBLE AS d, coalesce(importance::DOUBLE, 0) AS v FROM m) SELECT id, CASE WHEN tier = 'Working' AND round(v, 6) >= 0.35 AND d * 86400 >= 1800 THEN 'Session' WHEN tier = 'Session' AND round(v, 6) >= 0.5 AND d * 86400 >= 86400 THEN 'LongTerm' ELSE tier END AS tier,
CASE WHEN coalesce(valid_until < {AS_OF_SQL}, false) OR coalesce(d > 90 AND v < 0.2 AND coalesce(access_count, 0) = 0, false) THEN 'pruned' WHEN d >= 0 AND d <= 14 AND v >= 0.3 THEN 'replay' ELSE 'kept' END AS fate FROM x""")
def mutate_maintenance(spark, folder):
    return kn.maintained(memories(spark, folder), as_of()).select("id", "tier", "fate")


@_reg.add(_M + "SELECT id, CASE WHEN ends_with(id, '1') THEN 'LongTerm' ELSE tier END AS tier, CASE WHEN ends_with(id, '2') THEN (SELECT min(id) FROM m) ELSE parent_id END AS parent_id, ends_with(id, '4') AS anchored FROM m")
def mutate_assign(spark, folder):
    m = memories(spark, folder)
    root = table(spark, folder, "memories").agg(F.min("id")).first()[0]
    changes = m.select("id", F.when(F.col("id").endswith("1"), "LongTerm").alias("tier"), F.when(F.col("id").endswith("2"), root).alias("parent_id"), F.when(F.col("id").endswith("4"), True).alias("anchored"))
    return mu.assigned(m.withColumn("anchored", F.lit(False)), changes, ["tier", "parent_id", "anchored"]).select("id", "tier", "parent_id", "anchored")


@_reg.add(_M + f", h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY id) AS k FROM m WHERE content IS NOT NULL AND created_at >= {AS_OF_SQL}) WHERE k = 1 AND sha256(content) NOT IN (SELECT sha256(content) FROM m WHERE content IS NOT NULL AND created_at < {AS_OF_SQL})) SELECT id, round({_IMPORTANT}, 6) AS importance FROM h")
def mutate_remember_enriched(spark, folder):
    """What came after the reference time, remembered on top of what was there before: new contents only, with importance and dates."""
    m = memories(spark, folder, "content is not null")
    old, new = m.where(F.col("created_at") < as_of()), m.where(F.col("created_at") >= as_of())
    return mu.remember_enriched(old, new).select("id", r("importance").alias("importance"))


@_reg.add(f"WITH {_USABLE} SELECT model, count(*) AS vectors, count(*) FILTER (abs(list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) - 1) > 0.001) AS rescaled, round(sum(abs(vector[1]::DOUBLE) / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[]))), 4) AS first FROM v GROUP BY 1")
def vector_rebuild(spark, folder):
    from palimpsest.operators.vectors import norm

    v = rc.usable_vectors(table(spark, folder, "memory_vectors")).withColumn("norm", norm(F.col("vector")))
    return v.groupBy("model").agg(F.count("*").alias("vectors"), F.count_if(F.abs(F.col("norm") * F.col("norm") - 1) > 0.001).alias("rescaled"), r(F.sum(F.abs(F.get("vector", 0).cast("double")) / F.col("norm")), 4).alias("first"))


@_reg.add("SELECT source, count(*) AS files, sum(n_chars) AS chars, max(n_chars) AS largest, count(DISTINCT user_id) AS users FROM documents GROUP BY 1")
def stats_files(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"), F.countDistinct("user_id").alias("users"))


@_reg.add(f"WITH {MEMORIES} SELECT user_id, count(*) AS writable FROM m WHERE user_id = '{HOT_TENANT}' OR (user_id = 'usr_0000002') GROUP BY 1")
def acl_writable(spark, folder):
    m = memories(spark, folder)
    grants = spark.createDataFrame([("usr_0000002", HOT_TENANT, None, "write"), ("usr_0000003", HOT_TENANT, None, "read")], "owner string, viewer string, memory_id string, right string")
    return fl.writable(m, grants, HOT_TENANT).groupBy("user_id").agg(F.count("*").alias("writable"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
