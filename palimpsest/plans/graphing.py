"""Queries: graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators import filters as fl
from palimpsest.operators import graphs as gr
from palimpsest.operators import relations as rel
from palimpsest.operators.components import connected_components
from palimpsest.plans.common import AS_OF_SQL, EDGES, MEMORIES, Registry, as_of, edges, memories, r
from palimpsest.runtime import table

_reg = Registry()
_G = f"WITH {EDGES} "
_U = f"""WITH RECURSIVE {EDGES}, u0 AS (SELECT from_entity AS src, to_entity AS dst, strength::DOUBLE AS w FROM g UNION ALL SELECT to_entity, from_entity, strength::DOUBLE FROM g WHERE from_entity <> to_entity), u AS (SELECT src, dst, max(w) AS w FROM u0 GROUP BY ALL)"""
_START = "(SELECT min(uuid) FROM graph_entities)"


def _start(spark, folder):
    return table(spark, folder, "graph_entities").agg(F.min("uuid").alias("start"))


@_reg.add(_U + " SELECT src, list(DISTINCT dst ORDER BY dst) AS neighbours FROM u WHERE w >= 0.2 GROUP BY 1")
def graph_adjacency(spark, folder):
    return gr.adjacency(edges(spark, folder), 0.2)


@_reg.add(_G + """SELECT x.from_entity AS a, x.to_entity AS b, y.to_entity AS c, round(x.strength::DOUBLE + y.strength::DOUBLE, 6) AS strength FROM g x JOIN g y ON x.to_entity = y.from_entity WHERE x.from_entity <> y.to_entity AND x.strength::DOUBLE >= 0.6 AND y.strength::DOUBLE >= 0.6
AND NOT EXISTS (SELECT 1 FROM g z WHERE (z.from_entity = x.from_entity AND z.to_entity = y.to_entity) OR (z.from_entity = y.to_entity AND z.to_entity = x.from_entity))""")
def graph_open_triads(spark, folder):
    return gr.open_triads(edges(spark, folder), 0.6).select("a", "b", "c", r("strength").alias("strength"))


@_reg.add(_G + """, e AS (SELECT DISTINCT from_entity AS s, to_entity AS d FROM g WHERE strength >= 0.3), p AS (SELECT x.s AS a, x.d AS b, y.d AS d FROM e x JOIN e y ON x.d = y.s WHERE x.s <> y.d AND x.s <> x.d AND x.d <> y.d)
SELECT p.a, p.b, q.b AS c, p.d FROM p JOIN p q ON p.a = q.a AND p.d = q.d AND p.b < q.b WHERE NOT EXISTS (SELECT 1 FROM g z WHERE (z.from_entity = p.b AND z.to_entity = q.b) OR (z.from_entity = q.b AND z.to_entity = p.b))""")
def graph_diamond_gaps(spark, folder):
    return gr.diamond_gaps(edges(spark, folder), 0.3)


@_reg.add(_G + """, s AS (SELECT DISTINCT from_entity AS hub, to_entity AS spoke FROM g WHERE from_entity <> to_entity), h AS (SELECT hub, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT DISTINCT least(from_entity, to_entity) AS x, greatest(from_entity, to_entity) AS y FROM g WHERE from_entity <> to_entity),
l AS (SELECT a.hub, count(*) AS k FROM p JOIN s a ON a.spoke = p.x JOIN s b ON b.spoke = p.y AND b.hub = a.hub GROUP BY 1)
SELECT h.hub, n AS spokes, coalesce(k, 0) AS linked, round(coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE), 6) AS connectivity FROM h LEFT JOIN l USING (hub) WHERE coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE) <= 0.3""")
def graph_star_gaps(spark, folder):
    return gr.star_gaps(edges(spark, folder), 5, 0.3).select("hub", "spokes", "linked", r("connectivity").alias("connectivity"))


@_reg.add(_U + " SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM u) WHERE rank <= 3")
def graph_strongest_edges(spark, folder):
    return gr.strongest_edges(edges(spark, folder), 3).select("src", "dst", "rank")


@_reg.add(_U + f", t AS (SELECT {_START} AS node, 0 AS hop UNION SELECT u.dst, hop + 1 FROM t JOIN u ON u.src = t.node WHERE hop < 3) SELECT node, min(hop) AS hop FROM t GROUP BY 1")
def graph_bfs(spark, folder):
    return gr.reach(edges(spark, folder), _start(spark, folder), 3).select("node", "hop")


@_reg.add(_U + f", t AS (SELECT {_START} AS node, 0 AS hop, 1.0::DOUBLE AS score UNION SELECT u.dst, hop + 1, score * w FROM t JOIN u ON u.src = t.node AND u.src <> u.dst WHERE hop < 3) SELECT node, round(max(score), 6) AS score FROM t GROUP BY 1")
def graph_best_paths(spark, folder):
    return gr.best_paths(edges(spark, folder), _start(spark, folder), 3).select("node", r("score").alias("score"))


@_reg.add(_U + """, e AS (SELECT min(uuid) AS a FROM graph_entities GROUP BY user_id), pr AS (SELECT min(uuid) AS a, max(uuid) AS b FROM graph_entities GROUP BY user_id),
t AS (SELECT a AS start, a AS node, 0 AS hop FROM pr UNION SELECT start, u.dst, hop + 1 FROM t JOIN u ON u.src = t.node WHERE hop < 4) SELECT a, b, min(hop) AS hops FROM pr JOIN t ON t.start = a AND t.node = b GROUP BY ALL""")
def graph_meeting_paths(spark, folder):
    pairs = table(spark, folder, "graph_entities").groupBy("user_id").agg(F.min("uuid").alias("a"), F.max("uuid").alias("b")).select("a", "b")
    return gr.meeting_paths(edges(spark, folder), pairs, 4)


_STEP = "SELECT {a} AS s, {b} AS d, max(strength::DOUBLE) AS w FROM g WHERE relation_type = '{r}' AND strength >= 0.2 AND invalidated_at IS NULL AND from_entity <> to_entity GROUP BY ALL"


@_reg.add(_G + f", x AS ({_STEP.format(a='from_entity', b='to_entity', r='RelatedTo')}), y AS ({_STEP.format(a='to_entity', b='from_entity', r='RelatedTo')}) SELECT [x.s, x.d, y.d] AS path, round(x.w * y.w, 6) AS score FROM x JOIN y ON x.d = y.s WHERE y.d <> x.s AND y.d <> x.d")
def graph_pattern(spark, folder):
    return gr.match_pattern(edges(spark, folder), [("RelatedTo", True), ("RelatedTo", False)], 0.2).select("path", r("score").alias("score"))


@_reg.add(_U + f""", d AS (SELECT src, count(*) AS k FROM u WHERE src <> dst GROUP BY 1), l AS (SELECT u.src, dst, w / sqrt(1.0::DOUBLE + k) AS w FROM u JOIN d USING (src) WHERE u.src <> dst), a0 AS (SELECT {_START} AS node, 1.0::DOUBLE AS a),
a1 AS (SELECT dst AS node, sum(a * exp(-0.5::DOUBLE) * w) AS a FROM a0 JOIN l ON node = src GROUP BY 1 HAVING sum(a * exp(-0.5::DOUBLE) * w) >= 0.005), a2 AS (SELECT dst AS node, sum(a * exp(-1.0::DOUBLE) * w) AS a FROM a1 JOIN l ON node = src GROUP BY 1 HAVING sum(a * exp(-1.0::DOUBLE) * w) >= 0.005)
SELECT node, round(sum(a), 6) AS activation FROM (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2) GROUP BY 1""")
def graph_spread(spark, folder):
    seeds = _start(spark, folder).select(F.col("start").alias("node"), F.lit(1.0).alias("activation"))
    return gr.spread(edges(spark, folder), seeds, 2).select("node", r("activation").alias("activation"))


@_reg.add()
def graph_spread_both(spark, folder):
    e = table(spark, folder, "graph_entities")
    one, two = (e.agg(f("uuid").alias("node")).withColumn("activation", F.lit(1.0)) for f in (F.min, F.max))
    return gr.spread_both(edges(spark, folder), one, two).select("node", r("activation").alias("activation"))


@_reg.add(_U + ", c AS (SELECT src AS node, src AS reach FROM u UNION SELECT c.node, u.dst FROM c JOIN u ON u.src = c.reach) SELECT node, min(reach) AS component FROM c GROUP BY 1")
def graph_components(spark, folder):
    return connected_components(edges(spark, folder), "from_entity", "to_entity")


@_reg.add()
def graph_label_propagation(spark, folder):
    return gr.label_propagation(edges(spark, folder), 4)


_HOURS = f"floor((epoch_us({AS_OF_SQL}) - epoch_us(last_activated)) / 1000000) / 3600.0::DOUBLE"
_SLOW = "CASE ltp_status WHEN 'Burst' THEN 0.5::DOUBLE WHEN 'Weekly' THEN 0.3 WHEN 'Full' THEN 0.1 ELSE 1.0 END"
_RATE = "CASE tier WHEN 'L1' THEN 0.029::DOUBLE WHEN 'L2' THEN 0.031::DOUBLE / 24 ELSE 0.02::DOUBLE / 720 END"
_DEC = f"CASE WHEN {_HOURS} <= 0 THEN 1.0::DOUBLE ELSE greatest(exp(-({_RATE}) * ({_SLOW}) * {_HOURS}), 0.001) END"


def _hours():
    return F.floor((F.unix_micros(as_of()) - F.unix_micros("last_activated")) / 1_000_000) / 3600.0


@_reg.add(_G + f"SELECT uuid, round(greatest(strength::DOUBLE * {_DEC}, 0.01), 6) AS effective FROM g WHERE last_activated IS NOT NULL AND strength IS NOT NULL")
def graph_effective_strength(spark, folder):
    g = edges(spark, folder, "last_activated is not null and strength is not null")
    return g.select("uuid", r(sc.effective_strength(F.col("strength"), _hours(), F.col("tier"), F.col("ltp_status"))).alias("effective"))


@_reg.add(_G + f""", x AS (SELECT uuid, from_entity, to_entity, coalesce({_HOURS} > CASE tier WHEN 'L1' THEN 48.0 WHEN 'L2' THEN 720.0 ELSE 87600.0 END / ({_SLOW}) AND {_DEC} < CASE tier WHEN 'L1' THEN 0.1 WHEN 'L2' THEN 0.2 ELSE 0.3 END, false) AS prune FROM g),
k AS (SELECT from_entity AS e FROM x WHERE NOT prune UNION SELECT to_entity FROM x WHERE NOT prune) SELECT (SELECT count(*) FROM x WHERE prune) AS pruned, (SELECT count(DISTINCT uuid) FROM graph_entities WHERE uuid NOT IN (SELECT e FROM k)) AS orphans""")
def graph_decay_sweep(spark, folder):
    x = edges(spark, folder).withColumn("prune", F.coalesce(sc.edge_prunable(_hours(), F.col("tier"), F.col("ltp_status")), F.lit(False)))
    kept = x.where("not prune").select(F.explode(F.array("from_entity", "to_entity")).alias("uuid")).distinct()
    orphans = table(spark, folder, "graph_entities").select("uuid").distinct().join(kept, "uuid", "left_anti").count()
    return x.agg(F.count_if("prune").alias("pruned")).withColumn("orphans", F.lit(orphans).cast("long"))


@_reg.add(_G + "SELECT uuid, round(CASE WHEN tier = 'L1' THEN 0.0::DOUBLE ELSE activation_count / 10.0::DOUBLE * 0.5 + strength::DOUBLE / (CASE WHEN tier = 'L2' THEN 0.65::DOUBLE ELSE 0.80 END) * 0.5 + coalesce(entity_confidence::DOUBLE, 0.5) * 0.3 END, 6) AS readiness FROM g")
def graph_ltp_readiness(spark, folder):
    return edges(spark, folder).select("uuid", r(sc.ltp_readiness(F.col("tier"), F.col("activation_count"), F.col("strength"), F.col("entity_confidence"))).alias("readiness"))


@_reg.add(_G + ", c AS (SELECT DISTINCT ON (uuid) uuid, pii_classification AS p FROM graph_entities) SELECT g.uuid FROM g JOIN c a ON a.uuid = from_entity JOIN c b ON b.uuid = to_entity WHERE tier = 'L3' AND a.p IS NULL AND b.p IS NULL")
def graph_collective_export(spark, folder):
    c = fl.once(table(spark, folder, "graph_entities"), "uuid").where("pii_classification is null").select("uuid")
    g = edges(spark, folder, "tier = 'L3'")
    return g.join(c.select(F.col("uuid").alias("from_entity")), "from_entity", "left_semi").join(c.select(F.col("uuid").alias("to_entity")), "to_entity", "left_semi").select("uuid")


@_reg.add("WITH e AS (SELECT DISTINCT ON (uuid) * FROM graph_entities) SELECT user_id, lower(trim(name)) AS name, min(uuid) AS uuid, sum(mention_count) AS mentions, round(least(max(salience)::DOUBLE * (1 + 0.1 * ln(greatest(sum(mention_count), 1))), 1), 6) AS salience FROM e WHERE name IS NOT NULL GROUP BY ALL")
def graph_entity_upsert(spark, folder):
    e = gr.upsert_entities(fl.once(table(spark, folder, "graph_entities"), "uuid"))
    return e.select("user_id", "name", "uuid", "mentions", r("salience").alias("salience"))


@_reg.add(_G + """, x AS (SELECT user_id, least(from_entity, to_entity) AS a, greatest(from_entity, to_entity) AS b, relation_type, list(coalesce(strength::DOUBLE, 0) ORDER BY created_at NULLS FIRST, uuid) AS l, sum(coalesce(activation_count, 0)) AS activations, count(*) AS merged FROM g GROUP BY ALL)
SELECT user_id, a, b, relation_type, activations, merged, round(1 - (1 - l[1]) * pow(0.9::DOUBLE, merged - 1), 6) AS strength FROM x""")
def graph_edge_upsert(spark, folder):
    return gr.upsert_edges(edges(spark, folder)).withColumn("strength", r("strength"))


@_reg.add(f"""WITH RECURSIVE {MEMORIES}, l AS (SELECT DISTINCT id AS node, parent_id AS ancestor FROM m WHERE parent_id IS NOT NULL), t AS (SELECT node, ancestor, 1 AS distance FROM l UNION SELECT t.node, l.ancestor, distance + 1 FROM t JOIN l ON l.node = t.ancestor WHERE distance < 8 AND l.ancestor <> t.node)
SELECT node, ancestor, min(distance) AS distance FROM t GROUP BY ALL""")
def hierarchy_ancestors(spark, folder):
    return gr.ancestors(memories(spark, folder).select("id", "parent_id"), "id", "parent_id", 8)


@_reg.add(f"""WITH RECURSIVE {MEMORIES}, c AS (SELECT id AS effect, unnest(relations.related_memories) AS cause FROM m), l AS (SELECT DISTINCT cause, effect FROM c WHERE cause IS NOT NULL), s AS (SELECT id AS start FROM m WHERE ends_with(id, 'f')),
t AS (SELECT start, start AS node, 0 AS depth FROM s UNION SELECT start, l.cause, depth + 1 FROM t JOIN l ON l.effect = t.node WHERE depth < 3) SELECT start, node, min(depth) AS depth FROM t GROUP BY ALL""")
def lineage_trace(spark, folder):
    m = memories(spark, folder)
    cited = m.select(F.col("id").alias("effect"), F.explode("relations.related_memories").alias("cause")).where("cause is not null")
    return gr.trace(cited, m.where(F.col("id").endswith("f")).select("id"), 3, backward=True)


@_reg.add()
def lineage_trace_all(spark, folder):
    """``lineage_trace`` from every memory."""
    m = memories(spark, folder)
    cited = m.select(F.col("id").alias("effect"), F.explode("relations.related_memories").alias("cause")).where("cause is not null")
    return gr.trace(cited, m.select("id"), 3, backward=True)


@_reg.add(f"""WITH {MEMORIES}, {EDGES}, e AS (SELECT DISTINCT ON (uuid) uuid, user_id, lower(name) AS name FROM graph_entities), n AS (SELECT DISTINCT id, user_id, lower(x.text) AS name FROM (SELECT id, user_id, unnest(entities) AS x FROM m) WHERE x.text IS NOT NULL),
k AS (SELECT DISTINCT id, e.uuid FROM n JOIN e USING (user_id, name)), p AS (SELECT DISTINCT k.id, g.uuid, g.strength::DOUBLE AS w FROM k JOIN g ON g.from_entity = k.uuid JOIN k b ON b.id = k.id AND b.uuid = g.to_entity WHERE g.invalidated_at IS NULL)
SELECT m.id, round(coalesce(avg(w), 0.5), 6) AS hebbian FROM m LEFT JOIN p ON p.id = m.id GROUP BY 1""")
def graph_hebbian_strength(spark, folder):
    m = memories(spark, folder)
    e = fl.once(table(spark, folder, "graph_entities"), "uuid").select("user_id", F.lower("name").alias("entity"), "uuid")
    k = rel.entity_rows(m, "user_id").join(e, ["user_id", "entity"]).select("id", "uuid").distinct()
    g = edges(spark, folder, "invalidated_at is null").select("from_entity", "to_entity", F.col("uuid").alias("edge"), F.col("strength").cast("double").alias("w"))
    one = k.join(g, k.uuid == g.from_entity).select("id", "to_entity", "edge", "w")
    p = one.join(k.select("id", F.col("uuid").alias("to_entity")), ["id", "to_entity"]).groupBy("id").agg(F.avg("w").alias("w"))
    return m.select("id").join(p, "id", "left").select("id", r(F.coalesce("w", F.lit(0.5))).alias("hebbian"))


@_reg.add("WITH e AS (SELECT DISTINCT ON (uuid) * FROM graph_entities) SELECT user_id, string_agg('\"' || name || '\"', ';' ORDER BY name, uuid) AS nodes FROM e GROUP BY 1")
def graph_dot_nodes(spark, folder):
    e = fl.once(table(spark, folder, "graph_entities"), "uuid")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("name", "uuid"))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('"')))
    return e.groupBy("user_id").agg(F.array_join(listed, ";").alias("nodes"))


@_reg.add(f"""WITH {MEMORIES}, x AS (SELECT DISTINCT id, episode_id FROM m WHERE episode_id IS NOT NULL), y AS (SELECT id, episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY id) AS k FROM x)
SELECT a.id AS a, b.id AS b FROM y a JOIN y b ON a.episode_id = b.episode_id AND a.k < b.k AND a.k <= 20 AND b.k <= 20""")
def graph_coactivation(spark, folder):
    x = memories(spark, folder, "episode_id is not null").select("id", "episode_id")
    y = x.withColumn("k", F.row_number().over(Window.partitionBy("episode_id").orderBy("id"))).where("k <= 20")
    z = y.select("episode_id", F.col("id").alias("b"), F.col("k").alias("kb"))
    return y.join(z, "episode_id").where("k < kb").select(F.col("id").alias("a"), "b")


@_reg.add(f"WITH {MEMORIES}, n AS (SELECT episode_id, count(*) - 1 AS links FROM m WHERE episode_id IS NOT NULL GROUP BY 1) SELECT id, episode_id, links FROM m JOIN n USING (episode_id)")
def graph_coactivation_all(spark, folder):
    """Whole episodes: each memory with its episode and the number of others that it is activated with, so that no pairs are made;
    ``graph_coactivation`` lists the pairs of the first 20 memories of each, as its SQL does."""
    m = memories(spark, folder, "episode_id is not null").select("id", "episode_id")
    return m.join(m.groupBy("episode_id").agg((F.count("*") - 1).alias("links")), "episode_id").select("id", "episode_id", "links")


@_reg.add(_G + """, n AS (SELECT DISTINCT ON (uuid) uuid, name FROM graph_entities), l AS (SELECT 0 AS part, uuid AS key, '  "' || uuid || '" [label="' || replace(coalesce(name, ''), '"', chr(39)) || '"];' AS line FROM n
UNION ALL SELECT 1, uuid, '  "' || from_entity || '" -> "' || to_entity || '" [label="' || coalesce(relation_type, '') || '", weight=' || printf('%.3f', coalesce(strength::DOUBLE, 0)) || '];' FROM g) SELECT part, key, line FROM l""")
def graph_dot_document(spark, folder):
    return gr.dot_lines(table(spark, folder, "graph_entities"), edges(spark, folder))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
