"""Queries: plastic edges and activation that spreads over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators import filters as fl
from palimpsest.operators import plasticity as pl
from palimpsest.operators import relations as rel
from palimpsest.plans.common import AS_OF_SQL, EDGES, MEMORIES, Registry, as_of, edges, memories, r
from palimpsest.runtime import table

_reg = Registry()
_H = f"((epoch_us({AS_OF_SQL}) - epoch_us(last_activated)) / 3600000000.0::DOUBLE)"
_SLOW = "CASE ltp_status WHEN 'Burst' THEN 0.5::DOUBLE WHEN 'Weekly' THEN 0.3 WHEN 'Full' THEN 0.1 ELSE 1.0 END"
_RATE = "CASE tier WHEN 'L1' THEN 0.029::DOUBLE WHEN 'L2' THEN 0.031::DOUBLE / 24 ELSE 0.02::DOUBLE / 720 END"
_DECAY = f"CASE WHEN {_H} <= 0 THEN 1.0::DOUBLE ELSE greatest(exp(-({_RATE}) * ({_SLOW}) * {_H}), 0.001::DOUBLE) END"
_S = "coalesce(strength::DOUBLE, 0)"
_EFF = f"coalesce(greatest({{s}} * {_DECAY}, 0.01::DOUBLE), {{s}})"
_READY = "CASE WHEN tier = 'L1' THEN 0.0::DOUBLE ELSE {n} / 10.0::DOUBLE * 0.5 + {w} / (CASE WHEN tier = 'L2' THEN 0.65::DOUBLE ELSE 0.80 END) * 0.5 + coalesce(entity_confidence::DOUBLE, 0.5) * 0.3 END"
_SINCE = "len([t for t in CASE WHEN tier <> 'L1' THEN coalesce(activation_timestamps, []) ELSE [] END if t >= " + AS_OF_SQL + " - INTERVAL {a} HOUR AND t {op} " + AS_OF_SQL + " - INTERVAL {b} HOUR])"
_ORDER = "CASE {c} WHEN 'Burst' THEN 1 WHEN 'Weekly' THEN 2 WHEN 'Full' THEN 3 ELSE 0 END"
_G = f"WITH {EDGES} "
_START = "(SELECT from_entity FROM graph_edges GROUP BY 1 ORDER BY count(DISTINCT uuid) DESC, 1 LIMIT 1)"


@_reg.add(f"""WITH {EDGES}, a AS (SELECT *, coalesce(activation_count, 0) + 1 AS n, least({_S} + (0.1::DOUBLE + CASE tier WHEN 'L1' THEN 0.15::DOUBLE WHEN 'L2' THEN 0.12 ELSE 0.075 END) * (1 - {_S}), 1.0) AS w FROM g),
b AS (SELECT *, CASE WHEN {_READY.format(n='n', w='w')} >= 1.0 OR (floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 3600000000.0::DOUBLE / 24) >= 30 AND n >= 5) THEN 'Full'
WHEN {_SINCE.format(a=168, b=0, op='<=')} >= 3 AND {_SINCE.format(a=336, b=168, op='<')} >= 3 THEN 'Weekly' WHEN {_SINCE.format(a=24, b=0, op='<=')} >= 5 THEN 'Burst' END AS seen FROM a),
c AS (SELECT *, {_ORDER.format(c='seen')} > {_ORDER.format(c='ltp_status')} AS higher FROM b),
d AS (SELECT * EXCLUDE (w), CASE WHEN higher THEN least(w + CASE seen WHEN 'Burst' THEN 0.05::DOUBLE WHEN 'Weekly' THEN 0.1 ELSE 0.2 END, 1.0) ELSE w END AS w FROM c)
SELECT uuid, round(CASE WHEN tier = 'L1' AND w >= 0.5 THEN greatest(w, 0.5) WHEN tier = 'L2' AND w >= 0.7 THEN greatest(w, 0.7) ELSE w END, 6) AS strength, CASE WHEN tier = 'L1' AND w >= 0.5 THEN 'L2' WHEN tier = 'L2' AND w >= 0.7 THEN 'L3' ELSE tier END AS tier,
CASE WHEN higher THEN seen ELSE ltp_status END AS ltp_status, n AS activation_count, coalesce((tier = 'L1' AND w >= 0.5) OR (tier = 'L2' AND w >= 0.7), false) AS promoted FROM d""")
def graph_strengthen(spark, folder):
    return pl.strengthened(edges(spark, folder), as_of()).withColumn("strength", r("strength"))


@_reg.add(_G + f"""SELECT uuid, from_entity AS source, round({_EFF.format(s=f'least({_S} + 0.015::DOUBLE * (1 - {_S}), 1.0)')}, 6) AS strength FROM g
UNION ALL SELECT uuid, to_entity, round({_EFF.format(s=f'least({_S} + 0.010::DOUBLE * (1 - {_S}), 1.0)')}, 6) FROM g""")
def graph_directional(spark, folder):
    return pl.directional(edges(spark, folder), as_of()).withColumn("strength", r("strength"))


@_reg.add(_G + f"SELECT uuid, CASE WHEN from_entity = {_START} THEN to_entity ELSE from_entity END AS other, round({_EFF.format(s=_S)}, 6) AS effective FROM g WHERE invalidated_at IS NULL AND {_START} IN (from_entity, to_entity) AND {_EFF.format(s=_S)} > 0.01 ORDER BY {_EFF.format(s=_S)} DESC, uuid LIMIT 10")
def graph_associations(spark, folder):
    degree = table(spark, folder, "graph_edges").groupBy("from_entity").agg(F.countDistinct("uuid").alias("n"))
    start = degree.orderBy(F.desc("n"), "from_entity").first()[0]
    return pl.associations(edges(spark, folder), F.lit(start), as_of()).withColumn("effective", r("effective"))


@_reg.add(_G + f"SELECT relation_type, count(*) AS edges, count(*) FILTER (invalidated_at IS NULL AND NOT coalesce(strength::DOUBLE < 0.1, false)) AS valid, max(epoch_us(CASE WHEN coalesce(strength::DOUBLE < 0.1, false) THEN coalesce(invalidated_at, {AS_OF_SQL}) ELSE invalidated_at END)) AS last_us FROM g GROUP BY 1")
def graph_invalidate(spark, folder):
    after = pl.invalidated(edges(spark, folder), F.col("strength").cast("double") < 0.1, as_of())
    return after.groupBy("relation_type").agg(F.count("*").alias("edges"), F.count_if(F.col("invalidated_at").isNull()).alias("valid"), F.max(F.unix_micros("invalidated_at")).alias("last_us"))


@_reg.add(_G + f""", e AS (SELECT uuid, unnest(list_distinct([from_entity, to_entity])) AS node, coalesce(ltp_status IN ('Weekly', 'Full'), false)::INT AS p, round({_EFF.format(s=_S)}, 9) AS e FROM g),
k AS (SELECT uuid, row_number() OVER (PARTITION BY node ORDER BY p DESC, e DESC, uuid) AS n FROM e) SELECT DISTINCT uuid FROM k WHERE n > 12""")
def graph_degree_cap(spark, folder):
    """With a bound of 12, so that the test tables have nodes over it; the default is 500."""
    return pl.over_degree(edges(spark, folder), as_of(), 12)


def _npmi(spark, folder):
    g = edges(spark, folder)
    total = g.agg((F.sum("activation_count") + F.count("*")).alias("n")).first()[0] or 0
    c = fl.once(table(spark, folder, "graph_entities"), "uuid").select("uuid", "mention_count")
    x = g.select("uuid", "from_entity", "to_entity", "activation_count").where("activation_count is not null")
    x = x.join(c.select(F.col("uuid").alias("from_entity"), F.col("mention_count").alias("a")), "from_entity").join(c.select(F.col("uuid").alias("to_entity"), F.col("mention_count").alias("b")), "to_entity")
    return x.select("uuid", sc.npmi(F.col("activation_count"), F.col("a"), F.col("b"), F.lit(float(total))).alias("npmi"))


_SWEPT = f"""t AS (SELECT sum(activation_count) + count(*) AS total FROM g), c AS (SELECT DISTINCT ON (uuid) uuid, mention_count AS k FROM graph_entities),
f AS (SELECT g.*, activation_count + 1.0::DOUBLE AS f, greatest(a.k, activation_count) + 1.0::DOUBLE AS ma, greatest(b.k, activation_count) + 1.0::DOUBLE AS mb, total::DOUBLE AS total FROM g LEFT JOIN c a ON a.uuid = from_entity LEFT JOIN c b ON b.uuid = to_entity, t),
q AS (SELECT *, CASE WHEN total >= 100 THEN CASE WHEN log2(total / f) < 1e-12 THEN 1.0 ELSE least(greatest(log2(f * total / (ma * mb)) / log2(total / f), -1), 1) END END AS npmi, {_EFF.format(s=_S)} AS after,
coalesce({_H} > CASE tier WHEN 'L1' THEN 48.0 WHEN 'L2' THEN 720.0 ELSE 87600.0 END / ({_SLOW}) AND {_DECAY} < CASE tier WHEN 'L1' THEN 0.1 WHEN 'L2' THEN 0.2 ELSE 0.3 END, false) AS flagged FROM f),
w AS (SELECT *, CASE WHEN NOT flagged THEN 'kept' WHEN coalesce(npmi >= CASE tier WHEN 'L1' THEN 0.3 WHEN 'L2' THEN 0.4 ELSE 0.5 END, false) THEN 'rescued' ELSE 'pruned' END AS fate FROM q)"""


@_reg.add(f"WITH {EDGES}, {_SWEPT} SELECT uuid, round(after, 6) AS strength, CASE WHEN tier <> 'L1' AND {_READY.format(n='coalesce(activation_count, 0)', w='after')} >= 1.0 THEN 'Full' ELSE ltp_status END AS ltp_status, fate FROM w")
def graph_decay_rescue(spark, folder):
    return pl.decay_sweep(edges(spark, folder), _npmi(spark, folder), as_of()).select("uuid", r("strength").alias("strength"), "ltp_status", "fate")


@_reg.add(f"WITH {EDGES}, {_SWEPT} SELECT DISTINCT uuid FROM graph_entities WHERE uuid NOT IN (SELECT from_entity FROM w WHERE fate <> 'pruned' UNION SELECT to_entity FROM w WHERE fate <> 'pruned')")
def graph_decay_orphans(spark, folder):
    return pl.without_edges(table(spark, folder, "graph_entities"), pl.decay_sweep(edges(spark, folder), _npmi(spark, folder), as_of()))


@_reg.add(f"""WITH {MEMORIES}, {EDGES}, e AS (SELECT DISTINCT ON (uuid) uuid, user_id, lower(name) AS name FROM graph_entities), n AS (SELECT DISTINCT id, user_id, lower(x.text) AS name FROM (SELECT id, user_id, unnest(entities) AS x FROM m) WHERE x.text IS NOT NULL),
k AS (SELECT DISTINCT id, e.uuid FROM n JOIN e USING (user_id, name)), v AS (SELECT uuid, from_entity, to_entity, round({_EFF.format(s=_S)}, 9) AS w FROM g WHERE invalidated_at IS NULL),
s AS (SELECT uuid, node, w, CASE WHEN node = from_entity THEN to_entity ELSE from_entity END AS other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, uuid) AS n FROM (SELECT *, unnest(list_distinct([from_entity, to_entity])) AS node FROM v)) WHERE n <= 50),
p AS (SELECT DISTINCT k.id, s.uuid, s.w FROM k JOIN s ON s.node = k.uuid JOIN k b ON b.id = k.id AND b.uuid = s.other)
SELECT m.id, round(coalesce(avg(w), 0.5), 6) AS hebbian FROM m LEFT JOIN p ON p.id = m.id GROUP BY 1""")
def graph_hebbian_effective(spark, folder):
    m = memories(spark, folder)
    e = fl.once(table(spark, folder, "graph_entities"), "uuid").select("user_id", F.lower("name").alias("entity"), "uuid")
    k = rel.entity_rows(m, "user_id").join(e, ["user_id", "entity"]).select("id", "uuid").distinct()
    return m.select("id").join(pl.hebbian(k, edges(spark, folder), as_of()), "id", "left").select("id", r(F.coalesce("hebbian", F.lit(0.5))).alias("hebbian"))


def _seeds(spark, folder, n):
    e = fl.once(table(spark, folder, "graph_entities"), "uuid").where("salience is not null")
    best = e.orderBy(F.desc("salience"), "uuid").limit(n)
    return best.select((F.row_number().over(Window.orderBy(F.desc("salience"), "uuid")) - 1).alias("place"), F.col("uuid").alias("node"), F.col("salience").cast("double").alias("activation"))  # n rows


@_reg.add()
def graph_activation(spark, folder):
    """From the most salient entity; tested against a plain walk over small graphs."""
    return pl.spread_activation(edges(spark, folder), _seeds(spark, folder, 1).select("node", "activation"), as_of()).withColumn("activation", r("activation"))


@_reg.add()
def graph_activation_both(spark, folder):
    """From the four most salient entities, by turns from two sides."""
    return pl.spread_from_both(edges(spark, folder), _seeds(spark, folder, 4), as_of()).withColumn("activation", r("activation"))


@_reg.add(f"""WITH {MEMORIES}, {EDGES}, x AS (SELECT episode_id AS retrieval, id, row_number() OVER (PARTITION BY episode_id ORDER BY sequence_number NULLS FIRST, id) - 1 AS place FROM m WHERE episode_id IS NOT NULL),
b AS (SELECT retrieval, id FROM x WHERE place <= 20) SELECT DISTINCT p.id AS a, q.id AS b, 0.4::DOUBLE AS strength, true AS fresh FROM b p JOIN b q ON p.retrieval = q.retrieval AND p.id < q.id""")
def graph_coretrieved(spark, folder):
    m = memories(spark, folder, "episode_id is not null")
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("sequence_number", "id")) - 1
    return pl.coactivated(edges(spark, folder), m.select(F.col("episode_id").alias("retrieval"), place.alias("place"), F.col("id").alias("node")))


@_reg.add(f"""WITH RECURSIVE {EDGES}, e AS (SELECT uuid, from_entity AS a, to_entity AS b, round({_EFF.format(s=_S)}, 9) AS w FROM g WHERE invalidated_at IS NULL AND relation_type IN ('RelatedTo', 'Uses', 'WorksWith', 'PartOf')), s AS (SELECT uuid, a AS src, b AS dst, w FROM e WHERE a <> b UNION ALL SELECT uuid, b, a, w FROM e WHERE a <> b),
t AS (SELECT src, dst, max(w) * exp(-0.15::DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, uuid) AS k FROM s) WHERE k <= 100 GROUP BY ALL),
p AS (SELECT {_START} AS node, 1.0::DOUBLE AS score, 0 AS hop UNION SELECT t.dst, p.score * t.w, hop + 1 FROM p JOIN t ON t.src = p.node WHERE hop < 3) SELECT node, round(max(score), 6) AS score FROM p GROUP BY 1""")
def graph_traverse(spark, folder):
    """From the node of most edges over some relations, three hops, each decayed."""
    degree = table(spark, folder, "graph_edges").groupBy("from_entity").agg(F.countDistinct("uuid").alias("n")).orderBy(F.desc("n"), "from_entity").limit(1)
    found = pl.traversed(edges(spark, folder), degree.select("from_entity"), as_of(), 3, ["RelatedTo", "Uses", "WorksWith", "PartOf"], hop_decay=0.15)
    return found.select("node", r("score").alias("score"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
