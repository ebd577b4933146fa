"""Queries: field relevance, the unified score, retrieval modes, surfacing, prefetch, injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import querying as qy
from palimpsest.functions import scoring as sc
from palimpsest.operators import plasticity as pl
from palimpsest.operators import ranking as rk
from palimpsest.operators import recall as rc
from palimpsest.operators import texts as tx
from palimpsest.plans.common import AS_OF_SQL, HOT_TENANT, MEMORIES, MESSAGES, Registry, as_of, edges, memories, messages, r
from palimpsest.plans.retrieving import _TERMS
from palimpsest.runtime import table

_reg = Registry()
_M = f"WITH {MEMORIES} "
_QUERY, _WEIGHTS, _PHRASES = "retry loop double billing in staging", {"retry": 2.3, "loop": 1.7}, {"retry loop": 1.5}
_ASKED = ["retry", "loop", "double", "billing", "staging"]
_IN = "(" + ", ".join(f"'{w}'" for w in _ASKED) + ")"
_NAMED = "[lower(e.text) for e in entities if e.text is not null]"
_FLAT = lambda c: f"flatten(list_transform({c}, lambda x: {_TERMS.format(c='x')}))"


@_reg.add(f"""WITH {MEMORIES}, f AS (SELECT id, 'content' AS field, {_TERMS.format(c='content')} AS t FROM m UNION ALL SELECT id, 'tags', CASE WHEN tags IS NOT NULL THEN {_FLAT("[t for t in tags if t is not null]")} END FROM m
UNION ALL SELECT id, 'entities', CASE WHEN entities IS NOT NULL THEN {_FLAT(_NAMED)} END FROM m), k AS (SELECT field, avg(len(t)) AS mean FROM f GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM m),
tf AS (SELECT id, field, l, term, count(*) AS tf FROM (SELECT id, field, len(t) AS l, unnest(t) AS term FROM f) WHERE term IN {_IN} GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT id, CASE term WHEN 'retry' THEN 2.3::DOUBLE WHEN 'loop' THEN 1.7 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)) AS part FROM tf JOIN df USING (field, term) JOIN k USING (field), n
UNION ALL SELECT id, 1.5::DOUBLE * (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM df, n WHERE field = 'content' AND term IN ('retry', 'loop')) FROM m WHERE contains(lower(content), 'retry loop'))
SELECT id, round(sum(part), 6) AS score FROM s GROUP BY 1""")
def text_bm25_fields(spark, folder):
    m = memories(spark, folder)
    return rc.bm25_fields(m, "id", rc.fields_of(m), _QUERY, _WEIGHTS, _PHRASES, stems=False).select("id", r("score").alias("score"))


@_reg.add()
def text_bm25_stems(spark, folder):
    """With the field of stems; tested against a plain computation on a fixture."""
    m = memories(spark, folder)
    return rc.bm25_fields(m, "id", rc.fields_of(m), _QUERY, _WEIGHTS, _PHRASES, k=50).select("id", r("score").alias("score"), "rank")


_WORDS = "coalesce(len([w for w in string_split_regex(content, '\\s+') if w <> '']), 0)"
_N = lambda c: f"coalesce(len({c}), 0)"
_RICH = f"(({_N('tags')} > 0)::INT + ({_N('entities')} > 0)::INT + (coalesce(cardinality(metadata), 0) > 0)::INT + ({_N('geo_location')} > 0)::INT + (episode_id IS NOT NULL)::INT + (robot_id IS NOT NULL)::INT + (mission_id IS NOT NULL)::INT + (parent_id IS NOT NULL)::INT + (external_id IS NOT NULL)::INT + (outcome_type IS NOT NULL)::INT)"
_DATES = r"coalesce(len(list_filter(regexp_extract_all(content, '(?:^|[^0-9-])(\d{4}-\d{2}-\d{2})', 1), lambda z: try_cast(z AS DATE) IS NOT NULL)), 0)"
_ELAB = f"least(greatest((least({_RICH} / 10.0::DOUBLE, 1) + least({_N('entities')} / 5.0::DOUBLE, 1) + (parent_id IS NOT NULL)::INT + ({_DATES} > 0)::INT + ({_N('tags')} > 0)::INT + CASE WHEN {_WORDS} > 0 THEN least({_N('entities')}::DOUBLE / {_WORDS} * 10, 1) ELSE 0 END) / 7.0::DOUBLE, 0), 1)"
_HOURS = f"floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 3600000000.0::DOUBLE)"


@_reg.add(_M + f"SELECT id, {_RICH} AS richness, round({_ELAB}, 6) AS elaboration FROM m")
def score_elaboration(spark, folder):
    m = memories(spark, folder)
    return m.select("id", rc.richness(m).alias("richness"), r(rc.elaboration(m)).alias("elaboration"))


_TECH = " + ".join(f"CASE WHEN contains(lower(coalesce(content, '')), '{t}') THEN 0.015::DOUBLE ELSE 0 END" for t in rc.TECHNICAL)
_IMPORTANT = f"""least(CASE experience_type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rc.TYPE_WORTH.items())} ELSE 0.05 END + CASE WHEN {_WORDS} > 50 THEN 0.25::DOUBLE WHEN {_WORDS} > 20 THEN 0.15 WHEN {_WORDS} > 5 THEN 0.08 ELSE 0.02 END
+ CASE WHEN {_N('entities')} > 10 THEN 0.2::DOUBLE WHEN {_N('entities')} > 5 THEN 0.15 WHEN {_N('entities')} > 2 THEN 0.1 WHEN {_N('entities')} > 0 THEN 0.05 ELSE 0 END
+ least(CASE WHEN {_N('tags')} > 0 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN {_N('relations.related_memories')} > 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN mission_id IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END, 0.2)
+ least(CASE metadata['priority'] WHEN 'critical' THEN 0.15::DOUBLE WHEN 'high' THEN 0.1 WHEN 'medium' THEN 0.05 ELSE 0 END + CASE WHEN metadata['unexpected'] IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN metadata['breakthrough'] IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN metadata['role'] = 'user' THEN 0.02::DOUBLE ELSE 0 END, 0.15)
+ least({_TECH} + CASE WHEN contains(coalesce(content, ''), '?') THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN contains(content, '```') OR contains(content, 'fn ') OR contains(content, 'function ') OR contains(content, 'class ') THEN 0.03::DOUBLE ELSE 0 END, 0.1), 1)"""


@_reg.add(_M + f"SELECT id, round({_IMPORTANT}, 6) AS importance FROM m")
def score_importance(spark, folder):
    m = memories(spark, folder)
    return m.select("id", r(rc.importance(m)).alias("importance"))


@_reg.add(_M + f"""SELECT id, round((coalesce(importance::DOUBLE, 0) + 0.5 * 0.1::DOUBLE + exp(-0.01::DOUBLE * greatest({_HOURS}, 0)) * 0.5 + CASE WHEN {_HOURS} <= 2 THEN 0.03::DOUBLE ELSE 0 END + ln(1 + coalesce(access_count, 0)::DOUBLE) / 5 * 0.07::DOUBLE + 0.5 * 0.08::DOUBLE
+ ln(1 + coalesce(sequence_number, 0)::DOUBLE) / 5 * 0.02::DOUBLE + {_RICH} / 10.0::DOUBLE * 0.02::DOUBLE + least({_DATES} / 5.0::DOUBLE, 1) * 0.02::DOUBLE + least({_N('entities')} / 5.0::DOUBLE, 1) * 0.02::DOUBLE + {_ELAB} * 0.03::DOUBLE)
* (CASE WHEN coalesce(reward::DOUBLE, 0) < 0 THEN 1 + greatest(coalesce(reward::DOUBLE, 0) * 0.2::DOUBLE, -0.2) ELSE 1 + least(coalesce(reward::DOUBLE, 0) * 0.1::DOUBLE, 0.1) END), 6) AS score FROM m WHERE user_id = '{HOT_TENANT}'""")
def score_unified(spark, folder):
    """All memories of a tenant as candidates: their importance is the base, reward the momentum, and the query asks for recent things."""
    m = memories(spark, folder, F.col("user_id") == HOT_TENANT)
    c = m.withColumns({"base": F.coalesce(F.col("importance").cast("double"), F.lit(0.0)), "hebbian": F.lit(0.5), "momentum": F.col("reward")})
    return c.select("id", r(rc.unified(c, as_of(), "what changed in the most recent run")).alias("score"))


def _asked_vector(spark, folder):
    v = rc.usable_vectors(table(spark, folder, "memory_vectors").where("model = 'mini-enc-v2'"))
    return [float(x) for x in v.agg(F.min_by("vector", "vec_id")).first()[0]]


_USABLE = "v AS (SELECT DISTINCT ON (vec_id) * FROM memory_vectors WHERE vector IS NOT NULL AND len(vector) = dimensions AND len([x for x in vector if x IS NULL OR isnan(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0)"
_NEAR = f"""{_USABLE}, q AS (SELECT vector::DOUBLE[] AS q FROM v WHERE model = 'mini-enc-v2' ORDER BY vec_id LIMIT 1),
sim AS (SELECT memory_id AS id, max(round(list_cosine_similarity(vector::DOUBLE[], q), 9)) AS similarity FROM v, q WHERE dimensions = len(q) GROUP BY 1),
near AS (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT {{n}})"""


@_reg.add(f"WITH {MEMORIES}, {_NEAR.format(n=90)} SELECT id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM near WHERE id IN (SELECT id FROM m WHERE importance >= 0.3) ORDER BY rank LIMIT 30")
def mode_similarity(spark, folder):
    near = rc.by_similarity(memories(spark, folder), table(spark, folder, "memory_vectors"), _asked_vector(spark, folder), 30, F.col("importance") >= 0.3)
    return near.select("id", r("similarity").alias("similarity"), "rank")


@_reg.add(_M + "SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m WHERE created_at BETWEEN TIMESTAMPTZ '2025-05-25 00:00:00+00' AND " + AS_OF_SQL + " ORDER BY rank LIMIT 40")
def mode_temporal(spark, folder):
    return rc.by_time(memories(spark, folder), 40, as_of(), days=7)


_CAUSED = """l AS (SELECT DISTINCT id, unnest(relations.related_memories) AS next FROM m), c AS (SELECT id, 0 AS depth FROM {seeds} UNION SELECT l.next, depth + 1 FROM c JOIN l ON l.id = c.id WHERE depth < 8 AND l.next IS NOT NULL)"""


@_reg.add(f"WITH RECURSIVE {MEMORIES}, {_NEAR.format(n=9)}, s AS (SELECT id FROM near WHERE id IN (SELECT id FROM m) ORDER BY similarity DESC, id LIMIT 3), {_CAUSED.format(seeds='s')}, d AS (SELECT id, min(depth) AS depth FROM c WHERE id IN (SELECT id FROM m) GROUP BY 1) SELECT id, depth, row_number() OVER (ORDER BY depth, id) AS rank FROM d ORDER BY rank LIMIT 1000")
def mode_causal(spark, folder):
    m = memories(spark, folder)
    seeds = rc.by_similarity(m, table(spark, folder, "memory_vectors"), _asked_vector(spark, folder), 3)
    return rc.by_cause(m, seeds, 1000)


@_reg.add(f"""WITH RECURSIVE {MEMORIES}, {_NEAR.format(n=60)}, w AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM near WHERE id IN (SELECT id FROM m) ORDER BY rank LIMIT 20),
t AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m WHERE created_at BETWEEN TIMESTAMPTZ '2025-05-25 00:00:00+00' AND {AS_OF_SQL} ORDER BY rank LIMIT 20), s AS (SELECT id FROM w WHERE rank <= 3), {_CAUSED.format(seeds='s')},
d AS (SELECT id, row_number() OVER (ORDER BY min(depth), id) AS rank FROM c WHERE id IN (SELECT id FROM m) GROUP BY 1 ORDER BY rank LIMIT 20),
p AS (SELECT id, sum(part) AS score FROM (SELECT id, 0.5::DOUBLE / rank AS part FROM w UNION ALL SELECT id, 0.2::DOUBLE / rank FROM t UNION ALL SELECT id, 0.2::DOUBLE / rank FROM d UNION ALL SELECT id, 0.1::DOUBLE / rank FROM w) GROUP BY 1),
a AS (SELECT id, created_at, (epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000.0::DOUBLE AS days, coalesce(importance::DOUBLE, 0) AS imp, coalesce(access_count, 0) AS acc FROM m),
z AS (SELECT id, created_at, least(greatest(least(greatest((CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.7 WHEN days <= 90 THEN 0.4 ELSE 0.1 END)::DOUBLE * 0.6 + imp * 0.4, 0), 1) + CASE WHEN acc > 0 THEN least(log2(acc) * 0.05, 0.3) ELSE 0 END, 0), 1) AS salient FROM a)
SELECT id, round(score * 0.7::DOUBLE + salient * 0.3::DOUBLE, 6) AS score FROM p JOIN z USING (id) ORDER BY score * 0.7::DOUBLE + salient * 0.3::DOUBLE DESC, created_at DESC, id LIMIT 20""")
def mode_hybrid(spark, folder):
    m = memories(spark, folder)
    near = rc.by_similarity(m, table(spark, folder, "memory_vectors"), _asked_vector(spark, folder), 20)
    lists = {"similarity": near, "temporal": rc.by_time(m, 20, as_of()), "causal": rc.by_cause(m, near.where("rank <= 3"), 1000).where("rank <= 20"), "associative": near}
    return rc.hybrid(lists, m, as_of(), 20).select("id", r("score").alias("score"))


_CONTEXT, _NAMES = "the retry loop lost its backup after the release", ["Merkle Tree", "Bloom Filter"]
_BEGINS = "len([w for w in ['" + "', '".join(sorted(set(_CONTEXT.split()))) + "'] if starts_with(w, lower(t)) OR starts_with(lower(t), w)]) > 0"
_TAGS = f"CASE WHEN {_N('[t for t in tags if t is not null]')} > 0 THEN len([t for t in tags if t is not null AND (contains('{_CONTEXT}', lower(t)) OR {_BEGINS})])::DOUBLE / len([t for t in tags if t is not null]) ELSE 0 END"


@_reg.add(_M + f"SELECT id, round({_TAGS}, 6) AS score FROM m")
def score_tags(spark, folder):
    return memories(spark, folder).select("id", r(rc.tag_score(_CONTEXT, F.col("tags"))).alias("score"))


@_reg.add(_M + f""", x AS (SELECT id, round(0.35::DOUBLE * coalesce(len(list_intersect(list_distinct({_NAMED}), ['merkle tree', 'bloom filter'])), 0) / 2 + 0.15::DOUBLE * {_TAGS} + 0.5::DOUBLE * coalesce(importance::DOUBLE, 0), 12) AS s, {_HOURS} AS age FROM m),
y AS (SELECT id, round(CASE WHEN age <= 2000 THEN least(s * (1 + 0.2::DOUBLE * (1 - age / 2000.0::DOUBLE)), 1) ELSE s END, 9) AS score FROM x) SELECT id, round(score, 6) AS score FROM y WHERE score > 0.2 ORDER BY y.score DESC, id LIMIT 25""")
def surface_relevant(spark, folder):
    m = memories(spark, folder)
    relevance = m.select("id", F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("score"))
    return rc.surfaced(m, relevance, _CONTEXT, _NAMES, as_of(), hours=2000, threshold=0.2, limit=25).select("id", r("score").alias("score"))


@_reg.add(_M + f"""SELECT id, round(least(CASE WHEN mission_id = (SELECT min(mission_id) FROM memories) THEN 0.4::DOUBLE ELSE 0 END + coalesce(len(list_intersect(list_distinct({_NAMED}), ['merkle tree', 'bloom filter'])), 0) * 0.1::DOUBLE + CASE WHEN contains(content, 'src/') THEN 0.2::DOUBLE ELSE 0 END
+ CASE WHEN abs(hour(created_at AT TIME ZONE 'UTC') - 9) <= 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_HOURS} < 24 THEN 0.1::DOUBLE WHEN {_HOURS} < 168 THEN 0.05 ELSE 0 END, 1), 6) AS score FROM m""")
def prefetch_relevance(spark, folder):
    m = memories(spark, folder)
    mission = table(spark, folder, "memories").agg(F.min("mission_id")).first()[0]
    return m.select("id", r(rc.prefetch_score(m, {"project": mission, "entities": _NAMES, "file": "src/", "hour": 9}, as_of())).alias("score"))


@_reg.add(f"""WITH RECURSIVE {MESSAGES}, o AS (SELECT session_id, lower(trim(tag)) AS id, epoch_us(ts) AS t FROM (SELECT session_id, ts, unnest(tags) AS tag FROM s WHERE ts IS NOT NULL) WHERE tag IS NOT NULL),
k AS (SELECT session_id, id, min(t) AS t FROM o GROUP BY ALL UNION ALL SELECT * FROM (SELECT o.session_id, o.id, min(o.t) FROM k JOIN o ON o.session_id = k.session_id AND o.id = k.id AND o.t >= k.t + 180000000 GROUP BY ALL))
SELECT session_id, id, count(*) AS shown FROM k GROUP BY ALL""")
def stream_injection(spark, folder):
    """Memories offered by the tags of messages; the same one at most every 180 seconds in a session."""
    tags = messages(spark, folder, "ts is not null").select("session_id", "ts", F.explode("tags").alias("tag")).where("tag is not null")
    shown = rc.injected(tags.select("session_id", F.lower(F.trim("tag")).alias("id"), "ts")).where("shown")
    return shown.groupBy("session_id", "id").agg(F.count("*").alias("shown"))


@_reg.add(_M + "SELECT id, round(importance::DOUBLE * CASE WHEN len([t for t in tags if lower(trim(t)) IN ('fragment', 'snippet')]) > 0 OR length(content) < 80 THEN 0.7::DOUBLE ELSE 1 END, 6) AS score FROM m WHERE importance IS NOT NULL")
def rank_fragment_demotion(spark, folder):
    m = memories(spark, folder, "importance is not null")
    fragment = F.exists("tags", lambda t: F.lower(F.trim(t)).isin("fragment", "snippet"))
    return m.select("id", r(rk.demote_fragments(F.col("importance").cast("double"), F.coalesce(fragment, F.lit(False)) | F.coalesce(F.length("content") < 80, F.lit(False)), temporal=False)).alias("score"))


@_reg.add()
def recall_pipeline(spark, folder):
    """Recall of one question end to end: terms over four fields, the vector of a known memory, rank fusion with weights by how telling
    the question is, strength of links, and the unified score; the first twenty."""
    m = memories(spark, folder, "user_id is not null")
    analysis = qy.analyse(_QUERY)
    weights = {w: 2.3 for w in analysis.nouns} | {w: 1.7 for w in analysis.modifiers}
    terms = rc.bm25_fields(m, "id", rc.fields_of(m), _QUERY, weights, k=200).select("id", "score")
    near = rc.by_similarity(m, table(spark, folder, "memory_vectors"), _asked_vector(spark, folder), 200).select("id", F.col("similarity").alias("score"))
    keyword, vector = qy.channel_weights(0.6)
    fused = tx.fuse([(terms, keyword), (near, vector)], "id")
    e = table(spark, folder, "graph_entities").select("user_id", F.lower("name").alias("entity"), "uuid").distinct()
    from palimpsest.operators.relations import entity_rows

    found = m.join(fused, "id")
    links = pl.hebbian(entity_rows(found, "user_id").join(e, ["user_id", "entity"]).select("id", "uuid").distinct(), edges(spark, folder), as_of())
    c = found.join(links, "id", "left").withColumns({"base": F.col("fused") * 60.0, "hebbian": F.coalesce("hebbian", F.lit(0.5))})
    return tx.first_ranks(c.select("id", F.round(rc.unified(c, as_of(), _QUERY), 9).alias("score")), "id", "score", 20, [])


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
