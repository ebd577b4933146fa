"""Queries: vector similarity, text retrieval, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators import filters as fl
from palimpsest.operators import texts as tx
from palimpsest.operators import vectors as vc
from palimpsest.plans.common import AS_OF_SQL, MEMORIES, Registry, as_of, memories, r
from palimpsest.runtime import materialize, table

_reg = Registry()
_M = f"WITH {MEMORIES} "
_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings")


def _query(spark, folder) -> list[float]:
    return list(_embeddings(spark, folder).agg(F.min_by("embedding", "vec_id")).first()[0])


@_reg.add(f"WITH {_Q} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20")
def vector_top_k(spark, folder):
    return vc.top_k(_embeddings(spark, folder), _query(spark, folder), 20).select("vec_id", r("similarity").alias("similarity"))


@_reg.add(f"WITH {_Q} SELECT label, round(avg(list_inner_product(embedding::DOUBLE[], v)), 6) AS dot, round(avg(list_distance(embedding::DOUBLE[], v) ** 2), 6) AS squared, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm FROM embeddings, q GROUP BY 1")
def vector_distances(spark, folder):
    q = vc.literal(_query(spark, folder))
    e = F.col("embedding")
    return _embeddings(spark, folder).groupBy("label").agg(r(F.avg(vc.dot(e, q))).alias("dot"), r(F.avg(vc.euclidean_squared(e, q))).alias("squared"), r(F.avg(vc.norm(e))).alias("norm"))


@_reg.add("SELECT vec_id, round(list_extract(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 1), 6) AS first FROM embeddings")
def vector_normalize(spark, folder):
    return _embeddings(spark, folder).select("vec_id", r(F.get(vc.normalized(F.col("embedding")), 0)).alias("first"))


@_reg.add("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM q, embeddings)
SELECT query, vec_id, rank FROM (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def vector_top_k_each(spark, folder):
    e = _embeddings(spark, folder)
    return vc.top_k_each(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 3).select("query", "vec_id", "rank")


@_reg.add()
def vector_inverted_search(spark, folder):
    e = _embeddings(spark, folder)
    centres = vc.kmeans(vc._sample(e, "embedding"), 16)
    return vc.inverted_search(vc.assign(e, centres), centres, _query(spark, folder), 10, 6).select("vec_id", r("similarity").alias("similarity"))


@_reg.add()
def vector_quantized_search(spark, folder):
    e = _embeddings(spark, folder)
    books = vc.quantizer(e, 8, 32)
    coded = vc.encode(e, books)
    return coded.select("vec_id", r(vc.quantized_distance(F.col("codes"), books, _query(spark, folder))).alias("distance")).orderBy("distance", "vec_id").limit(20)


@_reg.add()
def vector_recall(spark, folder):
    e = _embeddings(spark, folder)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    exact = vc.top_k_each(e, asked, 5)
    books = vc.quantizer(e, 16, 64)
    # The collection is read once, as its codes stand for it, against all queries.
    found = vc.top_k_each(vc.decoded(vc.encode(e, books), books), asked, 20)
    return vc.recall_of(found, exact, "query", "vec_id").select("query", r("recall").alias("recall"))


@_reg.add("""WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, memory_id, model, vector::DOUBLE[] AS x FROM memory_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(vector, lambda y: y <> 0)) > 0),
q AS (SELECT x AS y FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)) SELECT memory_id, round(max(list_cosine_similarity(x, y)), 6) AS similarity FROM v, q GROUP BY 1""")
def vector_chunk_pool(spark, folder):
    v = table(spark, folder, "memory_vectors").where((F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    v = fl.once(v, "vec_id")
    q = vc.literal(list(v.agg(F.min_by("vector", "vec_id")).first()[0]))
    return vc.max_pool(v.select("memory_id", vc.cosine(F.col("vector"), q).alias("similarity")), "memory_id").select("memory_id", r("similarity").alias("similarity"))


@_reg.add()
def vector_mmr(spark, folder):
    e = _embeddings(spark, folder)
    top = vc.top_k(e, _query(spark, folder), 60)
    c = top.join(e, "vec_id").select(F.col("vec_id").alias("id"), F.col("similarity").alias("relevance"), F.col("embedding").alias("vector"))
    return c.withColumn("query", F.lit(1)).groupBy("query").applyInPandas(lambda p: vc.mmr(p, 0.7, 10), "id long, place int")  # sixty rows


@_reg.add("""WITH s AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT vec_id, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, other) AS n FROM s) WHERE n <= 5) SELECT vec_id, round(avg(1 - c), 6) AS isolation FROM k GROUP BY 1""")
def vector_isolation(spark, folder):
    e = _embeddings(spark, folder)
    knn = vc.top_k_each(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 6)
    knn = knn.where("query <> vec_id").where("rank <= 6").select(F.col("query").alias("vec_id"), F.col("vec_id").alias("other"), "similarity")
    return vc.cells_of_neighbours(knn).select("vec_id", r("isolation").alias("isolation"))


_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
_TERMS = "[w for w in string_split_regex(lower({c}), '[^a-z0-9]+') if length(w) >= 2 and w not in " + _STOP + "]"
_ASK = [("q1", "retry loop double billing in staging"), ("q2", "truncated snapshot headers"), ("q3", "robot lost map tiles near the warehouse")]
_BM = f"""WITH {MEMORIES}, q(query, text) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _ASK)}), t AS (SELECT DISTINCT query, unnest({_TERMS.format(c='text')}) AS term FROM q),
d AS (SELECT id, {_TERMS.format(c='content')} AS w FROM m), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d), x AS (SELECT id, len(w) AS l, unnest(w) AS term FROM d), tf AS (SELECT term, id, l, count(*) AS tf FROM x WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT query, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS score FROM tf JOIN df USING (term) JOIN t USING (term), n GROUP BY ALL)"""


def _bm25(spark, folder, k=None):
    m = memories(spark, folder).select("id", "content")
    return tx.bm25(m, "id", "content", spark.createDataFrame(_ASK, "query string, text string"), k)


@_reg.add(_BM + " SELECT query, id, round(score, 6) AS score FROM s")
def text_bm25(spark, folder):
    return _bm25(spark, folder).select("query", "id", r("score").alias("score"))


@_reg.add(_BM + """, a AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS k FROM s), b AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY importance DESC, id) AS k FROM q, m WHERE importance IS NOT NULL)
SELECT query, id, round(sum(p), 9) AS fused FROM (SELECT query, id, 0.6::DOUBLE / (60 + k) AS p FROM a UNION ALL SELECT query, id, 0.4::DOUBLE / (60 + k) FROM b) GROUP BY ALL""")
def text_rank_fusion(spark, folder):
    s = _bm25(spark, folder).select("query", "id", F.round("score", 9).alias("score"))
    q = spark.createDataFrame([(a,) for a, _ in _ASK], "query string")
    m = memories(spark, folder, "importance is not null").select("id", F.col("importance").alias("score"))
    ranked = m.withColumn("query", F.explode(F.array(*(F.lit(a) for a, _ in _ASK)))).select("query", "id", "score")
    return tx.fuse([(s, 0.6), (ranked, 0.4)], "id", by=["query"]).select("query", "id", r("fused", 9).alias("fused"))


@_reg.add(_M + f", x AS (SELECT unnest({_TERMS.format(c='content')}) AS term FROM m) SELECT term, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 20")
def text_terms(spark, folder):
    return memories(spark, folder).select(F.explode(tx.words(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 20")


@_reg.add()
def text_stems(spark, folder):
    t = memories(spark, folder).select(F.explode(tx.words(F.col("content"), 3)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return tx.stemmed(t).groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@_reg.add()
def text_sentences(spark, folder):
    return memories(spark, folder).select("id", F.size(tx.sentences(F.col("content"))).alias("sentences")).where("sentences > 0")


@_reg.add()
def text_cooccurrence(spark, folder):
    return tx.cooccurring_words(memories(spark, folder), "id", "content").where("n >= 5")


@_reg.add("""SELECT doc_id, chunk - 1 AS chunk, (chunk - 1) * 600 AS start, substr(text, CAST((chunk - 1) * 600 + 1 AS BIGINT), 800) AS piece FROM (SELECT doc_id, text, unnest(range(1, CAST(greatest(length(text) - 201, 0) // 600 + 2 AS BIGINT))) AS chunk FROM documents WHERE length(text) > 0)""")
def text_chunks(spark, folder):
    return tx.chunks(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


@_reg.add()
def text_keywords(spark, folder):
    return tx.keywords(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "term", r("score").alias("score"), "rank")


_DAYS = f"(epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000.0::DOUBLE"
_LADDER = "CASE WHEN {d} <= 7 THEN 1.0::DOUBLE WHEN {d} <= 30 THEN 0.7 WHEN {d} <= 90 THEN 0.4 ELSE {o} END"


def _aged(spark, folder):
    return memories(spark, folder, "created_at is not null").withColumn("days", sc.days_between(as_of(), F.col("created_at")))


@_reg.add(_M + f"SELECT id, {_LADDER.format(d=_DAYS, o='0.2')} AS relevance, round(exp(-0.01::DOUBLE * greatest({_DAYS} * 24, 0)) * 0.1::DOUBLE, 9) AS recency FROM m WHERE created_at IS NOT NULL")
def score_recency(spark, folder):
    return _aged(spark, folder).select("id", sc.temporal_relevance(F.col("days")).alias("relevance"), r(sc.recency_boost(F.col("days") * 24), 9).alias("recency"))


@_reg.add(_M + f"""SELECT id, round(least(greatest(({_LADDER.format(d=_DAYS, o='0.1')}) * 0.6 + importance::DOUBLE * 0.4, 0), 1), 6) AS salience,
round(least(greatest(least(greatest(({_LADDER.format(d=_DAYS, o='0.1')}) * 0.6 + importance::DOUBLE * 0.4, 0), 1) + CASE WHEN access_count > 0 THEN least(log2(access_count) * 0.05, 0.3) ELSE 0 END, 0), 1), 6) AS with_access FROM m WHERE created_at IS NOT NULL AND importance IS NOT NULL""")
def score_salience(spark, folder):
    a = _aged(spark, folder).where("importance is not null")
    return a.select("id", r(sc.salience(F.col("days"), F.col("importance"))).alias("salience"), r(sc.salience_with_access(F.col("days"), F.col("importance"), F.col("access_count"))).alias("with_access"))


_LATE = """exp(-(CASE WHEN p THEN 0.3465::DOUBLE ELSE 0.693 END) * 3) * pow(greatest(d, 3) / 3, -(CASE WHEN p THEN 0.3::DOUBLE ELSE 0.5 END)) * (1 + least(greatest((greatest(d, 3) - 3) / 3, 0), 1) * 0.15::DOUBLE * (cos(2 * pi() * ln(greatest(d, 3)) / ln(7.0::DOUBLE)) + cos(2 * pi() * ln(greatest(d, 3)) / ln(30.0::DOUBLE)) + cos(2 * pi() * ln(greatest(d, 3)) / ln(365.0::DOUBLE))))"""


@_reg.add(_M + f", x AS (SELECT id, {_DAYS} AS d, coalesce(access_count >= 10, false) AS p FROM m WHERE created_at IS NOT NULL) SELECT id, round(CASE WHEN d <= 0 THEN 1.0::DOUBLE WHEN d < 3 THEN exp(-(CASE WHEN p THEN 0.3465::DOUBLE ELSE 0.693 END) * d) ELSE {_LATE} END, 6) AS decay FROM x")
def score_memory_decay(spark, folder):
    a = _aged(spark, folder)
    return a.select("id", r(sc.memory_decay(F.col("days"), F.coalesce(F.col("access_count") >= 10, F.lit(False)))).alias("decay"))


_CAL = "1.0::DOUBLE / (1 + exp(-10.0::DOUBLE * (({x})::DOUBLE - 0.5)))"
_MOM = "(coalesce(reward::DOUBLE, 0) + 1) / 2"


@_reg.add(_M + f"""SELECT id, round(0.18 * {_CAL.format(x='importance')} + 0.17 * {_CAL.format(x='least(coalesce(len(entities), 0) / 5.0::DOUBLE, 1)')} + 0.05 * {_CAL.format(x='least(coalesce(len(tags), 0) / 4.0::DOUBLE, 1)')} + 0.05 * {_CAL.format(x='importance')}
+ 0.28 * {_CAL.format(x=f'CASE WHEN {_MOM} > 0.65 THEN least({_MOM} * 1.5, 1) WHEN {_MOM} < 0.40 THEN greatest({_MOM} * 0.3, 0) ELSE {_MOM} END')} + 0.14 * {_CAL.format(x='CASE WHEN access_count = 0 THEN 0 ELSE least(log2(access_count + 1) / 4, 1) END')} + 0.13 * {_CAL.format(x='0.5')}, 6) AS fused FROM m WHERE importance IS NOT NULL AND access_count IS NOT NULL""")
def score_fused(spark, folder):
    m = memories(spark, folder, "importance is not null and access_count is not null")
    share = lambda c, n: F.least(F.coalesce(F.size(c), F.lit(0)) / n, F.lit(1.0))
    return m.select("id", r(sc.fused(F.col("importance"), share("entities", 5.0), share("tags", 4.0), F.col("importance"), F.coalesce(F.col("reward").cast("double"), F.lit(0.0)), F.col("access_count"), F.lit(0.5))).alias("fused"))


@_reg.add("WITH f AS (SELECT DISTINCT ON (id) * FROM facts), x AS (SELECT id, support_count AS s, (epoch_us(" + AS_OF_SQL + ") - epoch_us(last_reinforced)) / 86400000000.0::DOUBLE AS d FROM f WHERE last_reinforced IS NOT NULL AND support_count IS NOT NULL) SELECT id, round(CASE WHEN d <= 90 THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, (d - 90) / (180 + 30 * s)) END, 6) AS factor FROM x")
def score_fact_decay(spark, folder):
    from palimpsest.plans.common import facts

    f = facts(spark, folder, "last_reinforced is not null and support_count is not null")
    return f.select("id", r(sc.fact_decay(sc.days_between(as_of(), F.col("last_reinforced")), F.col("support_count"))).alias("factor"))


def _asked(spark, folder):
    return _embeddings(spark, folder).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@_reg.add()
def vector_graph_search(spark, folder):
    """Five nearest of the asked vectors in a flat pruned graph; its recall against brute force is tested."""
    from palimpsest.operators import graph_index as gi

    return gi.search(materialize(gi.build(_embeddings(spark, folder))), _asked(spark, folder), 5)


@_reg.add()
def vector_layered_search(spark, folder):
    """The same in a layered graph, with a tenth of the vectors removed."""
    from palimpsest.operators import graph_index as gi

    index = materialize(gi.build(_embeddings(spark, folder), layered=True))
    return gi.search(index, _asked(spark, folder), 5, removed=_embeddings(spark, folder).where("vec_id % 10 = 1"))


@_reg.add(f"WITH {_Q} SELECT label, count(*) AS n FROM (SELECT label FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20) GROUP BY 1")
def mode_multimodal(spark, folder):
    """A search whose mode is chosen by name; the associative mode falls back to similarity."""
    from palimpsest.operators import recall as rc

    e = _embeddings(spark, folder)
    near = vc.top_k(e, _query(spark, folder), 20)
    return rc.by_mode("associative", similarity=near).join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@_reg.add("""WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS rank FROM p QUALIFY rank <= 5) SELECT vec_id, round(avg(1 - s), 6) AS isolation, round(1 / avg(1 - s), 4) AS density FROM k GROUP BY 1""")
def vector_cells(spark, folder):
    """Neighbourhoods of all vectors from their exact five nearest; shapes and directions are tested against plain computations."""
    e = _embeddings(spark, folder)
    return vc.shapes_of_cells(vc.knn_blocks(e, 5), e).select("vec_id", r("isolation").alias("isolation"), r("density", 4).alias("density"))


@_reg.add()
def vector_void(spark, folder):
    e = _embeddings(spark, folder)
    cells = materialize(vc.shapes_of_cells(vc.knn_blocks(e, 5), e))
    bound = cells.agg(F.percentile_approx("isolation", 0.9)).first()[0] or 0.0
    return vc.void(cells, e, bound)


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
