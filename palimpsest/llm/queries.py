"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import cooccurrence, leakage, name_variants, near_duplicates, neighbours, packing, pii, truncation
from palimpsest.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, folder, "memories"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return name_variants.clusters(table(spark, folder, "memories"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.memory_pairs(table(spark, folder, "memories"), least=5)
    chance = F.col("together").cast("decimal(38,0)") * F.col("total") >= F.lit(3) * F.col("count_a").cast("decimal(19,0)") * F.col("count_b")
    return pairs.where(chance).select("item_kind", "item_a", "item_b")


def p2_lift(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.memory_pairs(table(spark, folder, "memories"))
    return pairs.select("item_kind", "item_a", "item_b", "together", "count_a", "count_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "memories").select("id", "content").dropDuplicates(["id"])
    judged = table(spark, folder, "eval_memories").select(F.col("id").cast("string").alias("id"), "content").dropDuplicates(["id"])
    return own.select(F.lit("memories").alias("table_name"), F.col("id").alias("record_id"), "content").union(judged.select(F.lit("eval_memories"), "id", "content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(_contents(spark, folder), ["table_name", "record_id"]).select("table_name", "record_id", "kind", "found_value").distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_contents(spark, folder), ["table_name", "record_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_ids(table(spark, folder, "memories"), "id", "content", shingle=3, least=0.6, least_words=12)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(table(spark, folder, "memories"), "id", "content", shingle=3, least=0.6, least_words=12)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, folder, "memory_vectors"), 5, 0.75).select("vec_a", "vec_b")


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(table(spark, folder, "memory_vectors"), 5)


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_for_budgets(table(spark, folder, "documents"), table(spark, folder, "context_budgets"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    boxes = p6_packed(spark, folder).groupBy("model", "capacity", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return boxes.groupBy("model", "capacity").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("filled")
    )


def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return packing.mixture(p6_packed(spark, folder), ["model", "capacity"])


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", F.col("query_text").alias("text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), _items(spark, folder)).select("doc_id", "item_id")


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leakage.leaked_passages(table(spark, folder, "documents"), _items(spark, folder))
    return leaks.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("run").alias("longest_run"))  # at most one entry per item


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clusters, p2_found, p2_lift, p3_found, p3_redacted, p4_found, p4_groups, p5_found, p5_neighbours, p6_packed, p6_fill, p6_mixture, p7_found, p7_documents, p8_found, p8_rates,
    )
}

_PAIRS = """
WITH once AS (SELECT id, any_value(tags) AS tags, any_value(relations.related_memories) AS cited FROM memories GROUP BY id),
held AS (
  SELECT DISTINCT 'tag' AS kind, id, lower(trim(x)) AS item FROM (SELECT id, unnest(tags) AS x FROM once) WHERE x IS NOT NULL
  UNION ALL SELECT DISTINCT 'memory', id, x FROM (SELECT id, unnest(cited) AS x FROM once) WHERE x IS NOT NULL),
items AS (SELECT kind, item, count(*) AS n FROM held GROUP BY ALL),
pairs AS (SELECT a.kind, a.item AS item_a, b.item AS item_b, count(*) AS together FROM held a JOIN held b ON a.kind = b.kind AND a.id = b.id AND a.item < b.item GROUP BY ALL),
total AS (SELECT count(*) AS n FROM once)
"""

ORACLE_SQL = {
    "p2_found": _PAIRS
    + """SELECT p.kind AS item_kind, item_a, item_b FROM pairs p JOIN items x ON x.kind = p.kind AND x.item = item_a JOIN items y ON y.kind = p.kind AND y.item = item_b, total
WHERE together >= 5 AND together * total.n >= 3 * x.n * y.n""",
    "p2_lift": _PAIRS
    + """SELECT p.kind AS item_kind, item_a, item_b, together, x.n AS count_a, y.n AS count_b,
round(together::DOUBLE * total.n / (x.n::DOUBLE * y.n), 6) AS lift,
round((together + 0.5::DOUBLE) * (total.n - x.n - y.n + together + 0.5::DOUBLE) / ((x.n - together + 0.5::DOUBLE) * (y.n - together + 0.5::DOUBLE)), 6) AS odds_ratio
FROM pairs p JOIN items x ON x.kind = p.kind AND x.item = item_a JOIN items y ON y.kind = p.kind AND y.item = item_b, total""",
    "p4_found": """
WITH once AS (SELECT id, any_value(content) AS content FROM memories GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM once),
sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 12)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 5 * o >= 3 * (x.n + y.n - o)""",
}
