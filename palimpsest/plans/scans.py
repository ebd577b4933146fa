"""Queries: scans, lookups, filters, predicates, sorts and pages over memories."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators import filters as fl
from palimpsest.operators.filters import Criteria
from palimpsest.plans.common import AS_OF, AS_OF_SQL, HOT_TENANT, MEMORIES, TENANT, Registry, as_of, memories, r
from palimpsest.runtime import table

_reg = Registry()
_M = f"WITH {MEMORIES} "
_FORGOT = "coalesce(metadata['forgotten'] = 'true', false)"
_SHOWN = "coalesce(experience_type <> 'Intention', true)"
_LIVE = f"NOT {_FORGOT} AND {_SHOWN}"


def _searched(spark: SparkSession, folder: str, criteria: Criteria, *columns) -> DataFrame:
    return fl.search(table(spark, folder, "memories"), criteria).select(*(columns or ("id",)))


@_reg.add(_M + f"SELECT id, user_id, experience_type, length(content) AS n_chars FROM m WHERE NOT {_FORGOT}")
def scan_full(spark, folder):
    return memories(spark, folder, ~fl.forgotten()).select("id", "user_id", "experience_type", F.length("content").alias("n_chars"))


@_reg.add("""WITH t AS (SELECT DISTINCT ON (id) id, tier FROM memories), u AS (
SELECT id, tier, 0 AS k FROM t WHERE tier = 'Working' UNION ALL SELECT id, tier, 1 FROM t WHERE tier IN ('Working', 'Session') UNION ALL SELECT id, tier, 2 FROM t)
SELECT id, min(k) AS tier_rank FROM u GROUP BY id""")
def scan_tiers(spark, folder):
    m = memories(spark, folder).select("id", "tier")
    return fl.by_tier(m.where("tier = 'Working'"), m.where("tier in ('Working', 'Session')"), m).select("id", "tier_rank")


@_reg.add("SELECT DISTINCT id FROM memories")
def scan_keys(spark, folder):
    return table(spark, folder, "memories").select("id").distinct()


@_reg.add(_M + "SELECT id, user_id, content FROM m WHERE id = (SELECT min(id) FROM memories)")
def lookup_id(spark, folder):
    first = table(spark, folder, "memories").agg(F.min("id")).first()[0]
    return memories(spark, folder, F.col("id") == first).select("id", "user_id", "content")


@_reg.add(_M + "SELECT id, user_id FROM m WHERE starts_with(id, (SELECT substr(min(id), 1, 16) FROM memories))")
def lookup_prefix(spark, folder):
    prefix = table(spark, folder, "memories").agg(F.min("id")).first()[0][:16]
    return fl.find_by_prefix(table(spark, folder, "memories"), prefix).select("id", "user_id")


@_reg.add(_M + "SELECT id, external_id FROM m WHERE external_id = (SELECT min(external_id) FROM memories)")
def lookup_external(spark, folder):
    wanted = table(spark, folder, "memories").agg(F.min("external_id")).first()[0]
    return _searched(spark, folder, Criteria(external_id=wanted, types=None, include_forgotten=True, extra=[F.lit(True)]), "id", "external_id")


@_reg.add(_M + "SELECT sha256(content) AS content_hash, count(*) AS copies, min(id) AS kept FROM m WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def lookup_content_hash(spark, folder):
    m = memories(spark, folder, "content is not null").select("id", fl.content_hash().alias("content_hash"))
    return m.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("kept")).where("copies > 1")


@_reg.add(_M + f"SELECT id, epoch_us(updated_at) AS updated_us FROM m WHERE user_id = '{TENANT}' AND experience_type = 'Discovery'")
def relational_scan(spark, folder):
    m = memories(spark, folder, (F.col("user_id") == TENANT) & fl.equals("experience_type", "Discovery"))
    return m.orderBy(F.desc("updated_at"), "id").select("id", F.unix_micros("updated_at").alias("updated_us"))


@_reg.add(_M + f"""SELECT id FROM m WHERE {_LIVE.replace(f' AND {_SHOWN}', '')} AND user_id = '{HOT_TENANT}' AND experience_type IN ('Discovery', 'Error', 'Observation')
AND importance >= 0.3 AND created_at >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND outcome_type IN ('success', 'failure') AND NOT coalesce(valid_until < {AS_OF_SQL}, false)""")
def filter_unified(spark, folder):
    c = Criteria(user_id=HOT_TENANT, types=["Discovery", "Error", "Observation"], importance=(0.3, None), created=(datetime(2024, 3, 1, tzinfo=timezone.utc), None), outcome_types=["success", "failure"], as_of=AS_OF)
    return _searched(spark, folder, c)


@_reg.add(_M + f"SELECT {_FORGOT} AS forgotten, count(*) AS n FROM m GROUP BY 1")
def filter_soft_delete(spark, folder):
    return memories(spark, folder).groupBy(fl.forgotten().alias("forgotten")).agg(F.count("*").alias("n"))


@_reg.add(_M + f"SELECT id FROM m WHERE NOT coalesce(valid_until < {AS_OF_SQL}, false)")
def filter_expiry(spark, folder):
    return memories(spark, folder, fl.unexpired(as_of())).select("id")


@_reg.add(_M + f"SELECT experience_type, count(*) AS n FROM m WHERE {_LIVE} GROUP BY 1")
def filter_default_types(spark, folder):
    return _searched(spark, folder, Criteria(), "id", "experience_type").groupBy("experience_type").agg(F.count("*").alias("n"))


@_reg.add(_M + "SELECT id FROM m WHERE tier = 'LongTerm'")
def predicate_equals(spark, folder):
    return memories(spark, folder, fl.equals("tier", "LongTerm")).select("id")


@_reg.add(_M + "SELECT id FROM m WHERE severity IN ('high', 'critical')")
def predicate_in(spark, folder):
    return memories(spark, folder, fl.one_of("severity", ["high", "critical"])).select("id")


@_reg.add(_M + "SELECT id FROM m WHERE reward >= 0.0 AND reward <= 0.5")
def predicate_range(spark, folder):
    return memories(spark, folder, fl.between("reward", 0.0, 0.5)).select("id")


@_reg.add(_M + f"SELECT count(*) AS n FROM m WHERE user_id = '{TENANT}'")
def predicate_tenant(spark, folder):
    return memories(spark, folder, fl.equals("user_id", TENANT)).agg(F.count("*").alias("n"))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND CAST(created_at AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-02-20'")
def search_date(spark, folder):
    return _searched(spark, folder, Criteria(days=("2024-02-01", "2024-02-20")))


@_reg.add(_M + f"SELECT id FROM m WHERE NOT {_FORGOT} AND experience_type = 'Error'")
def search_type(spark, folder):
    return _searched(spark, folder, Criteria(types=["Error"]))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND floor(round(importance::DOUBLE * 10, 6)) BETWEEN 4 AND 6")
def search_importance_buckets(spark, folder):
    return _searched(spark, folder, Criteria(importance_buckets=(0.4, 0.6)))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND list_contains([lower(e.text) for e in entities if e.text is not null], 'bloom filter')")
def search_entity(spark, folder):
    return _searched(spark, folder, Criteria(entity="Bloom Filter"))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND coalesce(list_has_any([lower(trim(t)) for t in tags if t is not null], ['backup', 'privacy']), false)")
def search_tags(spark, folder):
    return _searched(spark, folder, Criteria(tags=["Backup", " privacy"]))


@_reg.add(_M + f"SELECT id, sequence_number FROM m WHERE {_LIVE} AND episode_id = (SELECT min(episode_id) FROM memories) AND sequence_number >= 0")
def search_episode(spark, folder):
    wanted = table(spark, folder, "memories").agg(F.min("episode_id")).first()[0]
    return _searched(spark, folder, Criteria(episode_id=wanted, sequence=(0, None)), "id", "sequence_number").orderBy("sequence_number", "id")


@_reg.add(_M + f"SELECT robot_id, mission_id, count(*) AS n FROM m WHERE {_LIVE} AND robot_id IS NOT NULL AND mission_id IS NOT NULL GROUP BY ALL")
def search_robot_mission(spark, folder):
    c = Criteria(extra=[F.col("robot_id").isNotNull(), F.col("mission_id").isNotNull()])
    return _searched(spark, folder, c, "robot_id", "mission_id").groupBy("robot_id", "mission_id").agg(F.count("*").alias("n"))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND floor(round((least(greatest(reward::DOUBLE, -1), 1) + 1) * 10, 6)) BETWEEN 5 AND 12")
def search_reward_buckets(spark, folder):
    return _searched(spark, folder, Criteria(reward_buckets=(-0.5, 0.2)))


_GEO = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"""
_HERE = _GEO.format(a="geo_location[1]", b="h.lat", c="geo_location[2]", d="h.lon")
_CENTRE = "h AS (SELECT geo_location[1] AS lat, geo_location[2] AS lon FROM memories WHERE len(geo_location) >= 2 ORDER BY id LIMIT 1)"


@_reg.add(f"WITH {MEMORIES}, {_CENTRE} SELECT id, round({_HERE}, 3) AS metres FROM m, h WHERE {_LIVE} AND len(geo_location) >= 2 AND {_HERE} <= 20000")
def search_location(spark, folder):
    centre = table(spark, folder, "memories").where(F.size("geo_location") >= 2).agg(F.min_by("geo_location", "id")).first()[0]
    found = _searched(spark, folder, Criteria(near=(centre[0], centre[1], 20_000.0)), "id", "geo_location")
    metres = geo.haversine(F.get("geo_location", 0), F.get("geo_location", 1), F.lit(centre[0]), F.lit(centre[1]))
    return found.select("id", F.round(metres, 3).alias("metres"))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND importance >= 0.25 AND list_contains([lower(e.text) for e in entities if e.text is not null], 'merkle tree') AND tier IN ('LongTerm', 'Session')")
def search_combined(spark, folder):
    return _searched(spark, folder, Criteria(importance=(0.25, None), entity="Merkle Tree", tiers=["LongTerm", "Session"]))


@_reg.add(_M + f"SELECT parent_id, count(*) AS children FROM m WHERE {_LIVE} AND parent_id IS NOT NULL GROUP BY 1")
def search_children(spark, folder):
    return _searched(spark, folder, Criteria(extra=[F.col("parent_id").isNotNull()]), "parent_id").groupBy("parent_id").agg(F.count("*").alias("children"))


@_reg.add(_M + f"SELECT user_id, count(*) AS roots FROM m WHERE {_LIVE} AND parent_id IS NULL GROUP BY 1")
def search_roots(spark, folder):
    return _searched(spark, folder, Criteria(roots_only=True), "user_id").groupBy("user_id").agg(F.count("*").alias("roots"))


@_reg.add(_M + f"SELECT id FROM m WHERE {_LIVE} AND coalesce(is_anomaly, false)")
def search_anomalies(spark, folder):
    return _searched(spark, folder, Criteria(anomalies_only=True))


@_reg.add(f"""WITH {MEMORIES}, w AS (SELECT id, user_id FROM m WHERE user_id IN ('{TENANT}', 'usr_0000002') OR (user_id = 'usr_0000003' AND id IN (SELECT min(id) FROM m WHERE user_id = 'usr_0000003')))
SELECT user_id, count(*) AS readable FROM w GROUP BY 1""")
def acl_readable(spark, folder):
    m = memories(spark, folder)
    one = m.where("user_id = 'usr_0000003'").agg(F.min("id")).first()[0]
    grants = spark.createDataFrame([("usr_0000002", TENANT, None), ("usr_0000003", TENANT, one)], "owner string, viewer string, memory_id string")
    return fl.readable(m, grants, TENANT).groupBy("user_id").agg(F.count("*").alias("readable"))


@_reg.add(_M + f"SELECT id, (SELECT count(*) > 30 FROM m WHERE user_id = '{HOT_TENANT}') AS has_more FROM (SELECT id FROM m WHERE user_id = '{HOT_TENANT}' ORDER BY importance DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 10 OFFSET 20)")
def page_offset(spark, folder):
    order = [F.desc_nulls_last("importance"), F.desc_nulls_last("created_at"), F.asc("id")]
    return fl.page(memories(spark, folder, F.col("user_id") == HOT_TENANT).select("id", "importance", "created_at"), order, 20, 10).select("id", "has_more")


@_reg.add(_M + "SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC NULLS LAST, created_at DESC NULLS LAST, id) AS rank FROM m) WHERE rank <= 3")
def top_per_tenant(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("created_at"), "id")
    return memories(spark, folder).select("user_id", "id", F.row_number().over(w).alias("rank")).where("rank <= 3")


@_reg.add(_M + "SELECT id FROM m WHERE list_has_any([lower(trim(t)) for t in tags if t is not null], ['audit']) INTERSECT SELECT id FROM m WHERE importance > 0.2")
def set_criteria_intersection(spark, folder):
    m = memories(spark, folder)
    return m.where(F.array_contains(fl.lowered("tags"), "audit")).select("id").intersect(m.where("importance > 0.2").select("id"))


@_reg.add(_M + "SELECT id FROM m WHERE list_has_any([lower(trim(t)) for t in tags if t is not null], ['backup', 'privacy', 'staging']) INTERSECT SELECT id FROM m WHERE importance > 0.2")
def set_criteria_overlap(spark, folder):
    tagged = F.arrays_overlap(fl.lowered("tags"), F.array(*(F.lit(t) for t in ("backup", "privacy", "staging"))))
    return memories(spark, folder, tagged).select("id").intersect(memories(spark, folder, "importance > 0.2").select("id"))


@_reg.add(_M + "SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(tags) AS t FROM m) WHERE t IS NOT NULL")
def set_tag_union(spark, folder):
    return memories(spark, folder).select(F.explode("tags").alias("t")).where("t is not null").select(F.lower(F.trim("t")).alias("tag")).distinct()


@_reg.add("SELECT DISTINCT id FROM memories WHERE id NOT IN (SELECT memory_id FROM memory_vectors)")
def set_without_vector(spark, folder):
    v = table(spark, folder, "memory_vectors").select(F.col("memory_id").alias("id")).distinct()
    return table(spark, folder, "memories").select("id").distinct().join(v, "id", "left_anti")


@_reg.add("SELECT nation.n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0 GROUP BY 1")
def dataset_filter_join(spark, folder):
    s = table(spark, folder, "supplier").where(F.col("s_acctbal") >= 0)
    n = table(spark, folder, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("suppliers"), r(F.sum("s_acctbal"), 2).alias("balance"))


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
