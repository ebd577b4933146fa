"""Changes to tables as idempotent batch transforms: old table in, new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators.filters import forgotten


def remember(memories: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows that are new: their content (by SHA-256) is not yet there, each content once (the smallest id)."""
    fresh = incoming.where("content is not null").withColumn("content_hash", F.sha2("content", 256))
    # Combined before the shuffle: a content that many rows share is no group of rows anywhere.
    first = fresh.groupBy("content_hash").agg(F.min("id").alias("id"))
    fresh = fresh.join(first, ["content_hash", "id"], "left_semi").dropDuplicates(["id"])
    return fresh.join(memories.select(F.sha2("content", 256).alias("content_hash")).distinct(), "content_hash", "left_anti")


def upsert(memories: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """``(external_id, content, history)`` after changes by external id: replaced contents go to the history; unknown ids are added."""
    old = memories.where("external_id is not null").groupBy("external_id").agg(F.min_by("content", "id").alias("old"))
    new = changes.groupBy("external_id").agg(F.max("content").alias("new"))
    both = old.join(new, "external_id", "full")
    changed = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))
    entry = F.struct(F.col("old").alias("content"), at.alias("changed_at"))
    return both.select("external_id", F.coalesce("new", "old").alias("content"), F.when(changed, F.array(entry)).otherwise(F.array().cast("array<struct<content:string,changed_at:timestamp>>")).alias("history"))


def forget(memories: DataFrame, condition: Column, hard: bool = False) -> DataFrame:
    """Soft: mark matching rows in their metadata; hard: leave them out. A null condition does not match."""
    hit = F.coalesce(condition, F.lit(False))
    if hard:
        return memories.where(~hit)
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "forgotten")
    return memories.withColumn("metadata", F.when(hit, F.map_concat(kept, F.create_map(F.lit("forgotten"), F.lit("true")))).otherwise(F.col("metadata")))


def promoted_tier(importance: Column, age_seconds: Column) -> Column:
    """Tier after promotion: Working to Session at 0.35 and half an hour, Session to LongTerm at 0.5 and a day."""
    tier = F.col("tier")
    return F.when((tier == "Working") & (importance >= 0.35) & (age_seconds >= 1800), "Session").when((tier == "Session") & (importance >= 0.5) & (age_seconds >= 86_400), "LongTerm").otherwise(tier)


def replay_candidates(memories: DataFrame, at: Column, limit: int = 50) -> DataFrame:
    """Recent important memories by priority ``importance * (1 - age / 14 days) * (1 + min(links / 10, 0.5))``."""
    age = F.floor(sc.days_between(at, F.col("created_at")) * 24) / 24.0
    links = F.coalesce(F.size("relations.related_memories"), F.lit(0))
    value = F.col("importance").cast("double")
    some = memories.where(~forgotten()).withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= 14) & (value >= 0.3))
    return some.select("id", (value * (1 - F.col("age") / 14.0) * (1 + F.least(links / 10.0, F.lit(0.5)))).alias("priority")).orderBy(F.desc("priority"), "id").limit(limit)


def interference(similar: DataFrame) -> DataFrame:
    """From ``(new_id, old_id, similarity, new_importance, old_importance, old_age_hours)``: duplicates, and how much old and new decay.

    At 0.95 or more a pair is a duplicate and its new memory has no other effects; from 0.85 the old one fades if young or weaker,
    the new one fades where the old is strong.
    """
    near = similar.where("similarity >= 0.85 and new_id <> old_id")
    duplicate = F.max((F.col("similarity") >= 0.95).cast("int")).over(Window.partitionBy("new_id")) == 1
    strength = (F.col("similarity") - 0.85) / 0.15
    fades = (F.col("old_age_hours") < 24) | (F.col("old_importance") < F.col("new_importance"))
    back = F.when(duplicate, 0.0).when(fades, 0.1 * strength).otherwise(0.0)
    ahead = F.when(duplicate, 0.0).when(~fades & (F.col("old_importance") > 0.8), 0.05 * strength * (F.col("old_importance") - 0.8)).otherwise(0.0)
    return near.select("new_id", "old_id", duplicate.alias("duplicate"), back.alias("retroactive"), ahead.alias("proactive"))


def reinforce_facts(facts: DataFrame, support: DataFrame) -> DataFrame:
    """Support counts grow by the number of new supporting memories ``(fact_id, memory_id)`` that a fact did not list; confidence moves a tenth of the way to 1 for each."""
    known = facts.select(F.col("id").alias("fact_id"), F.explode("source_memories").alias("memory_id"))
    fresh = support.distinct().join(known, ["fact_id", "memory_id"], "left_anti").groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("more"))
    out = facts.join(fresh, "id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    grown = 1 - (1 - F.col("confidence").cast("double")) * F.pow(F.lit(0.9), F.col("more"))
    return out.withColumn("support_count", F.col("support_count") + F.col("more")).withColumn("confidence", grown).drop("more")


def purge_facts(facts: DataFrame, at: Column, least: float, reason: str = "decayed") -> DataFrame:
    """Facts whose confidence has faded under ``least`` get ``purged_at`` and a reason; facts purged before keep theirs."""
    days = sc.days_between(at, F.col("last_reinforced"))
    faded = F.coalesce(F.col("confidence").cast("double") * sc.fact_decay(days, F.col("support_count")) < least, F.lit(False)) & F.col("purged_at").isNull()
    return facts.withColumn("purge_reason", F.when(faded, reason).otherwise(F.col("purge_reason"))).withColumn("purged_at", F.when(faded, at).otherwise(F.col("purged_at")))


def assigned(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows with the non-null values of ``changes`` in the named columns; of several changes of a key the greatest value counts."""
    last = changes.groupBy(key).agg(*(F.max(c).alias(f"_{c}") for c in columns))
    met = rows.join(last, key, "left")
    return met.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def remember_enriched(memories: DataFrame, incoming: DataFrame) -> DataFrame:
    """:func:`remember` with what is known at once about a new memory: its importance and the dates it names."""
    from palimpsest.functions.strings import explicit_dates
    from palimpsest.operators.recall import importance

    fresh = remember(memories, incoming)
    return fresh.withColumn("importance", importance(fresh)).withColumn("dates", explicit_dates(F.col("content")))
