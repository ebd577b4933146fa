"""Joins and aggregations over memories, entities and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.filters import entity_names, once

# Words that turn a statement round, and the relation that two memory types suggest.
NEGATIONS = "not no never none neither nobody nothing nowhere nor cannot can't won't don't doesn't didn't isn't aren't wasn't weren't shouldn't wouldn't couldn't without lacks fails failed".split()
LINEAGE_DAYS, LINEAGE_OVERLAP = 7, 0.3
LINEAGE_TYPES = {
    ("Error", "Task"): ("caused", 0.8), ("Task", "Learning"): ("resulted_in", 0.75), ("Discovery", "Decision"): ("informed_by", 0.8),
    ("Learning", "Decision"): ("informed_by", 0.8), ("Decision", "Task"): ("triggered_by", 0.7), ("Error", "Learning"): ("caused", 0.7), ("Observation", "Decision"): ("informed_by", 0.7),
}


def entity_rows(memories: DataFrame, *columns: str) -> DataFrame:
    """One row per memory and distinct entity name in lower case; memories without entities give none."""
    return memories.select("id", *columns, F.explode(F.array_distinct(entity_names())).alias("entity"))


def sharing_entities(memories: DataFrame, anchors: DataFrame) -> DataFrame:
    """Memories that share an entity with an anchor of their tenant: ``(anchor, id, shared)``; the anchor itself is left out.

    Both sides are pre-reduced to (entity, id); entities that no anchor holds are gone before the join.
    """
    rows = entity_rows(memories, "user_id")
    mine = rows.join(anchors.select("id").distinct(), "id", "left_semi").select("user_id", "entity", F.col("id").alias("anchor"))
    return mine.join(rows, ["user_id", "entity"]).where("anchor <> id").groupBy("anchor", "id").agg(F.count("*").alias("shared"))


def entity_links(memories: DataFrame) -> DataFrame:
    """For every memory the entities it shares, summed over all other memories of its tenant: ``(id, links)``.

    Each entity's memories are counted before the join, so no pair of memories is made; without entities or tenant there are 0.
    """
    rows = entity_rows(memories, "user_id")
    sizes = rows.groupBy("user_id", "entity").agg((F.count("*") - 1).alias("n"))
    links = rows.join(sizes, ["user_id", "entity"]).groupBy("id").agg(F.sum("n").alias("links"))
    return memories.select("id").join(links, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def matching_entities(memories: DataFrame, wanted: list[str]) -> DataFrame:
    """Memories that name any of a few wanted entities: ``(id, matched, score)``, the score being the matched share of the wanted."""
    names = sorted({w.lower() for w in wanted})
    hit = F.array_intersect(F.array_distinct(entity_names()), F.array(*(F.lit(w) for w in names)).cast("array<string>"))
    return memories.select("id", F.size(hit).alias("matched")).where("matched > 0").withColumn("score", F.col("matched") / float(max(1, len(names))))


def facts_as_of(facts: DataFrame, at: Column, limit: int | None = None) -> DataFrame:
    """Facts valid at ``at``: ``valid_from <= at < valid_until`` (open ends hold, a missing start is the creation), purged ones never.
    Sorted by confidence before any limit; a repeated id counts once. The tests are comparisons of single columns, which reach the scan."""
    begun = (F.col("valid_from") <= at) | (F.col("valid_from").isNull() & ((F.col("created_at") <= at) | F.col("created_at").isNull()))
    going_on = F.col("valid_until").isNull() | (F.col("valid_until") > at)
    out = once(facts.where(F.col("purged_at").isNull() & begun & going_on))
    return out.orderBy(F.desc_nulls_last("confidence"), "id").limit(limit) if limit is not None else out


def facts_as_of_many(facts: DataFrame, moments: DataFrame, bucket_days: int = 30) -> DataFrame:
    """For many moments ``(key, at)``: valid facts of each. A range join by time buckets: intervals are cut into buckets, so the join
    is an equi-join with a residual test; open ends reach to the last bucket of the moments."""
    size = bucket_days * 86_400_000_000
    ask = moments.select("key", "at", F.floor(F.unix_micros("at") / size).alias("bucket"))
    span = ask.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    if span is None or span.low is None:
        return facts.limit(0).select(F.lit(None).cast(moments.schema["key"].dataType).alias("key"), "id")
    start = F.coalesce("valid_from", "created_at")
    low = F.greatest(F.coalesce(F.floor(F.unix_micros(start) / size), F.lit(span.low)), F.lit(span.low))
    high = F.least(F.coalesce(F.floor(F.unix_micros("valid_until") / size), F.lit(span.high)), F.lit(span.high))
    cut = facts.where("purged_at is null").select("id", start.alias("start"), "valid_until", low.alias("low"), high.alias("high")).where("low <= high")
    cut = cut.select("id", "start", "valid_until", F.explode(F.sequence("low", "high")).alias("bucket"))
    hold = F.coalesce(F.col("start") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("valid_until") > F.col("at"), F.lit(True))
    return ask.join(cut, "bucket").where(hold).select("key", "id")


def fact_support(facts: DataFrame) -> DataFrame:
    """Per memory the facts it supports: count and greatest confidence."""
    rows = facts.select("id", "confidence", F.explode(F.array_distinct("source_memories")).alias("memory_id")).where("memory_id is not null")
    return rows.groupBy("memory_id").agg(F.count("*").alias("facts"), F.max("confidence").alias("confidence"))


def polarity(text: Column) -> Column:
    """True for an even number of negating words."""
    words = F.split(F.lower(text), r"[^a-z']+")
    return F.size(F.filter(words, lambda w: w.isin(NEGATIONS))) % 2 == 0


def tokens(text: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as distinct arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def contradictions(facts: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of facts of one tenant about a shared entity, worded alike (token Jaccard >= ``least``) and of opposite polarity.

    An equi-join on (tenant, entity, token prefix) would lose nothing only for large thresholds, so the join key is the entity and
    the pair is tested once, at its smallest shared entity.
    """
    shown = facts.select("id", "user_id", tokens(F.col("fact")).alias("words"), polarity(F.col("fact")).alias("positive"), F.array_distinct("related_entities").alias("all"))
    rows = shown.withColumn("entity", F.explode("all")).where("entity is not null")
    other = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    pair = (F.col("user_id") == F.col("user_id_b")) & (F.col("entity") == F.col("entity_b")) & (F.col("positive") != F.col("positive_b")) & (F.col("id") < F.col("id_b"))
    same = rows.join(other, pair).where(F.col("entity") == F.array_min(F.array_intersect("all", "all_b")))
    return same.withColumn("overlap", jaccard(F.col("words"), F.col("words_b"))).where(F.col("overlap") >= least).select("id", "id_b", "overlap")


def inferred_lineage(memories: DataFrame, days: int = LINEAGE_DAYS, least: float = LINEAGE_OVERLAP) -> DataFrame:
    """Ordered pairs of a tenant's memories within ``days`` whose entities overlap and whose types suggest a relation.

    The time band is cut into buckets of its own width (a memory looks into its bucket and the next), so the join is an equi-join
    on (tenant, entity, bucket).
    """
    width = days * 86_400_000_000
    shown = memories.select("id", "user_id", "experience_type", F.unix_micros("created_at").alias("t"), F.array_distinct(entity_names()).alias("names")).where("t is not null")
    wanted = shown.where(F.col("experience_type").isin(sorted({a for pair in LINEAGE_TYPES for a in pair})))
    rows = wanted.withColumn("entity", F.explode("names")).withColumn("bucket", F.floor(F.col("t") / width))
    later = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    early = rows.withColumn("look", F.explode(F.array("bucket", F.col("bucket") + 1)))
    near = (F.col("user_id") == F.col("user_id_b")) & (F.col("entity") == F.col("entity_b")) & (F.col("look") == F.col("bucket_b"))
    known = None
    for (a, b), (relation, confidence) in LINEAGE_TYPES.items():
        hit = (F.col("experience_type") == a) & (F.col("experience_type_b") == b)
        value = F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
        known = F.when(hit, value) if known is None else known.when(hit, value)
    pairs = early.join(later, near).where((F.col("t") <= F.col("t_b")) & (F.col("t_b") - F.col("t") <= width) & (F.col("id") != F.col("id_b")))
    pairs = pairs.where(F.col("entity") == F.array_min(F.array_intersect("names", "names_b")))
    return (
        pairs.withColumn("overlap", jaccard(F.col("names"), F.col("names_b"))).where(F.col("overlap") >= least).withColumn("k", known).where("k is not null")
        .select(F.col("id").alias("cause"), F.col("id_b").alias("effect"), "k.relation", F.col("k.confidence").alias("confidence"), "overlap").distinct()
    )


def head_duplicates(memories: DataFrame, letters: int = 200) -> DataFrame:
    """Per tenant one memory for each beginning of ``letters`` lower-case characters: the most important, then the smallest id."""
    w = Window.partitionBy("user_id", "head").orderBy(F.desc_nulls_last("importance"), "id")
    shown = memories.where("content is not null").withColumn("head", F.lower(F.substring("content", 1, letters)))
    return shown.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "head")


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average over an array in order, from its first element; null for an empty array."""
    step = lambda acc, x: F.coalesce(acc * (1 - alpha) + x * alpha, x)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def narratives(facts: DataFrame, least: int = 5, share: float = 0.2) -> DataFrame:
    """Facts gathered by topic: each fact belongs to its rarest entity; entities in ``max(least, share * facts)`` facts or more of a
    tenant are hubs and name no topic. Rows ``(user_id, topic, facts, support, confidence)``."""
    rows = facts.select("user_id", "id", "support_count", "confidence", F.explode(F.array_distinct("related_entities")).alias("entity")).where("entity is not null")
    df = rows.groupBy("user_id", "entity").agg(F.count("*").alias("df"))
    total = facts.groupBy("user_id").agg(F.count("*").alias("total"))
    usable = df.join(total, "user_id").where(F.col("df") < F.greatest(F.lit(float(least)), F.col("total") * share)).select("user_id", "entity", "df")
    topic = rows.join(usable, ["user_id", "entity"]).groupBy("user_id", "id", "support_count", "confidence").agg(F.min_by("entity", F.struct("df", "entity")).alias("topic"))
    return topic.groupBy("user_id", "topic").agg(F.count("*").alias("facts"), F.sum("support_count").alias("support"), F.avg("confidence").alias("confidence"))


def graph_stats(entities: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Per tenant that has any: distinct entities, edges with their mean strength (null without edges), and episodes.

    The three counts are aggregated side by side and united, so a tenant that lacks one of them is not lost.
    """
    none = F.lit(None)
    parts = [
        entities.groupBy("user_id").agg(F.countDistinct("uuid").alias("entities")).select("user_id", "entities", F.lit(0).alias("edges"), F.lit(0).alias("episodes"), none.cast("double").alias("strength")),
        edges.groupBy("user_id").agg(F.count("*").alias("edges"), F.avg(F.col("strength").cast("double")).alias("strength")).select("user_id", F.lit(0).alias("entities"), "edges", F.lit(0).alias("episodes"), "strength"),
        memories.groupBy("user_id").agg(F.countDistinct("episode_id").alias("episodes")).select("user_id", F.lit(0).alias("entities"), F.lit(0).alias("edges"), "episodes", none.cast("double").alias("strength")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in ("entities", "edges", "episodes")), F.max("strength").alias("strength"))
