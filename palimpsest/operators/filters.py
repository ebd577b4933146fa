"""Predicates over memories as columns, and the lookups and searches built from them.

Every predicate is one ``Column``; nothing here joins or shuffles, so filters reach the Parquet scan and compose freely.
Nulls: a row whose tested column is null never matches, except where a docstring says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geo

#: Columns that planner predicates may name.
WHITELIST = ("user_id", "id", "experience_type", "importance", "tier", "created_at", "updated_at", "robot_id", "mission_id", "severity", "outcome_type", "reward", "episode_id")
HIDDEN_TYPE = "Intention"


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Each key once: redelivered rows repeat the content, so any of them will do."""
    return df.dropDuplicates([key])


def forgotten() -> Column:
    """Softly deleted: the metadata say so. A missing map or entry means no."""
    return F.coalesce(F.element_at("metadata", "forgotten") == "true", F.lit(False))


def expired(as_of: Column) -> Column:
    """``valid_until`` is before ``as_of``; an open end never expires."""
    return F.col("valid_until").isNotNull() & (F.col("valid_until") < as_of)


def unexpired(as_of: Column) -> Column:
    """The opposite of ``expired`` in a form that reaches the scan."""
    return F.col("valid_until").isNull() | (F.col("valid_until") >= as_of)


def lowered(column: str) -> Column:
    """An array of strings trimmed and in lower case, nulls left out; a null array stays null."""
    return F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))


def entity_names() -> Column:
    return F.transform(F.filter("entities", lambda e: e["text"].isNotNull()), lambda e: F.lower(e["text"]))


@dataclass
class Criteria:
    """The optional parts of a search; parts that are given are ANDed, an empty list matches nothing."""

    user_id: str | None = None
    types: list[str] | None = None
    importance: tuple[float | None, float | None] | None = None
    importance_buckets: tuple[float, float] | None = None
    created: tuple[datetime | None, datetime | None] | None = None
    days: tuple[str, str] | None = None
    tags: list[str] | None = None
    entity: str | None = None
    robot_id: str | None = None
    mission_id: str | None = None
    episode_id: str | None = None
    sequence: tuple[int | None, int | None] | None = None
    outcome_types: list[str] | None = None
    severities: list[str] | None = None
    reward: tuple[float | None, float | None] | None = None
    reward_buckets: tuple[float, float] | None = None
    anomalies_only: bool = False
    near: tuple[float, float, float] | None = None
    tiers: list[str] | None = None
    parent_id: str | None = None
    roots_only: bool = False
    external_id: str | None = None
    as_of: datetime | None = None
    include_forgotten: bool = False
    extra: list[Column] = field(default_factory=list)


def within(column: str | Column, bounds: tuple) -> Column:
    """Inclusive range; an open bound is None, and two open bounds always hold."""
    c = F.col(column) if isinstance(column, str) else column
    low, high = bounds
    out = F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low))
    if high is not None:
        out = out & (c <= F.lit(high))
    return out


def importance_bucket(value: Column) -> Column:
    return F.floor(F.round(value.cast("double") * 10, 6))


def reward_bucket(value: Column) -> Column:
    return F.floor(F.round((F.least(F.greatest(value.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1) * 10, 6))


def near(lat: float, lon: float, radius: float, prune: bool = True) -> Column:
    """Within ``radius`` metres by exact distance; a covering set of cells may prune first."""
    here = F.col("geo_location")
    exact = F.coalesce((F.size(here) >= 2) & (geo.haversine(F.get(here, 0), F.get(here, 1), F.lit(lat), F.lit(lon)) <= radius), F.lit(False))
    if not prune:
        return exact
    precision = geo.covering_precision(radius)
    return geo.geohash(F.get(here, 0), F.get(here, 1), precision).isin(geo.covering_cells(lat, lon, radius)) & exact


def matching(c: Criteria) -> Column:
    """One predicate for all criteria. Without ``types``, memories of the hidden type are left out."""
    parts = [] if c.include_forgotten else [~forgotten()]
    if c.user_id is not None:
        parts.append(F.col("user_id") == c.user_id)
    parts.append(F.col("experience_type").isin(c.types) if c.types is not None else F.coalesce(F.col("experience_type") != HIDDEN_TYPE, F.lit(True)))
    for bounds, column in ((c.importance, "importance"), (c.created, "created_at"), (c.reward, "reward"), (c.sequence, "sequence_number")):
        if bounds is not None:
            parts.append(within(column, bounds))
    if c.importance_buckets is not None:
        low, high = (importance_bucket(F.lit(x)) for x in c.importance_buckets)
        # The range of raw values that the buckets span, for the scan; the bucket decides.
        parts.append(within("importance", (c.importance_buckets[0] - 0.11, c.importance_buckets[1] + 0.11)))
        parts.append(importance_bucket(F.col("importance")).between(low, high))
    if c.reward_buckets is not None:
        low, high = (reward_bucket(F.lit(x)) for x in c.reward_buckets)
        # Rewards beyond [-1, 1] fall into the outer buckets, so the raw range is open there.
        raw = [x if abs(x) < 1 else None for x in (c.reward_buckets[0] - 0.11, c.reward_buckets[1] + 0.11)]
        parts.append(within("reward", tuple(raw)))
        parts.append(reward_bucket(F.col("reward")).between(low, high))
    if c.days is not None:
        parts.append(F.to_date("created_at").between(F.lit(c.days[0]).cast("date"), F.lit(c.days[1]).cast("date")))
    if c.tags is not None:
        parts.append(F.coalesce(F.arrays_overlap(lowered("tags"), F.array(*(F.lit(t.strip().lower()) for t in c.tags)).cast("array<string>")), F.lit(False)))
    if c.entity is not None:
        parts.append(F.coalesce(F.array_contains(entity_names(), c.entity.lower()), F.lit(False)))
    for value, column in ((c.robot_id, "robot_id"), (c.mission_id, "mission_id"), (c.episode_id, "episode_id"), (c.parent_id, "parent_id"), (c.external_id, "external_id")):
        if value is not None:
            parts.append(F.col(column) == value)
    for values, column in ((c.outcome_types, "outcome_type"), (c.severities, "severity"), (c.tiers, "tier")):
        if values is not None:
            parts.append(F.col(column).isin(values))
    if c.anomalies_only:
        parts.append(F.coalesce("is_anomaly", F.lit(False)))
    if c.roots_only:
        parts.append(F.col("parent_id").isNull())
    if c.near is not None:
        parts.append(near(*c.near))
    if c.as_of is not None:
        parts.append(~expired(F.lit(c.as_of)))
    out = F.lit(True)
    for p in parts + c.extra:
        out = out & p
    return out


def search(memories: DataFrame, criteria: Criteria) -> DataFrame:
    return once(memories.where(matching(criteria)))


def equals(column: str, value, strict: bool = True) -> Column:
    """Planner equality. An unknown column is an error, or matches nothing if not ``strict``."""
    return _checked(column, strict, lambda: F.col(column) == F.lit(value))


def one_of(column: str, values: list, strict: bool = True) -> Column:
    """Planner membership; an empty list matches nothing."""
    return _checked(column, strict, lambda: F.col(column).isin(values) if values else F.lit(False))


def between(column: str, low=None, high=None, strict: bool = True) -> Column:
    return _checked(column, strict, lambda: within(column, (low, high)))


def _checked(column: str, strict: bool, make) -> Column:
    if column in WHITELIST:
        return make()
    if strict:
        raise ValueError(f"predicates may not name {column!r}; they may name {', '.join(WHITELIST)}")
    return F.lit(False)


def find_by_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    """The row whose id starts with ``prefix``; more than one id is an error, none gives no rows. At most two ids are looked at."""
    hits = memories.where(F.col("id").startswith(prefix))
    if len(hits.select("id").distinct().limit(2).collect()) > 1:
        raise ValueError(f"{prefix!r} is ambiguous")
    return once(hits)


def content_hash(column: str = "content") -> Column:
    return F.sha2(F.col(column), 256)


def by_tier(*tiers: DataFrame) -> DataFrame:
    """Union of tiers; an id in several tiers counts in the first."""
    out = None
    for rank, df in enumerate(tiers):
        df = df.withColumn("tier_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("tier_rank"))).where("_n = 1").drop("_n")


def readable(memories: DataFrame, grants: DataFrame, viewer: str) -> DataFrame:
    """Own memories and those that a grant ``(owner, viewer, memory_id)`` opens; a null memory_id grants all of the owner's."""
    mine = memories.where(F.col("user_id") == viewer)
    g = grants.where(F.col("viewer") == viewer)
    foreign = memories.where(F.col("user_id") != viewer)
    whole = foreign.join(g.where("memory_id is null").select(F.col("owner").alias("user_id")).distinct(), "user_id", "left_semi")
    single = foreign.join(g.where("memory_id is not null").select(F.col("owner").alias("user_id"), F.col("memory_id").alias("id")).distinct(), ["user_id", "id"], "left_semi")
    return once(mine.unionByName(whole).unionByName(single))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and ``has_more``, from a single ordered read of ``limit`` + 1 rows."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most limit + 1 rows
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def writable(memories: DataFrame, grants: DataFrame, viewer: str) -> DataFrame:
    """Memories that a viewer may change: their own, and those of an owner (or the one memory) that grants them the right to write."""
    may = grants.where((F.col("viewer") == viewer) & (F.col("right") == "write"))
    whole = may.where("memory_id is null").select(F.col("owner").alias("user_id")).distinct()
    single = may.where("memory_id is not null").select(F.col("owner").alias("user_id"), F.col("memory_id").alias("id")).distinct()
    others = memories.where(F.col("user_id") != viewer)
    by_owner = others.join(whole, "user_id", "left_semi")
    by_row = others.join(whole, "user_id", "left_anti").join(single, ["user_id", "id"], "left_semi")
    return memories.where(F.col("user_id") == viewer).unionByName(by_owner).unionByName(by_row)
