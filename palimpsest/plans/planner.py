"""The conjunctive planner: one scan per predicate, the rest as semi joins, and one total order.

Catalyst picks the join strategy and order; the planner fixes meaning: the tenant predicate is always there, vector predicates score
once (not once per candidate), no scan is truncated unless a cap is asked for, and results are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import vectors as vc


@dataclass
class Plan:
    user_id: str
    relational: list[Column] = field(default_factory=list)
    vector: tuple[list[float], int] | None = None
    entities: list[str] = field(default_factory=list)
    shares_with: str | None = None
    episode: str | None = None
    limit: int | None = None


def execute(plan: Plan, memories: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, similarity)``, by similarity where the plan has a vector predicate, then newest first, then id.

    ``vectors``: ``memory_id, vector`` with comparable vectors (repeated rows do no harm); a memory scores by its best vector. With a vector predicate only its
    ``top_k`` memories (after all other predicates) remain.
    """
    where = F.col("user_id") == plan.user_id
    for p in plan.relational:
        where = where & p
    if plan.episode is not None:
        where = where & (F.col("episode_id") == plan.episode)
    names = F.transform(F.filter("entities", lambda e: e["text"].isNotNull()), lambda e: F.lower(e["text"]))
    for e in plan.entities:
        where = where & F.coalesce(F.array_contains(names, e.lower()), F.lit(False))
    rows = memories.where(where).dropDuplicates(["id"])
    if plan.shares_with is not None:
        anchor = memories.where((F.col("user_id") == plan.user_id) & (F.col("id") == plan.shares_with)).select(F.explode(names).alias("name")).distinct()
        held = rows.select("id", F.explode(names).alias("name")).join(anchor, "name", "left_semi").select("id").distinct()
        rows = rows.join(held, "id", "left_semi").where(F.col("id") != plan.shares_with)
    rows = rows.select("id", "updated_at")
    newest = [F.desc_nulls_last("updated_at"), F.asc("id")]
    if plan.vector is None:
        out = rows.withColumn("similarity", F.lit(None).cast("double")).orderBy(*newest)
    else:
        query, k = plan.vector
        scored = vectors.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", vc.cosine_with("vector", query).alias("similarity"))
        best = vc.max_pool(scored.where("similarity is not null"), "memory_id")
        out = rows.join(best, rows.id == best.memory_id).select("id", "updated_at", "similarity").orderBy(F.desc("similarity"), *newest).limit(k)
    out = out.limit(plan.limit) if plan.limit is not None else out
    return out.select("id", "similarity")


def describe(plan: Plan) -> list[str]:
    """The stages in the order of their usual cost: equality before sets before vectors."""
    steps = [f"tenant {plan.user_id}"] + ["relational"] * len(plan.relational) + (["episode"] if plan.episode else []) + [f"entity {e}" for e in plan.entities]
    return steps + (["shares entities"] if plan.shares_with else []) + ([f"vector top {plan.vector[1]}"] if plan.vector else []) + ([f"limit {plan.limit}"] if plan.limit is not None else [])
