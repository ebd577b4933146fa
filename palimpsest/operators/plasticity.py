"""Plastic edges: strengthening, directions, potentiation, decay with rescue, degree limits, and activation that spreads over them.

Edges have ``uuid, from_entity, to_entity, relation_type, strength, tier, ltp_status, activation_count, activation_timestamps,
created_at, last_activated, invalidated_at, entity_confidence``. Every rule is a column expression over one row, so a batch of any size
is one pass; only the limits on a node's edges and the spreads shuffle. Null strengths count as 0, a null tier as the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.operators.texts import first_ranks
from palimpsest.runtime import materialize

# Fixed values that results depend on.
LEARNING_RATE, TIER_BOOST = 0.1, {"L1": 0.15, "L2": 0.15 * 0.8, "L3": 0.15 * 0.5}
LTP_ORDER, LTP_BONUS = {"Burst": 1, "Weekly": 2, "Full": 3}, {"Burst": 0.05, "Weekly": 0.1, "Full": 0.2}
PROMOTION = {"L1": (0.5, "L2", 0.5), "L2": (0.7, "L3", 0.7)}
READY, AGED_DAYS, AGED_ACTIVATIONS = 1.0, 30, 5
BURST_ACTIVATIONS, BURST_HOURS, WEEKLY_ACTIVATIONS, WEEKS = 5, 24, 3, 2
FORWARD_BOOST, BACKWARD_BOOST = 0.015, 0.010
RESCUE = {"L1": 0.30, "L2": 0.40, "L3": 0.50}
MAX_DEGREE = 500
DECAY_LOW, DECAY_HIGH = 0.05, 0.15
HOPS, FAN, THRESHOLD, RELAXED, FEW, FIRST_HOPS, SATURATED, ENOUGH, CEILING = 6, 100, 0.005, 0.001, 5, 3, 0.05, 50, 2.0
MEETING_LEAST, MEETING_BOOST = 0.0025, 1.5
GENERIC_RELATIONS, RELATION_PENALTY, ENTITY_PENALTY = ("CoOccurs", "RelatedTo", "CoRetrieved"), 0.4, 0.6


def _by(mapping: dict, key: Column, otherwise) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(otherwise)


def hours_since(moment: str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(moment)) / 3_600_000_000.0


def effective(now: Column, strength: Column | None = None) -> Column:
    """Strength after the decay since the last activation; an edge that was never activated keeps it."""
    raw = F.coalesce((F.col("strength") if strength is None else strength).cast("double"), F.lit(0.0))
    return F.coalesce(sc.effective_strength(raw, hours_since("last_activated", now), F.col("tier"), F.col("ltp_status")), raw)


def potentiation(now: Column, strength: Column, activations: Column) -> Column:
    """The status that the evidence gives an edge: 'Full' by readiness or by age, 'Weekly' by habit, 'Burst' by a busy day, else null."""
    stamps = F.coalesce(F.when(F.col("tier") != "L1", F.col("activation_timestamps")), F.array().cast("array<timestamp>"))
    since = lambda low, high: F.size(F.filter(stamps, lambda t: (t >= now - F.make_dt_interval(hours=F.lit(low))) & (t < now - F.make_dt_interval(hours=F.lit(high)) if high else t <= now)))
    ready = sc.ltp_readiness(F.col("tier"), activations, strength, F.col("entity_confidence")) >= READY
    aged = (F.floor(hours_since("created_at", now) / 24) >= AGED_DAYS) & (activations >= AGED_ACTIVATIONS)
    weekly = F.lit(True)
    for w in range(WEEKS):
        weekly = weekly & (since(168 * (w + 1), 168 * w) >= WEEKLY_ACTIVATIONS)
    return F.when(ready | aged, "Full").when(weekly, "Weekly").when(since(BURST_HOURS, 0) >= BURST_ACTIVATIONS, "Burst")


def strengthened(edges: DataFrame, now: Column) -> DataFrame:
    """The edges after one more activation: ``strength`` grows towards 1 by the learning rate and the tier's share, a higher
    potentiation adds its bonus and is never taken back, and an edge that reaches its tier's bound is promoted (``promoted``)."""
    weight = F.coalesce(F.col("strength").cast("double"), F.lit(0.0))
    count = F.coalesce("activation_count", F.lit(0)) + 1
    grown = F.least(weight + (LEARNING_RATE + _by(TIER_BOOST, F.col("tier"), TIER_BOOST["L3"])) * (1 - weight), F.lit(1.0))
    step = edges.withColumns({"_w": grown, "_n": count}).withColumn("_seen", potentiation(now, F.col("_w"), F.col("_n")))
    higher = _by(LTP_ORDER, F.col("_seen"), 0) > _by(LTP_ORDER, F.col("ltp_status"), 0)
    step = step.withColumn("_w", F.when(higher, F.least(F.col("_w") + _by(LTP_BONUS, F.col("_seen"), 0.0), F.lit(1.0))).otherwise(F.col("_w")))
    up = F.lit(False)
    tier, least = F.col("tier"), F.lit(0.0)
    for name, (bound, above, initial) in PROMOTION.items():
        reached = (F.col("tier") == name) & (F.col("_w") >= bound)
        up, tier, least = up | reached, F.when(reached, above).otherwise(tier), F.when(reached, initial).otherwise(least)
    return step.select(
        "uuid", F.greatest("_w", least).alias("strength"), tier.alias("tier"), F.when(higher, F.col("_seen")).otherwise(F.col("ltp_status")).alias("ltp_status"), F.col("_n").alias("activation_count"), F.coalesce(up, F.lit(False)).alias("promoted")
    )


def directional(edges: DataFrame, now: Column) -> DataFrame:
    """Both directions of the edges after their first end triggered the second once: ``(uuid, source, strength)``, the strength with
    which ``source`` reaches the other end, decayed like the edge. Directions begin at the edge's own strength."""
    base = F.coalesce(F.col("strength").cast("double"), F.lit(0.0))
    ways = [("from_entity", FORWARD_BOOST), ("to_entity", BACKWARD_BOOST)]
    way = F.array(*(F.struct(F.col(end).alias("source"), effective(now, F.least(base + boost * (1 - base), F.lit(1.0))).alias("strength")) for end, boost in ways))
    return edges.select("uuid", F.explode(way).alias("x")).select("uuid", "x.source", "x.strength")


def associations(edges: DataFrame, node: Column, now: Column, k: int = 10) -> DataFrame:
    """The ``k`` strongest edges of one node by effective strength over the floor: ``(uuid, other, effective)``."""
    mine = edges.where((F.col("from_entity") == node) | (F.col("to_entity") == node)).where("invalidated_at is null")
    other = F.when(F.col("from_entity") == node, F.col("to_entity")).otherwise(F.col("from_entity"))
    shown = mine.select("uuid", other.alias("other"), effective(now).alias("effective"))
    return shown.where(F.col("effective") > sc.STRENGTH_FLOOR).orderBy(F.desc("effective"), "uuid").limit(k)


def invalidated(edges: DataFrame, wanted: Column, now: Column) -> DataFrame:
    """The edges with ``invalidated_at`` stamped where ``wanted`` holds; a stamp that is there stays."""
    return edges.withColumn("invalidated_at", F.when(F.coalesce(wanted, F.lit(False)), F.coalesce("invalidated_at", now)).otherwise(F.col("invalidated_at")))


def over_degree(edges: DataFrame, now: Column, most: int = MAX_DEGREE) -> DataFrame:
    """``(uuid)`` of the edges that an end with over ``most`` edges lets go: its weakest, potentiated ones last.

    Every node's best ``most`` are found in parts first, so a hub of any degree is never sorted by one task.
    """
    protected = F.coalesce(F.col("ltp_status").isin("Weekly", "Full"), F.lit(False)).cast("int")
    ends = edges.select("uuid", F.explode(F.array_distinct(F.array("from_entity", "to_entity"))).alias("node"), F.struct(protected.alias("p"), F.round(effective(now), 9).alias("e")).alias("worth"))
    ends = materialize(ends)
    kept = first_ranks(ends, "uuid", "worth", most, ["node"]).select("uuid", "node")
    return ends.join(kept, ["uuid", "node"], "left_anti").select("uuid").distinct()


def decay_sweep(edges: DataFrame, npmi: DataFrame, now: Column) -> DataFrame:
    """Every edge once: ``(uuid, strength, ltp_status, fate)``. An edge over its age limit and faded under its tier's bound is 'pruned',
    unless its ends go together more than chance (``npmi`` of ``(uuid, npmi)`` at the tier's bound: 'rescued'); the rest are 'kept'.
    Edges of the upper tiers that are ready become 'Full'."""
    known = edges.join(npmi.select("uuid", F.col("npmi").alias("_npmi")), "uuid", "left")
    hours = hours_since("last_activated", now)
    flagged = F.coalesce(sc.edge_prunable(hours, F.col("tier"), F.col("ltp_status")), F.lit(False))
    rescued = F.coalesce(F.col("_npmi") >= _by(RESCUE, F.col("tier"), RESCUE["L3"]), F.lit(False))
    after = effective(now)
    ready = sc.ltp_readiness(F.col("tier"), F.coalesce("activation_count", F.lit(0)), after, F.col("entity_confidence")) >= READY
    fate = F.when(~flagged, "kept").when(rescued, "rescued").otherwise("pruned")
    return known.select("uuid", "from_entity", "to_entity", after.alias("strength"), F.when(F.coalesce(ready, F.lit(False)) & (F.col("tier") != "L1"), "Full").otherwise(F.col("ltp_status")).alias("ltp_status"), fate.alias("fate"))


def without_edges(entities: DataFrame, swept: DataFrame) -> DataFrame:
    """``(uuid)`` of entities that a sweep leaves without any edge."""
    held = swept.where("fate <> 'pruned'").select(F.explode(F.array("from_entity", "to_entity")).alias("uuid")).distinct()
    return entities.select("uuid").distinct().join(held, "uuid", "left_anti")


def hebbian(entity_of: DataFrame, edges: DataFrame, now: Column, each: int = 50) -> DataFrame:
    """``(id, hebbian)`` for memories given as ``(id, uuid)`` rows of their entities: the mean effective strength of the valid edges whose
    two ends are both among them, an end offering its ``each`` strongest; memories without such edges give no row (0.5 by default)."""
    valid = edges.where("invalidated_at is null").select("uuid", "from_entity", "to_entity", effective(now).alias("w"))
    ends = valid.select(F.col("uuid").alias("edge"), F.explode(F.array_distinct(F.array("from_entity", "to_entity"))).alias("node"), F.round("w", 9).alias("w"), "from_entity", "to_entity")
    strong = first_ranks(ends, "edge", "w", each, ["node"])
    here = entity_of.select("id", F.col("uuid").alias("node"))
    one = here.join(strong.select("edge", "node", "w", F.when(F.col("node") == F.col("from_entity"), F.col("to_entity")).otherwise(F.col("from_entity")).alias("other")), "node")
    both = one.join(here.select("id", F.col("node").alias("other")), ["id", "other"]).select("id", "edge", "w").distinct()
    return both.groupBy("id").agg(F.avg("w").alias("hebbian"))


def _ways(edges: DataFrame, now: Column, wanted_relations: list[str], fan: int) -> DataFrame:
    """Directed steps ``(src, dst, w, rate)``: what a hop over an edge passes on but for its decay, and the rate of that decay. A node
    offers its ``fan`` strongest edges, its share thinned by their number."""
    shown = edges.where("invalidated_at is null and from_entity is not null and to_entity is not null")
    one_way = F.array(F.struct(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst")), F.struct(F.col("to_entity").alias("src"), F.col("from_entity").alias("dst")))
    off_type = (F.col("relation_type").isin(wanted_relations) | F.col("relation_type").isin(list(GENERIC_RELATIONS))) if wanted_relations else F.lit(True)
    penalty = F.when(F.coalesce(off_type, F.lit(False)), 1.0).otherwise(RELATION_PENALTY)
    steps = shown.select("uuid", F.explode(F.array_distinct(one_way)).alias("x"), effective(now).alias("e"), sc.trust(F.col("tier"), F.col("ltp_status")).alias("trust"), penalty.alias("penalty")).select("uuid", "x.src", "x.dst", "e", "trust", "penalty")
    strong = first_ranks(steps.withColumn("e9", F.round("e", 9)), "uuid", "e9", fan, ["src"])
    degree = strong.groupBy("src").agg(F.count("*").alias("degree"))
    rate = DECAY_LOW + (1 - F.least(F.greatest("e", F.lit(0.0)), F.lit(1.0))) * (DECAY_HIGH - DECAY_LOW)
    return strong.join(degree, "src").select("src", "dst", (F.col("e") * F.col("trust") * F.col("penalty") / F.sqrt(1.0 + F.col("degree"))).alias("w"), rate.alias("rate"))


def spread_activation(
    edges: DataFrame, seeds: DataFrame, now: Column, hops: int = HOPS, adaptive: bool = True, wanted_relations: list[str] | None = None, fan: int = FAN, ways: DataFrame | None = None
) -> DataFrame:
    """``(node, activation)``: activation of ``(node, activation)`` seeds spread over up to ``hops`` hops.

    In each hop every active node passes on ``a * exp(-rate * hop) * w`` and keeps its own; the greatest activation is then scaled to
    ``CEILING`` at most, and nodes at or under the threshold fall out. With ``adaptive`` the threshold is relaxed while few nodes are
    active, and after ``FIRST_HOPS`` the spread ends when it hardly grows or has reached enough nodes. A round is one join and one
    map-side combined sum; only counts and a maximum reach the driver. No seeds give no rows.
    """
    ways = materialize(_ways(edges, now, wanted_relations or [], fan)) if ways is None else ways
    active = materialize(seeds.groupBy("node").agg(F.sum("activation").alias("activation")))
    threshold, before = THRESHOLD, active.count()
    for hop in range(1, hops + 1):
        passed = active.where(F.col("activation") >= threshold).join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("activation") * F.exp(-F.col("rate") * hop) * F.col("w")).alias("activation"))
        summed = materialize(active.union(passed).groupBy("node").agg(F.sum("activation").alias("activation")))
        top = summed.agg(F.max("activation")).first()[0] or 0.0
        scale = CEILING / top if top > CEILING else 1.0
        active = summed.select("node", (F.col("activation") * F.lit(scale)).alias("activation")).where(F.col("activation") > threshold)
        after = active.count()
        if adaptive:
            if after < FEW and threshold > RELAXED:
                threshold = RELAXED
            if hop >= FIRST_HOPS and after and ((after - before) / after < SATURATED or after >= ENOUGH):
                break
        before = after
    return active


def hops_for(density: float | None) -> int:
    """Hops of each side of a spread from two sides: fewer in dense graphs."""
    return 3 if density is None else 2 if density > 2.0 else 4 if density < 0.5 else 3


def spread_from_both(edges: DataFrame, seeds: DataFrame, now: Column, density: float | None = None, wanted_relations: list[str] | None = None) -> DataFrame:
    """Spread of ``(place, node, activation)`` seeds, even places from one side and odd ones from the other (a single seed from both):
    activations are added, and nodes that both sides reach count ``MEETING_BOOST`` times."""
    ways = materialize(_ways(edges, now, wanted_relations or [], FAN))
    seeds = materialize(seeds)
    even, odd = seeds.where("place % 2 = 0"), seeds.where("place % 2 = 1")
    odd = even if odd.isEmpty() else odd
    one, two = (spread_activation(edges, side.select("node", "activation"), now, hops_for(density), False, ways=ways) for side in (even, odd))
    both = one.withColumnRenamed("activation", "x").join(two.withColumnRenamed("activation", "y"), "node", "full").select("node", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    meet = (F.col("x") >= MEETING_LEAST) & (F.col("y") >= MEETING_LEAST)
    return both.select("node", F.when(meet, (F.col("x") + F.col("y")) * MEETING_BOOST).otherwise(F.col("x") + F.col("y")).alias("activation"))


def coactivated(edges: DataFrame, retrievals: DataFrame, most: int = 20) -> DataFrame:
    """New and strengthened links of retrievals ``(retrieval, place, node)``: place 0 triggers, the next ``most`` are co-retrieved.

    ``(a, b, strength, fresh)`` per unordered pair of a trigger with its co-retrieved and of the co-retrieved among themselves: a pair
    that an edge links is strengthened, another becomes a first-tier link. The limit per retrieval is the rule's own.
    """
    best = retrievals.where(F.col("place") <= most).select("retrieval", "node")
    other = best.select("retrieval", F.col("node").alias("other"))
    pairs = best.join(other, "retrieval").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    known = edges.where("invalidated_at is null").groupBy(F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b")).agg(F.max_by(F.struct("strength", "tier"), F.struct("strength", "uuid")).alias("k"))
    weight = F.coalesce(F.col("k.strength").cast("double"), F.lit(0.0))
    grown = F.least(weight + (LEARNING_RATE + _by(TIER_BOOST, F.col("k.tier"), TIER_BOOST["L3"])) * (1 - weight), F.lit(1.0))
    return pairs.join(known, ["a", "b"], "left").select("a", "b", F.when(F.col("k").isNull(), 0.4).otherwise(grown).alias("strength"), F.col("k").isNull().alias("fresh"))


def traversed(edges: DataFrame, starts: DataFrame, now: Column, depth: int, relations: list[str] | None = None, least: float = 0.0, fan: int = FAN, hop_decay: float = 0.0) -> DataFrame:
    """``(start, node, score, hop)``: the best product of effective strengths over walks of up to ``depth`` edges of the given relations,
    each hop times ``exp(-hop_decay)``, and the fewest hops of a walk with that product; nodes use their ``fan`` strongest edges. A
    start reaches itself with 1. Only bests are carried from round to round."""
    valid = edges.where("invalidated_at is null and from_entity is not null and to_entity is not null")
    if relations is not None:
        valid = valid.where(F.col("relation_type").isin(relations))
    both = F.array(F.struct(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst")), F.struct(F.col("to_entity").alias("src"), F.col("from_entity").alias("dst")))
    steps = valid.select("uuid", F.explode(both).alias("x"), F.round(effective(now), 9).alias("w")).select("uuid", "x.src", "x.dst", "w").where((F.col("w") >= least) & (F.col("src") != F.col("dst")))
    ways = materialize(first_ranks(steps, "uuid", "w", fan, ["src"]).groupBy("src", "dst").agg((F.max("w") * math.exp(-hop_decay)).alias("w")))
    best = materialize(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(1.0).alias("score"), F.lit(0).alias("hop")))
    front = best
    for hop in range(1, depth + 1):
        step = front.join(ways, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("w")).alias("score"))
        better = step.join(best.select("start", "node", F.col("score").alias("old")), ["start", "node"], "left").where("old is null or score > old")
        front = materialize(better.select("start", "node", "score", F.lit(hop).alias("hop")))
        if front.isEmpty():
            break
        best = materialize(best.union(front).groupBy("start", "node").agg(F.max_by(F.struct("score", "hop"), F.struct("score", -F.col("hop"))).alias("b")).select("start", "node", "b.score", "b.hop"))
    return best
