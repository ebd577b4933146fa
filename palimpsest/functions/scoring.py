"""Scores and decay curves as column expressions: all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
CROSSOVER_DAYS, BETA, BETA_POTENTIATED, LAMBDA, LOG_PERIODIC_BETA = 3.0, 0.5, 0.3, 0.693, 0.15
SCALES = (7.0, 30.0, 365.0)
# tier: (decay per hour, age limit in hours, strength under which an over-aged edge is pruned, weight of trust, strength floor)
TIERS = {
    "L1": (0.029, 48.0, 0.1, 0.20, None),
    "L2": (0.031 / 24, 720.0, 0.2, 0.50, 0.65),
    "L3": (0.02 / 720, 87_600.0, 0.3, 0.80, 0.80),
}
LTP_SLOWING = {"Burst": 0.5, "Weekly": 0.3, "Full": 0.1}
STRENGTH_FLOOR = 0.01
DENSITY = (0.5, 2.0, 0.5, 0.1, 0.15)  # density bounds, graph weight at them, linguistic weight
FUSION = {"semantic": 0.18, "entity": 0.17, "tag": 0.05, "importance": 0.05, "momentum": 0.28, "access": 0.14, "graph": 0.13}


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0


def ladder(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """The first ``result`` whose bound is not under ``value``; null stays null."""
    out = None
    for bound, result in steps:
        out = F.when(value <= bound, result) if out is None else out.when(value <= bound, result)
    return F.when(value.isNotNull(), out.otherwise(otherwise))


def log_periodic(days: Column, scales: tuple[float, ...] = SCALES) -> Column:
    """Correction of the power law that rings at the scales in log time, blended in between the crossover and its double."""
    blend = F.least(F.greatest((days - CROSSOVER_DAYS) / CROSSOVER_DAYS, F.lit(0.0)), F.lit(1.0))
    waves = sum((F.cos(F.log(days) * (2 * math.pi / math.log(s))) for s in scales), F.lit(0.0))
    return 1.0 + blend * LOG_PERIODIC_BETA * waves


def memory_decay(days: Column, potentiated: Column) -> Column:
    """Exponential to the crossover, then a power law with the log-periodic correction; 1 at and before time zero."""
    rate = F.when(potentiated, LAMBDA / 2).otherwise(LAMBDA)
    power = F.when(potentiated, BETA_POTENTIATED).otherwise(BETA)
    safe = F.greatest(days, F.lit(CROSSOVER_DAYS))
    late = F.exp(-rate * CROSSOVER_DAYS) * F.pow(safe / CROSSOVER_DAYS, -power) * log_periodic(safe)
    return F.when(days <= 0, 1.0).when(days < CROSSOVER_DAYS, F.exp(-rate * days)).otherwise(late)


def _by(mapping: dict, key: Column, otherwise) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(otherwise)


def edge_decay(hours: Column, tier: Column, ltp_status: Column) -> Column:
    """Decay factor of an edge of a tier after ``hours``, slowed by long-term potentiation; at least 0.001."""
    rate = _by({k: v[0] for k, v in TIERS.items()}, tier, TIERS["L3"][0])
    slow = _by(LTP_SLOWING, ltp_status, 1.0)
    return F.when(hours <= 0, 1.0).otherwise(F.greatest(F.exp(-rate * slow * hours), F.lit(0.001)))


def edge_prunable(hours: Column, tier: Column, ltp_status: Column) -> Column:
    """Whether an edge is over its age limit (extended by potentiation) and decayed under its tier's threshold."""
    slow = _by(LTP_SLOWING, ltp_status, 1.0)
    limit = _by({k: v[1] for k, v in TIERS.items()}, tier, TIERS["L3"][1]) / slow
    return (hours > limit) & (edge_decay(hours, tier, ltp_status) < _by({k: v[2] for k, v in TIERS.items()}, tier, TIERS["L3"][2]))


def effective_strength(strength: Column, hours: Column, tier: Column, ltp_status: Column) -> Column:
    return F.greatest(strength.cast("double") * edge_decay(hours, tier, ltp_status), F.lit(STRENGTH_FLOOR))


def trust(tier: Column, ltp_status: Column) -> Column:
    return F.when(ltp_status == "Full", 0.95).otherwise(_by({k: v[3] for k, v in TIERS.items()}, tier, 0.8))


def ltp_readiness(tier: Column, activations: Column, strength: Column, confidence: Column, threshold: Column | float = 10.0) -> Column:
    """How near an edge is to full potentiation (1 and more: reached); 0 for the first tier."""
    floor = F.when(tier == "L2", 0.65).otherwise(0.80)
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    score = activations / threshold * 0.5 + strength.cast("double") / floor * 0.5 + F.coalesce(confidence.cast("double"), F.lit(0.5)) * 0.3
    return F.when(tier == "L1", 0.0).otherwise(score)


def npmi(activations: Column, mentions_a: Column, mentions_b: Column, total: Column) -> Column:
    """Smoothed normalised pointwise mutual information in [-1, 1]; null under 100 activations in all."""
    both = activations + 1.0
    a, b = F.greatest(mentions_a, activations) + 1.0, F.greatest(mentions_b, activations) + 1.0
    pmi, scale = F.log2(both * total / (a * b)), F.log2(total / both)
    return F.when(total >= 100, F.when(scale < 1e-12, 1.0).otherwise(F.least(F.greatest(pmi / scale, F.lit(-1.0)), F.lit(1.0))))


def temporal_relevance(age_days: Column) -> Column:
    return ladder(age_days, [(7, 1.0), (30, 0.7), (90, 0.4)], 0.2)


def recency_boost(hours: Column, scale: float = 0.1) -> Column:
    return F.exp(-0.01 * F.greatest(hours, F.lit(0.0))) * scale


def salience(age_days: Column, importance: Column) -> Column:
    recency = ladder(age_days, [(7, 1.0), (30, 0.7), (90, 0.4)], 0.1)
    return F.least(F.greatest(recency * 0.6 + importance.cast("double") * 0.4, F.lit(0.0)), F.lit(1.0))


def salience_with_access(age_days: Column, importance: Column, accesses: Column) -> Column:
    boost = F.when(accesses > 0, F.least(F.log2(accesses) * 0.05, F.lit(0.3))).otherwise(0.0)
    return F.least(F.greatest(salience(age_days, importance) + boost, F.lit(0.0)), F.lit(1.0))


def calibrated(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-10.0 * (score.cast("double") - 0.5)))


def fused(semantic: Column, entity: Column, tag: Column, importance: Column, momentum: Column, accesses: Column, graph: Column) -> Column:
    """Weighted sum of seven calibrated signals; momentum in [-1, 1] is widened away from the middle first."""
    normal = (momentum + 1.0) / 2.0
    wide = F.when(normal > 0.65, F.least(normal * 1.5, F.lit(1.0))).when(normal < 0.40, F.greatest(normal * 0.3, F.lit(0.0))).otherwise(normal)
    access = F.when(accesses == 0, 0.0).otherwise(F.least(F.log2(accesses + 1.0) / 4.0, F.lit(1.0)))
    signals = {"semantic": semantic, "entity": entity, "tag": tag, "importance": importance, "momentum": wide, "access": access, "graph": graph}
    return sum((FUSION[k] * calibrated(v) for k, v in signals.items()), F.lit(0.0))


def heat(accesses: Column, richness: Column, age_days: Column) -> Column:
    """Accesses by richness, less with age. Ten days ahead of the reference time the divisor is 0, and the division follows IEEE as in
    the SQL: infinite, or not a number for a memory without anything."""
    above, below = accesses * F.log1p(richness.cast("double")), 1.0 + age_days * 0.1
    return F.when(below == 0, above * F.lit(float("inf"))).otherwise(above / below)


def fact_decay(days_since_support: Column, support: Column) -> Column:
    """Confidence factor of a fact: whole for 90 days, then halved every 180 + 30 * support days."""
    return F.when(days_since_support <= 90, 1.0).otherwise(F.pow(F.lit(0.5), (days_since_support - 90) / (180.0 + 30.0 * support)))


def density_weights(density: float) -> tuple[float, float, float]:
    """(semantic, graph, linguistic): sparse graphs weigh more."""
    low, high, most, least, linguistic = DENSITY
    graph = most - (min(max(density, low), high) - low) / (high - low) * (most - least)
    return 1.0 - graph - linguistic, graph, linguistic


def query_type_weights(weights: tuple[float, float, float], kind: str, floor: float = 0.05) -> tuple[float, float, float]:
    """Shift the weights for 'temporal' or 'attribute' queries, normalise, and give every channel at least ``floor``."""
    shift = {"temporal": (0.02, -0.12, 0.10), "attribute": (-0.10, 0.10, 0.0)}.get(kind, (0.0, 0.0, 0.0))
    raised = [max(0.0, w + s) for w, s in zip(weights, shift)]
    shares = [w / (sum(raised) or 1.0) for w in raised]
    for _ in range(3):
        missing = sum(max(0.0, floor - w) for w in shares)
        if not missing:
            break
        shares = [max(w, floor) for w in shares]
        top = max(range(3), key=lambda k: shares[k])
        shares[top] = max(floor, shares[top] - missing)
    return tuple(shares)
