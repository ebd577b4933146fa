"""Stages that adjust a ranked candidate list, retrieval modes, triggers, and analyses of the shape of a collection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators.components import connected_components
from palimpsest.operators.filters import entity_names
from palimpsest.runtime import materialize


def prefer_types(score: Column, preferred: list[str], penalty: float = 0.7) -> Column:
    """Scores of other types are multiplied by ``penalty``."""
    return F.when(F.col("experience_type").isin(preferred), score).otherwise(score * penalty)


def length_specificity(ranked: DataFrame, query: str, score: str, text: str, least: int = 5) -> DataFrame:
    """Per query with at least ``least`` candidates: texts over 1.5 times the mean length lose a tenth, under 0.8 times gain a twentieth."""
    w = Window.partitionBy(query)
    ratio = F.length(text) / F.avg(F.length(text)).over(w)
    factor = F.when(F.count("*").over(w) < least, 1.0).when(ratio > 1.5, 0.9).when(ratio < 0.8, 1.05).otherwise(1.0)
    return ranked.withColumn(score, F.col(score) * F.coalesce(factor, F.lit(1.0)))


def entity_concentration(score: Column, wanted: Column) -> Column:
    """By the share of a memory's entities that the query names: under a fifth 0.85, over a half 1.10; no entities, no change."""
    names = F.array_distinct(entity_names())
    share = F.size(F.array_intersect(names, wanted)) / F.size(names)
    return F.when(F.coalesce(F.size(names), F.lit(0)) == 0, score).when(share < 0.20, score * 0.85).when(share > 0.50, score * 1.10).otherwise(score)


def demote_outside(ranked: DataFrame, query: str, score: str, time: str, low: Column, high: Column, least: int = 2, factor: float = 0.5) -> DataFrame:
    """Where at least ``least`` candidates of a query lie in the period, the others are demoted."""
    inside = F.coalesce(F.col(time).between(low, high), F.lit(False))
    enough = F.count_if(inside).over(Window.partitionBy(query)) >= least
    return ranked.withColumn(score, F.when(enough & ~inside, F.col(score) * factor).otherwise(F.col(score)))


def linguistic_match(text: Column, nouns: list[str], modifiers: list[str], verbs: list[str]) -> Column:
    """Substring hits weighted 1.0, 0.5 and 0.2 over their greatest possible sum; 0 without any words."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    parts = [(w, 1.0) for w in nouns] + [(w, 0.5) for w in modifiers] + [(w, 0.2) for w in verbs]
    total = sum(v for _, v in parts)
    return sum((folded.contains(w.lower()).cast("double") * v for w, v in parts), F.lit(0.0)) / total if total else F.lit(0.0)


def learning_velocity(events: DataFrame, key: str, time: str, kind: str, at: Column, hours: float = 24.0) -> DataFrame:
    """Per key: ``sum(exp(-age / hours) * weight) * 24 / hours`` over events of the window; potentiations weigh 2, interferences 1.5."""
    age = (F.unix_micros(at) - F.unix_micros(time)) / 3.6e9
    weight = F.when(F.col(kind) == "potentiated", 2.0).when(F.col(kind).isin("interference", "fact"), 1.5).otherwise(1.0)
    recent = events.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") <= hours))
    return recent.groupBy(key).agg((F.sum(F.exp(-F.col("_age") / hours) * weight) * (24.0 / hours)).alias("velocity"), F.count("*").alias("events"), F.max((F.col(kind) == "potentiated").cast("int")).alias("potentiated"))


def learning_boost(velocity: Column, recent: Column, potentiated: Column) -> Column:
    return F.least(1.0 + F.when(recent, 0.05).otherwise(0.0) + F.least(0.05 * F.coalesce(velocity, F.lit(0.0)), F.lit(0.15)) + F.when(potentiated, 0.10).otherwise(0.0), F.lit(1.3))


def context_triggers(tasks: DataFrame, context: str) -> DataFrame:
    """Tasks ``(id, keywords, priority)`` any of whose keywords occurs in a context, by priority then id."""
    folded = F.lit(context.lower())
    return tasks.where(F.exists("keywords", lambda k: (F.length(k) > 0) & folded.contains(F.lower(k)))).orderBy(F.desc("priority"), "id")


def context_matches(tasks: DataFrame, context: str, similar: DataFrame, least: float = 0.75) -> DataFrame:
    """Tasks ``(id, keywords, priority)`` that a context calls up: by a keyword in it, or by likeness of at least ``least`` in
    ``similar`` ``(id, similarity)``; ``(id, priority, by_keyword)``. A task without keywords and without a vector never is."""
    word = F.coalesce(F.exists("keywords", lambda k: (F.length(k) > 0) & F.lit(context.lower()).contains(F.lower(k))), F.lit(False))
    near = similar.where(F.col("similarity") >= least).select("id", F.lit(True).alias("near")).distinct()
    met = tasks.join(near, "id", "left").withColumn("by_keyword", word)
    return met.where(F.col("by_keyword") | F.coalesce("near", F.lit(False))).select("id", "priority", "by_keyword")


def expand_hierarchy(found: DataFrame, memories: DataFrame) -> DataFrame:
    """Found ids, their parents (importance times 1.1, at most 1) and children (times 1.05) that are not yet there: ``(id, importance, via)``."""
    value = F.col("importance").cast("double")
    m = memories.select("id", "parent_id", value.alias("importance"))
    own = m.join(found.select("id").distinct(), "id", "left_semi")
    up = own.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().join(m, "id").select("id", F.least(F.col("importance") * 1.1, F.lit(1.0)).alias("importance"), F.lit(1).alias("rank"))
    down = m.join(found.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", F.least(F.col("importance") * 1.05, F.lit(1.0)).alias("importance"), F.lit(2).alias("rank"))
    every = own.select("id", "importance", F.lit(0).alias("rank")).union(up).union(down)
    first = every.groupBy("id").agg(F.min_by("importance", "rank").alias("importance"), F.min("rank").alias("rank"))
    return first.select("id", "importance", F.element_at(F.array(F.lit("found"), F.lit("parent"), F.lit("child")), F.col("rank") + 1).alias("via"))


def spatial(memories: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    here = F.col("geo_location")
    metres = geo.haversine(F.get(here, 0), F.get(here, 1), F.lit(lat), F.lit(lon))
    return memories.where(F.size(here) >= 2).withColumn("metres", metres).where(F.col("metres") <= radius).orderBy("metres", F.desc("created_at"), "id")


def by_outcome(memories: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return memories.where(F.col("reward").between(low, high)).orderBy(F.desc("reward"), F.desc("created_at"), "id")


def context_summary(memories: DataFrame, each: int = 3) -> DataFrame:
    """Per tenant and type of interest the first ``each`` memories by importance, then id."""
    kinds = ["Decision", "Learning", "Context", "Pattern", "Error"]
    w = Window.partitionBy("user_id", "experience_type").orderBy(F.desc_nulls_last("importance"), "id")
    return memories.where(F.col("experience_type").isin(kinds)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)


def resolve_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Each ``(user_id, asked)`` to one entity of its tenant: exact name 1.0, same letters in lower case 0.9, a name that holds the asked
    word 0.7; then salience, then the shortest name, then uuid. Names of under three letters match exactly only."""
    e = entities.where("name is not null").select("user_id", "uuid", "name", F.lower("name").alias("low"), F.coalesce("salience", F.lit(0.0)).alias("salience"))
    a = names.distinct().withColumn("low_asked", F.lower("asked"))
    whole = a.join(e, (a.user_id == e.user_id) & (a.low_asked == e.low)).select(a.user_id, "asked", "uuid", "name", "salience", F.when(F.col("asked") == F.col("name"), 1.0).otherwise(0.9).alias("score"))
    words = e.withColumn("word", F.explode(F.array_distinct(F.split("low", r"[^\p{L}\p{Nd}]+"))))
    part = a.where("length(asked) >= 3").join(words, (a.user_id == words.user_id) & (a.low_asked == words.word)).select(a.user_id, "asked", "uuid", "name", "salience", F.lit(0.7).alias("score"))
    w = Window.partitionBy("user_id", "asked").orderBy(F.desc("score"), F.desc("salience"), F.length("name"), "uuid")
    return whole.union(part).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "salience")


def resolve_entities_by_stem(names: DataFrame, entities: DataFrame) -> DataFrame:
    """:func:`resolve_entities` with a step between: names of the same stems (0.8), so that a plural or another form finds its entity. The
    words of all names are stemmed once each."""
    from palimpsest.operators.knowledge import stem_sets

    exact = resolve_entities(names, entities)
    asked = names.distinct().where("length(asked) >= 3").withColumn("id", F.xxhash64("user_id", "asked"))
    e = entities.where("name is not null").dropDuplicates(["uuid"])
    a = stem_sets(asked.withColumn("text", F.col("asked")).select("id", "user_id", "asked", "text")).where("size(tokens) > 0")
    b = stem_sets(e.select(F.col("uuid").alias("id"), F.col("user_id").alias("owner"), "name", F.coalesce("salience", F.lit(0.0)).alias("salience"), F.col("name").alias("text"))).where("size(tokens) > 0")
    met = a.select("user_id", "asked", "tokens").join(b.select(F.col("id").alias("uuid"), "owner", "name", "salience", F.col("tokens").alias("own")), (F.col("user_id") == F.col("owner")) & (F.col("tokens") == F.col("own")))
    stems = met.select("user_id", "asked", "uuid", "name", F.lit(0.8).alias("score"), "salience")
    every = exact.withColumn("salience", F.lit(1.0)).select("user_id", "asked", "uuid", "name", "score", "salience").unionByName(stems)
    w = Window.partitionBy("user_id", "asked").orderBy(F.desc("score"), F.desc("salience"), F.length("name"), "uuid")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "salience")


def proper_nouns(text: Column) -> Column:
    """Distinct runs of capitalised words that do not start a sentence, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![.!?:\n-] )(?<!^)\b((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)*)\b"), F.lit(1)))


#: Entities of a gap up to which related gaps are counted by inclusion and exclusion.
FEW_ENTITIES = 4


def gap_impact(gaps: DataFrame) -> DataFrame:
    """Of ``(gap, entities)``: the share of all gaps that share an entity with a gap (itself left out).

    A gap of up to ``FEW_ENTITIES`` entities counts by inclusion and exclusion over the sets of its entities: gaps are counted per set,
    so no pair of gaps is made and a hub of any degree is a number. Gaps of more entities are compared with the gaps they meet.
    """
    total = gaps.count()
    own = gaps.select("gap", F.array_sort(F.array_distinct("entities")).alias("e"))
    none = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("e", none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    few = own.where(F.size("e") <= FEW_ENTITIES)
    sets = few.select("gap", F.explode(F.filter(subsets, lambda s: F.size(s) > 0)).alias("s"))
    many = own.where(F.size("e") > FEW_ENTITIES)
    # Sets that small gaps ask about, as large gaps hold them.
    asked = sets.select("s").distinct().withColumn("first", F.get("s", 0))
    held = many.select("e", F.explode("e").alias("first")).join(asked, "first").where(F.size(F.array_except("s", "e")) == 0).select("s")
    sizes = sets.select("s").union(held).groupBy("s").agg(F.count("*").alias("n"))
    sign = F.when(F.size("s") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    related = sets.join(sizes, "s").groupBy("gap").agg((F.sum(sign) - 1).alias("related"))
    wide = many.select("gap", F.explode("e").alias("entity")).join(own.select(F.col("gap").alias("other"), F.explode("e").alias("entity")), "entity")
    related = related.union(wide.where("gap <> other").groupBy("gap").agg(F.countDistinct("other")))
    return gaps.select("gap").join(related, "gap", "left").select("gap", (F.coalesce("related", F.lit(0)) / F.lit(float(max(1, total)))).alias("impact"))


def compete(candidates: pd.DataFrame, similarity: float = 0.85) -> pd.DataFrame:
    """Of one query's twenty best ``(id, vector, strength)``: of two that are nearly the same the stronger stays (then the smaller id)."""
    c = candidates.sort_values(["strength", "id"], ascending=[False, True]).head(20)
    x = np.stack(c["vector"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    kept: list[int] = []
    for k in range(len(c)):
        if all(x[k] @ x[j] < similarity for j in kept):
            kept.append(k)
    return c.iloc[kept][["id", "strength"]]


def decay_scales(stamps: pd.DataFrame) -> pd.DataFrame:
    """Periods (days) at which one user's accesses recur: peaks of the spectrum of centred, windowed log intervals; under 50 accesses 7, 30, 365."""
    user = stamps["user_id"].iloc[0]
    t = np.sort(stamps["us"].to_numpy()) / 86_400e6
    gaps = np.diff(t)
    gaps = gaps[gaps > 0]
    scales = [7.0, 30.0, 365.0]
    if len(t) >= 50 and len(gaps) >= 16:
        x = np.log(gaps) - np.log(gaps).mean()
        power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
        peaks = [k for k in range(2, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        best = sorted(peaks, key=lambda k: -power[k])[:3]
        found = sorted({round(float(len(x) / k * np.median(gaps)), 3) for k in best if len(x) / k * np.median(gaps) > 1})
        scales = found or scales
    return pd.DataFrame({"user_id": user, "scale": scales})


def persistence(vectors: np.ndarray) -> list[float]:
    """Death distances (1 - cosine) of the components of a bounded set of vectors as the radius grows: the edges of a least spanning tree."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    far, inside, out = np.full(len(x), np.inf), np.zeros(len(x), bool), []
    at = 0
    for _ in range(len(x) - 1):
        inside[at] = True
        far = np.minimum(far, 1 - x @ x[at])
        far[inside] = np.inf
        at = int(far.argmin())
        out.append(float(far[at]))
    return sorted(out)


def forest(vectors: np.ndarray, ids: np.ndarray, split: int | None = None) -> pd.DataFrame:
    """Least spanning tree ``(a, b, death)`` by 1 - cosine; with ``split`` only edges between the rows before it and the others count."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    n = len(x)
    far, by, inside, at = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool), 0
    left = np.arange(n) < (n if split is None else split)
    a, b, death = [], [], []
    for _ in range(n - 1):
        inside[at] = True
        d = 1 - x @ x[at]
        if split is not None:
            d[left == left[at]] = np.inf
        nearer = d < far
        far[nearer], by[nearer] = d[nearer], at
        open_ = np.where(inside, np.inf, far)
        at = int(open_.argmin())
        a.append(ids[by[at]])
        b.append(ids[at])
        death.append(float(far[at]))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "death": np.array(death, float)})


def deaths(vectors: DataFrame, block: int = 2_000) -> DataFrame:
    """Death distances ``death`` of the components of all ``(id long, vector)``, as ``persistence`` gives them: n ids have n - 1. An id
    counts once, a null vector not at all.

    Every two blocks of about ``block`` rows meet in one group, which gives the least forest of the edges between them (every block
    its own tree); an edge of the least tree of all is in the forest of its blocks. The forests are merged by Boruvka's rounds over
    written tables: each component takes its least edge in the order (death, a, b), so at most log2(n) rounds.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.select(F.col("id").cast("long").alias("id"), "vector").where("vector is not null").dropDuplicates(["id"]))
    blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    met = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("k", "j").alias("one"), F.greatest("k", "j").alias("two"), "k", "id", "vector")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["k", "id"])
        split = int((p["k"] == p["one"]).sum()) if p["one"].iloc[0] != p["two"].iloc[0] else None
        if split in (0, len(p)):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "death": np.zeros(0)})
        return forest(np.stack(p["vector"].to_numpy()).astype(float), p["id"].to_numpy(), split)

    edges = met.groupBy("one", "two").applyInPandas(meet, "a long, b long, death double")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "death", F.col("a").alias("x"), F.col("b").alias("y")))
    parts = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array("x", "y")).alias("c"), F.struct("death", "a", "b", "x", "y").alias("e"))
        taken = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        parts.append(taken.select("death"))
        label = materialize(connected_components(taken.select(F.col("x").alias("src"), F.col("y").alias("dst"))))
        for end in ("x", "y"):
            edges = edges.join(label.select(F.col("node").alias(end), F.col("component").alias(f"to_{end}")), end)
        least = edges.where("to_x <> to_y").groupBy(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).agg(F.min(F.struct("death", "a", "b")).alias("e"))
        edges = materialize(least.select("e.a", "e.b", "e.death", "x", "y"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "death double")


def intervals_for(rows: int, each: int = 1_000) -> int:
    """Intervals of about ``each`` rows, eight at least."""
    return max(8, -(-rows // each))


def mapper(lens: DataFrame, intervals: int = 8, overlap: float = 0.25, cut: float = 0.6) -> DataFrame:
    """Mapper graph over ``(id, value, vector)``: intervals of the value that overlap, single-linkage groups (1 - cosine <= ``cut``) inside,
    edges where groups share members: ``(a, b, shared)`` with group names ``interval/group``. An interval's rows go to one task: choose
    ``intervals`` by the size of the collection (see ``intervals_for``)."""
    low, high = lens.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return lens.sparkSession.createDataFrame([], "a string, b string, shared long")
    step = (high - low) / intervals or 1.0
    first, last = F.floor((F.col("value") - low) / step - overlap), F.floor((F.col("value") - low) / step + overlap)
    rows = lens.withColumn("interval", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(F.greatest(last, F.lit(0)), F.lit(intervals - 1)))))

    def group(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", ignore_index=True)
        x = np.stack(p["vector"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parent = list(range(len(x)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for k in range(len(x)):
            for j in np.flatnonzero(1 - x[k + 1 :] @ x[k] <= cut):
                a, b = root(k), root(k + 1 + int(j))
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"id": p["id"], "node": [f"{p['interval'].iloc[0]}/{root(k)}" for k in range(len(x))]})

    kind = lens.schema["id"].dataType.simpleString()
    nodes = rows.groupBy("interval").applyInPandas(group, f"id {kind}, node string")
    other = nodes.select("id", F.col("node").alias("b"))
    return nodes.select("id", F.col("node").alias("a")).join(other, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def aligned(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rotation that maps paired rows of one embedding space onto another (orthogonal Procrustes)."""
    u, _, vt = np.linalg.svd(source.T @ target)
    return u @ vt


def demote_fragments(score: Column, fragment: Column, temporal: bool, factor: float = 0.7) -> Column:
    """Scores of fragments shrink, unless the question is about time."""
    return score if temporal else F.when(F.coalesce(fragment, F.lit(False)), score * factor).otherwise(score)
