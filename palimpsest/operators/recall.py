"""Recall: text relevance over several fields, one score from many signals, the retrieval modes, surfacing and prefetch.

Candidates are found by an index (terms, vectors, links); the score is one wide column expression over them. Signals that a table does
not carry (arousal, credibility, activation, ...) count as absent. Null values add nothing to a score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as sc
from palimpsest.functions import strings as st
from palimpsest.operators import filters as fl
from palimpsest.operators import texts as tx
from palimpsest.operators.filters import entity_names
from palimpsest.operators.vectors import cosine, literal
from palimpsest.runtime import materialize

# Fixed values that results depend on.
HEBBIAN, RECENCY_RATE, RECENCY_SCALE, RECENCY_ASKED, RECENCY_DECOMPOSED = 0.1, 0.01, 0.1, 0.5, 0.03
RECENT_PHRASES = ["last week", "most recent", "recent", "latest", "yesterday", "today"]
SESSION_HOURS, SESSION_BOOST = 2, 0.03
ACCESS_WEIGHT, ACCESS_EXPLORING, GRAPH_WEIGHT, EPISODE_BOOST = 0.07, 0.02, 0.08, 0.08
SOURCE_TRUST = {"user": 1.2, "file": 1.1, "system": 1.0, "external_api": 0.9, "web": 0.8, "ai_generated": 0.7, "inferred": 0.6}
DATE_EXACT, DATE_WEEK, DATE_MONTH = 0.25, 0.15, 0.05
STEM_WEIGHT = 0.8
MODE_WEIGHTS = {"similarity": 0.5, "temporal": 0.2, "causal": 0.2, "associative": 0.1}
TYPE_WORTH = {"Decision": 0.3, "Error": 0.25, "Learning": 0.25, "Discovery": 0.2, "Pattern": 0.2, "Task": 0.15, "Conversation": 0.1, "Context": 0.1}
TECHNICAL = "algorithm architecture implementation optimization performance security database api framework".split()
PRIORITY_WORTH = {"critical": 0.15, "high": 0.10, "medium": 0.05}


def has(df: DataFrame, name: str, otherwise=0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(otherwise)) if name in df.columns else F.lit(otherwise)


# Text relevance


def fields_of(memories: DataFrame) -> dict[str, Column]:
    """The searched fields of a memory as token arrays, with repeats; null where the field is."""
    flat = lambda c: F.flatten(F.transform(c, lambda x: tx.words(x)))
    return {"content": tx.words(F.col("content")), "tags": flat(F.filter("tags", lambda x: x.isNotNull())), "entities": flat(entity_names())}


def bm25_fields(memories: DataFrame, key: str, fields: dict[str, Column], query: str, weights: dict[str, float] | None = None, phrases: dict[str, float] | None = None, text: str = "content", stems: bool = True, k: int | None = None) -> DataFrame:
    """``(key, score)``: BM25 of one query summed over fields. ``weights`` multiply terms (information content), ``phrases`` add their
    boost times the summed rarity of their words wherever ``text`` holds them whole. With ``stems`` a field of stems of ``text``
    counts too: the vocabulary is stemmed, not the documents, and a query stem stands for all its words there.

    The table is read once for all fields; each row keeps only the query's terms. A query without words gives no rows.
    """
    asked = [w for w in dict.fromkeys(_words(query))]
    if not asked:
        return memories.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = {w: (weights or {}).get(w, 1.0) for w in asked}
    like: dict[str, str] = {}
    if stems:
        wanted = {tx.stem(w): w for w in reversed(asked)}
        vocabulary = memories.select(F.explode(F.array_distinct(tx.words(F.col(text)))).alias("term")).distinct()
        initial = F.substring("term", 1, 2).isin(sorted({s[:2] for s in wanted}))  # a stem begins as its words do
        near = tx.stemmed(vocabulary.where(initial)).where(F.col("stem").isin(list(wanted)))
        like = {r.term: r.stem for r in near.collect()}  # words of one query's stems
        for stem, w in wanted.items():
            weight.setdefault("~" + stem, weight[w] * STEM_WEIGHT)
    tokens = {name: F.filter(column, lambda w: w.isin(asked)) for name, column in fields.items()}
    lengths = {name: F.size(column) for name, column in fields.items()}
    if stems:
        table = F.create_map(*(F.lit(x) for pair in (like or {"": ""}).items() for x in pair))
        own = tx.words(F.col(text))
        tokens["stems"] = F.transform(F.filter(own, lambda w: w.isin(list(like))), lambda w: F.concat(F.lit("~"), F.element_at(table, w)))
        lengths["stems"] = F.size(own)
    said = {p: (F.length(F.lower(text)) - F.length(F.replace(F.lower(F.col(text)), F.lit(p)))) / F.lit(float(len(p))) for p in phrases or {}}
    rows = materialize(memories.select(key, *(tokens[f].alias(f"t_{f}") for f in tokens), *(lengths[f].alias(f"n_{f}") for f in tokens), *(c.alias(f"p_{i}") for i, c in enumerate(said.values()))))
    corpus = rows.agg(F.count("*").alias("n"), *(F.avg(f"n_{f}").alias(f) for f in tokens)).first()
    every = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("t"), F.col(f"n_{f}").alias("length"), F.lit(float(corpus[f] or 1.0)).alias("mean")) for f in tokens))).alias("x"))
    tf = every.select(key, "x.field", "x.length", "x.mean", F.explode("x.t").alias("term")).groupBy(key, "field", "length", "mean", "term").agg(F.count("*").alias("tf"))
    df = materialize(tf.groupBy("field", "term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (F.lit(float(corpus["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = F.create_map(*(F.lit(x) for pair in weight.items() for x in pair))
    part = F.element_at(worth, F.col("term")) * idf * F.col("tf") * (tx.K1 + 1) / (F.col("tf") + tx.K1 * (1 - tx.B + tx.B * F.col("length") / F.col("mean")))
    score = tf.join(df, ["field", "term"]).select(key, part.alias("part"))
    for i, (phrase, boost) in enumerate((phrases or {}).items()):
        rare = df.where((F.col("field") == "content") & F.col("term").isin(_words(phrase))).agg(F.sum(idf)).first()[0] or 0.0
        score = score.union(rows.where(F.col(f"p_{i}") > 0).select(key, F.lit(boost * rare).alias("part")))
    out = score.groupBy(key).agg(F.sum("part").alias("score"))
    return out if k is None else tx.first_ranks(out, key, "score", k, [])


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 2 and w not in tx.STOP_WORDS]


# Scores


def richness(memories: DataFrame) -> Column:
    """How many of ten kinds of context a memory carries."""
    filled = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("tags", "entities", "metadata", "geo_location")]
    filled += [F.col(c).isNotNull() for c in ("episode_id", "robot_id", "mission_id", "parent_id", "external_id", "outcome_type")]
    return sum((c.cast("int") for c in filled), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def elaboration(memories: DataFrame) -> Column:
    """Mean of seven measures of how well a memory is worked out: context, entities, emotion, threading, dates, tags, density."""
    entities, words = F.coalesce(F.size("entities"), F.lit(0)), word_count(F.col("content"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = [
        F.least(richness(memories) / 10.0, F.lit(1.0)), F.least(entities / 5.0, F.lit(1.0)), one((has(memories, "valence") != 0) | (has(memories, "arousal") != 0)), one(F.col("parent_id").isNotNull()),
        one(F.coalesce(F.size(st.explicit_dates(F.col("content"))), F.lit(0)) > 0), one(F.coalesce(F.size("tags"), F.lit(0)) > 0), F.when(words > 0, F.least(entities / words * 10.0, F.lit(1.0))).otherwise(0.0),
    ]
    return F.least(F.greatest(sum(parts, F.lit(0.0)) / 7.0, F.lit(0.0)), F.lit(1.0))


def importance(memories: DataFrame) -> Column:
    """Importance of a new memory from its type, length, entities, context, metadata, vector and wording; at most 1."""
    kind = F.lit(0.05)
    for name, worth in TYPE_WORTH.items():
        kind = F.when(F.col("experience_type") == name, worth).otherwise(kind)
    words, entities = word_count(F.col("content")), F.coalesce(F.size("entities"), F.lit(0))
    rich = F.when(words > 50, 0.25).when(words > 20, 0.15).when(words > 5, 0.08).otherwise(0.02)
    named = F.when(entities > 10, 0.2).when(entities > 5, 0.15).when(entities > 2, 0.1).when(entities > 0, 0.05).otherwise(0.0)
    context = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, 0.03).otherwise(0.0) + F.when(F.coalesce(F.size("relations.related_memories"), F.lit(0)) > 0, 0.04).otherwise(0.0) + F.when(F.col("mission_id").isNotNull(), 0.03).otherwise(0.0)
    meta = lambda k: F.element_at("metadata", k)
    priority = F.lit(0.0)
    for name, worth in PRIORITY_WORTH.items():
        priority = F.when(meta("priority") == name, worth).otherwise(priority)
    extra = priority + F.when(meta("unexpected").isNotNull(), 0.08).otherwise(0.0) + F.when(meta("breakthrough").isNotNull(), 0.12).otherwise(0.0) + F.when(meta("role") == "user", 0.02).otherwise(0.0)
    low = F.lower(F.coalesce("content", F.lit("")))
    text = F.coalesce("content", F.lit(""))
    quality = sum((F.when(low.contains(t), 0.015).otherwise(0.0) for t in TECHNICAL), F.lit(0.0)) + F.when(low.contains("?"), 0.02).otherwise(0.0)
    quality = quality + F.when(text.contains("```") | text.contains("fn ") | text.contains("function ") | text.contains("class "), 0.03).otherwise(0.0)
    vector = F.when(has(memories, "dimensions") >= 384, 0.1).when(has(memories, "dimensions") > 0, 0.05).otherwise(0.0)
    return F.least(kind + rich + named + F.least(context, F.lit(0.2)) + F.least(extra, F.lit(0.15)) + vector + F.least(quality, F.lit(0.1)), F.lit(1.0))


def recency_scale(query: str, decomposed: bool = False) -> float:
    """Weight of recency: more if the query asks for recent things, less for a query that was taken apart."""
    return RECENCY_ASKED if any(p in query.lower() for p in RECENT_PHRASES) else RECENCY_DECOMPOSED if decomposed else RECENCY_SCALE


def unified(candidates: DataFrame, now: Column, query: str = "", dates: list[str] | None = None, episode: str | None = None, exploring: bool = False, decomposed: bool = False, health: float = 1.0) -> Column:
    """The one score of a candidate memory with ``base`` (relevance) and ``hebbian`` (strength of its links): additive boosts of
    recency, emotion, credibility, dates, session, use, links, episode, sequence, context, activation, dates and entities held,
    elaboration and bursts of use, times the momentum of feedback, the calibrated confidence and the health of the graph."""
    hours = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / 3_600_000_000)
    zero = F.lit(0.0)
    recency = F.exp(-RECENCY_RATE * F.greatest(hours, F.lit(0))) * recency_scale(query, decomposed)
    hebb = F.coalesce(F.col("hebbian").cast("double"), zero)
    trust = F.lit(1.0)
    if "source_type" in candidates.columns:
        for name, worth in SOURCE_TRUST.items():
            trust = F.when(F.col("source_type") == name, worth).otherwise(trust)
    credibility = F.greatest(has(candidates, "credibility", 0.5) - 0.5, zero) * 0.1 * trust
    held = st.explicit_dates(F.col("content"))
    dated = zero
    for d in dates or []:
        apart = lambda x, d=d: F.abs(F.datediff(x, F.lit(d).cast("date")))
        worth = lambda x, apart=apart: F.when(apart(x) == 0, DATE_EXACT).when(apart(x) <= 7, DATE_WEEK * (1 - apart(x) / 7.0)).when(apart(x) <= 30, DATE_MONTH * (1 - apart(x) / 30.0)).otherwise(0.0)
        dated = F.greatest(dated, F.coalesce(F.array_max(F.transform(held, worth)), zero))
    access = F.log1p(F.coalesce("access_count", F.lit(0)).cast("double")) / 5.0 * (ACCESS_EXPLORING if exploring else ACCESS_WEIGHT)
    same = F.when(F.col("episode_id") == episode, EPISODE_BOOST).otherwise(0.0) if episode else zero
    momentum = has(candidates, "momentum")
    seen = F.greatest(has(candidates, "confidence_observations", 2.0) - 2.0, zero)
    boosts = [
        recency, has(candidates, "arousal") * 0.05, credibility, F.abs(has(candidates, "valence")) * 0.02, dated, F.when(hours <= SESSION_HOURS, SESSION_BOOST).otherwise(0.0), access,
        F.least(F.greatest(hebb, zero), F.lit(1.0)) * GRAPH_WEIGHT, same, F.log1p(F.coalesce("sequence_number", F.lit(0)).cast("double")) / 5.0 * 0.02, richness(candidates) / 10.0 * 0.02, has(candidates, "activation") * 0.03,
        F.least(F.coalesce(F.size(held), F.lit(0)) / 5.0, F.lit(1.0)) * 0.02, F.least(F.coalesce(F.size("entities"), F.lit(0)) / 5.0, F.lit(1.0)) * 0.02, elaboration(candidates) * 0.03, F.when(has(candidates, "burstiness") > 1.5, 0.02).otherwise(0.0),
    ]
    feedback = F.when(momentum < 0, 1.0 + F.greatest(momentum * 0.2, F.lit(-0.2))).otherwise(1.0 + F.least(momentum * 0.1, F.lit(0.1)))
    gate = F.when(seen >= 5.0, 0.85 + 0.15 * has(candidates, "calibrated_confidence", 0.5)).otherwise(1.0)
    return (F.col("base").cast("double") + hebb * HEBBIAN + sum(boosts, zero)) * feedback * gate * F.lit(health)


def reranked(fused: Column, normalised: Column) -> Column:
    """Blend of the fused rank score with a scorer's verdict, itself weighted by the rank score."""
    return 0.6 * fused + 0.4 * normalised * fused


# Modes


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors of the declared length, all elements finite, not all zero; each ``vec_id`` once."""
    good = (F.size("vector") == F.col("dimensions")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    return fl.once(vectors.where("vector is not null").where(good), "vec_id")


def by_similarity(memories: DataFrame, vectors: DataFrame, query: list[float], limit: int, wanted: Column | None = None) -> DataFrame:
    """``(id, similarity, rank)``: of the ``3 * limit`` memories nearest to a query vector (by the best of their vectors) those that
    meet ``wanted``, the first ``limit``. Ties go by id; vectors of another length are no candidates."""
    scored = usable_vectors(vectors.where(F.col("dimensions") == len(query))).select(F.col("memory_id").alias("id"), F.round(cosine(F.col("vector"), literal(query)), 9).alias("similarity")).groupBy("id").agg(F.max("similarity").alias("similarity"))
    near = tx.first_ranks(scored, "id", "similarity", 3 * limit, []).select("id", "similarity")
    kept = near.join(memories.select("id") if wanted is None else memories.where(wanted).select("id"), "id", "left_semi")
    return tx.first_ranks(kept, "id", "similarity", limit, [])


def by_time(memories: DataFrame, limit: int, now: Column, episode: str | None = None, span: tuple[Column, Column] | None = None, days: int = 7) -> DataFrame:
    """``(id, rank)``: an episode in its sequence; else a range, else the last days, newest first."""
    if episode is not None:
        own, order = memories.where(F.col("episode_id") == episode), [F.asc_nulls_last("sequence_number"), F.asc("id")]
    else:
        low, high = span or (now - F.make_dt_interval(days=F.lit(days)), now)
        own, order = memories.where((F.col("created_at") >= low) & (F.col("created_at") <= high)), [F.desc("created_at"), F.asc("id")]
    first = own.select("id", "created_at", "sequence_number").orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("id", "rank")  # ``limit`` rows


def by_cause(memories: DataFrame, seeds: DataFrame, limit: int, depth: int = 8) -> DataFrame:
    """``(id, depth, rank)``: memories reached from seeds ``(id, rank)`` over the related memories they name, nearest first, up to
    ``limit``; forgotten ones (without a row) are passed over. Whole levels are joined, so a hop is one shuffle."""
    cites = materialize(memories.select("id", F.explode(F.array_distinct("relations.related_memories")).alias("next")).where("next is not null"))
    seen = materialize(seeds.select("id", F.lit(0).alias("depth")).distinct())
    front, count = seen, seen.count()
    for d in range(1, depth + 1):
        if count >= limit:
            break
        step = front.join(cites, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        front = materialize(step)
        fresh = front.count()
        if not fresh:
            break
        seen, count = seen.union(front), count + fresh
    alive = seen.join(memories.select("id"), "id", "left_semi").orderBy("depth", "id").limit(limit)
    return alive.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", "id")))  # ``limit`` rows


def hybrid(ranked: dict[str, DataFrame], memories: DataFrame, now: Column, limit: int) -> DataFrame:
    """``(id, score)``: modes' ranked lists ``(id, rank)`` blended by reciprocal rank, 0.7 of it and 0.3 of the salience; score, then the
    newer, then the smaller id first."""
    parts = None
    for mode, rows in ranked.items():
        part = rows.select("id", (F.lit(MODE_WEIGHTS[mode]) / F.col("rank")).alias("part"))
        parts = part if parts is None else parts.union(part)
    score = parts.groupBy("id").agg(F.sum("part").alias("retrieval"))
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000.0
    salient = sc.salience_with_access(age, F.coalesce(F.col("importance").cast("double"), F.lit(0.0)), F.coalesce("access_count", F.lit(0)))
    full = memories.select("id", "created_at", salient.alias("salient")).join(score, "id")
    return full.select("id", "created_at", (F.col("retrieval") * 0.7 + F.col("salient") * 0.3).alias("score")).orderBy(F.desc("score"), F.desc("created_at"), "id").limit(limit).select("id", "score")


def by_mode(mode: str, **how: DataFrame) -> DataFrame:
    """The result of a mode by its name; the associative mode falls back to similarity."""
    if mode not in MODE_WEIGHTS and mode != "hybrid":
        raise ValueError(f"no such mode: {mode}")
    return how["similarity" if mode == "associative" and "associative" not in how else mode]


# Surfacing and prefetch


def tag_score(context: str, tags: Column) -> Column:
    """Share of a memory's tags that a context names: held as text, or a word of it begins the tag or the tag begins the word."""
    low = context.lower()
    words = sorted(set(low.split()))
    some = F.filter(tags, lambda t: t.isNotNull())
    begins = lambda t: F.exists(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lambda w: w.startswith(F.lower(t)) | F.lower(t).startswith(w))
    hit = F.filter(some, lambda t: F.lit(low).contains(F.lower(t)) | begins(t))
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, F.size(hit) / F.size(some)).otherwise(0.0)


def recency_boosted(score: Column, created: Column, now: Column, hours: int = 24, multiplier: float = 1.2) -> Column:
    """A score raised by up to ``multiplier`` within the first hours, linearly less with age, at most 1."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(created)) / 3_600_000_000)
    return F.when((age <= hours) & F.lit(hours > 0), F.least(score * (1 + (multiplier - 1) * (1 - age / float(max(1, hours)))), F.lit(1.0))).otherwise(score)


def surfaced(memories: DataFrame, semantic: DataFrame, context: str, names: list[str], now: Column, weights: tuple[float, float, float] = (0.5, 0.35, 0.15), hours: int = 24, threshold: float = 0.0, limit: int = 10) -> DataFrame:
    """Memories that bear on a context: ``(id, score)`` fused from relevance ``(id, score)``, the share of the context's entities that
    they name and their tags, raised while they are fresh; those over ``threshold``, the first ``limit``."""
    wanted = F.array(*(F.lit(n.lower()) for n in names)).cast("array<string>")
    shared = F.coalesce(F.size(F.array_intersect(F.array_distinct(entity_names()), wanted)), F.lit(0)) / float(max(1, len(set(names))))
    every = memories.join(semantic.select("id", F.col("score").alias("_s")), "id", "left")
    score = F.coalesce("_s", F.lit(0.0)) * weights[0] + shared * weights[1] + tag_score(context, F.col("tags")) * weights[2]
    shown = every.select("id", F.round(recency_boosted(score, F.col("created_at"), now, hours), 9).alias("score")).where(F.col("score") > threshold)
    return tx.first_ranks(shown, "id", "score", limit, []).select("id", "score")


def learned_weights(weights: dict[str, float], contributed: dict[str, bool], helpful: bool, rate: float = 0.05, least: float = 0.05) -> dict[str, float]:
    """Weights after one feedback: signals that took part move up when it helped and down when not; never under ``least``, sum 1."""
    moved = {k: max(least, w + (rate if helpful else -rate) * (1.0 if contributed.get(k) else 0.0)) for k, w in weights.items()}
    total = sum(moved.values())
    return {k: w / total for k, w in moved.items()}


def prefetch_kind(context: dict) -> str | None:
    """What to fetch ahead by: the strongest thing that a context names."""
    order = [("project", "project"), ("entities", "entities"), ("file", "file"), ("hour", "time")]
    return next((kind for field, kind in order if context.get(field) not in (None, [], "")), None)


def prefetch_score(memories: DataFrame, context: dict, now: Column) -> Column:
    """Relevance of memories for a context of ``project, entities, file, hour, episode``: 0.4 for the project, 0.2 for the share of
    entities, 0.2 for the file, 0.1 within an hour of the day, 0.3 for the episode and up to 0.1 while fresh; at most 1."""
    parts = [F.lit(0.0)]
    if context.get("project"):
        parts.append(F.when(F.col("mission_id") == context["project"], 0.4).otherwise(0.0))
    if context.get("entities"):
        wanted = sorted({e.lower() for e in context["entities"]})
        shared = F.coalesce(F.size(F.array_intersect(F.array_distinct(entity_names()), F.array(*(F.lit(w) for w in wanted)))), F.lit(0))
        parts.append(shared * (0.2 / len(wanted)))
    if context.get("file"):
        parts.append(F.when(F.coalesce(F.col("content").contains(context["file"]), F.lit(False)), 0.2).otherwise(0.0))
    if context.get("hour") is not None:
        parts.append(F.when(F.abs(F.hour("created_at") - context["hour"]) <= 1, 0.1).otherwise(0.0))
    if context.get("episode"):
        parts.append(F.when(F.col("episode_id") == context["episode"], 0.3).otherwise(0.0))
    hours = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / 3_600_000_000)
    parts.append(F.when(hours < 24, 0.1).when(hours < 168, 0.05).otherwise(0.0))
    return F.least(sum(parts, F.lit(0.0)), F.lit(1.0))


def injected(offers: DataFrame, seconds: int = 180) -> DataFrame:
    """Offers ``(session_id, id, ts)`` of memories to sessions without those within ``seconds`` of the last one shown: ``shown`` marks
    the offers that pass. The cooldown runs from a shown offer, so a fold over each (session, memory) decides in order of time."""
    rows = offers.groupBy("session_id", "id").agg(F.array_sort(F.collect_list(F.unix_micros("ts"))).alias("l"))  # one memory's offers to one session
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<t:bigint,shown:boolean>>").alias("out"))

    def step(s, t):
        show = s["last"].isNull() | (t - s["last"] >= seconds * 1_000_000)
        return F.struct(F.when(show, t).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(F.struct(t.alias("t"), show.alias("shown")))).alias("out"))

    done = F.aggregate("l", start, step, lambda s: s["out"])
    return rows.select("session_id", "id", F.explode(done).alias("x")).select("session_id", "id", F.timestamp_micros("x.t").alias("ts"), "x.shown")
