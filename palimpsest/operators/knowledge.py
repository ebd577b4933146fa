"""Facts and gaps: duplicates, contradictions, consolidation, facts in time, lineage, and confidence of what is missing in a graph.

Facts have ``id, user_id, fact, confidence, related_entities, ...``. Copies of a wording are folded before pairs are made, so a wording
that many facts share is compared once. Similarity of texts is the cosine of their word counts where no vectors are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import strings as st
from palimpsest.operators.components import connected_components
from palimpsest.operators.texts import STOP_WORDS, sentences, stem
from palimpsest.runtime import discard, materialize

# Fixed values that results depend on.
SAME_COSINE, SAME_JACCARD, SAME_WORDS_ONLY = 0.80, 0.30, 0.70
CLUSTER_JACCARD, CLUSTER_SUPPORT = 0.45, 2
HOT, HOT_AGE_DAYS, RELATED_LENGTH = 3.0, 3, 3
NEGATION_MARKERS = "not n't never no none neither nor cannot can't won't don't doesn't didn't shouldn't wouldn't couldn't isn't aren't wasn't weren't hasn't haven't hadn't".split()
OPPOSITION_MARKERS = ["not ", "n't ", "no ", "never ", "doesn't ", "don't ", "didn't ", "isn't ", "aren't ", "wasn't ", "weren't ", "won't ", "wouldn't ", "can't ", "cannot ", "couldn't ", "shouldn't ", "hasn't ", "haven't ", "hadn't "]
OPPOSITES = [
    ("yes", "no"), ("true", "false"), ("enabled", "disabled"), ("active", "inactive"), ("uses", "doesn't use"), ("supports", "doesn't support"), ("likes", "dislikes"), ("allow", "disallow"), ("accept", "reject"),
    ("include", "exclude"), ("open", "closed"), ("start", "stop"), ("enable", "disable"), ("connect", "disconnect"), ("agree", "disagree"), ("available", "unavailable"), ("valid", "invalid"), ("correct", "incorrect"),
    ("possible", "impossible"), ("complete", "incomplete"),
]
PLANNING = ["planning to", "planning on", "going to", "thinking about", "want to", "hope to", "looking forward to", "excited to", "next month", "next week", "this weekend", "soon"]
OCCURRED = ["last saturday", "last sunday", "last monday", "last tuesday", "last wednesday", "last thursday", "last friday", "last week", "last weekend", "last month", "yesterday", "this morning", "earlier today", "recently", "just", "ago", "two weeks ago", "a few days ago"]
PAST_VERBS = ["ran", "went", "did", "took", "made", "had", "got", "saw", "met"]
FACT_TRUST = {"Planned": 0.8, "Occurred": 0.75, "Historical": 0.85}
INERTIA = {"Learning": 0.95, "Decision": 0.90, "Pattern": 0.85, "Discovery": 0.75, "Context": 0.60, "Task": 0.50, "Observation": 0.40, "Conversation": 0.30, "Error": 0.20}
HELPFUL_BOOST, MISLEADING_DECAY, IMPORTANCE_FLOOR = 0.025, 0.10, 0.05
#: They steer work, never results: rows of a bucket that are compared without a look at its parts, counters of how common tokens are, and
#: stems that a task remembers.
BUCKET, COUNTERS, STEMS = 256, 1 << 16, 200_000


def word_counts(text: Column) -> Column:
    """Words of letters and digits of two characters and more, in lower case, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two arrays of words; 0 if either is empty."""
    times = lambda arr, w: F.size(F.filter(arr, lambda v: v == w)).cast("double")
    dot = F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, w: s + times(a, w) * times(b, w))
    size = lambda arr: F.sqrt(F.aggregate(F.array_distinct(arr), F.lit(0.0), lambda s, w: s + times(arr, w) * times(arr, w)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (size(a) * size(b)))


def _length(words: Column) -> Column:
    """Root of the summed squares of word counts."""
    times = lambda w: F.size(F.filter(words, lambda v: v == w)).cast("double")
    return F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + times(w) * times(w)))


def positive(text: Column) -> Column:
    """True for an even number of negating words."""
    return F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.isin(NEGATION_MARKERS))) % 2 == 0


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def opposed(a: Column, b: Column) -> Column:
    """Whether two texts speak against each other: one is negated, or each holds one side of a pair of opposites and not the other."""
    x, y = F.lower(a), F.lower(b)
    negated = lambda t: F.exists(F.array(*(F.lit(m) for m in OPPOSITION_MARKERS)), lambda m: t.contains(m))
    crossed = F.lit(False)
    for yes, no in OPPOSITES:
        crossed = crossed | (x.contains(yes) & y.contains(no) & ~x.contains(no) & ~y.contains(yes)) | (x.contains(no) & y.contains(yes) & ~x.contains(yes) & ~y.contains(no))
    return (negated(x) != negated(y)) | crossed


def _wordings(facts: DataFrame) -> DataFrame:
    """One row per tenant, wording and set of entities, with the smallest id that has it."""
    shown = facts.where("fact is not null").select("user_id", "fact", F.sort_array(F.array_distinct(F.filter(F.coalesce("related_entities", F.array().cast("array<string>")), lambda e: e.isNotNull()))).alias("entities"), "id")
    one = shown.groupBy("user_id", "fact", "entities").agg(F.min("id").alias("id"))
    words = one.withColumn("words", word_counts(F.col("fact"))).withColumns({"length": _length(F.col("words")), "different": F.array_distinct("words"), "tokens": F.array_distinct(F.filter(F.split(F.lower("fact"), r"\s+"), lambda w: w != "")), "positive": positive(F.col("fact"))})
    # Facts without entities are about nothing in particular and meet each other.
    return words.withColumn("entity", F.explode(F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit("")))))


def _pairs(facts: DataFrame, same_polarity: bool) -> DataFrame:
    """Pairs of different wordings of a tenant that share an entity, each once (at their smallest shared entity), with their cosine."""
    rows = materialize(_wordings(facts))
    other = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    polar = F.col("positive") == F.col("positive_b") if same_polarity else F.col("positive") != F.col("positive_b")
    pair = (F.col("user_id") == F.col("user_id_b")) & (F.col("entity") == F.col("entity_b")) & (F.col("id") < F.col("id_b")) & polar
    first = F.coalesce(F.array_min(F.array_intersect("entities", "entities_b")), F.lit(""))
    met = rows.join(other, pair).where(F.col("entity") == first)
    if same_polarity:
        met = met.where(jaccard(F.col("tokens"), F.col("tokens_b")) >= SAME_JACCARD)
    # Lengths are known per wording; only the words that both hold count for a pair.
    times = lambda arr, w: F.size(F.filter(arr, lambda v: v == w)).cast("double")
    dot = F.aggregate(F.array_intersect("different", "different_b"), F.lit(0.0), lambda s, w: s + times(F.col("words"), w) * times(F.col("words_b"), w))
    size = F.col("length") * F.col("length_b")
    return met.withColumn("cosine", F.when(size > 0, F.round(dot / size, 9)).otherwise(0.0)).where(F.col("cosine") >= SAME_COSINE)


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """``(id, match, cosine)``: for each wording the other fact of its tenant that says the same: an entity shared (or neither has any),
    the same polarity, cosine and Jaccard over their bounds; the best by cosine, then the smaller id. ``id`` stands for all facts of
    one wording."""
    near = _pairs(facts, True)
    both = near.select("id", F.col("id_b").alias("match"), "cosine").union(near.select("id_b", "id", "cosine"))
    return both.groupBy("id").agg(F.min_by(F.struct("match", "cosine"), F.struct(-F.col("cosine"), F.col("match"))).alias("m")).select("id", "m.match", "m.cosine")


def contradictions(facts: DataFrame) -> DataFrame:
    """``(id, id_b, cosine)``: wordings of a tenant about a shared entity that are nearly the same and of opposite polarity."""
    return _pairs(facts, False).select("id", "id_b", "cosine")


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``(id, tokens)`` with Jaccard >= ``least``, exactly: tokens are ordered by rarity, and only rows that share one
    of their rarest ``n - ceil(least * n) + 1`` are compared. Rows without tokens are in no pair."""
    rows = materialize(rows.where(F.size("tokens") > 0))
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    ranked = rows.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).join(counts, "t").groupBy("id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("tokens"))
    ranked = materialize(ranked)  # one row's own tokens, in order
    prefix = ranked.select("id", "size", F.explode(F.slice("tokens", F.lit(1), F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)).alias("t"))
    other = prefix.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "t")
    fits = (F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9) & (F.col("id") < F.col("b"))
    asked = prefix.join(other, "t").where(fits).select(F.col("id").alias("a"), "b").distinct()
    shown = ranked.select("id", "tokens")
    both = asked.join(shown.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(shown.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.where(jaccard(F.col("x"), F.col("y")) >= least - 1e-12).select("a", "b")


def _content_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def stem_codes(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without their text, with ``tokens``: the tokens of :func:`stem_sets` as 64-bit codes. Nothing is shuffled; a task stems a
    word once as long as it remembers it."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            lists = b.column("words")
            words = lists.flatten().dictionary_encode()
            names = words.dictionary.to_pylist()
            if len(known) > STEMS:
                known.clear()
            stems = [known[w] if w in known else known.setdefault(w, stem(w)) for w in names]
            spread = pa.array(stems, pa.string()).take(words.indices)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), spread)], names=[*kept, "stems"])

    asked = rows.select(*kept, F.coalesce(_content_words(F.col(text)), F.array().cast("array<string>")).alias("words"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", stems array<string>"
    return asked.mapInArrow(run, schema).select(*kept, F.array_distinct(F.transform("stems", lambda t: F.xxhash64(t))).alias("tokens"))


def _rarest_first(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            tokens, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            tokens = tokens[np.lexsort((tokens, counts[tokens & (len(counts) - 1)], np.repeat(np.arange(len(sizes)), sizes)))]
            marks = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (tokens & 63).astype(np.uint64)), ends[:-1]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(sizes.astype(np.int32)), pa.array(marks), pa.array(np.full(len(sizes), -1, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], names=["key", "id", "size", "mark", "at", "tokens"])

    return run


def linked_sets(rows: DataFrame, least: float, within: str, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between rows ``(id, within, tokens)`` of the same ``within`` with Jaccard >= ``least``. Not all pairs are listed, but
    the connected components are those of all pairs. Tokens are distinct 64-bit codes.

    Tokens stand in one order, common ones last. Rows of a ``within`` are a bucket. A bucket of up to ``bucket`` rows is compared pair by
    pair; a larger one is cut by the next token: rows that have to share ``k + 1`` tokens agree in the first ``k + 1`` that they share, and
    enough must be left behind these. Rows that share enough already are linked to the smallest row of the bucket. A bucket whose
    parts would cost more than half of its own pairs is compared as it is. Bits of the tokens rule most pairs out before their tokens are met.
    """
    need = lambda a, b: F.ceil((F.col(a) + F.col(b)) * (least / (1 + least)) - 1e-9)
    rows = rows.where(F.col(within).isNotNull() & (F.size("tokens") > 0))
    counts = np.zeros(COUNTERS, np.int64)
    for c in rows.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).agg(F.count("*").alias("n")).collect():  # COUNTERS rows at most
        counts[c["c"]] = c["n"]
    state = materialize(rows.select(F.xxhash64(within).alias("key"), "id", "tokens").mapInArrow(_rarest_first(counts), f"key long, id {rows.schema['id'].dataType.simpleString()}, size int, mark long, at int, tokens array<long>"))

    def met(some: DataFrame) -> DataFrame:
        # Both sides are one plan without new names, so that they are shuffled once.
        x, y = (some.select("key", "id", "size", "mark", "tokens").alias(side) for side in "xy")
        enough = need("x.size", "y.size")
        apart = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
        pair = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.size") - apart("x.mark", "y.mark") >= enough) & (F.col("y.size") - apart("y.mark", "x.mark") >= enough) & (F.size(F.array_intersect("x.tokens", "y.tokens")) >= enough)
        return x.join(y, pair).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    links, k = None, 0
    while True:
        sizes = state.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("size", "id")).alias("head"), F.max("size").alias("most"))
        large = materialize(sizes.where(F.col("n") > bucket).select("key", "n", F.col("head.size").alias("head_size"), F.col("head.id").alias("head"), "most"))
        last = large.isEmpty()
        found = met(state) if last else None
        if not last:
            own = state.join(large, "key")
            end = F.col("size") + k - F.greatest(F.lit(k + 1), F.ceil(F.col("size") * least - 1e-9).cast("int"))
            cut = own.where((need("size", "most") > k) & (end > F.col("at"))).select(F.col("key").alias("parent"), "n", "id", "size", "mark", "tokens", F.explode(F.sequence(F.col("at") + 1, end)).alias("at"))
            parts = materialize(cut.withColumn("key", F.xxhash64("parent", F.get("tokens", F.col("at")))))
            cost = parts.groupBy("parent", "key").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("cost"), F.first("n").alias("n"))
            whole = materialize(cost.where(F.col("cost") * 2 > F.col("n") * F.col("n")).select(F.col("parent").alias("key")))
            split = large.join(whole, "key", "left_anti")
            sure = own.where((F.col("id") != F.col("head")) & (need("size", "head_size") <= k)).select(F.col("id").alias("a"), F.col("head").alias("b"))
            found = met(state.join(split.select("key"), "key", "left_anti")).union(sure)
        found = materialize(found)
        links = found if links is None else links.union(found)
        if last:
            discard(state)
            return links
        rest = materialize(parts.join(whole.withColumnRenamed("key", "parent"), "parent", "left_anti").select("key", "id", "size", "mark", "at", "tokens"))
        discard(state)
        discard(parts)
        state, k = rest, k + 1


def stem_sets(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``: the distinct stems of the content words of a text. Words are stemmed once each, not once per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=[stem(t) for t in b["word"]])

    spread = materialize(rows.select("id", F.explode_outer(F.array_distinct(_content_words(F.col(text)))).alias("word")))
    stems = spread.select("word").where("word is not null").distinct().mapInPandas(run, "word string, stem string")
    tokens = spread.join(stems, "word", "left").groupBy("id").agg(F.sort_array(F.collect_set("stem")).alias("tokens"))  # one text's own stems
    return rows.join(tokens, "id")


def _relations(told: DataFrame) -> DataFrame:
    """``(user_id, fact, support, confidence, sources)`` of every two ``names`` of a ``memory``, "a relates to b". Names are compared in
    lower case; short ones, stop words and those that are a part of another name of the memory stand for nothing of their own."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform("names", lambda e: F.lower(F.trim(e))), lambda e: (F.length(e) >= RELATED_LENGTH) & ~e.isin(STOP_WORDS))))
    told = told.select("user_id", "memory", "confidence", known.alias("own")).where("size(own) > 1")
    told = told.withColumn("own", F.filter("own", lambda e: ~F.exists("own", lambda o: (o != e) & o.contains(e))))
    both = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = materialize(told.select("user_id", "memory", "confidence", F.explode(both).alias("p")).select("*", F.xxhash64("user_id", "p").alias("key")))
    # The same two names in several memories; alike is not enough, or all relations of one name would be one group. Most pairs stand alone
    # and are left behind before ids are gathered.
    several = materialize(pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CLUSTER_SUPPORT).select("key"))
    same = pairs.join(several, "key", "left_semi").groupBy("user_id", "p.x", "p.y").agg(F.count("*").alias("support"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list("memory")).alias("sources"))
    return same.where(F.col("support") >= CLUSTER_SUPPORT).select("user_id", F.concat("x", F.lit(" relates to "), "y").alias("fact"), "support", "confidence", "sources")


def consolidated(memories: DataFrame, now: Column, kinds: list[str] | None = None, least_age_days: int = 7, heat: Column | None = None, names: Column | None = None) -> DataFrame:
    """Facts that several memories support: ``(user_id, fact, support, confidence, sources)``, of memories ``(id, user_id, content,
    importance, created_at)``, each once, that are old enough. With ``heat`` those that are ``HOT_AGE_DAYS`` old and hot are old enough too;
    ``kinds`` narrows the memories to types of experience.

    Candidates are all sentences of a memory, with its importance as confidence. Sentences alike (stems, Jaccard >= ``CLUSTER_JACCARD``)
    form groups by connected components within a tenant; a group that ``CLUSTER_SUPPORT`` memories or more support gives one fact: its most
    confident sentence, the mean confidence, and the number of memories. The greedy grouping that depends on the order of rows has no
    counterpart here. With ``names`` (an array of the names of a memory's entities) every two of them are a candidate too, and the
    memories with the same two support it. ``sources`` are the ids of all memories of a fact, in order.
    """
    aged = lambda days: F.col("created_at") <= now - F.make_dt_interval(days=F.lit(days))
    ripe = aged(least_age_days) if heat is None else aged(least_age_days) | (aged(HOT_AGE_DAYS) & (heat >= HOT))
    old = memories.where(ripe if kinds is None else ripe & F.col("experience_type").isin(kinds))
    told = old.select("user_id", F.col("id").alias("memory"), F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("confidence"), F.array_distinct(sentences(F.col("content"))).alias("texts"), *([] if names is None else [names.alias("names")]))
    told = materialize(told)
    said = told.select("user_id", "memory", "confidence", F.explode("texts").alias("text")).withColumn("id", F.xxhash64("user_id", F.lower("text")))
    # A code of the tenant stands for it, so that memories without one meet each other as well. Texts move only where several rows are one wording.
    told_once = said.select("id", "text", F.xxhash64("user_id").alias("tenant"), F.lit(1).cast("long").alias("n"))
    several = materialize(said.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    folded = told_once.drop("n").join(several, "id").groupBy("id").agg(F.first("text").alias("text"), F.first("tenant").alias("tenant"), F.first("n").alias("n"))
    wordings = materialize(stem_codes(told_once.join(several, "id", "left_anti").union(folded)))
    groups = connected_components(linked_sets(wordings, CLUSTER_JACCARD, "tenant"), "a", "b")
    # A sentence that is like no other counts only if enough memories have it.
    kept = wordings.select("id", "n").join(groups, F.col("id") == F.col("node"), "left").where(F.col("component").isNotNull() | (F.col("n") >= CLUSTER_SUPPORT))
    full = said.join(materialize(kept.select("id", F.coalesce("component", "id").alias("group"))), "id")
    best = full.groupBy("group", "user_id", "memory").agg(F.max("confidence").alias("confidence"), F.max_by("text", F.struct("confidence", "text")).alias("text"))
    facts = best.groupBy("group", "user_id").agg(F.max_by("text", F.struct("confidence", "text")).alias("fact"), F.count("*").alias("support"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list("memory")).alias("sources"))
    facts = facts.where(F.col("support") >= CLUSTER_SUPPORT).select("user_id", "fact", "support", "confidence", "sources")
    if names is not None:
        facts = facts.union(_relations(told))
    return facts.withColumn("confidence", F.least("confidence", F.lit(1.0)))


def temporal_facts(memories: DataFrame) -> DataFrame:
    """Sentences that place something in time: ``(id, place, entity, event, event_type, relative_time, resolved, year, confidence,
    valid_from)``, one per sentence that names an entity of its memory and speaks of a plan, of what happened, or of an earlier year.

    The first listed entity that a sentence names is its subject. ``relative_time`` is the first known phrase in it, ``resolved`` the
    day that it names counted from the memory's creation (null if it names none).
    """
    split = F.filter(F.transform(F.split("content", "[.!?]"), lambda s: F.trim(s)), lambda s: s != "")
    rows = memories.where("created_at is not null").select("id", "user_id", "created_at", "entities", F.posexplode(split).alias("place", "event"))
    low = F.lower("event")
    holds = lambda phrases: F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: low.contains(p))
    first = lambda phrases: F.get(F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: low.contains(p)), 0)
    named = F.get(F.filter(F.transform(F.filter("entities", lambda e: e["text"].isNotNull()), lambda e: e["text"]), lambda t: low.contains(F.lower(t))), 0)
    year = F.regexp_extract("event", r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    kind = F.when(holds(PLANNING), "Planned").when(holds(OCCURRED) | holds(PAST_VERBS), "Occurred").when(year < F.year("created_at"), "Historical")
    told = rows.select("id", "user_id", "place", named.alias("entity"), "event", kind.alias("event_type"), first([*PLANNING, *OCCURRED]).alias("phrase"), year.alias("year"), "created_at").where("entity is not null and event_type is not null")
    trust = F.lit(None).cast("double")
    for name, value in FACT_TRUST.items():
        trust = F.when(F.col("event_type") == name, value).otherwise(trust)
    past = F.col("event_type") == "Historical"
    return told.select(
        "id", "user_id", "place", "entity", "event", "event_type", F.when(past, F.col("year").cast("string")).otherwise(F.col("phrase")).alias("relative_time"),
        F.when(~past, st.relative_date(F.lower("event"), F.to_date("created_at"))).alias("resolved"), F.when(past, F.col("year")).alias("year"), trust.alias("confidence"), F.col("created_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
    )


def told_by(facts: DataFrame, at: Column, limit: int) -> DataFrame:
    """Temporal facts that hold at a moment, the most confident first, then the newest, then by id and place."""
    valid = (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    return facts.where(valid).orderBy(F.desc("confidence"), F.desc("valid_from"), "id", "place").limit(limit)


def lineage_stats(edges: DataFrame) -> DataFrame:
    """Per relation and source of lineage edges ``(cause, effect, relation, source, confidence)``: their number and mean confidence."""
    return edges.groupBy("relation", "source").agg(F.count("*").alias("edges"), F.avg("confidence").alias("confidence"))


def branches(edges: DataFrame) -> DataFrame:
    """Causes with several effects: ``(cause, branches, relations)``, their distinct effects and relations counted."""
    return edges.groupBy("cause").agg(F.countDistinct("effect").alias("branches"), F.countDistinct("relation").alias("relations")).where("branches > 1")


def lineage_edited(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Lineage edges after edits ``(action, cause, effect, relation)``: 'confirm' makes an edge certain, 'reject' removes it, 'add' and
    'branch' put a certain edge of the user's own in its place. Of several edits of a pair the last by name of action counts."""
    last = edits.groupBy("cause", "effect").agg(F.max(F.struct("action", "relation")).alias("e")).select("cause", "effect", "e.action", F.col("e.relation").alias("new"))
    met = edges.join(last, ["cause", "effect"], "full")
    own = F.col("action").isin("add", "branch")
    out = met.where("coalesce(action, '') <> 'reject' and not (relation is null and action = 'confirm')")
    return out.select(
        "cause", "effect", F.when(own, F.col("new")).otherwise(F.col("relation")).alias("relation"),
        F.when(own, "explicit").when(F.col("action") == "confirm", "confirmed").otherwise(F.col("source")).alias("source"), F.when(F.col("action").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


# Gaps


def triad_confidence(strengths: Column, similarity: Column, saliences: Column) -> Column:
    """0.4 of the mean strength, 0.4 of the similarity of the ends (0.5 if unknown), 0.2 of their mean salience."""
    return F.least(F.greatest(strengths / 2.0 * 0.4 + F.coalesce(similarity, F.lit(0.5)) * 0.4 + saliences / 2.0 * 0.2, F.lit(0.0)), F.lit(1.0))


def gaps(triads: DataFrame, diamonds: DataFrame, stars: DataFrame, entities: DataFrame, edges: DataFrame, similarity: DataFrame | None = None, least_similarity: float = 0.3) -> DataFrame:
    """Gaps of three shapes with their confidence: ``(kind, key, missing_from, missing_to, confidence)``.

    Triads ``(a, b, c, strength)`` miss a-c, diamonds ``(a, b, c, d)`` miss b-c; ``similarity`` is ``(x, y, similarity)`` of entities with
    vectors, and pairs known to be under ``least_similarity`` are no gaps. A star ``(hub, spokes, linked)`` counts once, its confidence
    the share of missing links times the hub's mean strength.
    """
    worth = entities.groupBy("uuid").agg(F.max(F.coalesce(F.col("salience").cast("double"), F.lit(0.0))).alias("salience"))
    known = similarity if similarity is not None else entities.select(F.col("uuid").alias("x"), F.col("uuid").alias("y"), F.lit(None).cast("double").alias("similarity")).limit(0)

    def between(rows: DataFrame, left: str, right: str) -> DataFrame:
        ends = rows.withColumns({"x": F.least(left, right), "y": F.greatest(left, right)})
        return ends.join(known, ["x", "y"], "left").where(F.coalesce(F.col("similarity") >= least_similarity, F.lit(True)))

    t = between(triads, "a", "c").join(worth.select(F.col("uuid").alias("a"), F.col("salience").alias("sa")), "a").join(worth.select(F.col("uuid").alias("c"), F.col("salience").alias("sc")), "c")
    one = t.select(F.lit("triad").alias("kind"), F.concat_ws(":", "a", "b", "c").alias("key"), F.col("a").alias("missing_from"), F.col("c").alias("missing_to"), triad_confidence(F.col("strength"), F.col("similarity"), F.col("sa") + F.col("sc")).alias("confidence"))
    two = between(diamonds, "b", "c").select(F.lit("diamond"), F.concat_ws(":", "a", "b", "c", "d"), "b", "c", F.coalesce("similarity", F.lit(0.5)) * 0.6 + 0.4)
    mean = edges.groupBy(F.col("from_entity").alias("hub")).agg(F.avg(F.col("strength").cast("double")).alias("strength"))
    possible = F.col("spokes") * (F.col("spokes") - 1) / 2.0
    three = stars.join(mean, "hub").select(F.lit("star"), F.col("hub"), F.lit(None).cast("string"), F.lit(None).cast("string"), (possible - F.col("linked")) / F.greatest(possible, F.lit(1.0)) * F.col("strength"))
    return one.union(two).union(three)


# Feedback


def momentum(signals: DataFrame, now: Column, half_life_days: float = 30.0) -> DataFrame:
    """Feedback momentum of memories from signals ``(id, kind, at, value, confidence)``: ``(id, signals, ema, stability, decayed)``.

    A signal moves the average by what the memory's inertia leaves (by its type, its stability and the number of signals, between 0.5
    and 0.99), less after a pause; a certain and clearly negative signal overrides it. The fold runs in order of time over one memory's
    own signals; ``decayed`` halves every ``half_life_days`` since the last one.
    """
    base = F.lit(0.5)
    for name, value in INERTIA.items():
        base = F.when(F.col("kind") == name, value).otherwise(base)
    rows = signals.where("id is not null and value is not null").groupBy("id").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct(F.unix_micros("at").alias("t"), F.col("value").cast("double").alias("v"), F.col("confidence").cast("double").alias("c")))).alias("l")).withColumn("base", base)
    start = F.struct(F.lit(0.0).alias("ema"), F.lit(0.5).alias("st"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"))

    def step(s, x):
        inertia = F.least(F.greatest(F.col("base") * F.least(F.lit(0.8) + s["n"] * 0.01, F.lit(1.0)) * (F.lit(0.7) + s["st"] * 0.3), F.lit(0.5)), F.lit(0.99))
        pause = F.coalesce(x["t"] - s["last"], F.lit(0))
        recency = F.when(pause < 3_600_000_000, 1.0).when(pause < 86_400_000_000, 0.9).when(pause < 604_800_000_000, 0.7).otherwise(0.5)
        alpha = (1 - inertia) * recency * x["c"]
        override = (x["c"] > 0.8) & (x["v"] < -0.3)
        ema = F.when(override, x["v"]).otherwise(s["ema"] * (1 - alpha) + x["v"] * alpha)
        held = F.when(override, s["st"] * 0.3).otherwise(s["st"])
        same = ((x["v"] > 0) == (s["ema"] > 0)) | (F.abs(s["ema"]) < 1e-7)
        stable = F.when(same, F.least(held + 0.05, F.lit(1.0))).otherwise(F.greatest(held - 0.1 * F.abs(x["v"] - s["ema"]), F.lit(0.0)))
        return F.struct(ema.alias("ema"), stable.alias("st"), (s["n"] + 1).alias("n"), x["t"].alias("last"))

    done = rows.select("id", F.aggregate("l", start, step).alias("s"))
    days = F.floor((F.unix_micros(now) - F.col("s.last")) / 3_600_000_000) / 24.0
    decayed = F.when(days < 0.1, F.col("s.ema")).otherwise(F.col("s.ema") * F.pow(F.lit(0.5), days / half_life_days))
    return done.select("id", F.col("s.n").alias("signals"), F.col("s.ema").alias("ema"), F.col("s.st").alias("stability"), decayed.alias("decayed"))


def reinforced(memories: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Memories after recall outcomes ``(id, outcome)``: each 'helpful' moves importance towards 1, each 'misleading' takes a tenth of it
    (never under the floor), every outcome counts as an access: ``(id, importance, access_count)``."""
    counts = outcomes.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "helpful").alias("up"), F.count_if(F.col("outcome") == "misleading").alias("down"))
    met = memories.join(counts, "id", "left")
    old = F.coalesce(F.col("importance").cast("double"), F.lit(0.0))
    new = F.least(old + HELPFUL_BOOST * F.coalesce("up", F.lit(0)), F.lit(1.0)) * F.pow(F.lit(1 - MISLEADING_DECAY), F.coalesce("down", F.lit(0)))
    return met.select("id", F.when(F.coalesce("down", F.lit(0)) > 0, F.greatest(new, F.lit(IMPORTANCE_FLOOR))).otherwise(new).alias("importance"), (F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("access_count"))


def context_turns(contexts: DataFrame, similarity: Column) -> DataFrame:
    """Contexts ``(user_id, at, id, vector)`` against the one before: ``(id, similarity, repeated, changed)``, over 0.8 and under 0.3;
    ``similarity`` is a column of ``vector`` and ``before``. The first of a user has none before and gives no row."""
    turn = contexts.withColumn("before", F.lag("vector").over(Window.partitionBy("user_id").orderBy("at", "id")))
    scored = turn.where("before is not null").select("id", F.round(similarity, 9).alias("similarity"))
    return scored.select("id", "similarity", (F.col("similarity") > 0.8).alias("repeated"), (F.col("similarity") < 0.3).alias("changed"))


def maintained(memories: DataFrame, now: Column) -> DataFrame:
    """One maintenance pass: ``(id, tier, activation, fate)``. Tiers are promoted by importance and age, activation (importance here, as
    none is stored) fades by the forgetting curve, and memories that are expired, or old, unimportant and never used, are 'pruned';
    important ones of the last fortnight are marked for 'replay', the rest 'kept'."""
    from palimpsest.functions import scoring as sc
    from palimpsest.operators.mutations import promoted_tier

    days = sc.days_between(now, F.col("created_at"))
    value = F.coalesce(F.col("importance").cast("double"), F.lit(0.0))
    expired = F.col("valid_until").isNotNull() & (F.col("valid_until") < now)
    stale = (days > 90) & (value < 0.2) & (F.coalesce("access_count", F.lit(0)) == 0)
    fate = F.when(expired | F.coalesce(stale, F.lit(False)), "pruned").when((days >= 0) & (days <= 14) & (value >= 0.3), "replay").otherwise("kept")
    return memories.select("id", promoted_tier(F.round(value, 6), days * 86_400).alias("tier"), (value * sc.memory_decay(days, F.lit(False))).alias("activation"), fate.alias("fate"))
