"""Text retrieval: inverted index with BM25, rank fusion, sentences, chunks, keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

# Frequent English words that carry no content.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her
here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the
their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves
""".split()
K1, B = 1.2, 0.75
#: Distinct query terms that are compared as a list; parts in which a ranked group is cut first.
TERMS, SALTS = 500, 32


def words(text: Column, least: int = 2, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits of at least ``least`` characters, stop words left out; in text order with repeats."""
    keep = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.filter(keep, lambda w: ~w.isin(STOP_WORDS)) if stop else keep


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index ``(term, key, tf, length)``: term counts are combined on the map side before the shuffle."""
    shown = documents.select(key, words(F.col(text)).alias("w")).where("size(w) > 0").withColumn("length", F.size("w"))
    return shown.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, key: str, text: str, queries: DataFrame, k: int | None = None) -> DataFrame:
    """``(query, key, score)``: BM25 of every document that holds a query term; ``queries`` is ``(query, text)``.

    Corpus statistics cover all documents. The texts are read once: each gives its length and, of the query terms (few, checked by
    ``TERMS``), those it holds with their counts; beyond that bound all terms are exploded and joined. Null texts count as documents
    but not in the mean length.
    """
    asked = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    terms = [r.term for r in asked.select("term").distinct().limit(TERMS + 1).collect()]
    shown = documents.select(key, words(F.col(text)).alias("w"))
    if len(terms) <= TERMS:
        wanted = F.filter("w", lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")
        held = materialize(shown.select(key, F.size("w").alias("length"), wanted.alias("w")))
        corpus = held.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        rows = held.select(key, "length", F.explode("w").alias("term"))
    else:
        corpus = shown.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).first()
        rows = shown.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    n, mean = corpus["n"] or 0, corpus["mean"] or 1.0
    tf = rows.groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
    scored = tf.join(df, "term").withColumn("part", part).join(asked, "term").groupBy("query", key).agg(F.sum("part").alias("score"))
    return scored if k is None else first_ranks(scored, key, "score", k, ["query"])


def first_ranks(scored: DataFrame, key: str, score: str, k: int, by: list[str]) -> DataFrame:
    """The best ``k`` rows of each group with their ``rank`` from 1, ties by key. A group of any size is cut to ``k`` in every one of
    its ``SALTS`` parts before the parts meet, so no task sorts a whole group."""
    cut = scored.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), key))
    some = cut.withColumn("rank", best(*by, "_salt")).where(F.col("rank") <= k).drop("_salt", "rank")
    return some.withColumn("rank", best(*(by or [F.lit(0)]))).where(F.col("rank") <= k)


def all_ranks(scored: DataFrame, key: str, score: str, by: list[str]) -> DataFrame:
    """Every row with its ``rank`` in its group, by score from high to low, ties by key. Rows are cut into ranges of the whole order;
    a row's rank is its place in its range and the sizes of the group's ranges before, so a group of any size spans many tasks."""
    groups = [F.col(c) for c in by]
    placed = materialize(scored.repartitionByRange(*groups, F.desc(score), F.asc(key)).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # a row for each group and range
    starts = sizes.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(F.desc(score), key))
    return placed.withColumn("_place", place).join(starts, [*by, "_part"]).withColumn("rank", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def fuse(lists: list[tuple[DataFrame, float]], key: str, score: str = "score", k: float = 60.0, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``sum(w / (k + rank))`` over ranked lists, weights normalised; ranks start at 1, ties go by key."""
    by = by or []
    total = sum(w for _, w in lists) or 1.0
    out = None
    for df, weight in lists:
        ranked = all_ranks(df.select(*by, key, score), key, score, by)
        part = ranked.select(*by, key, (F.lit(weight / total) / (F.lit(k) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*by, key).agg(F.sum("part").alias("fused"))


def sentences(text: Column) -> Column:
    """Split behind a stop that white space and a capital follow; common abbreviations and initials do not end a sentence."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?=\s)(?<!\b(?:Mr|Dr|Ms|St|vs|Inc|Ltd|No|Fig)\.)(?<!\b[A-Z]\.)\s+(?=[A-Z0-9])|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def cooccurring_words(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of neighbouring content words of a sentence, in text order: ``(first, second, n)`` counted over all documents."""
    s = documents.select(F.explode(sentences(F.col(text))).alias("s")).select(words(F.col("s"), 3).alias("w")).where("size(w) > 1")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def chunks(documents: DataFrame, key: str, text: str, size: int = 800, overlap: int = 200) -> DataFrame:
    """``(key, chunk, start, piece)``: pieces of ``size`` characters that overlap; whole texts are covered, a short text is one piece."""
    step = size - overlap
    t = F.col(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - F.lit(overlap) - 1, F.lit(0)), F.lit(step))
    return documents.where(F.length(t) > 0).select(key, F.posexplode(starts).alias("chunk", "start"), t.alias("_t")).select(key, "chunk", "start", F.substring("_t", F.col("start") + 1, F.lit(size)).alias("piece"))


def keywords(documents: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """Best terms per document by tf-idf weighted towards early places: ``(key, term, score, rank)``."""
    shown = documents.select(key, words(F.col(text), 3).alias("w"))
    n = shown.count()
    rows = shown.select(key, F.posexplode("w").alias("place", "term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.min("place").alias("first"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    score = F.col("tf") * F.log(F.lit(float(n + 1)) / F.col("df")) / F.log(F.col("first") + 3.0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return rows.join(df, "term").withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).select(key, "term", "score", "rank")


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of term frequencies of two texts; 0 if either has no words."""
    x, y = words(a), words(b)
    every = F.array_union(F.array_distinct(x), F.array_distinct(y))
    count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w)).cast("double")
    both = F.aggregate(every, F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
    size = lambda arr: F.sqrt(F.aggregate(F.array_distinct(arr), F.lit(0.0), lambda s, w: s + count(arr, w) * count(arr, w)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (size(x) * size(y)))


_DOUBLE = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
           "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def stem(word: str) -> str:
    """English stem by the published Porter rules; words of two letters and words with other signs stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def vowel(w, i):
        return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def measure(w):
        kinds = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
        return sum(1 for i in range(1, len(kinds)) if kinds[i] == "c" and kinds[i - 1] == "v")

    def short(w):
        return len(w) > 2 and not vowel(w, len(w) - 1) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 3) and w[-1] not in "wxy"

    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_DOUBLE, _SINGLE):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in [*_LAST, "ion"] if w.endswith(e)), key=len, default=None)
    if end and measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """Adds ``stem`` to distinct terms (the vocabulary, not the text, passes through Python)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=[stem(t) if t else t for t in b[column]])

    distinct = terms.select(column).distinct()
    return terms.join(distinct.mapInPandas(run, f"{column} string, stem string"), column)
