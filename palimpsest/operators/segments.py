"""Texts taken apart: chunks at natural ends, atomic segments, word pairs, keywords, threads of topics, names of code, rows of CSV."""

from __future__ import annotations

import csv
import io
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import strings as st
from palimpsest.operators import texts as tx
from palimpsest.operators.knowledge import jaccard, stem_sets

# Fixed values that results depend on.
CHUNK, OVERLAP, LEAST = 800, 200, 200
SEGMENT_MOST, SEGMENT_LEAST, CSV_ROWS, TOPIC_JACCARD = 500, 10, 100, 0.3
DECLARATION = r"\b(fn|func|function|def|class|struct|enum|trait|interface|impl|module|type|const)\s+([A-Za-z_][A-Za-z0-9_]*)"
ORGANISATION_ENDS = "inc ltd llc gmbh corp corporation company limited plc labs technologies systems group".split()
LEXICON = {
    "Technology": "python rust java javascript typescript spark docker kubernetes redis postgres kafka linux git terraform ansible grafana prometheus".split(),
    "Location": "london paris berlin madrid rome tokyo delhi mumbai sydney boston chicago seattle dublin".split(),
}
BASE_SALIENCE = {"Person": 0.8, "Organization": 0.7, "Location": 0.6, "Technology": 0.6, "Concept": 0.4}


def _end(raw: bytes, start: int, end: int, least: int) -> int:
    """The last end of a sentence in a piece, at least ``least`` bytes behind its start; else the last white space; else the piece's end."""
    piece = raw[start:end].decode("utf-8")
    at, sentence, space = 0, None, None
    for k, c in enumerate(piece):
        if at >= least:
            if c in ".!?" and (k + 1 == len(piece) or piece[k + 1].isspace()):
                sentence = at + 1
            if c.isspace():
                space = at
        at += len(c.encode("utf-8"))
    return end if sentence is None and space is None else start + (sentence if sentence is not None else space)


def chunked(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Pieces of ``size`` bytes at most that end with a sentence or a word where one does, begin ``overlap`` bytes before the last end,
    and never part a character; a tail under ``least`` bytes joins the piece before. A short text is one piece, an empty one none."""
    raw = (text or "").strip().encode("utf-8")
    if not raw:
        return []
    if len(raw) <= size:
        return [raw.decode("utf-8")]
    inside = lambda k: 0 < k < len(raw) and raw[k] & 0xC0 == 0x80
    out: list[str] = []
    start = 0
    while start < len(raw):
        end = min(start + size, len(raw))
        while inside(end):
            end -= 1
        if end < len(raw):
            end = _end(raw, start, end, least)
        piece = raw[start:end].decode("utf-8").strip()
        if len(piece.encode("utf-8")) >= least or not out:
            out.append(piece)
        else:
            out[-1] += " " + piece
        if end >= len(raw):
            break
        back = max(0, end - overlap)
        while inside(back):
            back += 1
        start = end if back <= (len(out) - 1) * (size - overlap) or back <= start else back
    return out


def chunks(documents: DataFrame, key: str, text: str, **how: int) -> DataFrame:
    """``(key, chunk, piece)`` of every document by :func:`chunked`; whole texts are covered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, p) for k, t in zip(b[key], b[text]) for n, p in enumerate(chunked(t, **how))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "piece"])

    return documents.select(key, text).mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, chunk int, piece string")


def segmented(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, segment, kind, confidence)``: a text's lines and list items as atomic statements; lines over ``SEGMENT_MOST``
    characters are split into their sentences, shorter than ``SEGMENT_LEAST`` ones left out. Each has its detected type."""
    lines = F.transform(F.split(F.col(text), r"\n+"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*+•]|\d+[.)])\s+", ""))
    parts = F.filter(F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > SEGMENT_MOST, tx.sentences(x)).otherwise(F.array(x)))), lambda x: F.length(x) >= SEGMENT_LEAST)
    rows = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("place", "segment"))
    kind, confidence = st.detected_type(F.col("segment"))
    return rows.withColumns({"kind": kind, "confidence": confidence})


def sentence_words(text: Column) -> Column:
    """Content words (three letters and more, no stop words) of each sentence of a text, in text order."""
    parts = F.split(F.lower(text), r"[.!?\n]+")
    return F.transform(parts, lambda s: F.filter(F.split(s, "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(tx.STOP_WORDS)))


def word_pairs(documents: DataFrame, text: str) -> DataFrame:
    """``(first, second, n)``: how often a content word stands somewhere before another in one sentence, over all documents. Pairs are
    made inside a sentence, so nothing is joined, and are counted before the shuffle."""
    sentences = documents.select(F.explode(sentence_words(F.col(text))).alias("w")).where("size(w) > 1")
    after = lambda w, i: F.transform(F.slice(F.col("w"), i + 2, F.size("w")), lambda v: F.struct(w.alias("first"), v.alias("second")))
    pairs = F.flatten(F.transform("w", after))
    return sentences.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def yake(text: str | None, k: int = 10, window: int = 1) -> list[tuple[str, float]]:
    """The best ``k`` words of one text by the published unsupervised scheme (case, place, frequency, relatedness and spread over
    sentences), as (word, importance), importance being 1 / (1 + score). Stop words, numbers and words under three letters are none."""
    sentences = [re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s) for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip()]
    seen: dict[str, list[int]] = defaultdict(list)
    upper, left, right = Counter(), defaultdict(Counter), defaultdict(Counter)
    for n, words in enumerate(sentences):
        for i, w in enumerate(words):
            low = w.lower()
            seen[low].append(n)
            upper[low] += (w[0].isupper() and i > 0) or (len(w) > 1 and w.isupper())
            for j in range(max(0, i - window), i):
                left[low][words[j].lower()] += 1
                right[words[j].lower()][low] += 1
    wanted = [w for w in seen if len(w) > 2 and w not in tx.STOP_WORDS and not w.isdigit()]
    if not wanted:
        return []
    counts = [len(seen[w]) for w in wanted]
    mean = sum(counts) / len(counts)
    spread = math.sqrt(sum((c - mean) ** 2 for c in counts) / len(counts))
    most = max(counts)
    out = []
    for w in wanted:
        tf = len(seen[w])
        case = upper[w] / (1 + math.log(tf))
        places = sorted(seen[w])
        place = math.log(3 + places[len(places) // 2])
        related = 1 + sum((len(side[w]) / sum(side[w].values()) if side[w] else 0.0) * tf / most for side in (left, right))
        frequency, different = tf / (mean + spread), len(set(seen[w])) / len(sentences)
        score = related * place / (case + frequency / related + different / related)
        out.append((w, 1 / (1 + score)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def keywords(documents: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """``(key, word, importance, rank)`` of every document by :func:`yake`; a document is judged by itself, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, w, s, n + 1) for d, t in zip(b[key], b[text]) for n, (w, s) in enumerate(yake(t, k))]
            yield pd.DataFrame(rows, columns=[key, "word", "importance", "rank"])

    return documents.select(key, text).mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, word string, importance double, rank int")


def topic_threads(turns: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """``(id, thread, tag)``: turns ``(id, key, order, text)`` of a conversation go on with a thread while their stems overlap the turn
    before by ``TOPIC_JACCARD``; a thread's tag is made of the first five sorted stems of its first turn."""
    shown = stem_sets(turns.select("id", key, *order, F.col(text).alias("text")))
    w = Window.partitionBy(key).orderBy(*order, "id")
    new = F.coalesce(jaccard(F.col("tokens"), F.lag("tokens").over(w)) < TOPIC_JACCARD, F.lit(True)).cast("int")
    marked = shown.withColumn("_new", new).withColumn("thread", F.sum("_new").over(w))
    tag = F.first(F.array_join(F.slice("tokens", 1, 5), "-")).over(Window.partitionBy(key, "thread").orderBy(*order, "id"))
    return marked.select("id", key, "thread", tag.alias("tag"))


def code_names(text: Column) -> Column:
    """Distinct names that a text declares (functions, classes, types), in lower case and order; names of one letter are left out."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(2)), lambda n: F.length(n) > 1), lambda n: F.lower(n))))


def plain_counts(text: Column) -> tuple[Column, Column]:
    """(words, lines) of a text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return words, F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))


def csv_text(content: str | None, rows: int = CSV_ROWS) -> str:
    """A CSV text as lines of ``column: value`` pairs; beyond ``rows`` lines a note says how many there are (as a reader is shown)."""
    if not content:
        return ""
    parsed = list(csv.reader(io.StringIO(content), delimiter="\t" if "\t" in content.split("\n", 1)[0] else ","))
    header, body = [h.strip() for h in parsed[0]], [x for x in parsed[1:] if any(f.strip() for f in x)]
    lines = [", ".join(f"{header[i] if i < len(header) else '?'}: {f.strip()}" for i, f in enumerate(x)) for x in body[:rows]]
    return "\n".join(lines + ([f"... ({len(body)} total rows, showing first {rows})"] if len(body) > rows else []))


def csv_texts(documents: DataFrame, key: str, column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [csv_text(t) for t in b[column]]})

    return documents.select(key, column).mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, text string")


def extracted_entities(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, name, label, proper, salience)``: names by rule and lexicon. Runs of capitalised words inside a sentence are proper nouns
    (an organisation by its last word, else a person of two or three words, else a concept); words of the lexicon are known wherever
    they stand. Salience is the label's base, a fifth more for proper nouns, at most 1."""
    t = F.col(text)
    runs = F.regexp_extract_all(t, F.lit(r"(?<=[a-z0-9,;:)] )([A-Z][A-Za-z'’-]+(?: [A-Z][A-Za-z'’-]+){0,3})"), F.lit(1))
    known = sorted(w for words in LEXICON.values() for w in words)
    listed = F.array_intersect(F.array_distinct(F.split(F.lower(t), "[^a-z0-9]+")), F.array(*(F.lit(w) for w in known)))
    found = F.concat(F.transform(F.coalesce(F.array_distinct(runs), F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(True).alias("proper"))), F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("proper"))))
    rows = documents.select(key, F.explode(found).alias("x")).select(key, "x.name", "x.proper")
    last, low, words = F.lower(F.element_at(F.split("name", " "), -1)), F.lower("name"), F.size(F.split("name", " "))
    label = F.when(low.isin(LEXICON["Technology"]), "Technology").when(low.isin(LEXICON["Location"]), "Location").when(last.isin(ORGANISATION_ENDS), "Organization").when(F.col("proper") & words.between(2, 3), "Person").otherwise("Concept")
    base = F.lit(0.0)
    for name, value in BASE_SALIENCE.items():
        base = F.when(F.col("label") == name, value).otherwise(base)
    one = rows.withColumn("label", label).groupBy(key, low.alias("name"), "label").agg(F.bool_or("proper").alias("proper"))
    return one.withColumn("salience", F.least(base * F.when(F.col("proper"), 1.2).otherwise(1.0), F.lit(1.0)))
