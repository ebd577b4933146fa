"""Text cut off by field limits: right-censored lengths per source, combined with the evidence of each ending.

Lengths (in characters and in UTF-8 bytes) of each source are modelled as log-normal, right-censored at the source's candidate
limits: lengths at which far more values pile up than the fit explains. The fit is by maximum likelihood (EM over the length
histogram), and a value at a limit is cut with the posterior that the pile-up gives. Endings are judged by what the corpus itself
shows: for the last one, two and three words, how often that context is followed by an end (a full stop and space, a line break, a
comma in a list, or the end of more documents than cuts at random places would leave there) and how often by more text; by unclosed structures; and by final stops where a source usually sets them.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

TOKEN = re.compile(r"[^\W_]+|%")
#: What may follow a complete utterance: stops with closing quotes and brackets, then white space; or a line break.
CLOSE = re.compile(r"[\"'”’»)\]*_`]*(?:[.!?…。]+[\"'”’»)\]*_`]*(?=\s)|[ \t,;:]*\n)")
#: A word, and whether an end follows it.
WORD_AND_END = re.compile(rf"(?:{TOKEN.pattern})(?=({CLOSE.pattern})?)")
FINAL_STOP = re.compile(r"[.!?。][\"'”’»)\]*_`]*\s*$")
#: Marks left by a system that cut; also authors trail off this way, so the words before decide.
MARK = re.compile(r"\s*(?:…|\.\.\.|\[(?:\.\.\.|…|truncated|cut|clipped|more)\]|\(truncated\))\s*$", re.I)
#: A line that lists short items after a label: a comma ends an item there.
LISTING = re.compile(r"(?m)^[^\W\d_][\w ]{1,20}: ?(?:[\w./-]+, )*[\w./-]*$")
#: Contexts counted from the start of a line are this long at most.
ANCHORED = 6
#: Within how many characters below a limit a cut at a word boundary may end.
BOUNDARY = 14
#: Values at one length, and in the BOUNDARY characters below one, on which a limit is believed.
LEAST_AT, LEAST_NEAR = 5, 8
#: Log odds of evidence that is not estimated from the corpus: an open structure, a closed one, a final stop, a mark at and away from
#: a limit, the prior, and a last word that was never seen. Set by hand to orders of magnitude: structures decide alone (e**8 to 1), a stop
#: outweighs all words but those that always go on, a mark alone is weak (authors trail off), and the prior is a cut in six texts without
#: other evidence.
OPEN, CLOSED, STOPPED, MARKED_AT_LIMIT, MARKED, PRIOR, UNSEEN = 8.0, -8.0, -5.0, 3.0, -1.5, -1.5, 2.5
#: Share of documents cut away from limits that is assumed when random cuts are discounted; only its order of magnitude matters.
CUT_SHARE = 0.04
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_code(word: str) -> int:
    shape = "#" if any(c.isdigit() for c in word) else word.lower()
    raw = shape.encode()
    return (zlib.crc32(raw) << 32) | zlib.crc32(raw, 0x5BD1E995)


def structure(text: str) -> int:
    """1: a structure is open at the end, -1: the text is one closed structure or ends by closing one, 0: neither."""
    body = text.strip()
    if body.count("```") % 2:
        return 1
    if body.endswith("```"):
        return -1
    if body[:1] not in ("{", "["):
        return 0
    depth, quoted, skip = 0, False, False
    for c in body:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    if body[0] == "[" and not re.match(r"\[\s*[\[{\"\d-]", body):
        return 0
    return 1 if depth > 0 or quoted else -1


_ORDERS = ("line", "three", "two", "one")
_COLUMNS = ["doc_id", "source", "chars", "bytes", "stop", "mark", "open", *(f"g_{o}" for o in _ORDERS), *(f"p_{o}" for o in _ORDERS), "gram", "ends", "mids"]


def _tokens(body: str, known: dict[str, int]) -> tuple[list[int], list[bool], list[int]]:
    """Word codes of a text, whether an end follows each word, and which words start a line."""
    found = [(m.end(), m[0], m[1] is not None) for m in WORD_AND_END.finditer(body)]
    closed, names, gaps = (list(x) for x in zip(*found)) if found else ([], [], [])
    if ": " in body:
        for line in LISTING.finditer(body):
            for k in range(bisect_left(closed, line.start() + 1), bisect_left(closed, line.end() + 1)):
                names[k] = "," + names[k]  # items of lists are words of their own
                gaps[k] |= body[closed[k] : closed[k] + 1] == ","
    firsts = sorted({0, *(bisect_left(closed, m.start() + 1) for m in re.finditer("\n", body))} - {len(found)}) if found else []
    for t in names:
        if t not in known:
            known[t] = _word_code(t)
    return [known[t] for t in names], gaps, firsts


def _contexts(w: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of the contexts that end at each word; zeros are gaps between documents, and 0 stands for no context."""
    zero = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        one = np.where(w == 0, np.uint64(0), ((w ^ (w >> np.uint64(31))) * _MIX) | np.uint64(1))
        two = np.concatenate([zero, (one[1:] ^ (w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2))) * _MIX])
        three = np.concatenate([zero, (two[1:] ^ (np.concatenate([zero, w[:-2]]) * np.uint64(0x165667B19E3779F9) + np.uint64(3))) * _MIX])
        line, code, at = np.zeros(len(w), np.uint64), np.full(len(firsts), 5, np.uint64), firsts
        starts = np.zeros(len(w) + ANCHORED, bool)
        starts[firsts] = True
        for k in range(ANCHORED):
            code = ((code ^ w[at]) * _MIX) ^ (code >> np.uint64(27))
            line[at] = code | np.uint64(1)
            on = (at + 1 < len(w)) & ~starts[at + 1]
            on[on] = w[at[on] + 1] != 0
            code, at = code[on], at[on] + 1
    return {"line": line, "three": three, "two": two, "one": one}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its ending; per batch the counts of contexts that an end or more text follows (the last word is left out)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        known: dict[str, int] = {}
        rows, codes, follow, firsts, last = [], [0, 0], [-1, -1], [], []
        for text in batch.column(2).to_pylist():
            mark = MARK.search(text)
            body = text[: mark.start()] if mark else text.rstrip()
            mine, gaps, lines = _tokens(body, known)
            firsts += [len(codes) + k for k in lines]
            codes += [*mine, 0, 0]
            follow += [*gaps[:-1], *[-1] * (2 + bool(mine))]
            last.append(len(codes) - 3 if mine else 0)
            rows.append((len(text), len(text.encode("utf-8", "surrogatepass")), bool(FINAL_STOP.search(body)) and not mark, bool(mark), 1 if text.endswith("\ufffd") else structure(body)))
        w, after, last = np.array(codes, np.uint64), np.array(follow, np.int8), np.array(last)
        codes_of = _contexts(w, np.array(firsts, np.int64))
        grams = [codes_of[o][last] for o in _ORDERS]
        # What a cut inside the last word would have continued: the context without that word.
        before = np.maximum(last - 1, 0)
        parents = [codes_of["line"][before], codes_of["two"][before], codes_of["one"][before], np.zeros(len(last), np.uint64)]
        parents[0] = np.where(np.isin(last, firsts), np.uint64(0), parents[0])
        inside = after >= 0
        every = np.concatenate([codes_of[o][inside] for o in _ORDERS])
        kinds, inverse = np.unique(every, return_inverse=True)
        ended = np.bincount(inverse, weights=np.tile(after[inside], len(_ORDERS)), minlength=len(kinds)).astype(np.int64)
        times = np.bincount(inverse, minlength=len(kinds)).astype(np.int64)
        kept = kinds != 0
        kinds, ended, times = kinds[kept], ended[kept], times[kept]
        n, k, columns = len(rows), len(kinds), list(zip(*rows))
        types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), *[pa.int64()] * 8]
        shown = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types[2:7])), *(pa.array(g.view(np.int64)) for g in (*grams, *parents))]
        yield pa.RecordBatch.from_arrays([*shown, *[pa.nulls(n, pa.int64())] * 3], _COLUMNS)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in types), pa.array(kinds.view(np.int64)), pa.array(ended), pa.array(times - ended)], _COLUMNS)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: list[int], rounds: int = 30) -> tuple[float, float]:
    """Mean and deviation of log length by EM: the pile-up at each limit counts as 'longer than that', the rest as seen."""
    logs = np.log(np.maximum(lengths, 1.0))
    at = np.isin(lengths, limits)
    seen, weights = logs[~at], counts[~at].astype(float)
    if weights.sum() < 2:
        return float(np.average(logs, weights=counts)), 1.0
    mean = float(np.average(seen, weights=weights))
    sd = max(0.05, math.sqrt(float(np.average((seen - mean) ** 2, weights=weights))))
    for _ in range(rounds):
        total, first, second = weights.sum(), (weights * seen).sum(), (weights * seen**2).sum()
        for x, n in zip(logs[at], counts[at]):
            z = (x - mean) / sd
            tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            expect = mean + sd * hazard
            total, first, second = total + n, first + n * expect, second + n * (mean * mean + sd * sd + sd * (x + mean) * hazard)
        mean, sd = first / total, max(0.05, math.sqrt(max(1e-6, second / total - (first / total) ** 2)))
    return float(mean), float(sd)


def _density(lengths: np.ndarray, mean: float, sd: float) -> np.ndarray:
    x = np.maximum(lengths.astype(float), 1.0)
    return np.exp(-(((np.log(x) - mean) / sd) ** 2) / 2) / (x * sd * math.sqrt(2 * math.pi))


def source_limits(histogram: pd.DataFrame) -> pd.DataFrame:
    """Of one source's histogram ``(source, unit, length, n)``: rows ``(source, unit, length, posterior)`` at and just below limits.

    Counts around a length come from running sums over the lengths that occur, so the work grows with their number, not with the
    longest text. ``LEAST_AT`` and ``LEAST_NEAR`` values are the least evidence on which a limit, or a crowd below one, is believed.
    """
    out = []
    for unit, part in histogram.groupby("unit"):
        part = part.sort_values("length")
        lengths, counts = part["length"].to_numpy(), part["n"].to_numpy()
        total = counts.sum()

        def within(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[np.searchsorted(lengths, high, "right")] - sums[np.searchsorted(lengths, low, "left")]

        # The fit alone may be off where a source mixes kinds of text: the neighbourhood is asked too.
        near = (within(counts, lengths - 40, lengths + 40) - counts) / 80.0
        limits: list[int] = []
        while True:  # limits are only added, so this ends
            mean, sd = fit_censored(lengths, counts, limits)
            usual = np.maximum(total * _density(lengths, mean, sd), near)
            # Below nearly all of the fit, texts of one length are short answers rather than cuts.
            least = min(64, math.exp(mean - 2 * sd))
            piled = lengths[(counts >= LEAST_AT) & (counts > 5 * usual + 3 * np.sqrt(usual + 1)) & (lengths >= least)]
            if set(piled) <= set(limits):
                break
            limits = sorted({*limits, *piled.tolist()})
        for x in limits:
            k = int(np.searchsorted(lengths, x))
            out.append((unit, x, float(np.clip(1 - usual[k] / counts[k], 0.02, 0.98))))
        # Cuts at a word boundary end anywhere in the last BOUNDARY characters below a limit: look for crowded windows.
        loose = np.where(np.isin(lengths, limits), 0, counts)
        window = within(loose, lengths - BOUNDARY + 1, lengths)
        around = (within(loose, lengths - 6 * BOUNDARY, lengths + 6 * BOUNDARY) - within(loose, lengths - BOUNDARY, lengths + BOUNDARY)) / 10.0
        for k in np.flatnonzero((window >= LEAST_NEAR) & (window > 3 * around + 3 * np.sqrt(around + 1)) & (lengths >= least)):
            p = float(np.clip(1 - around[k] / window[k], 0.02, 0.95))
            low = np.searchsorted(lengths, lengths[k] - BOUNDARY + 1)
            out += [(unit, int(y), p) for y in lengths[low : k + 1][loose[low : k + 1] > 0]]
    frame = pd.DataFrame(out, columns=["unit", "length", "posterior"])
    frame = frame.groupby(["unit", "length"], as_index=False)["posterior"].max()
    frame.insert(0, "source", histogram["source"].iloc[0])
    return frame


def endings(documents: DataFrame) -> DataFrame:
    """Per document the evidence and ``score``, the log odds that the text stops before its author's end.

    ``documents``: ``doc_id, source, text``; null and blank texts have no ending and give no row; a null source is its own group.
    """
    shown = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("length(trim(text)) > 0")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    contexts = ", ".join(f"{c} long" for c in _COLUMNS[7:])
    held = materialize(shown.mapInArrow(_scan, f"doc_id {id_type}, source string, chars long, bytes long, stop boolean, mark boolean, open int, {contexts}"))
    docs = held.where("gram is null").drop("gram", "ends", "mids")
    grams = held.where("gram is not null").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids"))
    histogram = docs.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    histogram = histogram.groupBy("source", "x.unit", "x.length").agg(F.count("*").alias("n"))
    limits = materialize(histogram.groupBy("source").applyInPandas(source_limits, "source string, unit string, length long, posterior double"))
    # Bounded by sources and lengths, not by documents; joined, not broadcast by hand.
    for unit in ("chars", "bytes"):
        mine = limits.where(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.col("posterior").alias(f"at_{unit}"))
        docs = docs.join(mine, ["source", unit], "left")
    docs = docs.withColumn("limit_posterior", F.greatest(F.coalesce("at_chars", F.lit(0.0)), F.coalesce("at_bytes", F.lit(0.0))))
    totals = grams.agg(F.sum(F.col("ends")).alias("e"), F.sum(F.col("ends") + F.col("mids")).alias("t")).first()
    ratio = (totals.t or 1) / max(1, totals.e or 1)
    asked = materialize(
        docs.select("doc_id", "limit_posterior", F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.col(f"g_{o}").alias("gram"), F.col(f"p_{o}").alias("parent")) for o in _ORDERS))).alias("x"))
        .select("doc_id", "limit_posterior", "x.*")
        .where("gram <> 0")
    )
    # Cuts at random places leave a context last in proportion to how often text goes on after it (or, inside a word, after the
    # words before it); the surplus are real ends.
    chance = 2.0 * CUT_SHARE * docs.count() / max(1, (totals.t or 1) / len(_ORDERS))
    finals = asked.groupBy("gram", "order").agg(F.count_if(F.col("limit_posterior") == 0).alias("finals"), F.min("parent").alias("parent"))
    parents = grams.select(F.col("gram").alias("parent"), F.col("mids").alias("goes_on"))
    discounted = F.greatest(F.coalesce("mids", F.lit(0)), F.when(F.col("order") == "one", F.lit((totals.t or 0) // len(_ORDERS))).otherwise(F.coalesce("goes_on", F.lit(0))))
    surplus = F.greatest(F.lit(0.0), F.col("finals") - 1 - discounted * chance).cast("long")
    known = finals.join(grams, "gram", "left").join(parents, "parent", "left")
    known = known.select("gram", (F.coalesce("ends", F.lit(0)) + surplus).alias("ends"), F.coalesce("mids", F.lit(0)).alias("mids"))
    seen = asked.join(known, "gram").groupBy("doc_id").agg(*(F.max(F.when(F.col("order") == o, F.struct("ends", "mids"))).alias(f"s_{o}") for o in _ORDERS))
    docs = docs.join(seen, "doc_id", "left")
    shares = docs.where("limit_posterior = 0").groupBy("source").agg(F.avg((~F.col("stop")).cast("double")).alias("bare"))
    docs = docs.join(shares, "source", "left").withColumn("bare", F.greatest(F.lit(0.03), F.least(F.lit(0.9), F.coalesce("bare", F.lit(0.3)))))

    def llr(s: str):
        ends, mids = F.col(f"{s}.ends"), F.col(f"{s}.mids")
        return F.log((mids + ends + 0.1) / (ratio * (ends + 0.3)))

    enough = lambda s, n: F.coalesce(F.col(f"{s}.ends") + F.col(f"{s}.mids"), F.lit(0)) >= n
    words = F.when(enough("s_line", 2), llr("s_line")).when(enough("s_three", 5), llr("s_three")).when(enough("s_two", 5), llr("s_two")).when(enough("s_one", 3) | (F.col("s_one.ends") > 0), llr("s_one"))
    words = F.when(F.col("g_one") == 0, 0.0).otherwise(F.coalesce(words, F.lit(UNSEEN)))
    # A stop after a context that always goes on (72.|5 %, filter.|py) is no end; elsewhere it nearly always is one.
    stop = F.when(F.col("stop"), F.lit(STOPPED)).when(F.col("mark"), F.when(F.col("limit_posterior") > 0, MARKED_AT_LIMIT).otherwise(F.lit(MARKED))).otherwise(F.log(0.97 / F.col("bare")))
    limit = F.when(F.col("limit_posterior") > 0, F.log(F.col("limit_posterior") / (1 - F.col("limit_posterior")))).otherwise(0.0)
    score = F.when(F.col("open") == 1, OPEN).when(F.col("open") == -1, CLOSED).otherwise(F.lit(PRIOR) + words + stop + limit)
    return docs.select("doc_id", "source", "chars", "bytes", "stop", "mark", "open", "limit_posterior", words.alias("words_llr"), score.alias("score"))


def truncated(documents: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The documents that are cut: rows ``(doc_id, source, score)``."""
    return endings(documents).where(F.col("score") > least_score).select("doc_id", "source", "score")


def truncation_rates(documents: DataFrame, least_score: float = 0.0) -> DataFrame:
    """Per source the number of judged documents, of cut ones, and their share."""
    cut = (F.col("score") > least_score).cast("long")
    return endings(documents).groupBy("source").agg(F.count("*").alias("documents"), F.sum(cut).alias("cut"), F.avg(cut.cast("double")).alias("share"))
