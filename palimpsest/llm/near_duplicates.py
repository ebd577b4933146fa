"""Near-duplicate records with small edits: an exact set join by universe partition and the pigeonhole principle.

Texts are sets of word shingles. Two sets of sizes l and s whose Jaccard similarity is at least t differ in at most
H = (1 - t) / (1 + t) * (l + s) elements. Sets fall into size bands; each band hashes the universe of shingles into m segments, so a
set becomes m segment subsets. A pair that is near enough must, for any split of H + 1 units over the segments into 0, 1 or 2 each,
agree exactly on a segment with 1 unit or more, or differ there by one element if it has 2. Every set is indexed by its subsets and
their one-deletion neighbourhoods; the probing side chooses its units by dynamic programming so that they fall on rare subsets
(cost-based allocation). Costs come from a table of fixed size fitted on a bounded sample; they steer work and never the result.

Signatures travel packed: a task sends each reducer one block per chunk of sets, with every set's size and 256-bit parity sketch once
and six bytes a signature. The reducer sorts, matches, drops pairs whose sizes or sketches prove them too far apart, and sends on
the few that are left; those are verified exactly on their words. Frequent signatures are salted over several reducers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.runtime import discard, materialize, partitions

#: Ratio between the largest and the smallest set of a size band.
BAND = 2.0
#: Segments per element of the band's largest set.
SEGMENTS = 0.5
#: Sets on which signature costs are fitted, and cells of the cost table.
COST_SAMPLE = 20_000
COST_CELLS = 1 << 20
#: Sets of the sample from which the number of probes is estimated (it sets the number of reducers only).
PROBE_SAMPLE = 2_000
#: What a signature costs to send, in candidate pairs.
ENTRY_COST = 0.3
#: Expected entries of one signature beyond which it is salted, and signatures per reducer.
SALT_AT = 1_000_000
ENTRIES_PER_REDUCER = 6_000_000
#: Pairs expanded at a time in a reducer, and sets in a packed block.
SLICE = 2_000_000
CHUNK = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * _A
        x ^= x >> np.uint64(32)
        x = x * _B
        return x ^ (x >> np.uint64(29))


class _Codes(dict):
    """A 64-bit code of every word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self[word] = code = (zlib.crc32(raw) << 32) | zlib.crc32(raw, 0x5BD1E995)
        return code


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the distinct shingles of each text of blank-separated words, and the offsets of the texts."""
    code_of, flat, lengths = _Codes().__getitem__, [], []
    for t in texts:
        w = t.split(" ")
        lengths.append(len(w))
        flat.extend(map(code_of, w))
    words, lengths = np.array(flat, np.uint64), np.array(lengths, np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            code = _mix(code + words[k : k + n], k + 1)
    inside = np.arange(n) + width <= ends[owner[:n]]
    code, owner = code[inside], owner[:n][inside]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, bool)
    code, owner = code[fresh], owner[fresh]
    return code, np.searchsorted(owner, np.arange(len(texts) + 1))


class Plan:
    """Bands, segment counts and difference bounds for one similarity threshold."""

    def __init__(self, least: float):
        if not 0 < least <= 1:
            raise ValueError("the similarity threshold lies in (0, 1]")
        self.least, self.gap = least, (1 - least) / (1 + least)

    def band(self, size):
        return np.floor(np.log(np.maximum(size, 1)) / math.log(BAND) + 1e-9).astype(np.int64)

    def low(self, band: int) -> int:
        return next(s for s in range(max(1, int(BAND**band) - 1), int(BAND**band) + 3) if self.band(np.array([s]))[0] >= band)

    def high(self, band: int) -> int:
        return max(1, self.low(band + 1) - 1)

    def segments(self, band: int) -> int:
        high = self.high(band)
        most = int(self.gap * (high / self.least + high) + 1e-9)
        return max(1, (most + 2) // 2, round(SEGMENTS * high))

    def units(self, size: np.ndarray, band: int) -> np.ndarray:
        """Units that a probing set of ``size`` must spread over the segments of ``band``: the most differences, and one."""
        return (self.gap * (size + np.minimum(size, self.high(band))) + 1e-9).astype(np.int64) + 1

    def probed(self, size: int) -> range:
        smallest = max(1, math.ceil(self.least * size - 1e-9))
        return range(int(self.band(np.array([smallest]))[0]), int(self.band(np.array([size]))[0]) + 1)


def _subsets(codes: np.ndarray, owner: np.ndarray, n: int, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``n`` sets: a sum code per segment (n x m), each element's cell in it, and the code of its segment without it."""
    segment = (_mix(codes, 3) >> np.uint64(33)).astype(np.int64) % m
    value = _mix(codes, 5)
    cell = owner * m + segment
    total = np.zeros(n * m, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, cell, value)
        without = total[cell] - value
    return total.reshape(n, m), cell, without


def _signature(code: np.ndarray, segment: np.ndarray, band: int, space: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(code + segment.astype(np.uint64) * _B, 1000 + 2 * band + space)


def _allocate(one: np.ndarray, two: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Cheapest 0, 1 or 2 units per segment with ``units`` in all, by dynamic programming over the segments, for all rows at once."""
    n, m = one.shape
    most = int(units.max())
    best = np.full((n, most + 1), np.inf, np.float32)
    best[:, 0] = 0
    choice = np.zeros((m, n, most + 1), np.int8)
    for j in range(m):
        with_one = np.full_like(best, np.inf)
        with_two = np.full_like(best, np.inf)
        with_one[:, 1:] = best[:, :-1] + one[:, j, None]
        if most > 1:
            with_two[:, 2:] = best[:, :-2] + two[:, j, None]
        pick = np.where(with_one < best, 1, 0).astype(np.int8)
        best = np.minimum(best, with_one)
        pick[with_two < best] = 2
        best = np.minimum(best, with_two)
        choice[j] = pick
    out, rows, left = np.zeros((n, m), np.int8), np.arange(n), units.copy()
    for j in range(m - 1, -1, -1):
        out[:, j] = choice[j][rows, left]
        left -= out[:, j]
    return out


def _sketch(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """256 parities per set: the sketch of a symmetric difference is the exclusive or of the sketches."""
    bit = (_mix(codes, 9) >> np.uint64(40)).astype(np.int64) & 255
    odd = np.bincount(owner * 256 + bit, minlength=n * 256).reshape(n, 256) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


class Costs:
    """Expected number of entries of a signature, read from a table of fixed size."""

    def __init__(self, table: np.ndarray, scale: float):
        self.table, self.scale = table, scale

    def of(self, signature: np.ndarray) -> np.ndarray:
        return self.table[(signature & np.uint64(COST_CELLS - 1)).astype(np.int64)]


def _by_band(plan: Plan, codes: np.ndarray, offsets: np.ndarray, probing: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, rows, codes, owner among rows): the band of each set, or every band that it probes."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mine = plan.band(sizes)
    if probing:
        kinds = {s: plan.probed(int(s)) for s in np.unique(sizes[sizes > 0])}
        first, last = np.array([kinds[s][0] if s else 1 for s in sizes]), np.array([kinds[s][-1] if s else 0 for s in sizes])
    else:
        first, last = mine, np.where(sizes > 0, mine, -1)
    if not len(sizes):
        return
    for band in range(int(first.min()), int(last.max()) + 1):
        member = (first <= band) & (band <= last) & (sizes > 0)
        rows = np.flatnonzero(member)
        if len(rows):
            number = np.cumsum(member) - 1
            inside = member[owner]
            yield band, rows, codes[inside], number[owner[inside]]


def _index_entries(plan: Plan, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures under which sets are found, and the row of each."""
    signatures, rows_out = [], []
    for band, rows, part, owner in _by_band(plan, codes, offsets, False):
        m = plan.segments(band)
        total, cell, without = _subsets(part, owner, len(rows), band, m)
        signatures += [_signature(total.ravel(), np.tile(np.arange(m), len(rows)), band, 0), _signature(without, cell % m, band, 1)]
        rows_out += [np.repeat(rows, m), rows[owner]]
    return np.concatenate(signatures or [np.zeros(0, np.uint64)]), np.concatenate(rows_out or [np.zeros(0, np.int64)])


def _probe_entries(plan: Plan, codes: np.ndarray, offsets: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that sets look up, after allocation, and the row of each."""
    sizes = np.diff(offsets)
    signatures, rows_out = [], []
    for band, rows, part, owner in _by_band(plan, codes, offsets, True):
        m = plan.segments(band)
        n = len(rows)
        total, cell, without = _subsets(part, owner, n, band, m)
        segment = np.tile(np.arange(m), n)
        whole, thinner, dropped = _signature(total.ravel(), segment, band, 0), _signature(total.ravel(), segment, band, 1), _signature(without, cell % m, band, 0)
        one = costs.of(whole) + np.float32(ENTRY_COST)
        two = one + costs.of(thinner) + np.float32(ENTRY_COST) + np.bincount(cell, weights=costs.of(dropped) + ENTRY_COST, minlength=n * m).astype(np.float32)
        units = plan.units(sizes[rows], band)
        given = np.zeros(n * m, np.int8)
        step = max(1, 30_000_000 // (m * (int(units.max()) + 1)))
        for a in range(0, n, step):
            given[a * m : (a + step) * m] = _allocate(one.reshape(n, m)[a : a + step], two.reshape(n, m)[a : a + step], units[a : a + step]).ravel()
        used, double = given > 0, given == 2
        signatures += [whole[used], thinner[double], dropped[double[cell]]]
        rows_out += [np.repeat(rows, m)[used], np.repeat(rows, m)[double], rows[owner][double[cell]]]
    return np.concatenate(signatures or [np.zeros(0, np.uint64)]), np.concatenate(rows_out or [np.zeros(0, np.int64)])


def _spread(signatures: np.ndarray, rows: np.ndarray, ids: np.ndarray, costs: Costs, reducers: int, probing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reducer, 24 bits of the signature, row); within a reducer chance matches are few and the sketches drop them. A frequent signature has several shares: an entry goes to one of them, a probe to all."""
    shares = 1 + (costs.of(signatures) * costs.scale / SALT_AT).astype(np.int64)
    if probing:
        again = np.repeat(np.arange(len(signatures)), shares)
        share = np.arange(len(again)) - np.repeat(np.cumsum(shares) - shares, shares)
        signatures, rows = signatures[again], rows[again]
    else:
        share = (_mix(ids[rows].view(np.uint64), 11) >> np.uint64(1)).astype(np.int64) % shares
    place = _mix(signatures + share.astype(np.uint64), 13)
    return (place >> np.uint64(33)).astype(np.int64) % reducers, ((signatures >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.uint32), rows


def _block(ids, sizes, sketch, signature, rows, probe_signature, probe_rows) -> bytes:
    """Entries stand in the order of their sets, so a count per set says whose they are."""
    mine, asks = np.bincount(rows, minlength=len(ids)), np.bincount(probe_rows, minlength=len(ids))
    used = (mine > 0) | (asks > 0)
    wide = 1 if max(mine.max(), asks.max()) < 256 else 4
    counts = [x[used].astype(np.uint8 if wide == 1 else np.uint32) for x in (mine, asks)]
    halves = lambda x: [(x >> np.uint32(8)).astype(np.uint16), x.astype(np.uint8)]
    parts = [ids[used], sizes[used].astype(np.int32), sketch[used], *counts, *halves(signature), *halves(probe_signature)]
    return np.array([int(used.sum()), len(rows), len(probe_rows), wide], np.int64).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unblock(raw: bytes) -> list[np.ndarray]:
    """(ids, sizes, sketches, entry signatures, their sets, probe signatures, their sets)"""
    n, e, p, wide = np.frombuffer(raw, np.int64, 4)
    count = np.uint8 if wide == 1 else np.uint32
    out, at = [], 32
    for kind, size in ((np.int64, n), (np.int32, n), (np.uint64, 4 * n), (count, n), (count, n), (np.uint16, e), (np.uint8, e), (np.uint16, p), (np.uint8, p)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    join = lambda high, low: (high.astype(np.uint32) << np.uint32(8)) | low
    return [*out[:3], join(out[5], out[6]), np.repeat(np.arange(n), out[3]), join(out[7], out[8]), np.repeat(np.arange(n), out[4])]


def _sender(plan: Plan, width: int, costs: Costs, reducers: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []

        def blocks():
            codes, offsets = shingle_sets(texts, width)
            number, sizes = np.array(ids, np.int64), np.diff(offsets)
            sketch = _sketch(codes, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            index = _spread(*_index_entries(plan, codes, offsets), number, costs, reducers, False)
            probe = _spread(*_probe_entries(plan, codes, offsets, costs), number, costs, reducers, True)
            for r, b in _blocks(number, sizes, sketch, index, probe):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.binary())], ["reducer", "block"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            if len(ids) >= CHUNK:
                yield from blocks()
                ids, texts = [], []
        if ids:
            yield from blocks()

    return send


def _blocks(ids, sizes, sketch, index, probe) -> Iterator[tuple[int, bytes]]:
    """(reducer, block) for each reducer that gets anything: entries are sorted (by radix) by reducer and set."""
    small = lambda w: w.astype(np.uint16) if not len(w) or w.max() < 65_536 else w

    def grouped(entries):
        order = np.argsort(small(entries[2]), kind="stable")
        order = order[np.argsort(small(entries[0][order]), kind="stable")]
        return [x[order] for x in entries]

    index, probe = grouped(index), grouped(probe)
    for r in np.union1d(index[0], probe[0]):
        a, b = np.searchsorted(index[0], [r, r + 1])
        c, d = np.searchsorted(probe[0], [r, r + 1])
        yield int(r), _block(ids, sizes, sketch, index[1][a:b], index[2][a:b], probe[1][c:d], probe[2][c:d])


def _matcher(plan: Plan):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unblock(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not blocks:
            return
        base = np.cumsum([0, *(len(b[0]) for b in blocks)])
        ids, sizes, sketch = (np.concatenate([b[k] for b in blocks]) for k in (0, 1, 2))
        sketch = sketch.reshape(-1, 4)
        entry, probe = np.concatenate([b[3] for b in blocks]), np.concatenate([b[5] for b in blocks])
        entry_row = np.concatenate([b[4] + base[k] for k, b in enumerate(blocks)]).astype(np.int32)
        probe_row = np.concatenate([b[6] + base[k] for k, b in enumerate(blocks)]).astype(np.int32)
        del blocks
        order = np.argsort(entry)
        entry, entry_row = entry[order], entry_row[order]
        order = np.argsort(probe)
        probe, probe_row = probe[order], probe_row[order]
        first, counts = np.searchsorted(entry, probe), np.searchsorted(entry, probe, side="right")
        counts -= first
        kept = counts > 0
        first, counts, probe_row = first[kept], counts[kept], probe_row[kept]
        # One probe's hits are cut too, so a slice never grows with the frequency of a signature.
        ends, at, skipped = np.cumsum(counts), 0, 0
        found = np.zeros(0, np.uint64)
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, SLICE):
            high = min(total, low + SLICE)
            a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1
            starts = ends[a:b] - counts[a:b]
            begin, stop = np.maximum(starts, low), np.minimum(ends[a:b], high)
            many = stop - begin
            left = np.repeat(probe_row[a:b], many)
            inner = np.arange(high - low) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin - starts, many)
            right = entry_row[np.repeat(first[a:b], many) + inner]
            big, small = sizes[left], sizes[right]
            good = (small < big) | ((small == big) & (ids[right] < ids[left]))
            good &= small >= plan.least * big - 1e-9
            left, right, limit = left[good], right[good], plan.gap * (big[good] + small[good]) + 1e-9
            apart = np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1, dtype=np.int64)
            near = apart <= limit
            found = np.union1d(found, (left[near].astype(np.uint64) << np.uint64(32)) | right[near].astype(np.uint64))
            if len(found) >= SLICE:
                yield _pairs(ids, found)
                found = np.zeros(0, np.uint64)
        if len(found):
            yield _pairs(ids, found)

    return match


def _pairs(ids: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    x, y = ids[(found >> np.uint64(32)).astype(np.int64)], ids[(found & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _verifier(width: int, least: float):
    def shingles(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[k:] for k in range(width))))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for x, y in zip(batch["words_a"], batch["words_b"]):
                s, t = shingles(x), shingles(y)
                both = len(s & t)
                scores.append(both / (len(s) + len(t) - both))
            batch = batch[["a", "b"]].assign(similarity=scores)
            yield batch[batch["similarity"] >= least - 1e-12]

    return verify


def representatives(records: DataFrame, key: str, text: str, least_words: int) -> tuple[DataFrame, DataFrame]:
    """``(members, texts)``, both written: rows ``(id, gid)`` of the records with enough words, and one ``(gid, words)`` per distinct wording.

    Words are the runs of ``[a-z0-9]`` in the lower-cased text; ``gid`` is a 64-bit hash of the words. A repeated key counts once.
    """
    kind = records.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[a-z0-9]+").findall
        for batch in batches:
            found = [words(t.lower()) for t in batch.column(1).to_pylist()]
            kept = [k for k, w in enumerate(found) if len(w) >= least_words]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([" ".join(found[k]) for k in kept], pa.string())], ["id", "words"])

    shown = records.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    stored = materialize(shown.mapInArrow(read, f"id {kind}, words string").withColumn("gid", F.xxhash64("words")))
    members = materialize(stored.select("id", "gid").distinct())
    # Copies of a wording are folded before the shuffle, so a hot wording travels once per task.
    texts = materialize(stored.groupBy("gid").agg(F.first("words").alias("words")))
    discard(stored)
    return members, texts


def similar_texts(texts: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows ``(a, b, similarity)``, ``a < b``, for all pairs of ``(gid, words)`` whose shingle sets have Jaccard >= ``least``.

    Exact: no pair is lost, whatever the sizes, ties or frequencies. Texts with fewer words than a shingle have an empty set and
    are in no pair.
    """
    return _similar(materialize(texts.where(F.length("words") - F.length(F.replace("words", F.lit(" "))) >= shingle - 1)), shingle, least)


def _similar(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """:func:`similar_texts` of a written table whose texts have the words of a shingle at least."""
    spark = texts.sparkSession
    plan = Plan(least)
    number = texts.count()
    if number < 2:
        return spark.createDataFrame([], "a long, b long, similarity double")
    every = max(1, number // COST_SAMPLE)
    sample = [r.words for r in texts.where(F.pmod(F.xxhash64("gid", F.lit(5)), F.lit(every)) == 0).select("words").limit(2 * COST_SAMPLE).toLocalIterator()]
    cells = np.zeros(COST_CELLS, np.float32)
    codes, offsets = shingle_sets(sample, shingle)
    signatures, _ = _index_entries(plan, codes, offsets)
    np.add.at(cells, (signatures & np.uint64(COST_CELLS - 1)).astype(np.int64), np.float32(1))
    costs = Costs(cells, number / max(1, len(sample)))
    # Signatures that a set sends, to the index (as in the sample) and as probes (as in its first sets), times the sets: what the
    # reducers share.
    some = min(len(sample), PROBE_SAMPLE)
    probes = len(_probe_entries(plan, codes[: offsets[some]], offsets[: some + 1], costs)[0])
    entries = int(number * (len(signatures) / max(1, len(sample)) + probes / max(1, some))) + 1
    reducers = max(min(partitions(spark), 6), -(-entries // ENTRIES_PER_REDUCER))
    blocks = texts.select("gid", "words").mapInArrow(_sender(plan, shingle, costs, reducers), "reducer int, block binary")
    near = blocks.repartitionById(reducers, F.col("reducer")).mapInArrow(_matcher(plan), "a long, b long").distinct()
    near = materialize(near)
    # Only the texts in a surviving pair are moved for the exact check.
    involved = near.select(F.col("a").alias("gid")).union(near.select("b")).distinct()
    asked = materialize(texts.join(involved, "gid", "left_semi"))
    one = asked.select(F.col("gid").alias("a"), F.col("words").alias("words_a"))
    two = asked.select(F.col("gid").alias("b"), F.col("words").alias("words_b"))
    return near.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInPandas(_verifier(shingle, least), "a long, b long, similarity double")


def similar_ids(records: DataFrame, key: str, text: str, shingle: int = 5, least: float = 0.8, least_words: int = 1) -> DataFrame:
    """All pairs ``(id_a, id_b)`` of different records that are near duplicates, ``id_a < id_b``; copies are expanded into pairs.

    Null texts and texts under ``least_words`` words are out.
    """
    members, texts = representatives(records, key, text, max(least_words, shingle))
    links = _similar(texts, shingle, least).select("a", "b")
    alike = members.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    left, right = members.select(F.col("id").alias("x"), F.col("gid").alias("a")), members.select(F.col("id").alias("y"), F.col("gid").alias("b"))
    pairs = links.union(alike).join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(records: DataFrame, key: str, text: str, shingle: int = 5, least: float = 0.8, least_words: int = 1) -> DataFrame:
    """One row ``(id, group, links)`` per record with enough words: the smallest wording number of its connected group, and the
    number of other wordings that it is linked to. Copies share a group."""
    members, texts = representatives(records, key, text, max(least_words, shingle))
    links = materialize(_similar(texts, shingle, least).select("a", "b"))
    component = connected_components(links, "a", "b")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    return (
        members.join(component.join(degree, "node"), members.gid == F.col("node"), "left")
        .select("id", F.coalesce("component", "gid").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )
