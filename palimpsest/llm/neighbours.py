"""Most similar vectors for every vector: a hash-prefix forest.

A tree is an array of vectors sorted by a long hash string, one sign per random hyperplane. A vector descends to the rows that share
the longest prefix with it, a length that differs from vector to vector, and then ascends: at each prefix length, from long to short,
all trees at once offer the rows that share so much with it, until ``candidates`` rows are met. At the last length only the rows
nearest to the vector's place are taken, so that a prefix which many rows share costs no more than any other.

Trees are planted in groves. The trees of a grove begin with the same string, the trunk; the array sorted by trunk is cut into stretches
of equal size (cut points are quantiles of all codes), a stretch is one task, and its trees, descents and ascents live in that task's
memory. A vector moves once per grove, whatever the number of trees, as 24-bit fractions of its largest element (similarities keep an
error of about 1e-7). An eighth of either neighbour stretch stands at a stretch's ends, to answer there and ask in its own. Pairs that a
trunk separates meet in another grove: ``groves_for`` says how many that takes as the collection grows. A trunk code that holds more rows
than a stretch is dealt over the stretches it spans.

Vectors are known by a hash of their content: copies count once in a stretch, and the answers are expanded to all copies at the end
from a table of ids that holds no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

#: Fewest groves, which are also planted at a time; trees of a grove; signs of a trunk and of a tree's hash.
GROVES, TREES, BITS = 3, 16, 62
#: Chance that a pair of similarity ``NEAR`` (or ``least``, if that is more) shares a stretch in some grove.
MEET, NEAR = 0.86, 0.85
#: Rows a vector is compared with in a grove (twice as many at most), over all its trees: for the ``k`` nearest whatever their
#: similarity, and for pairs of at least ``NEAR``, which share longer prefixes.
CANDIDATES, CLOSE_CANDIDATES = 10_000, 600
#: Vectors of a stretch, and the parts in which it is cut, of which the outer ones also go to the neighbour.
ROWS_PER_STRETCH, PARTS = 65_536, 8
BLOCK = 128


def groves_for(rows: int, least: float = -1.0) -> int:
    """Groves with which a pair of similarity ``NEAR`` or ``least`` shares a stretch with chance ``MEET``: a trunk tells apart
    log2(rows / stretch) signs, each of which agrees with chance 1 - angle / pi."""
    signs = max(0.0, math.log2(max(rows, 1) / ROWS_PER_STRETCH))
    one = (1 - math.acos(min(1.0, max(NEAR, least))) / math.pi) ** signs
    return GROVES if one >= 1 else max(GROVES, math.ceil(math.log(1 - MEET) / math.log(1 - one)))


def usable(vectors: DataFrame) -> DataFrame:
    """One row per ``vec_id`` whose vector is not null, has ``dimensions`` elements, all finite, not all zero."""
    good = (
        F.col("vector").isNotNull()
        & (F.size("vector") == F.col("dimensions"))
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return vectors.where(good).select("vec_id", "model", "vector")


def planes(grove: int, tree: int, dimensions: int, seed: int = 17) -> np.ndarray:
    """Orthogonal blocks of random directions, the same on every executor; tree -1 is the grove's trunk."""
    rng = np.random.default_rng([seed, grove, tree + 1, dimensions])
    blocks = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-BITS // dimensions))]
    return np.concatenate(blocks, axis=1)[:, :BITS].astype(np.float32)


def hashed(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The signs of a projection as one number, first sign highest."""
    signs = np.zeros((len(x), 64), np.uint8)
    signs[:, 64 - BITS :] = x @ directions >= 0
    return np.packbits(signs, axis=1).view(">u8").ravel().astype(np.int64)


def _unit(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch of packed float32 vectors, by dimension."""
    packed = batch.column(column)
    sizes = np.diff(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1])
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed)]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.stack([data[a : a + size] for a in start[rows]]).view(np.float32)


def _scaled(batch: pa.RecordBatch) -> list[bytes]:
    """Unit vectors as packed float32; scaled copies of a vector become equal where rounding allows."""
    vectors = batch.column("vector")
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        v = flat[a:b].astype(np.float64)
        v /= np.abs(v).max()  # far from overflow before the norm
        out.append((v / np.sqrt(v @ v)).astype(np.float32).tobytes())
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("model"), pa.array(_scaled(batch), pa.binary())], ["vec_id", "model", "unit"])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with the content hash of their vector, without the vector."""
    for batch in batches:
        names = [_copy(m, u) for m, u in zip(batch.column("model").to_pylist(), _scaled(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.int64())], ["vec_id", "copy"])


def _copy(model: str, unit: bytes) -> int:
    return xxhash.xxh64_intdigest(unit, seed=xxhash.xxh32_intdigest(model)) - (1 << 63)


def shortened(x: np.ndarray) -> list[bytes]:
    """Vectors as 24-bit fractions of their largest element."""
    whole = np.rint(x * (8_388_607 / np.abs(x).max(axis=1, keepdims=True).astype(np.float64))).astype("<i4")
    return [v.tobytes() for v in whole.view(np.uint8).reshape(*x.shape, 4)[:, :, :3]]


def lengthened(packed: list[bytes]) -> np.ndarray:
    """Unit vectors of what ``shortened`` gave, all of one dimension."""
    parts = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1, 3)
    whole = np.zeros((*parts.shape[:2], 4), np.uint8)
    whole[:, :, 1:] = parts  # the upper three bytes, so that the sign stands where it belongs
    x = (whole.view("<i4")[:, :, 0] >> 8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batch: pa.RecordBatch):
    """The distinct vectors of a batch: content hashes, models, and (rows, vectors) by dimension."""
    units, models = _scaled(batch), batch.column("model").to_pylist()
    names = np.array([_copy(m, u) for m, u in zip(models, units)], np.int64)
    _, first = np.unique(names, return_index=True)
    some = pa.RecordBatch.from_arrays([pa.array([units[k] for k in first], pa.binary())], ["unit"])
    return names[first], np.array([models[k] for k in first], object), list(_unit(some, "unit"))


def _trunks(groves: range, seed: int):
    """Rows ``(grove, model, code)`` for every vector and grove."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, models, units = _coded(batch)
            for grove in groves:
                for rows, x in units:
                    code = hashed(x, planes(grove, -1, x.shape[1], seed))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), grove, np.int32)), pa.array(models[rows], pa.string()), pa.array(code)], ["grove", "model", "code"])

    return place


def _stretches(good: DataFrame, rows: int, groves: range, seed: int) -> tuple[int, dict]:
    """The number of stretches; per grove and model the number of its first and the codes at which their parts begin.

    One number for every part of a stretch reaches the driver.
    """
    fine = PARTS * -(-rows // ROWS_PER_STRETCH)
    spots = F.percentile_approx("code", [k / fine for k in range(1, fine)], max(10_000, 20 * fine))
    count, out = 0, {}
    for r in good.mapInArrow(_trunks(groves, seed), "grove int, model string, code long").groupBy("grove", "model").agg(F.count("*").alias("n"), spots.alias("spots")).collect():
        own = PARTS * -(-r.n // ROWS_PER_STRETCH)
        out[r.grove, r.model] = (count, own // PARTS, np.array([r.spots[round(k * fine / own) - 1] for k in range(1, own)], np.int64))
        count += own // PARTS
    return count, out


def _parts(code: np.ndarray, names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The part of each row; rows of a code that spans several parts are dealt over them."""
    low, high = np.searchsorted(starts, code, "left"), np.searchsorted(starts, code, "right")
    return np.where(high - low > 1, low + 1 + names.astype(np.uint64) % np.maximum(high - low, 1).astype(np.uint64), high).astype(np.int64)


def _plant(groves: range, seed: int, stretches: dict):
    """Rows for every grove: the vector in 24 bits an element with its stretch; ``own`` is false in stretches beside its own."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, models, units = _coded(batch)
            for rows, x in units:
                packed = pa.array(shortened(x), pa.binary())
                for grove in groves:
                    code = hashed(x, planes(grove, -1, x.shape[1], seed))
                    for model in dict.fromkeys(models[rows]):
                        mine = np.flatnonzero(models[rows] == model)
                        first, count, starts = stretches[grove, model]
                        part = _parts(code[mine], names[rows[mine]], starts)
                        home = part // PARTS
                        for to, there in ((home, part >= 0), (home - 1, (part % PARTS == 0) & (home > 0)), (home + 1, (part % PARTS == PARTS - 1) & (home < count - 1))):
                            some = np.flatnonzero(there)
                            if len(some):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(some), grove, np.int32)), pa.array((first + to[some]).astype(np.int32)), pa.array(to[some] == home[some]), pa.array(names[rows[mine[some]]]), packed.take(pa.array(mine[some]))],
                                    ["grove", "stretch", "own", "copy", "unit"],
                                )

    return plant


def _runs(shared: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array with the prefix lengths that neighbours share: first row and end of the run of each row at a prefix length."""
    cuts = np.concatenate([[0], np.flatnonzero(shared < level) + 1, [len(shared) + 1]])
    sizes = np.diff(cuts)
    return np.repeat(cuts[:-1], sizes), np.repeat(cuts[1:], sizes)


def ascend(codes: list[np.ndarray], candidates: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For trees given as hashes of the same rows: each tree's order of rows, and per tree and row (by row number) the places from
    which and up to which it is compared.

    From the longest prefix to none, all trees together, until a row has met ``candidates`` others. The runs one length before the
    last are taken whole; of the last, so many rows on either side as its share of what was missing.
    """
    n, trees = len(codes[0]), len(codes)
    orders = [np.argsort(c, kind="stable") for c in codes]
    places, shared = [], []
    for c, order in zip(codes, orders):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        places.append(place)
        differ = (c[order][1:] ^ c[order][:-1]).astype(np.uint64)
        # The highest differing sign; values stay exact below 2**53 after the shift.
        length = np.where(differ == 0, BITS, BITS - 1 - np.where(differ >> np.uint64(32) > 0, 32 + np.log2(np.maximum(differ >> np.uint64(32), 1).astype(float)).astype(np.int64), np.log2(np.maximum(differ & np.uint64(0xFFFFFFFF), 1).astype(float)).astype(np.int64)))
        shared.append(length)
    low, high = np.tile(np.stack(places), 1), np.stack(places) + 1  # before the ascent a row is alone
    met, open_rows = np.zeros(n, np.int64), np.ones(n, bool)
    for level in range(max((int(s.max()) for s in shared if len(s)), default=0), -1, -1):
        now_low, now_high = np.empty_like(low), np.empty_like(high)
        for t in range(trees):
            a, b = _runs(shared[t], level)
            now_low[t], now_high[t] = a[places[t]], b[places[t]]
        total = (now_high - now_low - 1).sum(axis=0)
        ready = open_rows & ((total >= candidates) | (level == 0))
        if ready.any():
            more = -(-(candidates - met[ready]) // trees)
            low[:, ready] = np.maximum(now_low[:, ready], low[:, ready] - more)
            high[:, ready] = np.minimum(now_high[:, ready], high[:, ready] + more)
            open_rows &= ~ready
        low[:, open_rows], high[:, open_rows], met[open_rows] = now_low[:, open_rows], now_high[:, open_rows], total[open_rows]
        if not open_rows.any():
            break
    return orders, low, high


def _compared(x: np.ndarray, asking: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers: of the rows a tree offers to each asking row, those that can be among its best ``k`` and reach ``least``."""
    turned, asks, found = x[order], [], []
    low, high, asking = low[order], high[order], asking[order]
    for a in range(0, len(order), BLOCK):
        rows = a + np.flatnonzero(asking[a : a + BLOCK])
        if not len(rows):
            continue
        first, end = low[rows].min(), high[rows].max()
        scores = turned[rows] @ turned[first:end].T
        if least > -1:
            r, c = np.nonzero(scores >= least - 1e-4)
        else:
            column = np.arange(first, end)
            scores[(column < low[rows, None]) | (column >= high[rows, None]) | (column == rows[:, None])] = -2.0
            c = np.argpartition(-scores, k, axis=1)[:, :k].ravel() if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), len(rows))
            r = np.repeat(np.arange(len(rows)), min(k, scores.shape[1]))
        at = first + c
        good = (at >= low[rows[r]]) & (at < high[rows[r]]) & (at != rows[r])
        asks.append(order[rows[r[good]]])
        found.append(order[at[good]])
    return np.concatenate(asks or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def search(x: np.ndarray, names: np.ndarray, asking: np.ndarray, grove: int, k: int, least: float, candidates: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` others of each asking row that the trees of a grove offer: names asking, names found, similarities."""
    orders, low, high = ascend([hashed(x, planes(grove, t, x.shape[1], seed)) for t in range(trees)], candidates)
    pairs = [_compared(x, asking, orders[t], low[t], high[t], k, least) for t in range(trees)]
    r, c = np.divmod(np.unique(np.concatenate([a * len(x) + b for a, b in pairs])), len(x))
    scores = np.empty(len(r))
    for a in range(0, len(r), 1 << 16):
        b = a + (1 << 16)
        scores[a:b] = np.einsum("ij,ij->i", x[r[a:b]].astype(np.float64), x[c[a:b]].astype(np.float64))
    scores = np.round(np.clip(scores, -1, 1), 9)
    good = scores >= least
    r, c, scores = r[good], c[good], scores[good]
    order = np.lexsort((names[c], -scores, r))
    r, c, scores = r[order], c[order], scores[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return names[r[best]], names[c[best]], scores[best]


def _climb(k: int, least: float, candidates: int, trees: int, seed: int):
    """Search each stretch of a partition."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a stretch and what stands at its ends
        if not held:
            return
        rows = pa.Table.from_batches(held)
        stretch, copies, own = rows["stretch"].to_numpy(), rows["copy"].to_numpy(), rows["own"].to_numpy()
        for s in np.unique(stretch):
            here = np.flatnonzero(stretch == s)
            order = here[np.lexsort((~own[here], copies[here]))]
            order = order[np.concatenate([[True], np.diff(copies[order]) != 0])]
            x = lengthened(rows["unit"].take(pa.array(order)).to_pylist())
            a, b, score = search(x, copies[order], own[order], int(rows["grove"][int(order[0])].as_py()), k, least, candidates, trees, seed)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["asks", "found", "similarity"])

    return climb


def _offers(good: DataFrame, rows: int, groves: range, k: int, least: float, candidates: int, trees: int, seed: int) -> DataFrame:
    """Rows ``(asks, found, similarity)``: the best ``k`` of what each of the groves offers every distinct vector."""
    count, stretches = _stretches(good, rows, groves, seed)
    forest = good.mapInArrow(_plant(groves, seed, stretches), "grove int, stretch int, own boolean, copy long, unit binary")
    return forest.repartitionById(max(1, count), F.col("stretch")).mapInArrow(_climb(k, least, candidates, trees, seed), "asks long, found long, similarity double")


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, groves: int | None = None, candidates: int = CANDIDATES, trees: int = TREES, seed: int = 17) -> DataFrame:
    """Rows ``(vec_id, other, similarity, place)``: for every usable vector its ``k`` most similar ones of the same model.

    ``place`` counts from 1; equal similarity goes to the smaller ``vec_id``. ``least`` leaves out less similar ones. Unusable vectors
    (null, wrong length, NaN or infinite elements, all zero) neither ask nor answer; a repeated ``vec_id`` counts once; a model with one
    vector gives nothing. Which neighbours are found is subject to the forest's recall (see the README), which rises with ``groves``
    (from ``groves_for``, if not given), ``trees`` and ``candidates``.
    """
    good = usable(vectors)
    # Ids without vectors: the first k + 1 of each group of copies, and all members.
    named = materialize(good.mapInArrow(_name, "vec_id long, copy long").distinct())
    heads = named.withColumn("n", F.row_number().over(Window.partitionBy("copy").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    rows = named.count()
    groves = groves or groves_for(rows, least)
    groups = [range(g, min(g + GROVES, groves)) for g in range(0, groves, GROVES)]
    offers = (_offers(good, rows, group, k, least, candidates, trees, seed) for group in groups)
    # Several groups are written one by one, so that each group's vectors are moved and done with before the next.
    offered = next(offers) if len(groups) == 1 else reduce(DataFrame.union, map(materialize, offers))
    merged = offered.groupBy("asks", "found").agg(F.max("similarity").alias("similarity"))
    near = merged.join(heads.where("n = 1").select(F.col("copy").alias("found"), F.col("vec_id").alias("first")), "found")
    listed = F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("similarity"), "first"))
    near = materialize(near.withColumn("place", listed).where(F.col("place") <= k).select("asks", "found", "similarity"))
    # Each group's answer: the heads of the groups it found and its own; at most (k + 1) squared rows.
    own = heads.join(heads.where("n = 2").select("copy"), "copy", "left_semi").select(F.col("copy").alias("asks"), F.col("vec_id").alias("other"), F.lit(1.0).alias("similarity"))
    outer = near.join(heads.select(F.col("copy").alias("found"), F.col("vec_id").alias("other")), "found").select("asks", "other", "similarity")
    pool = outer.union(own).withColumn("p", F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("similarity"), "other"))).where(F.col("p") <= k + 1)
    mine = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other")
    answers = named.join(pool, named.copy == pool.asks).where("vec_id <> other").select("vec_id", "other", "similarity")
    return answers.withColumn("place", F.row_number().over(mine)).where(F.col("place") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.75, candidates: int = CLOSE_CANDIDATES, **forest) -> DataFrame:
    """Unordered pairs ``(vec_a, vec_b, similarity)``, at least one among the other's ``k`` most similar, similarity >= ``least``."""
    found = neighbours(vectors, k, least, candidates=candidates, **forest)
    return found.groupBy(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).agg(F.max("similarity").alias("similarity"))


def exact_neighbours(vectors: DataFrame, asking: DataFrame, k: int = 5) -> DataFrame:
    """The true answer for a stated, small set of ``vec_id`` (for measuring recall): the asked vectors are matched in blocks against all rows."""
    units = materialize(usable(vectors).dropDuplicates(["vec_id"]).mapInArrow(_pack, "vec_id long, model string, unit binary"))
    asked = [(r.vec_id, r.model, bytes(r.unit)) for r in units.join(asking.select("vec_id").distinct(), "vec_id").toLocalIterator()]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, models = batch.column("vec_id").to_numpy(), np.array(batch.column("model").to_pylist(), object)
            for rows, x in _unit(batch, "unit"):
                wide = x.astype(np.float64)
                for q, model, unit in asked:
                    if len(unit) == 4 * x.shape[1]:
                        s = np.round(np.clip(wide @ np.frombuffer(unit, np.float32).astype(np.float64), -1, 1), 9)
                        fit = np.flatnonzero((models[rows] == model) & (ids[rows] != q))
                        top = fit[np.lexsort((ids[rows][fit], -s[fit]))[:k]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q)), pa.array(ids[rows][top]), pa.array(s[top])], ["vec_id", "other", "similarity"])

    offered = units.mapInArrow(match, "vec_id long, other long, similarity double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other"))
    return offered.withColumn("place", place).where(F.col("place") <= k)
