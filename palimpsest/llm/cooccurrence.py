"""Items that appear together: pair counts by an external sort of packed 64-bit codes, and lift over chance.

Every distinct item gets a dense 32-bit number in byte order of (kind, item), so a pair is one 64-bit code and code order is
item order. Each task packs the pairs of its baskets into bounded buffers, sorts a buffer, counts its runs and hands the sorted,
counted run to the shuffle; the reducing task merges the spilled runs of its share of the codes with Spark's external sorter and
sums equal neighbours in one streaming pass. No task holds more than a buffer, no basket is compared with another, and a hot
pair reaches a reducer as at most one row per buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize, partitions

#: Packed codes that a task sorts at a time.
BUFFER_PAIRS = 2_000_000


def _number_within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        batch["part"] = part
        batch["place"] = np.arange(seen, seen + len(batch), dtype=np.int64)
        seen += len(batch)
        yield batch


def number_items(counted: DataFrame) -> DataFrame:
    """Give rows ``(kind, item, n)`` dense numbers ``code`` from 0 in byte order of (kind, item), without a global sort task."""
    ranged = counted.repartitionByRange("kind", "item").sortWithinPartitions("kind", "item")
    placed = materialize(ranged.mapInPandas(_number_within, "kind string, item string, n long, part int, place long"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    # One row per task of the previous stage: bounded by the shuffle width, so a single ordered window is safe here.
    starts = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("kind", "item", "n", (F.col("start") + F.col("place")).alias("code"))


def _packed(codes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Pair codes of every basket; baskets of one size are handled together, a basket of any size in slices."""
    sizes = np.diff(offsets)
    for size in np.unique(sizes[sizes > 1]):
        rows = offsets[:-1][sizes == size]
        if size * (size - 1) // 2 <= BUFFER_PAIRS:
            left, right = np.triu_indices(size, 1)
            step = max(1, BUFFER_PAIRS // len(left))
            for at in range(0, len(rows), step):
                block = codes[rows[at : at + step, None] + np.arange(size)]
                yield ((block[:, left] << 32) | block[:, right]).ravel()
        else:
            for start in rows:
                basket = codes[start : start + size]
                for k in range(size - 1):
                    yield (basket[k] << 32) | basket[k + 1 :]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def run() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(times.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        baskets = batch.column(0)
        codes = baskets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(baskets.offsets.to_numpy())
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for packed in _packed(codes, offsets):
            held.append(packed)
            count += len(packed)
            if count >= BUFFER_PAIRS:
                yield run()
                held, count = [], 0
    if held:
        yield run()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of equal neighbouring codes; the last code of a batch is carried into the next."""
    last, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        values, sums = pair[first], np.add.reduceat(n, first)
        if last is not None:
            if values[0] == last:
                sums[0] += carried
            else:
                values, sums = np.concatenate([[last], values]), np.concatenate([[carried], sums])
        last, carried = int(values[-1]), int(sums[-1])
        if len(values) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(values[:-1]), pa.array(sums[:-1])], ["pair", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([carried], pa.int64())], ["pair", "n"])


def pair_counts(baskets: DataFrame, least: int = 1) -> DataFrame:
    """Rows ``(item_kind, item_a, item_b, together, count_a, count_b)`` for every pair of items held by ``least`` baskets or more.

    ``baskets`` has ``kind string, items array<string>``, one row per basket. Nulls and repeats inside a basket are ignored;
    ``item_a < item_b`` in byte order; pairs never mix kinds. ``least`` prunes losslessly: an item rarer than that cannot be in
    such a pair, so it gets no code. Empty or null baskets give nothing.
    """
    clean = baskets.select("kind", F.array_distinct(F.filter("items", lambda x: x.isNotNull())).alias("items")).where(F.size("items") > 0)
    clean = materialize(clean.withColumn("basket", F.monotonically_increasing_id()))
    held = clean.select("kind", "basket", F.explode("items").alias("item"))
    items = materialize(number_items(held.groupBy("kind", "item").agg(F.count("*").alias("n")).where(F.col("n") >= least)))
    if (items.agg(F.max("code")).first()[0] or 0) >= 1 << 32:
        raise OverflowError("over 2**32 items of the asked frequency: two codes do not fit in 64 bits; raise `least`")
    # Items are as many as the data names: joined by shuffle, never broadcast by an estimate.
    items = items.hint("merge")
    coded = held.join(items, ["kind", "item"]).groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    runs = coded.where(F.size("codes") > 1).select("codes").mapInArrow(_sorted_runs, "pair long, n long")
    merged = runs.repartition(partitions(baskets.sparkSession), "pair").sortWithinPartitions("pair").mapInArrow(_run_lengths, "pair long, n long")
    pairs = merged.where(F.col("n") >= least).select(
        F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.col("n").alias("together")
    )
    left = items.select(F.col("code").alias("a"), F.col("kind").alias("item_kind"), F.col("item").alias("item_a"), F.col("n").alias("count_a"))
    right = items.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("count_b"))
    return pairs.join(left, "a").join(right, "b").select("item_kind", "item_a", "item_b", "together", "count_a", "count_b")


def association(total: int) -> dict[str, Column]:
    """``lift`` and ``odds_ratio`` (with 0.5 added to every cell of the two-by-two table) of a row of pair counts."""
    both, a, b = F.col("together"), F.col("count_a"), F.col("count_b")
    half = F.lit(0.5)
    return {
        "lift": both.cast("double") * total / (a.cast("double") * b),
        "odds_ratio": (both + half) * (total - a - b + both + half) / ((a - both + half) * (b - both + half)),
    }


def memory_baskets(memories: DataFrame) -> tuple[DataFrame, int]:
    """The tag and citation baskets of each memory id counted once, and the number of ids."""
    once = materialize(
        memories.select("id", F.col("tags"), F.col("relations.related_memories").alias("cited")).groupBy("id").agg(F.first("tags").alias("tags"), F.first("cited").alias("cited"))
    )
    tags = once.select(F.lit("tag").alias("kind"), F.transform("tags", lambda x: F.lower(F.trim(x))).alias("items"))
    cited = once.select(F.lit("memory").alias("kind"), F.col("cited").alias("items"))
    return tags.union(cited), once.count()


def memory_pairs(memories: DataFrame, least: int = 1) -> DataFrame:
    """All pairs of tags and of cited memories with counts, ``total`` ids, ``lift`` and ``odds_ratio``."""
    baskets, total = memory_baskets(memories)
    return pair_counts(baskets, least).withColumn("total", F.lit(total)).withColumns(association(total))
