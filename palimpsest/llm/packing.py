"""Filling fixed-capacity containers with items: mixture-controlled packing by deficit round-robin.

Documents are measured once in tokens of a public tokenizer. A document larger than a container is cut into pieces that fill a
container each and one rest; nothing else is split. The rest is spread evenly over partitions of bounded size. In a partition the
sources are queues; each window is filled by deficit round-robin: every source earns tokens in proportion to its target share and
sends items while its deficit lasts. Deficits are carried from window to window, and each partition starts with the deficits that
the partitions before it leave behind (running sums over per-partition token counts, computed on the cluster before any packing
starts). A window holds what fills ``WINDOW_BOXES`` containers. Inside it items go, largest first, to one of the ``LOOK`` fullest
containers that still take them, to the one that holds least of the item's source against its target; containers with room left stay
open for the next window.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

#: Items in one partition of the packing: bounds a task's memory (ids and sizes only, no text).
ITEMS_PER_PARTITION = 20_000
#: Containers that deficit round-robin fills with one window, and containers among which an item's source decides.
WINDOW_BOXES, LOOK = 64, 4
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Rows ``(doc_id, source, tokens)``. Null and empty texts have 0 tokens; whole texts are measured."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    shown = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return shown.mapInArrow(count, f"doc_id {kind}, source string, tokens long")


class _Shelf:
    """Open containers of one partition, sorted by free room, with the tokens of each source in them."""

    def __init__(self, capacity: int, targets: dict[str, float]):
        self.capacity, self.targets, self.free, self.held = capacity, targets, [], []

    def put(self, size: int, source: str) -> int:
        free, held = self.free, self.held
        k = bisect_left(free, (size, -1))
        if k < len(free):
            if len(free) > k + 1:
                k = min(range(k, min(len(free), k + LOOK)), key=lambda i: (held[free[i][1]].get(source, 0) / (self.capacity - free[i][0]), i))
            room, box = free.pop(k)
        else:
            room, box = self.capacity, len(held)
            held.append({})
        held[box][source] = held[box].get(source, 0) + size
        if room > size:
            insort(free, (room - size, box))
        return box


def draw_windows(sources: list[str], sizes: list[int], targets: dict[str, float], deficits: dict[str, float], window: int = 4_000) -> Iterator[list[int]]:
    """Deficit round-robin over one queue per source: yields windows of item positions; ``deficits`` is carried and updated."""
    queues: dict[str, deque] = {}
    for k, s in enumerate(sources):
        queues.setdefault(s, deque()).append(k)
    quantum = max(1.0, float(np.mean(sizes))) * max(1, len(queues))
    taken: list[int] = []
    while queues:
        share = sum(targets.get(s, 0.0) for s in queues) or 1.0
        for s in list(queues):
            deficits[s] = deficits.get(s, 0.0) + quantum * (targets.get(s, 0.0) / share if share else 1.0 / len(queues))
            queue = queues[s]
            while queue and sizes[queue[0]] <= deficits[s]:
                k = queue.popleft()
                deficits[s] -= sizes[k]
                taken.append(k)
                if len(taken) >= window:
                    yield taken
                    taken = []
            if not queue:
                del queues[s]
        if queues and max(targets.get(s, 0.0) for s in queues) <= 0:
            rest = [k for q in queues.values() for k in q]  # sources without a target share go last, whole
            queues.clear()
            taken += rest
    if taken:
        yield taken


def _packer(capacity: int):
    def pack(group: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        deficits, targets = (dict(zip(owed["source"].tolist(), owed[c].tolist())) for c in ("deficit", "target"))
        sizes, sources = group["tokens"].tolist(), group["source"].tolist()
        width = max(LOOK, round(WINDOW_BOXES * capacity / max(1.0, float(group["tokens"].mean()))))
        shelf, box, window_of = _Shelf(capacity, targets), [0] * len(group), [0] * len(group)
        for number, window in enumerate(draw_windows(sources, sizes, targets, deficits, width)):
            for k in sorted(window, key=lambda i: (-sizes[i], i)):
                box[k], window_of[k] = shelf.put(sizes[k], sources[k]), number
        group["container"] = box
        group["window"] = window_of
        return group[["part", "window", "container", "doc_id", "piece", "start", "tokens", "source"]]

    return pack


def owed_at_start(placed: DataFrame, targets: dict[str, float] | None, total: int) -> DataFrame:
    """Rows ``(part, source, target, deficit)``: what each source present in a partition is owed when it starts, its target share of
    all tokens before less its own tokens before; shares that no target names are those of the input, or 0 beside given targets."""
    own = placed.groupBy("part", "source").agg(F.sum("tokens").alias("own"))
    if targets is None:
        share = own.groupBy("source").agg((F.sum("own") / F.lit(max(1, total))).alias("target"))
    else:
        share = own.sparkSession.createDataFrame(sorted(targets.items()), "source string, target double")
    # A row per partition of ITEMS_PER_PARTITION items: running sums over them are short; those by source run side by side.
    parts = own.groupBy("part").agg(F.sum("own").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    own = own.withColumn("own_before", F.sum("own").over(Window.partitionBy("source").orderBy("part")) - F.col("own"))
    known = own.join(parts, "part").join(share, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    return known.select("part", "source", "target", (F.col("target") * F.col("before") - F.col("own_before")).alias("deficit"))


def packed(counted: DataFrame, capacity: int, targets: dict[str, float] | None = None, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """Put counted documents into containers of ``capacity`` tokens.

    ``counted``: ``doc_id, source, tokens`` (see :func:`token_counts`). Rows: ``container`` (string), ``window``, ``doc_id``,
    ``piece`` (0 from the start of the document), ``start`` (first token), ``tokens``, ``source``. ``targets`` are token shares by
    source; by default the shares of the input itself. Documents without tokens take no room and get no container. An empty input
    gives no rows; a capacity under 1 is an error.
    """
    if capacity < 1:
        raise ValueError("a container needs room for a token")
    kind = counted.schema["doc_id"].dataType.simpleString()
    some = counted.where("tokens > 0")
    full = (
        some.where(F.col("tokens") >= capacity)
        .select("doc_id", "source", F.explode(F.sequence(F.lit(0), (F.col("tokens") / capacity).cast("int") - 1)).alias("piece"))
        .select(
            F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.lit(None).cast("int").alias("window"),
            "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"), "source",
        )
    )
    rests = some.where(F.col("tokens") % capacity > 0).select(
        "doc_id", "source", (F.col("tokens") / capacity).cast("int").alias("piece"), (F.floor(F.col("tokens") / capacity) * capacity).alias("start"), (F.col("tokens") % capacity).alias("tokens")
    )
    items, total = rests.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = max(1, -(-items // items_per_partition))
    placed = rests.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    owed = materialize(owed_at_start(placed, targets, total))
    schema = f"part int, window int, container int, doc_id {kind}, piece int, start long, tokens long, source string"
    out = placed.groupBy("part").cogroup(owed.groupBy("part")).applyInPandas(_packer(capacity), schema)
    name = F.concat(F.col("part").cast("string"), F.lit("-"), F.col("container").cast("string"))
    return out.select(name.alias("container"), "window", "doc_id", "piece", "start", "tokens", "source").union(full)


def packed_for_budgets(documents: DataFrame, budgets: DataFrame, path: str | None = None) -> DataFrame:
    """:func:`packed` for the usable capacity of every row of ``budgets`` (``model, max_tokens, reserved_tokens``), plus ``model`` and ``capacity``."""
    counted = materialize(token_counts(documents, path))
    out = None
    for row in budgets.distinct().orderBy("model").collect():  # one row per model
        capacity = row["max_tokens"] - row["reserved_tokens"]
        one = packed(counted, capacity).select(F.lit(row["model"]).alias("model"), F.lit(capacity).alias("capacity"), "*")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no budget given")
    return out


def mixture(placed: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``(*by, source, target, share, off)`` of packed rows in containers (whole-container pieces left out): the source's share of
    all tokens, the token-weighted mean share of its windows that it fills there, and the mean distance of windows from the target."""
    mixed = placed.where("window is not null").withColumn("part", F.split_part("container", F.lit("-"), F.lit(1)))
    own = mixed.groupBy(*by, "part", "window", "source").agg(F.sum("tokens").alias("own"))
    windows = own.groupBy(*by, "part", "window").agg(F.sum("own").alias("all"), F.map_from_entries(F.collect_list(F.struct("source", "own"))).alias("held"))  # one entry per source
    sources = own.groupBy(*by, "source").agg(F.sum("own").alias("tokens"))
    totals = sources.groupBy(*by).agg(F.sum("tokens").alias("total"))
    targets = sources.join(totals, by).select(*by, "source", (F.col("tokens") / F.col("total")).alias("target"))
    each = windows.join(targets, by).withColumn("share", F.coalesce(F.element_at("held", F.col("source")), F.lit(0)) / F.col("all"))
    return each.groupBy(*by, "source", "target").agg(
        (F.sum(F.col("share") * F.col("all")) / F.sum("all")).alias("share"), (F.sum(F.abs(F.col("share") - F.col("target")) * F.col("all")) / F.sum("all")).alias("off")
    )
