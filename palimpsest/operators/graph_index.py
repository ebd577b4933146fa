"""Graph indices for vectors: flat graphs with pruned long links, and layered graphs, built in shards of bounded size.

A shard of ``SHARD`` vectors is a task: its graph links every vector to its nearest ones, thinned so that a link stays only if no kept
neighbour is nearer to its target (by ``alpha``), with ways back added. A search walks each shard's graph by a beam and merges the best
of all shards. Shards are dealt by a hash of the key, so a search meets every shard, and new vectors make new shards until the index is
rebuilt. Removed vectors are marked: they still lead the way but are no answers. Null vectors and those of another length are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.texts import first_ranks

#: Vectors of a shard, links of a vector, candidates for links, width of the beam; slack of long links; share of a layer in the next.
SHARD, LINKS, CANDIDATES, BEAM, ALPHA, LAYER = 5_000, 24, 64, 64, 1.2, 16


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float32) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def thinned(distance: np.ndarray, between: np.ndarray, alpha: float, most: int) -> list[int]:
    """Of candidates in order of their distance those to link: the nearest left, then without all that it reaches ``alpha`` times as near."""
    alive, kept = np.ones(len(distance), bool), []
    for k in range(len(distance)):
        if alive[k]:
            kept.append(k)
            if len(kept) == most:
                break
            alive &= alpha * between[k] > distance
    return kept


def linked(x: np.ndarray, alpha: float, links: int = LINKS, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """The out-links of each row of unit vectors; ways back are added and over-full rows thinned again."""
    n = len(x)
    width = min(candidates, n - 1)
    out: list[list[int]] = []
    for low in range(0, n, 1024):
        near = 2 - 2 * (x[low : low + 1024] @ x.T)
        near[np.arange(len(near)), low + np.arange(len(near))] = np.inf
        best = np.argpartition(near, width - 1, axis=1)[:, :width] if width > 0 else np.zeros((len(near), 0), int)
        for i, c in enumerate(best):
            c = c[np.lexsort((c, near[i, c]))]
            out.append([int(c[k]) for k in thinned(near[i, c], 2 - 2 * (x[c] @ x[c].T), alpha, links)])
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            back[j].append(i)
    for i in range(n):
        both = np.array(sorted({*out[i], *back[i]} - {i}), int)
        if len(both) > links:
            both = both[np.lexsort((both, 2 - 2 * (x[both] @ x[i])))]
            both = both[thinned(2 - 2 * (x[both] @ x[i]), 2 - 2 * (x[both] @ x[both].T), alpha, links)]
        out[i] = both
    return [np.asarray(o, np.int64) for o in out]


def walked(x: np.ndarray, links: dict[int, np.ndarray] | list[np.ndarray], query: np.ndarray, start: list[int], beam: int) -> list[tuple[float, int]]:
    """The ``beam`` nearest rows that a best-first walk over links meets, as (distance, row) in order."""
    seen = set(start)
    first = [(float(2 - 2 * (x[s] @ query)), s) for s in start]
    front, best = list(first), [(-d, -s) for d, s in first]
    heapq.heapify(front)
    heapq.heapify(best)
    while front:
        d, at = heapq.heappop(front)
        if len(best) >= beam and d > -best[0][0]:
            break
        fresh = [int(j) for j in links[at] if int(j) not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for e, j in zip((2 - 2 * (x[fresh] @ query)).tolist(), fresh):
            if len(best) < beam or e < -best[0][0]:
                heapq.heappush(front, (e, j))
                heapq.heappush(best, (-e, -j))
                if len(best) > beam:
                    heapq.heappop(best)
    return sorted((-d, -j) for d, j in best)


def _layers(keys: np.ndarray) -> np.ndarray:
    """The top layer of each row: a row is in the next layer with chance 1 / LAYER, by a hash of its key."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    share = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
    return np.minimum((-np.log(share) / np.log(LAYER)).astype(int), 6)


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", layered: bool = False, shard: int = SHARD) -> DataFrame:
    """Rows ``(shard, key, place, layer, vector, links)``: the index, one row per vector; ``links`` has the out-links (places in the
    shard) of each layer from the lowest. A repeated key counts once. Write it to keep it."""
    known = vectors.where(F.col(column).isNotNull()).dropDuplicates([key])
    count = known.count()
    pieces = max(1, -(-count // shard))
    width = known.select(F.max(F.size(column))).first()[0] or 0
    dealt = known.where(F.size(column) == width).select(F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int").alias("shard"), key, F.col(column).cast("array<float>").alias("vector"))
    kind = vectors.schema[key].dataType.simpleString()

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        x = _unit(group["vector"].tolist())
        layer = _layers(pd.util.hash_array(group[key].to_numpy())) if layered else np.zeros(len(x), int)
        links: list[list[list[int]]] = [[] for _ in range(len(x))]
        for level in range(int(layer.max()) + 1):
            members = np.flatnonzero(layer >= level)
            graph = linked(x[members], 1.0 if layered else ALPHA) if len(members) > 1 else [np.zeros(0, int)] * len(members)
            for m, own in zip(members, graph):
                links[m].append(members[own].tolist())
        return pd.DataFrame({"shard": group["shard"], key: group[key], "place": np.arange(len(x), dtype=np.int32), "layer": layer.astype(np.int32), "vector": group["vector"], "links": links})

    # A shard holds about ``shard`` rows whatever the data, because keys are hashed.
    return dealt.groupBy("shard").applyInPandas(make, f"shard int, {key} {kind}, place int, layer int, vector array<float>, links array<array<int>>")


def added(index: DataFrame, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", layered: bool = False, shard: int = SHARD) -> DataFrame:
    """The index with further vectors in shards of their own (keys that it holds are left out)."""
    fresh = vectors.join(index.select(key), key, "left_anti")
    last = index.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0]
    return index.unionByName(build(fresh, key, column, layered, shard).withColumn("shard", (F.col("shard") + last).cast("int")))


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", beam: int = BEAM, removed: DataFrame | None = None) -> DataFrame:
    """``(query, key, similarity, rank)``: the ``k`` nearest of each query of a stated, bounded set ``(query, vector)``; a query's own key
    may answer. ``removed`` keys ``(key)`` are no answers. Ties go to the smaller key."""
    asked = queries.collect()
    kind, schema = queries.schema["query"].dataType.simpleString(), index.schema[key].dataType.simpleString()
    names = [q["query"] for q in asked]
    wanted = _unit([q["vector"] for q in asked]) if asked else np.zeros((0, 1), np.float32)
    marked = index.withColumn("gone", F.lit(False)) if removed is None else index.join(removed.select(key).distinct().withColumn("gone", F.lit(True)), key, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        x, gone, top = _unit(group["vector"].tolist()), group["gone"].to_numpy(), int(group["layer"].max())
        layers = [{i: np.asarray(own[level], np.int64) for i, own in enumerate(group["links"]) if len(own) > level} for level in range(top + 1)]
        middle = int(np.argmax(x @ x.mean(axis=0))) if not top else int(group["layer"].to_numpy().argmax())
        ids, rows = group[key].tolist(), []
        for q, v in zip(names, wanted):
            if len(v) != x.shape[1]:
                continue
            at = [middle]
            for level in range(top, 0, -1):
                at = [walked(x, layers[level], v, at, 1)[0][1]]
            # Wide enough that removed rows on the way leave k answers.
            found = [(d, j) for d, j in walked(x, layers[0], v, at, beam + k + int(gone.sum() > 0) * beam) if not gone[j]]
            rows += [(q, ids[j], 1 - d / 2) for d, j in found[: 2 * k]]
        return pd.DataFrame(rows, columns=["query", key, "similarity"])

    if not asked:
        return index.sparkSession.createDataFrame([], f"query {kind}, {key} {schema}, similarity double, rank int")
    found = marked.groupBy("shard").applyInPandas(walk, f"query {kind}, {key} {schema}, similarity double")
    return first_ranks(found.withColumn("similarity", F.round("similarity", 6)), key, "similarity", k, ["query"])


def rebuilt(index: DataFrame, removed: DataFrame | None = None, key: str = "vec_id", layered: bool = False, shard: int = SHARD) -> DataFrame:
    """The index anew over all its vectors but the removed ones, in full shards."""
    kept = index if removed is None else index.join(removed.select(key).distinct(), key, "left_anti")
    return build(kept.select(key, F.col("vector").alias("embedding")), key, "embedding", layered, shard)
