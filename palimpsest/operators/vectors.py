"""Vector operators: similarity expressions, top-k, inverted lists, product quantization, neighbourhood analysis."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize

#: Rows on which cluster centres and codebooks are fitted (every row is assigned and encoded).
FIT_ROWS = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is (nearly) zero; null for null vectors or different lengths."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size < 1e-10, 0.0).otherwise(dot(a, b) / size))


def euclidean_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n < 1e-10, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_with(column: str, query: list[float]) -> Column:
    """:func:`cosine` with one query vector, by Arrow batches: one matrix product for each batch."""
    q = np.asarray(query, np.float64)
    size = float(np.linalg.norm(q))

    def run(v: pd.Series) -> pd.Series:
        fit = [i for i, x in enumerate(v) if x is not None and len(x) == len(q)]
        out = np.full(len(v), np.nan)
        if fit:
            x = np.stack([v.iloc[i] for i in fit]).astype(np.float64)
            norms = np.linalg.norm(x, axis=1) * size
            out[fit] = np.where(norms < 1e-10, 0.0, (x @ q) / np.maximum(norms, 1e-300))
        return pd.Series(out)

    return F.nanvl(F.pandas_udf(run, "double")(F.col(column)), F.lit(None).cast("double"))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(key, similarity)`` of the ``k`` most similar rows, ties to the smaller key: one scan, a heap per task, no shuffle of vectors."""
    scored = vectors.select(key, cosine(F.col(column), literal(query)).alias("similarity")).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), key).limit(k)


#: Query vectors that are sent to every task at a time.
QUERY_BLOCK = 20_000


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(query, key, similarity, rank)`` for a bounded set of query vectors ``(query, vector)``: blocks of the collection against all
    queries by one matrix product in each task, the best ``k`` of a block kept before the shuffle."""
    count = queries.count()
    if count > QUERY_BLOCK:
        # Queries go to every task, so they are taken in blocks, one scan each.
        blocks = 2 * -(-count // QUERY_BLOCK)
        mine = F.pmod(F.xxhash64("query"), F.lit(blocks))
        return reduce(DataFrame.union, (materialize(top_k_each(vectors, queries.where(mine == b), k, key, column)) for b in range(blocks)))
    asked = queries.collect()  # at most QUERY_BLOCK
    if not asked:
        return vectors.sparkSession.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, {key} long, similarity double, rank int")
    names = [q["query"] for q in asked]
    wanted = np.array([q["vector"] for q in asked], np.float64)
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[column].map(lambda v: v is not None and len(v) == wanted.shape[1])]
            if len(b):
                x = np.stack(b[column].to_numpy()).astype(np.float64)
                s = wanted @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                ids = b[key].to_numpy()
                for q in range(len(names)):
                    best = np.lexsort((ids, -s[q]))[:k]
                    yield pd.DataFrame({"query": names[q], key: ids[best], "similarity": s[q][best]})

    found = vectors.select(key, column).mapInPandas(scan, f"query {queries.schema['query'].dataType.simpleString()}, {key} long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _sample(vectors: DataFrame, column: str, rows: int = FIT_ROWS) -> np.ndarray:
    got = vectors.where(F.col(column).isNotNull()).select(column, F.xxhash64(column).alias("h")).orderBy("h").limit(rows).toPandas()[column]
    return np.stack(got.to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from rows spread over the sample; deterministic."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """Adds ``cell``, the nearest centre; every row is assigned, null vectors get null."""

    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="Int64")
        rows = [i for i, x in enumerate(v) if x is not None and len(x) == centres.shape[1]]
        if rows:
            x = np.stack([v.iloc[i] for i in rows]).astype(np.float64)
            out.iloc[rows] = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        return out

    return vectors.withColumn("cell", F.pandas_udf(run, "int")(F.col(column)))


def inverted_search(cells: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Top-k within the ``probes`` nearest cells; with ``cell`` as a partition column only those files are read."""
    q = np.array(query, float)
    near = np.argsort(((centres - q) ** 2).sum(1), kind="stable")[:probes].tolist()
    return top_k(cells.where(F.col("cell").isin([int(c) for c in near])), query, k, key, column)


def quantizer(vectors: DataFrame, parts: int = 8, codes: int = 64, column: str = "embedding") -> np.ndarray:
    """Codebooks (parts, codes, width) by k-means per sub-vector on the bounded sample."""
    x = _sample(vectors, column)
    width = x.shape[1] // parts
    books = [kmeans(x[:, p * width : (p + 1) * width], codes) for p in range(parts)]
    return np.stack(books)


def encode(vectors: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """Adds ``codes``: the nearest codebook entry of each sub-vector."""
    parts, _, width = books.shape

    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        near = [((books[p] ** 2).sum(1)[None] - 2 * x[:, p * width : (p + 1) * width] @ books[p].T).argmin(1) for p in range(parts)]
        return pd.Series(list(np.stack(near, 1)))

    return vectors.where(F.size(column) == parts * width).withColumn("codes", F.pandas_udf(run, "array<int>")(F.col(column)))


def decoded(coded: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """The vectors that codes stand for, in place of ``column``."""

    def run(c: pd.Series) -> pd.Series:
        codes = np.stack(c.to_numpy())
        return pd.Series(list(np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)))

    return coded.withColumn(column, F.pandas_udf(run, "array<double>")("codes"))


def quantized_distance(codes: Column, books: np.ndarray, query: list[float]) -> Column:
    """Squared distance to the query by looking up a table per part; the table is a literal of parts x codes numbers."""
    parts, _, width = books.shape
    q = np.array(query, float).reshape(parts, width)
    table = ((books - q[:, None]) ** 2).sum(2)
    terms = [F.element_at(F.array(*(F.lit(float(x)) for x in table[p])), F.get(codes, p) + 1) for p in range(parts)]
    return sum(terms[1:], terms[0])


def recall_of(found: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """Per query the share of the exact answer that was found."""
    hit = exact.join(found.select(query, key).distinct(), [query, key], "left_semi").groupBy(query).agg(F.count("*").alias("hits"))
    return exact.groupBy(query).agg(F.count("*").alias("k")).join(hit, query, "left").select(query, (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("recall"))


def max_pool(scored: DataFrame, owner: str, score: str = "similarity") -> DataFrame:
    """Best chunk per owner."""
    return scored.groupBy(owner).agg(F.max(score).alias(score))


def mmr(candidates: pd.DataFrame, weight: float, k: int) -> pd.DataFrame:
    """Greedy ``weight * relevance - (1 - weight) * greatest similarity to the chosen`` over one query's bounded candidate set."""
    x = np.stack(candidates["vector"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    relevance, ids = candidates["relevance"].to_numpy(float), candidates["id"].to_numpy()
    left, chosen, near = set(range(len(ids))), [], np.zeros(len(ids))
    while left and len(chosen) < k:
        best = min(left, key=lambda i: (-(weight * relevance[i] - (1 - weight) * near[i]), ids[i]))
        left.remove(best)
        chosen.append(best)
        near = np.maximum(near, x @ x[best])
    return pd.DataFrame({"id": ids[chosen], "place": range(1, len(chosen) + 1)})


def cells_of_neighbours(knn: DataFrame) -> DataFrame:
    """From ``(vec_id, other, similarity)``: isolation (mean distance to the neighbours), density and in-degree per vector."""
    mine = knn.groupBy("vec_id").agg(F.avg(1 - F.col("similarity")).alias("isolation"))
    heard = knn.groupBy(F.col("other").alias("vec_id")).agg(F.count("*").alias("in_degree"))
    return mine.join(heard, "vec_id", "left").select("vec_id", "isolation", (1 / F.greatest("isolation", F.lit(1e-9))).alias("density"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def knn_blocks(vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 2_000) -> DataFrame:
    """``(key, other, similarity, rank)``: the exact ``k`` nearest others of every vector of the commonest length. Each pair of blocks of
    about ``block`` rows is one task, so memory is bounded and the work is quadratic: for collections where exactness is worth that."""
    known = vectors.where(F.col(column).isNotNull()).dropDuplicates([key]).select(key, F.col(column).alias("v"))
    size = known.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    kind = vectors.schema[key].dataType.simpleString()
    if size is None:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, other {kind}, similarity double, rank int")
    rows = materialize(known.where(F.size("v") == size["s"]))
    blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks)))
    met = placed.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"), "b", key, "v")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, side = p[key].to_numpy(), p["b"].to_numpy() == p["one"].iloc[0]
        same = p["one"].iloc[0] == p["two"].iloc[0]
        parts = []
        for mine, theirs in (((slice(None), slice(None)),) if same else ((side, ~side), (~side, side))):
            s = np.round(x[mine] @ x[theirs].T, 9)
            if same:
                np.fill_diagonal(s, -np.inf)
            for i, row in zip(ids[mine], s):
                best = np.lexsort((ids[theirs], -row))[:k]
                best = best[np.isfinite(row[best])]
                parts.append(pd.DataFrame({key: i, "other": ids[theirs][best], "similarity": row[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({key: ids[:0], "other": ids[:0], "similarity": np.zeros(0)})

    found = met.groupBy("one", "two").applyInPandas(meet, f"{key} {kind}, other {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def shapes_of_cells(knn: DataFrame, vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(key, isolation, density, anisotropy, sparse)`` from ``(key, other, similarity)``: mean distance of the neighbours and its inverse;
    the greatest over the mean likeness of two directions to neighbours (1 at least; 1 with fewer than two); and the direction away
    from the neighbours' mean, null with fewer than three. A vector's own neighbours are all that a row of work holds."""
    own = vectors.dropDuplicates([key]).select(key, F.col(column).alias("v"))
    near = knn.join(own.select(F.col(key).alias("other"), F.col("v").alias("w")), "other").groupBy(key).agg(F.avg(1 - F.col("similarity")).alias("isolation"), F.collect_list("w").alias("ws"))
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shape, sparse = [], []
            for v, ws in zip(b["v"], b["ws"]):
                d = np.stack(list(ws)).astype(np.float64) - np.asarray(v, np.float64)
                d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
                off = np.abs((d @ d.T)[np.triu_indices(len(d), 1)])
                shape.append(max(1.0, off.max() / off.mean()) if len(off) and off.mean() > 0.001 else 1.0)
                mean = d.mean(axis=0)
                sparse.append((-mean / np.linalg.norm(mean)).tolist() if len(d) > 2 and np.linalg.norm(mean) > 1e-9 else None)
            yield pd.DataFrame({key: b[key], "isolation": b["isolation"], "anisotropy": shape, "sparse": sparse})

    done = near.join(own, key).mapInPandas(run, f"{key} {kind}, isolation double, anisotropy double, sparse array<double>")
    return done.select(key, "isolation", F.when(F.col("isolation") > 0, 1 / F.col("isolation")).otherwise(0.0).alias("density"), "anisotropy", "sparse")


def void(cells: DataFrame, vectors: DataFrame, isolation: float, least: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(boundary, nearest, radius, confidence)``: the hole that isolated vectors surround, if their centre is empty: at least ``least``
    cells over ``isolation`` whose centroid no vector is nearer to than 0.3. No row otherwise."""
    lone = vectors.dropDuplicates([key]).select(key, F.col(column).alias("v")).join(cells.where(F.col("isolation") > isolation).select(key), key, "left_semi")
    means = lone.select(F.posexplode("v").alias("place", "x")).groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("place").collect()  # one number per dimension
    count = lone.count()
    spark = vectors.sparkSession
    schema = "boundary long, nearest double, radius double, confidence double"
    if count < least:
        return spark.createDataFrame([], schema)
    centre = literal([m["x"] for m in means])
    nearest = vectors.where(F.col(column).isNotNull()).agg(F.min(1 - cosine(F.col(column), centre))).first()[0]
    if nearest is None or nearest <= 0.3:
        return spark.createDataFrame([], schema)
    radius = lone.agg(F.avg(1 - cosine(F.col("v"), centre))).first()[0]
    confidence = min(max(count / 10, 0.2), 0.9) * min(max(nearest / 0.5, 0.3), 1.0)
    return spark.createDataFrame([(count, float(nearest), float(radius), confidence)], schema)
