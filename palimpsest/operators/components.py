"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import materialize


#: Nodes of which a task keeps the forest at a time.
HELD_NODES = 500_000


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of a task: stars around the least node known. A forest of more than ``HELD_NODES`` nodes is handed on
    and a new one begun, so memory is bounded and nothing is lost."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pd.DataFrame:
        nodes = list(parent)
        return pd.DataFrame({"src": nodes, "dst": [find(x) for x in nodes]})

    for batch in batches:
        for a, b in zip(batch["src"].tolist(), batch["dst"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
        if len(parent) > HELD_NODES:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every endpoint; ``component`` is the smallest node of its component.

    First every task contracts its edges to star forests (bounded memory, no shuffle); then rounds of minimum-label
    exchange with pointer jumping run until no label changes. Each round is written to the shared folder, so lost
    executors cost at most one round. Hot nodes are safe: all aggregations are map-side combinable minima.
    Edges with a null endpoint are dropped; self-loops yield a component of one; an empty input yields no rows.
    """
    kind = edges.schema[src].dataType
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    schema = f"src {kind.simpleString()}, dst {kind.simpleString()}"
    stars = pairs.mapInPandas(_local_forest, schema).distinct()
    links = materialize(stars)
    labels = materialize(
        links.select("src", "dst").union(links.select("dst", "src")).groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component"))
    )
    links = links.where("src <> dst")
    for _ in range(max_rounds):
        own = labels.withColumnRenamed("component", "mine")
        both = links.select("src", "dst").union(links.select("dst", "src"))
        heard = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("heard"))
        best = own.join(heard, own.node == heard.src, "left").select("node", "mine", F.least("mine", F.coalesce("heard", "mine")).alias("low"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("jump"))
        step = materialize(
            best.join(roots, best.low == roots.root, "left").select(
                "node", F.least("low", F.coalesce("jump", "low")).alias("component"), (F.least("low", F.coalesce("jump", "low")) < F.col("mine")).alias("moved")
            )
        )
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")
