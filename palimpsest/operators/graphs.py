"""Graph operators over an edge DataFrame: gaps, traversals, activation, communities.

Edges have ``from_entity, to_entity, strength, relation_type``; null ends are ignored. Loops are joins whose rounds are cut by
durable materialization; the stop test reads one number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions ``(src, dst, strength)``, self-loops once, parallel edges folded to the strongest."""
    e = edges.where("from_entity is not null and to_entity is not null").select("from_entity", "to_entity", F.col("strength").cast("double").alias("strength"))
    both = e.select(F.explode(F.array_distinct(F.array(F.struct(F.col("from_entity").alias("s"), F.col("to_entity").alias("d")), F.struct(F.col("to_entity").alias("s"), F.col("from_entity").alias("d"))))).alias("x"), "strength")
    return both.groupBy(F.col("x.s").alias("src"), F.col("x.d").alias("dst")).agg(F.max("strength").alias("strength"))


def adjacency(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Sorted neighbours per node over edges of at least ``least`` strength."""
    return undirected(edges).where(F.col("strength") >= least).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def open_triads(edges: DataFrame, least: float) -> DataFrame:
    """Directed a -> b -> c over strong edges with a and c unlinked either way: ``(a, b, c, strength)``, the sum of the strengths.

    One equi-join on the middle, one anti join on the unordered pair of ends; Spark splits skewed middles at run time.
    """
    e = edges.select("from_entity", "to_entity", F.col("strength").cast("double").alias("strength"))
    strong = e.where(F.col("strength") >= least)
    left = strong.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"), F.col("strength").alias("s1"))
    right = strong.select(F.col("from_entity").alias("b"), F.col("to_entity").alias("c"), F.col("strength").alias("s2"))
    linked = e.select(F.least("from_entity", "to_entity").alias("lo"), F.greatest("from_entity", "to_entity").alias("hi")).distinct()
    paths = left.join(right, "b").where("a <> c").withColumn("lo", F.least("a", "c")).withColumn("hi", F.greatest("a", "c"))
    return paths.join(linked, ["lo", "hi"], "left_anti").select("a", "b", "c", (F.col("s1") + F.col("s2")).alias("strength"))


def diamond_gaps(edges: DataFrame, least: float) -> DataFrame:
    """a -> b -> d and a -> c -> d with b < c and no edge between b and c: ``(a, b, c, d)``."""
    e = edges.select("from_entity", "to_entity", "strength")
    strong = e.where(F.col("strength") >= least).select("from_entity", "to_entity").distinct()
    paths = strong.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b")).join(strong.select(F.col("from_entity").alias("b"), F.col("to_entity").alias("d")), "b").where("a <> d and a <> b and b <> d")
    other = paths.select("a", "d", F.col("b").alias("c"))
    linked = e.select(F.least("from_entity", "to_entity").alias("b"), F.greatest("from_entity", "to_entity").alias("c")).distinct()
    return paths.join(other, ["a", "d"]).where("b < c").join(linked, ["b", "c"], "left_anti").select("a", "b", "c", "d")


def star_gaps(edges: DataFrame, min_spokes: int, max_connectivity: float) -> DataFrame:
    """Hubs with many distinct spokes of which few pairs are linked: ``(hub, spokes, linked, connectivity)``.

    Pairs of spokes are never formed: existing edges are joined to the hubs of both of their ends, so the work follows the edges.
    """
    spokes = edges.select(F.col("from_entity").alias("hub"), F.col("to_entity").alias("spoke")).where("hub <> spoke").distinct()
    hubs = spokes.groupBy("hub").agg(F.count("*").alias("spokes")).where(F.col("spokes") >= min_spokes)
    wide = spokes.join(hubs.select("hub"), "hub", "left_semi")
    pairs = edges.select(F.least("from_entity", "to_entity").alias("x"), F.greatest("from_entity", "to_entity").alias("y")).where("x <> y").distinct()
    linked = pairs.join(wide.select("hub", F.col("spoke").alias("x")), "x").join(wide.select("hub", F.col("spoke").alias("y")), ["hub", "y"]).groupBy("hub").agg(F.count("*").alias("linked"))
    out = hubs.join(linked, "hub", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return out.withColumn("connectivity", F.col("linked") / (F.col("spokes") * (F.col("spokes") - 1) / 2)).where(F.col("connectivity") <= max_connectivity)


def strongest_edges(edges: DataFrame, limit: int) -> DataFrame:
    """Per node its ``limit`` strongest undirected edges: ``(src, dst, strength, rank)``."""
    w = Window.partitionBy("src").orderBy(F.desc("strength"), "dst")
    return undirected(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def reach(edges: DataFrame, starts: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """Breadth-first: ``(start, node, hop)`` with the least number of hops up to ``depth``; a start reaches itself at 0."""
    links = materialize(undirected(edges).where(F.col("strength") >= least).where("src <> dst").select("src", "dst"))
    seen = materialize(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hop")))
    front = seen
    for hop in range(1, depth + 1):
        fresh = front.join(links, front.node == links.src).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = materialize(fresh.withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def best_paths(edges: DataFrame, starts: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """Greatest product of strengths along a path of at most ``depth`` edges: ``(start, node, score)``."""
    links = materialize(undirected(edges).where((F.col("strength") >= least) & (F.col("src") != F.col("dst"))))
    best = materialize(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(1.0).alias("score")))
    front = best
    for _ in range(depth):
        step = front.join(links, front.node == links.src).groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("strength")).alias("score"))
        old = best.select("start", "node", F.col("score").alias("before"))
        front = materialize(step.join(old, ["start", "node"], "left").where("before is null or score > before").select("start", "node", "score"))
        if front.isEmpty():
            break
        best = materialize(best.union(front).groupBy("start", "node").agg(F.max("score").alias("score")))
    return best


def meeting_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """Shortest hops between ``(a, b)`` by two searches that meet in the middle; pairs further apart than ``depth`` give no row."""
    half = (depth + 1) // 2
    ends = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    r = materialize(reach(edges, ends, half))
    left = pairs.distinct().join(r.select(F.col("start").alias("a"), "node", F.col("hop").alias("h1")), "a")
    return left.join(r.select(F.col("start").alias("b"), "node", F.col("hop").alias("h2")), ["b", "node"]).groupBy("a", "b").agg(F.min(F.col("h1") + F.col("h2")).alias("hops")).where(F.col("hops") <= depth)


def match_pattern(edges: DataFrame, pattern: list[tuple[str, bool]], least: float = 0.0) -> DataFrame:
    """Simple paths whose edges have the given relation types and directions (True: outgoing): ``(path, score)``, the product."""
    e = edges.where((F.col("strength") >= least) & F.col("invalidated_at").isNull()).select("from_entity", "to_entity", "relation_type", F.col("strength").cast("double").alias("strength"))
    out = None
    for relation, outgoing in pattern:
        a, b = ("from_entity", "to_entity") if outgoing else ("to_entity", "from_entity")
        step = e.where(F.col("relation_type") == relation).groupBy(F.col(a).alias("s"), F.col(b).alias("d")).agg(F.max("strength").alias("w")).where("s <> d")
        if out is None:
            out = step.select(F.array("s", "d").alias("path"), F.col("d").alias("end"), F.col("w").alias("score"))
        else:
            out = out.join(step, out.end == step.s).where(~F.array_contains("path", F.col("d"))).select(F.concat("path", F.array("d")).alias("path"), F.col("d").alias("end"), (F.col("score") * F.col("w")).alias("score"))
    return out.select("path", "score")


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.5, threshold: float = 0.005) -> DataFrame:
    """Spreading activation from ``(node, activation)``: ``(node, activation)`` summed over hops.

    A node passes on ``a * exp(-decay * hop) * strength / sqrt(1 + degree)`` along each edge; amounts under ``threshold`` stop.
    Each round is one join and one map-side combined sum.
    """
    links = undirected(edges).where("src <> dst")
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    links = materialize(links.join(degree, "src").select("src", "dst", (F.col("strength") / F.sqrt(1.0 + F.col("degree"))).alias("w")))
    total = materialize(seeds.groupBy("node").agg(F.sum("activation").alias("activation")))
    front = total
    for hop in range(1, hops + 1):
        amount = F.col("activation") * F.exp(F.lit(-decay * hop)) * F.col("w")
        front = materialize(front.join(links, front.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.sum(amount).alias("activation")).where(F.col("activation") >= threshold))
        if front.isEmpty():
            break
        total = total.union(front)
    return total.groupBy("node").agg(F.sum("activation").alias("activation"))


def spread_both(edges: DataFrame, seeds_a: DataFrame, seeds_b: DataFrame, hops: int = 2, bonus: float = 1.5) -> DataFrame:
    """Two spreads added up; nodes that both reach count ``bonus`` times."""
    a, b = spread(edges, seeds_a, hops).withColumnRenamed("activation", "x"), spread(edges, seeds_b, hops).withColumnRenamed("activation", "y")
    both = a.join(b, "node", "full")
    value = F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))
    return both.select("node", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), value * bonus).otherwise(value).alias("activation"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Synchronous communities ``(node, label)``: each round a node takes its neighbours' most frequent label, ties to the smallest."""
    links = materialize(undirected(edges).where("src <> dst").select("src", "dst"))
    labels = materialize(links.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = links.join(labels, links.dst == labels.node).groupBy("src", "label").agg(F.count("*").alias("n"))
        new = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).select(F.col("src").alias("node"), "label")
        new = materialize(new)
        if new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        labels = new
    return labels


def ancestors(rows: DataFrame, key: str, parent: str, depth: int = 10) -> DataFrame:
    """``(node, ancestor, distance)`` along parent links up to ``depth``; cycles end where a pair repeats, unknown parents are listed once."""
    link = materialize(rows.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("ancestor")).distinct())
    found = link.withColumn("distance", F.lit(1))
    front = found
    for d in range(2, depth + 1):
        up = link.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        step = front.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct().where("node <> ancestor").join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        front = materialize(step.withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def trace(edges: DataFrame, starts: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """Directed reach over ``(cause, effect)``: ``(start, node, depth)``, least depth first."""
    a, b = ("effect", "cause") if backward else ("cause", "effect")
    link = materialize(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).distinct())
    seen = materialize(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    front = seen
    for k in range(1, depth + 1):
        fresh = front.join(link, front.node == link.s).select("start", F.col("d").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = materialize(fresh.withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def upsert_entities(entities: DataFrame) -> DataFrame:
    """One row per tenant and name in lower case: summed mentions, first and last times, greatest salience, all labels, and a
    salience that grows with the mentions: ``base * (1 + 0.1 ln(mentions))``, at most 1."""
    g = entities.where("name is not null").groupBy("user_id", F.lower(F.trim("name")).alias("name")).agg(
        F.min("uuid").alias("uuid"), F.sum("mention_count").alias("mentions"), F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max("salience").alias("base"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("labels", F.array().cast("array<string>")))))).alias("labels"),
    )
    return g.withColumn("salience", F.least(F.col("base").cast("double") * (1 + 0.1 * F.log(F.greatest("mentions", F.lit(1)))), F.lit(1.0)))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair and relation type: strength strengthened once per further activation, ``w += rate * (1 - w)``,
    in order of creation; counts summed."""
    rows = edges.select("user_id", F.least("from_entity", "to_entity").alias("a"), F.greatest("from_entity", "to_entity").alias("b"), "relation_type", "created_at", "uuid", F.coalesce(F.col("strength").cast("double"), F.lit(0.0)).alias("strength"), F.coalesce("activation_count", F.lit(0)).alias("n"))
    g = rows.groupBy("user_id", "a", "b", "relation_type").agg(F.sort_array(F.collect_list(F.struct("created_at", "uuid", "strength"))).alias("l"), F.sum("n").alias("activations"), F.count("*").alias("merged"))
    first = F.get("l", 0)["strength"]
    return g.select("user_id", "a", "b", "relation_type", "activations", "merged", (1 - (1 - first) * F.pow(F.lit(0.9), F.col("merged") - 1)).alias("strength"))


def dot_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines ``(part, key, line)`` of a graph document in DOT: nodes (part 0) and edges (part 1), to be written in that order between
    ``digraph {`` and ``}`` (see ``write_dot``). Quotes inside names become apostrophes; each entity and edge is there once."""
    name = F.replace(F.coalesce("name", F.lit("")), F.lit('"'), F.lit("'"))
    nodes = entities.dropDuplicates(["uuid"]).select(F.lit(0).alias("part"), F.col("uuid").alias("key"), F.concat(F.lit('  "'), "uuid", F.lit('" [label="'), name, F.lit('"];')).alias("line"))
    weight = F.format_string("%.3f", F.coalesce(F.col("strength").cast("double"), F.lit(0.0)))
    line = F.concat(F.lit('  "'), "from_entity", F.lit('" -> "'), "to_entity", F.lit('" [label="'), F.coalesce("relation_type", F.lit("")), F.lit('", weight='), weight, F.lit("];"))
    return nodes.union(edges.where("from_entity is not null and to_entity is not null").select(F.lit(1), "uuid", line))


def write_dot(lines: DataFrame, path: str) -> None:
    """Write a graph document as text files in order of part and key, framed by its first and last line."""
    frame = lines.sparkSession.createDataFrame([(-1, "", "digraph {"), (2, "", "}")], "part int, key string, line string")
    lines.union(frame).orderBy("part", "key").select("line").write.text(path)
