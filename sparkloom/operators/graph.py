"""Graph operators over edges (subject, predicate, object, confidence) as bounded loops of joins.

Loops run at most their depth; each round's frontier is reduced to one row a node before it is joined, nodes already
reached are taken out by an anti-join, and lineage is cut by a written table where a loop may run long.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import numbered
from sparkloom.session import cut


def directed(edges: DataFrame, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """src, dst, predicate, confidence, subject, object: steps that a walk may take. An undirected match is the union of both
    directions, so that it stays an equi-join."""
    e = edges if predicate is None else edges.where(F.col("predicate") == predicate)
    cols = ["predicate", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "subject", "object"]
    out = e.select(F.col("subject").alias("src"), F.col("object").alias("dst"), *cols)
    back = e.select(F.col("object").alias("src"), F.col("subject").alias("dst"), *cols)
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def bfs(steps: DataFrame, roots: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, depth: least number of steps (src, dst) from any root (node). keep filters a frontier."""
    pairs = steps.select("src", "dst").distinct()
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(pairs, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        if keep is not None:
            new = keep(new)
        frontier = cut(new) if d % 2 == 0 else new
        seen = seen.unionByName(frontier)
    return seen


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int = 2, direction: str = "both", predicate: str | None = None, max_nodes: int = 500) -> DataFrame:
    """Nodes within depth steps, nearest first: node, depth; at most max_nodes (a report's limit), ties by name."""
    return bfs(directed(edges, direction, predicate), roots, min(depth, 4)).orderBy("depth", "node").limit(max_nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n, F.col("subject") == F.col("node"), "left_semi").join(n, F.col("object") == F.col("node"), "left_semi")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 8, direction: str = "out") -> DataFrame:
    """source, target, path, length for pairs (source, target); of equal paths the one whose last step has the greatest
    confidence, then the least predicate and node. A search is kept to one path a node and source, or where there are fewer
    targets, to one a node and target: both find the same paths."""
    n = pairs.agg(F.count_distinct("source").alias("s"), F.count_distinct("target").alias("t")).first()
    if n["t"] <= n["s"]:
        return _paths_from_targets(directed(edges, direction), pairs, max_depth)
    steps = directed(edges, direction)
    best = Window.partitionBy("src", "dst").orderBy(F.col("confidence").desc(), "predicate")
    steps = steps.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("src", "dst", "confidence", "predicate")
    seen = pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(0).alias("length"))
    frontier = seen
    one = Window.partitionBy("source", "dst").orderBy(F.col("confidence").desc(), "predicate", "node")
    for d in range(1, max_depth + 1):
        grown = frontier.join(steps, F.col("node") == F.col("src")).withColumn("_rn", F.row_number().over(one)).where("_rn = 1")
        grown = grown.select("source", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), F.lit(d).alias("length"))
        frontier = cut(grown.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return pairs.join(seen.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "path", "length")


def _paths_from_targets(steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """shortest_paths, searched from the targets against the steps.

    Of equal paths to a target their last steps are compared first, then those before. So paths of one length are ranked as
    they grow: by the rank of the path that they put a step before, then by this step. The last round keeps sources only.
    """
    steps = steps.select("src", "dst", (-F.col("confidence")).alias("less"), "predicate")
    sources = cut(pairs.select(F.col("source").alias("src")).where("src IS NOT NULL").distinct())
    frontier = cut(pairs.select("target").where("target IS NOT NULL").distinct().select(F.col("target").alias("node"), "target", F.array("target").alias("path"), F.monotonically_increasing_id().alias("rank")))
    reached = [frontier.select("node", "target", "path", F.lit(0).alias("length"))]
    for d in range(1, max_depth + 1):
        last = d == max_depth
        onward = steps.join(sources, "src", "left_semi") if last else steps
        grown = onward.join(frontier.select(F.col("node").alias("dst"), "target", "rank"), "dst").groupBy(F.col("src").alias("node"), "target")
        # Paths of other nodes have other ranks, so the least rank is one path, and the step before it decides between parallel ones.
        grown = grown.agg(F.min("rank").alias("rank")) if last else grown.agg(F.min(F.struct("rank", "less", "predicate")).alias("best")).select("node", "target", "best.*")
        seen = reached[0].select("node", "target")
        for r in reached[1:]:
            seen = seen.unionByName(r.select("node", "target"))
        grown = grown.join(seen, ["node", "target"], "left_anti").join(frontier.select("rank", "path"), "rank").withColumn("path", F.array_prepend("path", F.col("node")))
        if not last:
            # Partitions are ranges in order, so numbers that grow with the partition rank the paths.
            grown = grown.orderBy("rank", "less", "predicate", "node").withColumn("rank", F.monotonically_increasing_id())
        frontier = cut(grown.select("node", "target", "path", "rank"))
        reached.append(frontier.select("node", "target", "path", F.lit(d).alias("length")))
        if frontier.isEmpty():
            break
    found = reached[0]
    for r in reached[1:]:
        found = found.unionByName(r)
    return pairs.join(found.withColumnRenamed("node", "source"), ["source", "target"]).select("source", "target", "path", "length")


def triple_closure(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """Triples met within hops steps of the roots: subject, predicate, object, depth, confidence 1 / depth."""
    near = bfs(directed(edges, direction), roots, hops - 1).select("node", "depth")
    ends = edges.select("subject", "predicate", "object", F.explode(F.array("subject", "object")).alias("node")) if direction == "both" else edges.select("subject", "predicate", "object", F.col("subject").alias("node"))
    met = ends.join(near, "node").groupBy("subject", "predicate", "object").agg((F.min("depth") + 1).alias("depth"))
    return met.withColumn("confidence", 1.0 / F.col("depth"))


def follow(pointers: DataFrame, max_hops: int = 10) -> DataFrame:
    """node -> final over pointers (node, next): up to max_hops hops, the last node reached on a cycle or longer chain."""
    p = pointers.select("node", "next").where("next IS NOT NULL")
    out = pointers.select("node", F.coalesce("next", "node").alias("final"), F.when(F.col("next").isNull(), F.array("node")).otherwise(F.array("node", "next")).alias("trail"))
    hop = p.select(F.col("node").alias("at"), F.col("next").alias("onward"))
    for _ in range(max_hops - 1):
        out = out.join(hop, F.col("final") == F.col("at"), "left")
        fresh = F.col("onward").isNotNull() & ~F.array_contains("trail", F.col("onward"))
        out = out.select("node", F.when(fresh, F.col("onward")).otherwise(F.col("final")).alias("final"), F.when(fresh, F.array_append("trail", F.col("onward"))).otherwise(F.col("trail")).alias("trail"))
    return out.select("node", "final", (F.size("trail") - 1).alias("hops"))


def chain_ends(pointers: DataFrame) -> DataFrame:
    """node -> final over pointers (node, next): the end of the whole chain, however long; on a cycle, or into one, the cycle's
    least node.

    Pointers are doubled until none is open. Only open ones look up others, so that an end many nodes share is no hot key.
    """
    to = F.coalesce("next", "node")
    known = cut(pointers.select("node", to.alias("at"), F.least(F.col("node"), to).alias("low"), F.col("next").isNull().alias("done")))
    n = left = known.where("NOT done").count()
    hops = lambda: known.select(F.col("node").alias("at"), F.col("at").alias("onward"), F.col("low").alias("low_on"), F.col("done").alias("done_on"))
    reach = 1
    # What is still open after as many hops as there are pointers is on a cycle.
    while left and reach <= n:
        moved = known.where("NOT done").join(hops(), "at", "left")
        moved = moved.select("node", F.coalesce("onward", "at").alias("at"), F.least("low", "low_on").alias("low"), F.coalesce("done_on", F.lit(True)).alias("done"))
        known, reach = cut(known.where("done").unionByName(moved)), 2 * reach
        left = known.where("NOT done").count()
    ended = known.where("done").select("node", F.col("at").alias("final"))
    if not left:
        return ended
    return ended.unionByName(known.where("NOT done").select("node", "at").join(hops().select("at", "low_on").distinct(), "at").select("node", F.col("low_on").alias("final")))


def chain_origin(versions: DataFrame) -> DataFrame:
    """id -> origin over versions (id, supersedes): the first of its chain."""
    f = chain_ends(versions.select(F.col("id").alias("node"), F.col("supersedes").alias("next")))
    return f.select(F.col("node").alias("id"), F.col("final").alias("origin"))


def chain_head(versions: DataFrame) -> DataFrame:
    """id -> head: the latest of its chain."""
    back = versions.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("node"), F.col("id").alias("next"))
    rows = versions.select(F.col("id").alias("node")).join(back, "node", "left")
    return chain_ends(rows).select(F.col("node").alias("id"), F.col("final").alias("head"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree."""
    ends = edges.select(F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("object").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def strengths(edges: DataFrame) -> DataFrame:
    """a, b (unordered), weight: the sum of confidence times occurrences, and the number of triples."""
    return edges.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.sum(F.col("confidence") * F.col("occurrence_count")).alias("weight"), F.count(F.lit(1)).alias("triples"))


def symmetric(edges: DataFrame, predicates: list[str]) -> DataFrame:
    """Edges with the flipped row of each edge of a symmetric predicate."""
    flipped = edges.where(F.col("predicate").isin(predicates)).select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"), *[c for c in edges.columns if c not in ("subject", "predicate", "object")])
    return edges.unionByName(flipped).dropDuplicates(["subject", "predicate", "object"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). Each round takes the least label nearby, then that label's own label, until nothing
    changes. Tables are written before each join, so that both sides are plain shuffles whose hot keys can be split."""
    ends = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        heard = ends.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        told = cut(labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component")))
        # A label that names itself has nothing above it, so only nodes whose label does are joined by it.
        above = told.where("node != component").select(F.col("node").alias("component"), F.col("component").alias("above"))
        above = cut(above.join(told.select("component").distinct(), "component", "left_semi"))
        told = cut(told.join(above, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = told.drop("old")
        if told.where("old != component").isEmpty():
            return labels


def label_propagation(weighted: DataFrame, rounds: int = 20) -> DataFrame:
    """node, label over undirected edges (a, b, weight): synchronous rounds, the heaviest label nearby, ties to the least.

    A node's own label counts with its heaviest edge, which keeps two-sided graphs from swapping labels forever.
    """
    edges = cut(weighted.select("a", "b", "weight"))
    g = numbered.numbered(edges)
    return _spread(edges, rounds) if g is None else g.named(label=numbered.spread_labels(g, rounds))


def _spread(weighted: DataFrame, rounds: int) -> DataFrame:
    """label_propagation by joins, for graphs that are not numbered."""
    both = cut(weighted.select("a", "b", "weight").unionByName(weighted.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    own = both.groupBy(F.col("a").alias("node")).agg(F.max("weight").alias("weight"))
    for r in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node"), "label").agg(F.sum("weight").alias("weight"))
        votes = votes.unionByName(labels.join(own, "node").select("node", "label", "weight")).groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        best = Window.partitionBy("node").orderBy(F.col("weight").desc(), "label")
        new = cut(votes.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("node", "label"))
        if r % 3 == 2 and new.join(labels.withColumnRenamed("label", "old"), "node").where("label != old").isEmpty():
            return new
        labels = new
    return labels


def local_moves(edges: DataFrame, rounds: int = 12, settled: int = 200) -> DataFrame:
    """node, label over undirected edges (part, a, b, weight; a self-loop once): communities by moves that raise modularity.

    Each round a node looks at its neighbours' communities and takes the one of greatest gain; half of the nodes, by a hash
    that changes with the round, may move, so that neighbours don't swap for ever. It ends when less than one node in `settled`
    would move. Each part is a graph of its own. A round writes two tables: communities' totals and nodes' labels.
    """
    both = cut(edges.select("part", "a", "b", "weight").unionByName(edges.select("part", F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    degree = both.groupBy("part", F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    two_m = cut(degree.groupBy("part").agg(F.sum("k").alias("two_m")))
    state = cut(degree.join(two_m, "part").select("node", "k", "two_m", F.col("node").alias("label"), F.lit(True).alias("would")))
    steps = cut(both.where("a != b").groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight")))
    n = state.count()
    for r in range(rounds):
        totals = cut(state.groupBy("label").agg(F.sum("k").alias("total")))
        near = steps.join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        here = state.select("node", "label", F.lit(0.0).alias("w"))
        near = near.unionByName(here).groupBy("node", "label").agg(F.sum("w").alias("w"))
        rated = near.join(state.select("node", "k", "two_m", F.col("label").alias("own")), "node").join(totals, "label")
        at_home = F.col("label") == F.col("own")
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(at_home, F.col("k")).otherwise(0.0)) / F.col("two_m"), 9)
        best = rated.groupBy("node", "k", "two_m", "own").agg(F.max_by("label", F.struct(gain, at_home, -F.xxhash64("label"))).alias("best"), F.max(gain).alias("g"), F.max(F.when(at_home, gain)).alias("h"))
        may, would = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0, F.col("g") > F.col("h")
        state = cut(best.select("node", "k", "two_m", F.when(may & would, F.col("best")).otherwise(F.col("own")).alias("label"), would.alias("would")))
        if state.where("would").count() * settled < n or not n:
            break
    return state.select("node", "label")


def merged(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges (part, a, b, weight) between labels instead of nodes; edges within a label are its self-loop."""
    named = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    return named.groupBy("part", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("weight").alias("weight"))


#: Levels of a search for communities, and rounds of moves at each.
LEVELS, ROUNDS = 5, 12


def communities(edges: DataFrame, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """node, label over undirected edges (part, a, b, weight): local moves, then moves of whole communities as nodes, until none
    joins another. A community is named by its least node."""
    graph_ = cut(edges)
    labels = up = cut(local_moves(graph_, rounds))
    for _ in range(levels - 1):
        graph_ = cut(merged(graph_, up))
        up = cut(local_moves(graph_, rounds))
        if up.where("node != label").isEmpty():
            break
        labels = cut(labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")))
    first = labels.groupBy("label").agg(F.min("node").alias("name"))
    return labels.join(first, "label").select("node", F.col("name").alias("label"))


def two_level_communities(weighted: DataFrame, least: int = 3) -> DataFrame:
    """node, community, sub_community over undirected edges (a, b, weight): communities, and within each of `least` nodes or more
    its own communities, all of them searched at once; a smaller one is its own only sub-community."""
    edges = cut(_plain(weighted))
    g = numbered.numbered(edges)
    if g is not None:
        top_ = numbered.top_communities(g, LEVELS, ROUNDS)
        return g.named(community=top_, sub_community=numbered.inner_communities(g, top_, least, LEVELS, ROUNDS))
    return _two_levels(edges, least)


def top_communities(weighted: DataFrame) -> DataFrame:
    """node, community: the upper of the two levels alone."""
    edges = cut(_plain(weighted))
    g = numbered.numbered(edges)
    return communities(edges).withColumnRenamed("label", "community") if g is None else g.named(community=numbered.top_communities(g, LEVELS, ROUNDS))


def _plain(weighted: DataFrame) -> DataFrame:
    return weighted.where("a != b").select(F.lit("").alias("part"), "a", "b", "weight")


def _two_levels(edges: DataFrame, least: int) -> DataFrame:
    """two_level_communities by joins, for graphs that are not numbered."""
    top = cut(communities(edges).withColumnRenamed("label", "community"))
    size = top.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    inside = edges.drop("part").join(top.select(F.col("node").alias("a"), F.col("community").alias("part")), "a").join(top.select(F.col("node").alias("b"), F.col("community").alias("other")), "b").where("part = other")
    inside = inside.join(size.select(F.col("community").alias("part")), "part", "left_semi").select("part", "a", "b", "weight")
    low = communities(inside).select("node", F.col("label").alias("sub"))
    return top.join(low, "node", "left").select("node", "community", F.coalesce("sub", "community").alias("sub_community"))


def community_names(membership: DataFrame, paths: DataFrame) -> DataFrame:
    """label, name, nodes of communities of two nodes or more: the commonest folder of members' paths (node, path), ties by name."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")).otherwise("root")
    votes = membership.join(paths.select("node", folder.alias("name")), "node").groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("label").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    return membership.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 2").join(best, "label", "left").select("label", F.coalesce("name", F.lit("root")).alias("name"), "nodes")


def cohesion(weighted: DataFrame, membership: DataFrame) -> DataFrame:
    """label, nodes, internal edges, cohesion: edges inside over pairs of members."""
    inside = weighted.join(membership.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(membership.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
    n = membership.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    e = inside.groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("internal"))
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    return n.join(e, "label", "left").select("label", "nodes", F.coalesce("internal", F.lit(0)).alias("internal"), F.when(pairs > 0, F.coalesce("internal", F.lit(0)) / pairs).otherwise(0.0).alias("cohesion"))


def modularity(weighted: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the modularity of a membership."""
    named = weighted.join(membership.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(membership.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    total = named.agg(F.sum("weight").alias("m"))
    ends = named.select(F.col("la").alias("label"), "weight").unionByName(named.select(F.col("lb").alias("label"), "weight"))
    tot = ends.groupBy("label").agg(F.sum("weight").alias("k"))
    inn = named.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("w"))
    rows = tot.join(inn, "label", "left").join(F.broadcast(total))
    return rows.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, betweenness over undirected edges (a, b) from the given sources (node): Brandes' dependencies, summed.

    Every source needs the whole graph, so it is broadcast, as numbers: four bytes an edge and direction, and nodes' names.
    """
    import numpy as np

    pairs = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    # Edges come to the driver as numbers, in Arrow's columns; names come once a node.
    ids = [nodes.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id")) for x in "ab"]
    named = nodes.toPandas().sort_values("id")
    known = named["id"].to_numpy()
    coded = pairs.join(ids[0], "a").join(ids[1], "b").select("a_id", "b_id").toArrow()
    a, b = (np.searchsorted(known, coded.column(x).to_numpy()).astype(np.int32) for x in ("a_id", "b_id"))
    names = named["node"].to_numpy(object)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    held = edges.sparkSession.sparkContext.broadcast((names, np.searchsorted(src[order], np.arange(len(names) + 1)), dst[order]))

    def run(batches):  # noqa: ANN001, ANN202
        names_, first, to = held.value
        wanted = [s for pdf in batches for s in pdf["node"]]
        if not wanted:
            return
        index = {v: i for i, v in enumerate(names_)}
        total = numbered.dependencies(first, to, np.array([index[s] for s in wanted if s in index], np.int64))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"node": names_[hit].astype(str), "part": total[hit]})

    # Dealt out by number of tasks: a few bytes of names are much work, and adaptive execution would put them into one task. Names of
    # one kind stay together, as searches that run side by side read the fewest edges where they reach like nodes at a time.
    tasks = 8 * edges.sparkSession.sparkContext.defaultParallelism
    parts = sources.select("node").repartitionByRange(tasks, "node").sortWithinPartitions("node").mapInPandas(run, "node string, part double")
    return parts.groupBy("node").agg(F.sum("part").alias("betweenness"))


def flows(calls: DataFrame, entries: DataFrame, depth: int = 10, branch: int = 4, steps: int = 2000) -> DataFrame:
    """entry, path of traces along calls (source, target) from entries (entry): up to depth nodes, branch calls a node in
    order of name, no node twice; a trace ends at a leaf, at the depth, or where every call would close a cycle.

    An entry's paths are looked at level by level, in order, and no more than `steps` of them: those beyond are given up.
    """
    own = Window.partitionBy("source").orderBy("target")
    # The first calls of a node are its branches; branching is a parameter of the trace, not a cut of the data.
    first = calls.select("source", "target").distinct().withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= branch)
    nexts = cut(first.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("nexts")))
    live = entries.select("entry", F.array("entry").alias("path"), F.lit(0).alias("used"))
    level, whole = Window.partitionBy("entry").orderBy("path"), Window.partitionBy("entry")
    done: list[DataFrame] = []
    for k in range(1, depth + 1):
        # A level has at most branch * steps paths an entry.
        live = live.withColumns({"_rn": F.row_number().over(level) + F.col("used"), "_n": F.count(F.lit(1)).over(whole)}).where(F.col("_rn") <= steps)
        at = live.withColumn("used", F.least(F.col("used") + F.col("_n"), F.lit(steps)).cast("int")).withColumn("source", F.element_at("path", -1)).join(nexts, "source", "left")
        onward = at.withColumn("onward", F.filter(F.coalesce("nexts", F.array().cast("array<string>")), lambda t: ~F.array_contains(F.col("path"), t)))
        onward = cut(onward.select("entry", "path", "used", "onward"))
        stop = (F.size("onward") == 0) | F.lit(k == depth)
        done.append(onward.where(stop & (F.size("path") >= 2)).select("entry", "path"))
        live = onward.where(~stop).select("entry", F.explode("onward").alias("t"), "path", "used").select("entry", F.array_append("path", F.col("t")).alias("path"), "used")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def containments(members: DataFrame, group: str, key: str) -> DataFrame:
    """inner, outer: groups all of whose keys another group has, over distinct members (group, key).

    An outer group has the inner one's rarest key, so only the groups that share that key are compared.
    """
    sets = members.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    common = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rarest = members.join(common, key).groupBy(group).agg(F.min_by(key, F.struct("n", key)).alias("rarest"))
    inner = cut(sets.join(rarest, group).select(F.col(group).alias("inner"), F.col("rarest").alias("k"), F.col("keys").alias("inner_keys")))
    outer = cut(members.join(sets, group).select(F.col(group).alias("outer"), F.col(key).alias("k"), "keys"))
    fits = (F.size("inner_keys") <= F.size("keys")) & (F.size(F.array_except("inner_keys", "keys")) == 0)
    return inner.join(outer, "k").where((F.col("inner") != F.col("outer")) & fits).select("inner", "outer")


def impact(calls: DataFrame, roots: DataFrame, direction: str = "up", depth: int = 5, exclude: Column | None = None) -> DataFrame:
    """node, depth, risk of what a change reaches over calls (source, target): callers (up) or callees (down)."""
    src, dst = ("target", "source") if direction == "up" else ("source", "target")
    steps = calls.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    reached = bfs(steps, roots, depth, None if exclude is None else lambda df: df.where(~exclude)).where("depth > 0")
    return reached.withColumn("risk", F.when(F.col("depth") == 1, "high").when(F.col("depth") <= 3, "medium").otherwise("low"))


def sparql(triples: DataFrame, patterns: list[tuple[str, str, str]], *, where: Column | None = None, optional: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """A basic graph pattern over (subject, predicate, object): terms that start with ? are variables; patterns join on the
    variables they share, optional ones as left joins; where filters."""

    def one(p: tuple[str, str, str]) -> DataFrame:
        df = triples
        names: dict[str, str] = {}
        for term, col in zip(p, ("subject", "predicate", "object"), strict=True):
            if not term.startswith("?"):
                df = df.where(F.col(col) == term)
            elif term[1:] in names.values():
                df = df.where(F.col(col) == F.col(next(k for k, v in names.items() if v == term[1:])))
            else:
                names[col] = term[1:]
        return df.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()

    out = one(patterns[0])
    for how, ps in (("inner", patterns[1:]), ("left", optional or [])):
        for p in ps:
            right = one(p)
            shared = [c for c in right.columns if c in out.columns]
            out = out.join(right, shared, how) if shared else out.join(F.broadcast(right))
    return out if where is None else out.where(where)
