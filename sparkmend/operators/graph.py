"""Graph operators over an edge table (src, dst, relation): reach, paths, closures, degrees, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.operators.shared import written


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: ends at the node, both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, plane: str, k: int = 5, above: int = 2) -> DataFrame:
    """plane, node, degree: the k nodes of most ends in each plane, if more than `above`."""
    d = degrees(edges).join(nodes, "node").where(F.col("degree") > above)
    w = Window.partitionBy(plane).orderBy(F.desc("degree"), "node")
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select(plane, "node", "degree")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """node, depth, relation: nodes reached from the seeds within `depth` steps src to dst, at the first step that reaches them.

    `relation` is that step's, the least by name of several; seeds have depth 0. A round joins the frontier with the edges and
    drops what was seen; rounds are written, so the plan doesn't grow.
    """
    step = edges.select("src", "dst", "relation")
    if undirected:
        step = step.union(edges.select("dst", "src", "relation"))
    seen = written(seeds.select(F.col("node")).distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation")), "reach")
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.select(F.col("node").alias("src")).join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.min("relation").alias("relation"))
        new = new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "relation")
        frontier = written(new, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def retraction(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """node, depth, strength of all that rests on the seeds: strong by derived_from, weak by informed_by, as the first step says."""
    back = edges.where(F.col("relation").isin("derived_from", "informed_by")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    out = reach(back, seeds, depth).where("depth > 0")
    return out.select("node", "depth", F.when(F.col("relation") == "derived_from", "strong").otherwise("weak").alias("strength"))


def highest_upstream(edges: DataFrame, ranks: DataFrame, relations: list[str], depth: int = 6) -> DataFrame:
    """node, rank: the highest rank of a node and what it rests on, up to `depth` steps; ranks move along edges, no node's ancestors are listed."""
    step = edges.where(F.col("relation").isin(*relations)).select("src", "dst").distinct()
    now = ranks
    for _ in range(depth):
        upward = step.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "rank")
        now = written(now.union(upward).groupBy("node").agg(F.max("rank").alias("rank")), "ranks")
    return now


def shortest_paths(edges: DataFrame, start, goal, most: int = 12) -> DataFrame:
    """hop, node of one undirected shortest path; of several, each hop back takes the least node. No row without a path."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    kind = edges.schema["src"].dataType.simpleString()
    seen = written(spark.createDataFrame([(start, 0, None)], f"node {kind}, depth int, parent {kind}"), "path")
    frontier, found = seen, start == goal
    for d in range(1, most + 1):
        if found:
            break
        new = frontier.select(F.col("node").alias("src")).join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")).join(seen.select("node"), "node", "left_anti")
        frontier = written(new.select("node", F.lit(d).alias("depth"), "parent"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        found = not frontier.where(F.col("node") == goal).isEmpty()
    hops, at = [], goal
    while found:  # at most `most` + 1 look-ups
        row = seen.where(F.col("node") == at).first()
        hops.append((row.depth, at))
        if row.parent is None:
            break
        at = row.parent
    return spark.createDataFrame(hops, f"hop int, node {kind}")


def neighbours(edges: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """node, way, relation, others: up to `most` neighbours by relation and direction, the least first."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("way"), "relation", F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("node"), F.lit("in").alias("way"), "relation", F.col("src").alias("other"))
    near = out.union(into).join(nodes.select("node").distinct(), "node", "left_semi")
    w = Window.partitionBy("node", "way", "relation").orderBy("other")
    return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).groupBy("node", "way", "relation").agg(F.sort_array(F.collect_list("other")).alias("others"))


def shared_members(rows: DataFrame, item: str, group: str, cap: int = 1000) -> DataFrame:
    """a, b (a < b), groups: items that share a group, and how many. Groups over `cap` raise an error: they would make a square of pairs."""
    largest = rows.groupBy(group).agg(F.count_distinct(item).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > cap:
        raise ValueError(f"a group has {largest} members; link items to their group instead of to one another")
    gathered = rows.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("m"))
    pairs = gathered.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"))


def communities(edges: DataFrame, small: int = 3, rounds: int = 24) -> DataFrame:
    """node, community: Louvain's local moves over the whole graph, then small communities join the neighbour they have most edges to.

    In a round half of the nodes, by a hash of node and round, see what each neighbouring community would gain them and move to the best (ties:
    the own, then the least); the others stand still, so no two change places for ever. A round is joins and
    partial sums over all edges, so neither a giant component nor a hub is one task's work. Rounds end when nothing has moved twice
    running. Runs agree. A community is named by its least node.
    """
    ends = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("x")).select("x.*")
    near = written(ends.groupBy("node", "other").agg(F.count(F.lit(1)).cast("double").alias("w")), "weights")
    degrees = near.groupBy("node").agg(F.sum("w").alias("degree"))
    labels = written(degrees.select("node", "degree", F.col("node").alias("label")), "labels")
    mass = near.agg(F.sum("w")).first()[0] or 1.0
    still = 0
    for r in range(rounds):
        held = labels.groupBy("label").agg(F.sum("degree").alias("held"))
        pulls = near.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("w").alias("pull"))
        pulls = pulls.union(labels.select("node", "label", F.lit(0.0))).groupBy("node", "label").agg(F.sum("pull").alias("pull")).join(held, "label")
        mine = labels.select("node", "degree", F.col("label").alias("own")).where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        gain = F.col("pull") - (F.col("held") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0.0)) * F.col("degree") / mass
        best = pulls.join(mine, "node").groupBy("node").agg(F.min_by("label", F.struct(-F.round(gain, 9), F.col("label") != F.col("own"), F.col("label"))).alias("best"))
        moved = written(labels.join(best, "node", "left").select("node", "degree", F.coalesce("best", "label").alias("label"), (F.col("best") != F.col("label")).alias("moved")), "labels")
        still = 0 if moved.where("moved").limit(1).count() else still + 1
        labels = moved.select("node", "degree", "label")
        if still == 2:
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sized = written(labels.join(sizes, "label").select("node", "label", "size"), "sized_labels")
    large = sized.where(F.col("size") >= small).select(F.col("node").alias("other"), F.col("label").alias("next"))
    pulled = near.join(sized.where(F.col("size") < small).select("node"), "node").join(large, "other").groupBy("node", "next").agg(F.sum("w").alias("w"))
    joined = pulled.groupBy("node").agg(F.min_by("next", F.struct(-F.col("w"), F.col("next"))).alias("next"))
    final = written(sized.join(joined, "node", "left").select("node", F.coalesce("next", "label").alias("label")), "communities")
    return final.join(final.groupBy("label").agg(F.min("node").alias("community")), "label").select("node", "community")


def members_named_in(texts: DataFrame, key: str, text: str, members: DataFrame, least: int = 2) -> DataFrame:
    """key, community, n: communities of which a text names `least` members or more. Names are met word by word: an equi-join on each name's longest word."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    longest = F.array_max(F.transform(words(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    names = members.where(F.length("name") > 3).select("community", "name", longest.alias("w"))
    held = texts.select(F.col(key), F.lower(text).alias("__t"), F.explode(words(F.col(text))).alias("w"))
    hit = held.join(names, "w").where(F.contains("__t", F.lower("name"))).select(key, "community", "name").distinct()
    return hit.groupBy(key, "community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def beam(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, each: int = 15, most: int = 60) -> DataFrame:
    """src, relation, dst: edges at the first `each` nodes of the chosen communities, in order, `most` of them."""
    w = Window.partitionBy("community").orderBy("node")
    first = nodes.join(chosen.select("community"), "community", "left_semi").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= each).select("node").distinct()
    out = edges.join(first.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "relation", "dst")
    into = edges.join(first.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "relation", "dst")
    return out.union(into).distinct().orderBy("src", "relation", "dst").limit(most)


def derivation_depth(edges: DataFrame, nodes: DataFrame, relations: tuple[str, ...] = ("derived_from", "informed_by"), most: int = 6) -> DataFrame:
    """node, depth: the longest chain of such steps from the node, up to `most`; lengths move along edges, no chain is listed."""
    step = edges.where(F.col("relation").isin(*relations)).select("src", "dst").distinct()
    now = nodes.select("node", F.lit(0).alias("depth"))
    for _ in range(most):
        longer = step.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.least(F.col("depth") + 1, F.lit(most)).alias("depth"))
        now = written(now.union(longer).groupBy("node").agg(F.max("depth").alias("depth")), "depths")
    return now
