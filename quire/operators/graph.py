"""Property graphs: nodes (node_id, node_type, label, weight), edges (source_id, target_id, relation_type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.components import connected_components
from quire.plans.storage import materialize, partitions_for

KEY = ["source_id", "target_id", "relation_type"]


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (source, target, type): the most confident."""
    return edges.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))


def co_occurrence(members: DataFrame) -> DataFrame:
    """(a, b, doc_id) for each pair a < b of clusters that share a document; the first such document.

    members: (doc_id, cluster_id). A document's pairs grow with the square of its clusters, as the result does; members and pairs are
    counted first, and dealt out by their number before they are grouped: nearly all pairs differ, and a task would hold all of its own.
    """
    spark, m = members.sparkSession, members.select("doc_id", "cluster_id")
    m = m.repartition(partitions_for(spark, m.count()), "doc_id").distinct()
    n = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0] or 0
    a, b = m.withColumnRenamed("cluster_id", "a"), m.withColumnRenamed("cluster_id", "b")
    pairs = a.join(b, "doc_id").where("a < b").repartition(partitions_for(spark, n), "a", "b")
    return pairs.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes in ids, and the edges with both ends there."""
    ids = ids.select("node_id").distinct()
    inside = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi"
    )
    return nodes.join(ids, "node_id", "left_semi"), inside


def query_nodes(nodes: DataFrame, condition: Column | str, limit: int) -> DataFrame:
    """The heaviest nodes that meet a condition; ties by node_id."""
    return nodes.where(condition).orderBy(F.desc("weight"), "node_id").limit(limit)


def query_edges(edges: DataFrame, condition: Column | str, limit: int) -> DataFrame:
    """The most confident edges that meet a condition; ties by their key."""
    return edges.where(condition).orderBy(F.desc("confidence"), *KEY).limit(limit)


def top_predicates(edges: DataFrame, n: int) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n_edges")).orderBy(F.desc("n_edges"), "relation_type").limit(n)


def _both(edges: DataFrame) -> DataFrame:
    forward = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return forward.unionByName(forward.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def distances(edges: DataFrame, starts: DataFrame, depth: int | None = None, until: str | None = None) -> DataFrame:
    """(node_id, distance) of every node within so many undirected hops of the starts (node_id), or of all that can be reached.

    With until, the search ends with the hop that finds that node.
    """
    ways = materialize(_both(edges), "ways")
    found = starts.select("node_id").distinct().withColumn("distance", F.lit(0))
    frontier, hop = found, 0
    while depth is None or hop < depth:
        hop += 1
        step = (
            frontier.join(ways, F.col("node_id") == F.col("u"))
            .select(F.col("v").alias("node_id"))
            .distinct()
            .join(found, "node_id", "left_anti")
            .withColumn("distance", F.lit(hop))
        )
        frontier = materialize(step, "frontier")
        found = found.unionByName(frontier)
        if frontier.isEmpty() or until is not None and not frontier.where(F.col("node_id") == until).isEmpty():
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge."""
    return connected_components(edges, "source_id", "target_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges out plus edges in, a self loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """mean, upper median, largest and smallest degree over nodes with an edge; the counts by degree decide."""
    by_degree = degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree")  # a row for each different degree
    ranked = by_degree.select("degree", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranked.agg(
        F.round(F.sum(F.col("degree") * F.col("n")) / F.max("total"), 4).alias("mean_degree"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("degree"))).alias("median_degree"),
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
    )


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, average degree, density, components, self loops and confidence."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.coalesce(F.sum((F.col("source_id") == F.col("target_id")).cast("long")), F.lit(0)).alias("n_self_loops"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )
    parts = components(edges)
    c = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(
        F.count(F.lit(1)).alias("linked"), F.coalesce(F.sum("size"), F.lit(0)).alias("covered"), F.max("size").alias("largest")
    )
    both = n.crossJoin(e).crossJoin(c)  # one row each
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return both.select(
        "n_nodes",
        "n_edges",
        F.round(2 * F.col("n_edges") / F.col("n_nodes"), 4).alias("avg_degree"),
        F.round(F.least(F.col("n_edges") / possible, F.lit(1.0)), 6).alias("density"),
        (F.col("linked") + F.col("n_nodes") - F.col("covered")).alias("n_components"),
        F.coalesce("largest", F.lit(1)).alias("largest_component"),
        "n_self_loops",
        "avg_confidence",
        "min_confidence",
        "max_confidence",
    )


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(position, node_id) of a path of fewest undirected edges, however long; no rows if there is none.

    Of several the one that takes, from the target backwards, the least node at each step. Only the rows of the
    path itself reach the driver; the search ends where it meets the target or nothing new.
    """
    spark = edges.sparkSession
    ways = materialize(_both(edges), "ways")
    found = materialize(distances(edges, spark.createDataFrame([(source,)], "node_id string"), until=target), "distances")
    end = found.where(F.col("node_id") == target).first()
    if end is None:
        return spark.createDataFrame([], "position int, node_id string")
    path = [target]
    for hop in range(end.distance - 1, -1, -1):
        before = ways.where(F.col("u") == path[-1]).join(found.where(F.col("distance") == hop), F.col("v") == F.col("node_id"))
        path.append(before.agg(F.min("node_id")).first()[0])
    return spark.createDataFrame(list(enumerate(reversed(path))), "position int, node_id string")


def simple_paths(edges: DataFrame, source: str, target: str, depth: int = 5) -> DataFrame:
    """(nodes, n_edges) of every undirected path without a repeated node from source to target, of at most so many edges.

    A path ends where it meets the target; from a node to itself there is one path, of no edge. Only nodes from which
    the target lies within what is left of depth carry a path on.
    """
    spark = edges.sparkSession
    ways = materialize(_both(edges).where("u <> v"), "ways")
    near = materialize(distances(edges, spark.createDataFrame([(target,)], "node_id string"), depth), "distances")
    ways = materialize(ways.join(near.select(F.col("node_id").alias("v"), "distance"), "v"), "ways")
    open_paths = spark.createDataFrame([([source],)], "nodes array<string>")
    done = open_paths.where(F.lit(source == target))
    for n in range(1, depth + 1 if source != target else 1):
        step = open_paths.join(ways, F.element_at("nodes", -1) == F.col("u")).where(~F.array_contains("nodes", F.col("v")) & (F.col("distance") <= depth - n))
        step = materialize(step.select(F.concat("nodes", F.array("v")).alias("nodes")), "paths")
        done = done.unionByName(step.where(F.element_at("nodes", -1) == target))
        open_paths = step.where(F.element_at("nodes", -1) != target)
    return done.select("nodes", (F.size("nodes") - 1).alias("n_edges"))


def edge_paths(edges: DataFrame, source: str, target: str, depth: int = 5) -> DataFrame:
    """(edge_ids, nodes, n_edges, weight, confidence): simple_paths with each way to choose among parallel edges.

    edges also have edge_id and weight; weight is the sum of a path's, confidence the least of its edges'.
    """
    paths = materialize(simple_paths(edges, source, target, depth).withColumn("path", F.monotonically_increasing_id()), "paths")
    kept = ["edge_id", "weight", "confidence"]
    there = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), *kept)
    both = there.unionByName(edges.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"), *kept))
    out = paths.select("path", "nodes", "n_edges", F.array().cast("array<string>").alias("edge_ids"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("confidence"))
    for i in range(depth):
        going = out.where(F.col("n_edges") > i).withColumns({"u": F.get("nodes", F.lit(i)), "v": F.get("nodes", F.lit(i + 1))})
        step = going.join(both.withColumnsRenamed({"weight": "w", "confidence": "c"}), ["u", "v"])
        step = step.select("path", "nodes", "n_edges", F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), (F.col("weight") + F.col("w")).alias("weight"), F.least("confidence", "c").alias("confidence"))
        out = out.where(F.col("n_edges") <= i).unionByName(step)
    return out.select("edge_ids", "nodes", "n_edges", F.round("weight", 4).alias("weight"), F.when(F.col("n_edges") > 0, F.col("confidence")).otherwise(0.0).alias("confidence"))


def components_with_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node; one without an edge is its own."""
    found, n = components(edges), nodes.count()
    every = nodes.select(F.col("node_id").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return materialize(every, "components", n)


def stage_of_edge(edge_id: Column, stages: dict[str, str]) -> Column:
    """The stage that made an edge, by what its id begins with up to the first `_`; `unknown` for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])[F.substring_index(edge_id, "_", 1)], F.lit("unknown"))


def density_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_type, n_nodes, n_edges, density): edges with both ends of a type over n (n - 1), uncapped."""
    kinds = nodes.select("node_id", "node_type")
    ends = edges.join(kinds.toDF("source_id", "node_type"), "source_id").join(kinds.toDF("target_id", "other"), "target_id")
    inside = ends.where("node_type = other").groupBy("node_type").agg(F.count(F.lit(1)).alias("n_edges"))
    n = kinds.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    edges_of = F.coalesce("n_edges", F.lit(0))
    return n.join(inside, "node_type", "left").select("node_type", "n_nodes", edges_of.alias("n_edges"), F.round(F.when(possible > 0, edges_of / possible).otherwise(0.0), 10).alias("density"))
