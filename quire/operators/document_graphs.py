"""A knowledge graph for each document, all of them as two tables keyed by document: built, measured and searched together.

A search goes on in rounds of joins over all documents at once; a document that is done takes no further part. Documents of few
parts have a second form, a row each with its nodes and edges in arrays (graphs_in_rows): these are measured and searched without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import once
from quire.plans.components import connected_components
from quire.plans.storage import materialize

_NODE = ["doc_id", "node_id", "node_type", "label", "text", "confidence"]
_EDGE = ["doc_id", "source_id", "target_id", "predicate", "confidence", "negated"]


#: Texts of a document that all its other texts may well be compared with; where there are more, three characters lead from one to the other.
FEW = 32


def _holds(left: DataFrame, right: DataFrame, whole: str, part: str) -> DataFrame:
    """Rows of left with those of right of the same document whose part is in whole, both in lower case.

    Where a document has few parts they meet all its wholes. Else: a text that holds another holds its first three characters, and
    these lead from one to the other; shorter ones meet by document.
    """
    there = left.withColumn("_whole", F.lower(whole))
    here = right.withColumn("_part", F.lower(part)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    met = there.join(here.where(F.col("_n") <= FEW).drop("_n"), "doc_id")
    crowded = right.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("doc_id")
    there = there.join(crowded, "doc_id", "left_semi")
    here = here.where(F.col("_n") > FEW).drop("_n").withColumn("_first", F.substring("_part", 1, 3))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("_whole") - 2, F.lit(1))), lambda i: F.substring("_whole", i, F.lit(3)))
    long = F.char_length("_part") >= 3
    led = there.withColumn("_first", F.explode(F.array_distinct(grams))).join(here.where(long), ["doc_id", "_first"])
    short = there.join(here.where(~long).drop("_first"), "doc_id")
    every = met.unionByName(led.drop("_first")).unionByName(short)
    return every.where(F.contains("_whole", "_part")).drop("_whole", "_part")


def build_graphs(entities: DataFrame, claims: DataFrame, chunks: DataFrame, facts: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (doc_id, node_id, node_type, label, text, confidence) and edges (doc_id, edge_id, source_id, target_id, predicate, confidence, negated).

    entities: (doc_id, entity_id, label, text, confidence, chunk_id); claims: (doc_id, claim_id, label, sentence, confidence, chunk_id); chunks: (doc_id,
    chunk_id, text, confidence); facts: (doc_id, fact_id, label, value, confidence); triples: (doc_id, subject_id, predicate, object_id,
    confidence, negated). Ids are unique in their table and document; of one id in two tables the later table's node stays (facts, chunks, claims,
    entities). Edges: triples; entities and claims with their chunks, both ways; entities with the claims of their chunk that hold their text; facts with
    the entities whose text they hold. edge_id counts a document's edges, edge_0001 on. Texts of chunks are cut at 200 characters.
    """
    kinds = [
        entities.select("doc_id", F.col("entity_id").alias("node_id"), F.lit("entity").alias("node_type"), "label", "text", "confidence"),
        claims.select("doc_id", F.col("claim_id").alias("node_id"), F.lit("claim").alias("node_type"), "label", F.col("sentence").alias("text"), "confidence"),
        chunks.select("doc_id", F.col("chunk_id").alias("node_id"), F.lit("chunk").alias("node_type"), F.lit("chunk").alias("label"), F.substring("text", 1, 200).alias("text"), "confidence"),
        facts.select("doc_id", F.col("fact_id").alias("node_id"), F.lit("fact").alias("node_type"), "label", F.col("value").alias("text"), "confidence"),
    ]
    every = reduce(DataFrame.unionByName, [k.withColumn("kind", F.lit(i)) for i, k in enumerate(kinds)])
    last = every.groupBy("doc_id", "node_id").agg(F.max_by(F.struct("node_type", "label", "text", "confidence"), "kind").alias("n"))
    nodes = last.select("doc_id", "node_id", "n.*").select(*_NODE)

    def edge(rows: DataFrame, source: str, target: str, predicate: Column | str, confidence: Column | str, stage: int, negated: Column | bool = False) -> DataFrame:
        name = predicate if isinstance(predicate, Column) else F.lit(predicate)
        sure = F.col(confidence) if isinstance(confidence, str) else confidence
        return rows.select("doc_id", F.col(source).alias("source_id"), F.col(target).alias("target_id"), name.alias("predicate"), sure.alias("confidence"), F.lit(negated).alias("negated"), F.lit(stage).alias("stage"))

    known = chunks.select("doc_id", "chunk_id").distinct()
    placed, said = entities.join(known, ["doc_id", "chunk_id"], "left_semi"), claims.join(known, ["doc_id", "chunk_id"], "left_semi")
    product = F.round(F.col("confidence") * F.col("_confidence"), 4)
    other = entities.select("doc_id", "entity_id", F.col("text").alias("_text"), F.col("confidence").alias("_confidence"), F.col("chunk_id").alias("_chunk"))
    mentioned = _holds(claims, other, "sentence", "_text").where(F.col("chunk_id").eqNullSafe(F.col("_chunk")))
    referred = _holds(facts, other, "value", "_text")
    edges = reduce(DataFrame.unionByName, [
        edge(triples, "subject_id", "object_id", F.col("predicate"), "confidence", 0, F.col("negated")),
        edge(placed, "entity_id", "chunk_id", "appears_in", "confidence", 1), edge(placed, "chunk_id", "entity_id", "contains_entity", "confidence", 2),
        edge(said, "claim_id", "chunk_id", "appears_in", "confidence", 3), edge(said, "chunk_id", "claim_id", "contains_claim", "confidence", 4),
        edge(mentioned, "entity_id", "claim_id", "mentioned_in", product, 5), edge(referred, "fact_id", "entity_id", "references", product, 6),
    ])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "source_id", "target_id", "predicate", "confidence", "negated"))
    return nodes, edges.withColumn("edge_id", F.format_string("edge_%04d", nth)).select("doc_id", "edge_id", *_EDGE[1:])


def graphs_in_rows(parts: DataFrame) -> DataFrame:
    """(doc_id, nodes, edges): build_graphs with a row for each document, for documents of few parts; no text leaves its row.

    parts: (doc_id, entities, claims, chunks, facts, triples), arrays of structs with the columns that build_graphs takes, doc_id never null. Pairs of
    a document's parts are looked at one by one, so a document of many parts belongs to build_graphs.
    """
    node = lambda rows, key, kind, label, text: F.transform(rows, lambda x: F.struct(x[key].alias("node_id"), F.lit(kind).alias("node_type"), label(x).alias("label"), text(x).alias("text"), x["confidence"].alias("confidence")))
    label = lambda x: x["label"]
    every = F.concat(
        node("facts", "fact_id", "fact", label, lambda x: x["value"]), node("chunks", "chunk_id", "chunk", lambda _: F.lit("chunk"), lambda x: F.substring(x["text"], 1, 200)),
        node("claims", "claim_id", "claim", label, lambda x: x["sentence"]), node("entities", "entity_id", "entity", label, lambda x: x["text"]),
    )
    nodes = once(every, lambda a: once(F.transform(a, lambda x: x["node_id"]), lambda ids: F.filter(a, lambda x, i: F.array_position(ids, x["node_id"]) == i + 1)))

    def edge(source: Column, target: Column, predicate: Column | str, confidence: Column, stage: int, negated: Column | None = None) -> Column:
        name = predicate if isinstance(predicate, Column) else F.lit(predicate)
        no = F.lit(False) if negated is None else negated
        return F.struct(F.lit(stage).alias("stage"), source.alias("source_id"), target.alias("target_id"), name.alias("predicate"), confidence.alias("confidence"), no.alias("negated"))

    def placed(rows: str, key: str, back: str, stage: int) -> list[Column]:
        inside = lambda body: once(F.transform("chunks", lambda c: c["chunk_id"]), lambda known: F.transform(F.filter(rows, lambda x: F.array_contains(known, x["chunk_id"])), body))
        return [inside(lambda x: edge(x[key], x["chunk_id"], "appears_in", x["confidence"], stage)), inside(lambda x: edge(x["chunk_id"], x[key], back, x["confidence"], stage + 1))]

    def held(rows: str, text: str, fits: Callable[[Column, Column], Column], made: Callable[[Column, Column, Column], Column]) -> Column:
        within = lambda x, low: F.filter("entities", lambda e: fits(x, e) & F.contains(low, F.lower(e["text"])))
        sure = lambda x, e: F.round(x["confidence"] * e["confidence"], 4)
        return F.flatten(F.transform(rows, lambda x: once(F.lower(x[text]), lambda low: F.transform(within(x, low), lambda e: made(x, e, sure(x, e))))))

    edges = F.concat(
        F.transform("triples", lambda t: edge(t["subject_id"], t["object_id"], t["predicate"], t["confidence"], 0, t["negated"])), *placed("entities", "entity_id", "contains_entity", 1), *placed("claims", "claim_id", "contains_claim", 3),
        held("claims", "sentence", lambda c, e: c["chunk_id"].eqNullSafe(e["chunk_id"]), lambda c, e, sure: edge(e["entity_id"], c["claim_id"], "mentioned_in", sure, 5)),
        held("facts", "value", lambda f, e: F.lit(True), lambda f, e, sure: edge(f["fact_id"], e["entity_id"], "references", sure, 6)),
    )
    return parts.select("doc_id", nodes.alias("nodes"), edges.alias("edges"))


# What is left out of rows is left out after explode_outer: Spark moves other filters below the arrays, which it would then build again for each step.


def tables_of_rows(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of build_graphs from graphs_in_rows; edges are numbered in the same order."""
    nodes = graphs.select("doc_id", F.explode_outer("nodes").alias("n")).where("n is not null").select("doc_id", "n.*")
    edges = graphs.select("doc_id", F.posexplode_outer(F.sort_array("edges")).alias("i", "e")).where("e is not null")
    return nodes.select(*_NODE), edges.select("doc_id", F.format_string("edge_%04d", F.col("i") + 1).alias("edge_id"), *[f"e.{c}" for c in _EDGE[1:]])


def _ids(nodes: str = "nodes") -> Column:
    return F.transform(nodes, lambda n: n["node_id"])


def _joined(ids: Column, edges: str = "edges") -> Column:
    """The names that edges lead between, a list for each component; a node without edges has its own."""
    pairs = F.array_distinct(F.transform(edges, lambda e: F.struct(F.least(e["source_id"], e["target_id"]).alias("a"), F.greatest(e["source_id"], e["target_id"]).alias("b"))))
    has = lambda g, e: F.array_contains(g, e["a"]) | F.array_contains(g, e["b"])

    def met(groups: Column, e: Column) -> Column:
        one = F.array_union(F.flatten(F.filter(groups, lambda g: has(g, e))), F.array(e["a"], e["b"]))
        known = F.exists(groups, lambda g: F.array_contains(g, e["a"]) & F.array_contains(g, e["b"]))
        return F.when(known, groups).otherwise(F.concat(F.filter(groups, lambda g: ~has(g, e)), F.array(one)))

    return F.aggregate(pairs, F.transform(ids, lambda x: F.array(x)), met)


def statistics_of_rows(graphs: DataFrame) -> DataFrame:
    """graph_statistics of graphs_in_rows."""
    ends = lambda ids: F.size(F.filter("edges", lambda e: F.array_contains(ids, e["source_id"]))) + F.size(F.filter("edges", lambda e: F.array_contains(ids, e["target_id"])))
    of_type = lambda t: F.size(F.filter("nodes", lambda n: n["node_type"] == t)).cast("long")
    by_type = [of_type(t).alias(f"n_{t}s".replace("entitys", "entities")) for t in ("entity", "claim", "chunk", "fact")]
    parts = lambda ids: F.size(F.filter(_joined(ids), lambda g: F.arrays_overlap(g, ids)))
    counted = graphs.where(F.size("nodes") > 0).select(
        "doc_id", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), once(_ids(), ends).cast("long").alias("ends"), once(_ids(), parts).cast("long").alias("n_components"), *by_type,
    )
    return _measured(counted)


def neighborhoods_of_rows(graphs: DataFrame, asked: Column, depth: int = 1) -> DataFrame:
    """(doc_id, node_id, distance) of the nodes within depth of asked, a node of each row of graphs_in_rows."""
    start = F.struct(F.array(F.struct(F.col("asked").alias("node_id"), F.lit(0).alias("distance"))).alias("seen"), F.array("asked").alias("front"))
    seen = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), start, lambda acc, d: once(_next(acc["front"], F.transform(acc["seen"], lambda x: x["node_id"])), lambda new: F.struct(
        F.concat(acc["seen"], F.transform(new, lambda x: F.struct(x.alias("node_id"), d.alias("distance")))).alias("seen"), new.alias("front"),
    )), lambda acc: acc["seen"])
    found = once(_ids(), lambda ids: F.when(F.array_contains(ids, F.col("asked")), F.filter(seen, lambda x: F.array_contains(ids, x["node_id"]))))
    at = graphs.select("doc_id", "nodes", "edges", asked.alias("asked"))
    return at.select("doc_id", F.explode_outer(found).alias("x")).where("x is not null").select("doc_id", "x.*")


def _next(front: Column, seen: Column, edges: str = "edges") -> Column:
    """Names one edge away from the front that are not among seen."""
    there = F.transform(F.filter(edges, lambda e: F.array_contains(front, e["source_id"])), lambda e: e["target_id"])
    back = F.transform(F.filter(edges, lambda e: F.array_contains(front, e["target_id"])), lambda e: e["source_id"])
    return F.array_except(F.concat(there, back), seen)


def path_lengths_of_rows(graphs: DataFrame, source: Column, target: Column) -> DataFrame:
    """(doc_id, source_id, target_id, length) of the shortest path between two nodes of each row of graphs_in_rows that has one."""
    start = F.struct(F.array("source_id").alias("seen"), F.array("source_id").alias("front"), F.lit(0).alias("hops"))
    over = lambda acc: (F.size(acc["front"]) == 0) | F.array_contains(acc["front"], F.col("target_id"))
    on = lambda acc: once(_next(acc["front"], acc["seen"]), lambda new: F.struct(F.concat(acc["seen"], new).alias("seen"), new.alias("front"), (acc["hops"] + 1).alias("hops")))
    # a path has no more edges than the document
    length = F.aggregate(F.concat(F.array(F.lit(0)), F.transform("edges", lambda _: F.lit(0))), start, lambda acc, _: F.when(over(acc), acc).otherwise(on(acc)), lambda acc: F.when(F.size(acc["front"]) > 0, acc["hops"]))
    asked = graphs.select("doc_id", "nodes", "edges", source.alias("source_id"), target.alias("target_id"))
    known = once(_ids(), lambda ids: F.array_contains(ids, F.col("source_id")) & F.array_contains(ids, F.col("target_id")))
    found = F.explode_outer(F.filter(F.array(F.when(known, length)), lambda x: x.isNotNull()))
    return asked.select("doc_id", "source_id", "target_id", found.alias("length")).where("length is not null")


def _both_ends(edges: DataFrame) -> DataFrame:
    """(doc_id, node_id, next_id, edge_id, confidence) for each end of every edge."""
    there = edges.select("doc_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id"), "edge_id", "confidence")
    return there.unionByName(edges.select("doc_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("next_id"), "edge_id", "confidence"))


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, node_id, component): nodes of each document with the least name that edges lead to, through ends that are no nodes too."""
    key = lambda c: F.concat_ws("\x01", F.col("doc_id").cast("string"), c)
    links = edges.select(key("source_id").alias("src"), key("target_id").alias("dst")).unionByName(nodes.select(key("node_id").alias("src"), key("node_id").alias("dst")))
    found = connected_components(links, "src", "dst")
    return nodes.select("doc_id", "node_id", key("node_id").alias("node")).join(found, "node").select("doc_id", "node_id", F.split("component", "\x01")[1].alias("component"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, n_edges, avg_degree, density, n_components, n_entities, n_claims, n_chunks, n_facts) of every document with nodes.

    Both ends of an edge count for the degree where they are nodes; density is edges over n (n - 1) / 2.
    """
    by_type = [F.count(F.when(F.col("node_type") == t, 1)).alias(f"n_{t}s".replace("entitys", "entities")) for t in ("entity", "claim", "chunk", "fact")]
    counted = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), *by_type)
    m = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    degree = _both_ends(edges).join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("ends"))
    parts = graph_components(nodes, edges).groupBy("doc_id").agg(F.count_distinct("component").alias("n_components"))
    return _measured(counted.join(m, "doc_id", "left").join(degree, "doc_id", "left").join(parts, "doc_id").fillna(0, ["n_edges", "ends"]))


def _measured(told: DataFrame) -> DataFrame:
    """Averages of the counts."""
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return told.select(
        "doc_id", "n_nodes", "n_edges", F.round(F.col("ends") / F.col("n_nodes"), 4).alias("avg_degree"), F.when(possible > 0, F.round(F.col("n_edges") / possible, 6)).otherwise(0.0).alias("density"),
        "n_components", "n_entities", "n_claims", "n_chunks", "n_facts",
    )


def neighborhoods(nodes: DataFrame, edges: DataFrame, asked: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """nodes (doc_id, node_id, distance) within depth of the asked ones (doc_id, node_id), and the edges (doc_id, edge_id) met on the way.

    Asked names that are no nodes of their document give nothing; depth is at least 1.
    """
    ends = materialize(_both_ends(edges), "ends")
    front = asked.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").distinct().withColumn("distance", F.lit(0))
    seen = front = materialize(front, "front")
    met = None
    for d in range(1, max(1, depth) + 1):
        step = front.drop("distance").join(ends, ["doc_id", "node_id"])
        used = step.select("doc_id", "edge_id")
        met = used if met is None else met.unionByName(used)
        front = step.select("doc_id", F.col("next_id").alias("node_id")).distinct().join(seen, ["doc_id", "node_id"], "left_anti").withColumn("distance", F.lit(d))
        front = materialize(front, "front")
        seen = seen.unionByName(front)
    return seen.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi"), met.distinct()


def shortest_paths(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, source_id, target_id, length, edge_ids, confidence): a shortest path for each of asked (doc_id, source_id, target_id) that has one.

    Of equally short ones that with the least edge_ids, compared from the source; confidence is the least of its edges', 0 for a path
    of none. Ends that are no nodes have no path. Rounds go on until every path is found or nothing new is reached; no length is too great.
    """
    key = ["doc_id", "source_id", "target_id"]
    known = nodes.select("doc_id", "node_id")
    for end in ("source_id", "target_id"):
        asked = asked.join(known.withColumnRenamed("node_id", end), ["doc_id", end], "left_semi")
    ends = materialize(_both_ends(edges), "ends")
    start = asked.select(*key).distinct().select(*key, F.col("source_id").alias("node_id"), F.array().cast("array<string>").alias("edge_ids"), F.lit(1.0).alias("confidence"))
    seen = front = materialize(start, "front")
    found = front.where("source_id = target_id")
    front = front.where("source_id <> target_id")
    while not front.isEmpty():
        step = front.join(ends.withColumnRenamed("confidence", "sure"), ["doc_id", "node_id"])
        reached = step.select(*key, F.col("next_id").alias("node_id"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.least("confidence", "sure").alias("confidence"))
        reached = reached.join(seen.select(*key, "node_id"), [*key, "node_id"], "left_anti")
        first = reached.groupBy(*key, "node_id").agg(F.min(F.struct("edge_ids", "confidence")).alias("x")).select(*key, "node_id", "x.*")
        first = materialize(first, "front")
        arrived = first.where("node_id = target_id")
        found = found.unionByName(arrived)
        seen = seen.unionByName(first)
        front = first.join(arrived.select(*key), key, "left_anti")
    return found.select(*key, F.size("edge_ids").alias("length"), "edge_ids", F.when(F.size("edge_ids") > 0, F.round("confidence", 4)).otherwise(0.0).alias("confidence"))
