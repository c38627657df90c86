"""The graph of a corpus, built in stages: documents, entity clusters and claims as nodes, what joins them as edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import co_occurrence
from quire.plans.storage import materialize, partitions_for

#: Kinds of edges: name, whether directed, stage; of equally confident ones the first is kept.
KINDS = [("doc_contains_entity", True, 3), ("doc_relation", True, 4), ("entity_co_occur", False, 5), ("doc_has_claim", True, 7), ("claim_relation", True, 7)]


def build_corpus_graph(documents: DataFrame, entities: DataFrame, clusters: DataFrame, relations: DataFrame, claims: DataFrame, stage_5: bool = True, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, node_type, label, weight, year) and edges (source_id, target_id, relation_type, edge_kind, confidence, is_directed, stage).

    documents: (doc_id, title, date, overall); entities: (doc_id, entity_id, cluster_id, confidence), cluster_id null outside clusters; clusters:
    (cluster_id, canonical_text, confidence); relations: (source_id, target_id, relation_type, confidence, source_claim_id, target_claim_id);
    claims: (doc_id, claim_id, sentence, confidence). Ids are texts. Stages: 1 documents, 2 clusters, 3 documents with their clusters, 4 relations,
    5 clusters that share a document, 6 claims, 7 documents with their claims and claims with claims that a relation names; 8 keeps the most
    confident edge of one source, target and type. stage_5=False leaves that stage out; rows: about how many edges
    the others give, if known. A document without a title has its id as label, one without a score weight 1.
    """
    year = F.nullif(F.regexp_extract(F.col("date").cast("string"), r"^(\d{4})", 1), F.lit("")).cast("int")
    no_year = F.lit(None).cast("int").alias("year")
    claim_node = lambda doc, claim: F.concat(F.lit("cl_"), doc, F.lit("_"), claim)
    nodes = [
        documents.select(F.col("doc_id").alias("node_id"), F.lit("document").alias("node_type"), F.coalesce(F.nullif("title", F.lit("")), "doc_id").alias("label"), F.coalesce("overall", F.lit(1.0)).alias("weight"), year.alias("year")),
        clusters.select(F.col("cluster_id").alias("node_id"), F.lit("entity_cluster").alias("node_type"), F.col("canonical_text").alias("label"), F.col("confidence").alias("weight"), no_year),
        claims.select(claim_node(F.col("doc_id"), F.col("claim_id")).alias("node_id"), F.lit("claim").alias("node_type"), F.substring("sentence", 1, 120).alias("label"), F.col("confidence").alias("weight"), no_year),
    ]

    def edge(rows: DataFrame, source: Column, target: Column, relation: Column | str, what: int, sure: Column | float) -> DataFrame:
        relation = F.lit(relation) if isinstance(relation, str) else relation
        return rows.select(source.alias("source_id"), target.alias("target_id"), relation.alias("relation_type"), F.lit(what).alias("what"), F.lit(sure).alias("confidence"))

    members = graph_members(documents, entities, clusters)
    named = claims.select(F.col("doc_id").alias("of"), F.col("claim_id").alias("claim"))
    across = relations.join(named, (F.col("source_id") == F.col("of")) & (F.col("source_claim_id") == F.col("claim")), "left_semi")
    across = across.join(named, (F.col("target_id") == F.col("of")) & (F.col("target_claim_id") == F.col("claim")), "left_semi")
    c = F.col
    edges = reduce(DataFrame.unionByName, [
        edge(members, c("doc_id"), c("cluster_id"), "extends", 0, c("confidence")),
        edge(relations, c("source_id"), c("target_id"), c("relation_type"), 1, c("confidence")),
        edge(claims, c("doc_id"), claim_node(c("doc_id"), c("claim_id")), "supports", 3, c("confidence")),
        edge(across, claim_node(c("source_id"), c("source_claim_id")), claim_node(c("target_id"), c("target_claim_id")), c("relation_type"), 4, c("confidence")),
    ])
    kept = best(edges, rows)
    if stage_5:
        # its pairs differ from each other: they meet only those edges that compare, if there are any
        pairs = edge(co_occurrence(materialize(members.select("doc_id", "cluster_id"), "members")), c("a"), c("b"), "compares_with", 2, 1.0)
        rivals = materialize(edges.where("relation_type = 'compares_with'"), "rivals")
        kept = kept.unionByName(told(pairs.withColumnRenamed("what", "kind"), c("confidence"))) if rivals.isEmpty() else best(edges.unionByName(pairs), rows)
    return reduce(DataFrame.unionByName, nodes), kept


def graph_members(documents: DataFrame, entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """Entities of the documents and clusters that are there."""
    return entities.join(clusters.select("cluster_id"), "cluster_id", "left_semi").join(documents.select("doc_id"), "doc_id", "left_semi")


def stage_5_counts(members: DataFrame) -> DataFrame:
    """(n_edges, n_sources, n_targets) of the edges of stage 5, one row, none without edges.

    A cluster is a source if some document has it and a later one, a target if some document has it and an earlier one. Edges
    are counted as numbers: each cluster of a document goes with the list of those after it, to one place.
    """
    spark = members.sparkSession
    members = members.select("doc_id", "cluster_id").where("doc_id is not null and cluster_id is not null")
    names = materialize(members.select("cluster_id").distinct().select("cluster_id", F.monotonically_increasing_id().alias("c")), "names")
    sets = members.join(names, "cluster_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("c")).alias("of"), F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high"))
    sets = materialize(sets.where(F.size("of") > 1), "members")
    n = sets.agg(F.sum(F.expr("cast(size(of) as bigint) * (size(of) - 1) div 2"))).first()[0] or 0
    lists = sets.select("of", F.posexplode("of").alias("at", "a")).select("a", F.slice("of", F.col("at") + 2, F.size("of")).alias("bs")).where(F.size("bs") > 0)
    pairs = lists.repartition(partitions_for(spark, n), "a").select("a", F.explode("bs").alias("b")).distinct()
    # the first and the last of a document: all others are source and target there
    told = sets.select("low", "high", F.explode("of").alias("c")).join(names, "c").groupBy("cluster_id").agg(F.max(F.col("cluster_id") < F.col("high")).alias("s"), F.max(F.col("cluster_id") > F.col("low")).alias("t"))
    ends = told.agg(F.count(F.when(F.col("s"), 1)).alias("n_sources"), F.count(F.when(F.col("t"), 1)).alias("n_targets"))
    return pairs.agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges > 0").crossJoin(F.broadcast(ends))  # one row each


def best(edges: DataFrame, rows: int | None) -> DataFrame:
    """The most confident edge of one source, target and type, of equal ones that of the first kind; rows: about how many edges there are.

    The best of each kind stand side by side, as numbers, which Spark aggregates without sorting. With rows, a source's edges come to one place, where
    its edges can be counted without sending it from many.
    """
    c, none = F.col, F.lit(float("-inf"))
    kinds = range(len(KINDS))
    key = ["source_id", "target_id", "relation_type"]
    if rows is not None:
        edges = edges.repartition(partitions_for(edges.sparkSession, rows), "source_id")
    found = edges.groupBy(*key).agg(*[F.max(F.when(c("what") == i, F.coalesce("confidence", none))).alias(f"best_{i}") for i in kinds])
    found = found.withColumn("most", F.greatest(*[c(f"best_{i}") for i in kinds]))
    found = found.withColumn("kind", F.coalesce(*[F.when(c(f"best_{i}") == c("most"), F.lit(i)) for i in kinds]))
    return told(found, F.nullif("most", none))


def told(edges: DataFrame, confidence: Column) -> DataFrame:
    """Edges with what their kind says."""
    of_kind = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in KINDS]), F.col("kind") + 1)
    return edges.select(
        "source_id", "target_id", "relation_type", of_kind(0).alias("edge_kind"), confidence.alias("confidence"), of_kind(1).alias("is_directed"), of_kind(2).alias("stage")
    )
