"""Graph searches and set overlaps against brute force."""

import itertools
import random

from quire.operators import document_graphs as D
from quire.operators import graph as G
from quire.operators import relations as X


def test_long_path(spark):
    """A path of many edges is found; none is told where there is none."""
    rows = [(f"n{i:02d}", f"n{i + 1:02d}", "r", 0.5) for i in range(14)] + [("x", "y", "r", 1.0)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, confidence double")
    assert [r.node_id for r in G.shortest_path(edges, "n14", "n00").orderBy("position").collect()] == [f"n{i:02d}" for i in range(14, -1, -1)]
    assert G.shortest_path(edges, "n00", "x").count() == 0 and G.shortest_path(edges, "x", "x").count() == 1


def test_edge_paths(spark):
    rows = [("e1", "a", "b", 0.5, 0.9), ("e2", "b", "a", 2.0, 0.4), ("e3", "b", "c", 1.0, 0.8), ("e4", "a", "c", 7.0, 0.3), ("e5", "c", "d", 1.0, 1.0), ("e6", "d", "e", 1.0, 1.0)]
    edges = spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, weight double, confidence double")
    got = {(tuple(r.edge_ids), r.weight, r.confidence) for r in G.edge_paths(edges, "a", "c", 3).collect()}
    assert got == {(("e1", "e3"), 1.5, 0.8), (("e2", "e3"), 3.0, 0.4), (("e4",), 7.0, 0.3)}
    assert G.edge_paths(edges, "a", "a", 3).collect()[0].edge_ids == [] and G.edge_paths(edges, "a", "e", 2).count() == 0


def test_overlaps(spark):
    """Every pair that reaches the share, whatever the sizes of the sets, with and without salts."""
    rng = random.Random(5)
    sets = {d: {rng.choice(range(30)) for _ in range(rng.choice([1, 2, 6, 15]))} | ({99} if d % 2 else set()) for d in range(40)}
    rows = [(d, i) for d, s in sets.items() for i in s] * 2 + [(None, 1), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, item long")
    for least, plain in ((0.2, 10_000), (0.5, 3), (1.0, 3)):
        X.PLAIN_ROWS, before = plain, X.PLAIN_ROWS
        got = {(r.a, r.b): round(r.overlap, 9) for r in X.overlaps(frame, least).collect()}
        X.PLAIN_ROWS = before
        share = lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))
        assert got == {(a, b): round(share(a, b), 9) for a, b in itertools.combinations(sets, 2) if share(a, b) >= least - 1e-12}


def test_document_graphs(spark):
    """Many small graphs at once: paths, neighbours, ends that are no nodes."""
    rng = random.Random(6)
    nodes = [(d, f"n{i}") for d in range(30) for i in range(6)]
    edges = [(d, f"e{k:02d}", f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice([0.5, 0.9])) for d in range(30) for k in range(rng.choice([0, 4, 6]))]
    node_rows = spark.createDataFrame([(*n, "fact", "l", "t", 1.0) for n in nodes], "doc_id long, node_id string, node_type string, label string, text string, confidence double")
    edge_rows = spark.createDataFrame(edges, "doc_id long, edge_id string, source_id string, target_id string, confidence double")

    def paths(d):
        """By length, then edges, the paths from n0 to n5."""
        best, front = None, [((), "n0")]
        seen = {"n0"}
        while front and best is None:
            step = {}
            for ids, at in front:
                for e in (e for e in edges if e[0] == d):
                    for a, b in ((e[2], e[3]), (e[3], e[2])):
                        if a == at and b not in seen:
                            step[b] = min(step.get(b, (*ids, e[1])), (*ids, e[1]))
            seen |= set(step)
            front = [(ids, b) for b, ids in step.items()]
            best = step.get("n5")
        return best

    asked = spark.createDataFrame([(d, "n0", "n5") for d in range(30)] + [(0, "n1", "n1"), (0, "n6", "n1"), (77, "n0", "n1")], "doc_id long, source_id string, target_id string")
    got = {(r.doc_id, r.source_id): tuple(r.edge_ids) for r in D.shortest_paths(node_rows, edge_rows, asked).collect()}
    assert got == {(d, "n0"): p for d in range(30) if (p := paths(d))} | {(0, "n1"): ()}
    start = spark.createDataFrame([(d, "n0") for d in range(30)] + [(1, "n6")], "doc_id long, node_id string")
    near, met = D.neighborhoods(node_rows, edge_rows, start, 1)
    assert {(r.doc_id, r.edge_id) for r in met.collect()} == {(e[0], e[1]) for e in edges if "n0" in e[2:4]}
    assert {(r.doc_id, r.node_id) for r in near.collect()} == {(d, "n0") for d in range(30)} | {(e[0], x) for e in edges for x in e[2:4] if "n0" in e[2:4] and x != "n6"}
    empty = D.graph_statistics(node_rows.limit(0), edge_rows.limit(0))
    assert empty.count() == 0


def test_graphs_in_rows(spark):
    """Graphs of a row each are those of the tables: nodes, numbered edges, statistics, neighbours and paths, with parts that share ids, lack texts or chunks."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    word = lambda: rng.choice(["Ab", "b", "abc", "", "x y", None])
    chunk = lambda: rng.choice(["c0", "c1", "c9", None])
    sure = lambda: rng.choice([0.5, 0.9, None])
    parts = []
    for d in range(40):
        entities = [(f"{rng.choice('es')}{i}", "l", word(), sure(), chunk()) for i in range(rng.randrange(5))]
        claims = [(f"{rng.choice('ks')}{i}", "m", word(), sure(), chunk()) for i in range(rng.randrange(4))]
        chunks = [(f"c{i}", "abc " * 80, 0.9) for i in range(rng.randrange(3))]
        facts = [(f"f{i}", "n", word(), sure()) for i in range(rng.randrange(3))]
        triples = [(f"{rng.choice('es')}{rng.randrange(5)}", "uses", rng.choice(["z", "f0", "c1"]), 0.5, d % 2 == 0) for _ in range(rng.randrange(3))]
        parts.append((d, entities, claims, chunks, facts, triples))
    of = lambda *names: f"array<struct<{','.join(n if ':' in n else f'{n}:string' for n in names)}>>"
    c = "confidence:double"
    kinds = {
        "entities": of("entity_id", "label", "text", c, "chunk_id"), "claims": of("claim_id", "label", "sentence", c, "chunk_id"), "chunks": of("chunk_id", "text", c),
        "facts": of("fact_id", "label", "value", c), "triples": of("subject_id", "predicate", "object_id", c, "negated:boolean"),
    }
    frame = spark.createDataFrame(parts, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    nodes, edges = (t.cache() for t in D.build_graphs(*[frame.select("doc_id", F.inline(k)) for k in kinds]))
    rows = D.graphs_in_rows(frame)
    told = lambda t: sorted(map(repr, t.collect()))
    for got, want in zip(D.tables_of_rows(rows), (nodes, edges), strict=True):
        assert told(got) == told(want)
    assert told(D.statistics_of_rows(rows)) == told(D.graph_statistics(nodes, edges))
    ids = F.transform("nodes", lambda n: n["node_id"])
    asked = nodes.groupBy("doc_id").agg(F.min("node_id").alias("source_id"), F.max("node_id").alias("target_id"))
    near = D.neighborhoods(nodes, edges, asked.select("doc_id", F.col("source_id").alias("node_id")), 3)[0]
    assert told(D.neighborhoods_of_rows(rows, F.array_min(ids), 3)) == told(near.select("doc_id", "node_id", "distance"))
    paths = D.shortest_paths(nodes, edges, asked).select("doc_id", "source_id", "target_id", "length")
    assert told(D.path_lengths_of_rows(rows, F.array_min(ids), F.array_max(ids))) == told(paths)
    assert D.path_lengths_of_rows(rows, F.array_min(ids), F.lit("none")).count() == 0


def test_crowded_graphs(spark, tmp_path):
    """Orders with more lines than a row holds are measured as tables, with the same results."""
    from quire.plans import document_graph_queries as Q

    few = Q.FEW_LINES
    names = ("document_graph_nodes", "document_graph_edges", "document_graph_statistics", "document_graph_paths", "document_graph_neighbors")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 40 = 0")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    told = lambda: [sorted(map(repr, getattr(Q, n)(spark, str(tmp_path)).collect())) for n in names]
    try:
        want = told()
        Q.FEW_LINES = 3
        assert told() == want
    finally:
        Q.FEW_LINES = few


def test_edges_of_pairs_and_their_rivals(spark):
    """Pairs of clusters are not sent with other edges unless one of these compares the same two; the surer edge, then the earlier stage, is kept."""
    from quire.operators import corpus_graph as C

    frame = spark.createDataFrame
    docs = frame([(d, d, None, 0.5) for d in ("x", "y", "p", "q")], "doc_id string, title string, date string, overall double")
    entities = frame([("x", "e1", "p", 0.4), ("x", "e2", "q", 0.9), ("y", "e3", "p", None), ("x", "e4", "p", 0.7), ("x", "e5", "r", 0.1)], "doc_id string, entity_id string, cluster_id string, confidence double")
    clusters = frame([(k, k, 1.0) for k in "pqr"], "cluster_id string, canonical_text string, confidence double")
    claims = frame([("x", "1", "s", 0.3), ("y", "2", "s", 0.2)], "doc_id string, claim_id string, sentence string, confidence double")
    made = "source_id string, target_id string, relation_type string, confidence double, source_claim_id string, target_claim_id string"
    told = lambda t: {tuple(r) for r in t.collect()}
    want = {
        ("x", "p", "extends", "doc_contains_entity", 0.7, True, 3), ("x", "q", "extends", "doc_contains_entity", 0.9, True, 3), ("y", "p", "extends", "doc_contains_entity", None, True, 3),
        ("x", "r", "extends", "doc_contains_entity", 0.1, True, 3), ("x", "cl_x_1", "supports", "doc_has_claim", 0.3, True, 7), ("y", "cl_y_2", "supports", "doc_has_claim", 0.2, True, 7),
        ("x", "y", "cites", "doc_relation", 0.6, True, 4), ("cl_x_1", "cl_y_2", "cites", "claim_relation", 0.6, True, 7),
    }
    pairs = {(a, b, "compares_with", "entity_co_occur", 1.0, False, 5) for a, b in (("p", "q"), ("p", "r"), ("q", "r"))}
    cites = [("x", "y", "cites", 0.6, "1", "2"), ("x", "y", "cites", 0.5, "1", "3")]
    of = lambda more, **k: told(C.build_corpus_graph(docs, entities, clusters, frame(cites + more, made), claims, **k)[1])
    assert of([]) == want | pairs and of([], stage_5=False) == want and of([], rows=8) == want | pairs
    weak, equal = ("p", "q", "compares_with", 0.9, None, None), ("p", "r", "compares_with", 1.0, None, None)
    assert of([weak]) == want | pairs
    assert of([weak, equal]) == want | pairs - {("p", "r", "compares_with", "entity_co_occur", 1.0, False, 5)} | {("p", "r", "compares_with", "doc_relation", 1.0, True, 4)}
