"""Queries that go over whole tables, against brute force on small fixtures."""

import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import documents, graph
from quire.plans import components, queries, storage


def _union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_take_every_edge(spark, tmp_path):
    """Lines of any flag and discount join their ends; one flag or confidence alone would not."""
    lines = [(1, 1, "A", 0.0), (1, 2, "N", 0.1), (2, 2, "R", 0.05), (3, 3, "N", 0.0), (4, 4, "R", 0.07), (4, 5, "A", 0.02), (5, 5, "N", 0.1), (5, 5, "N", 0.1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.graph_components(spark, str(tmp_path)).collect()
    expected = _union_find((f"d{a}", f"c{b}") for a, b, _, _ in lines)
    assert len(got) == len(expected) and {tuple(r) for r in got} == set(expected.items())
    assert len(set(expected.values())) == 3


TEXTS = [
    (1, "en", "a", "He and the dog. The end of the day is the best.\nAnd a cat"),
    (2, "fr", "a", "Été and the nuit. éand the non. And thé non. With Thé Theé"),
    (3, "de", "b", "The Mädchen in the Garten, This und That. Äin the Haus"),
    (4, None, "b", "The_x is the. ısland Is The"),
    (5, "es", "b", "The\u0301 and a\u0301"),
    (6, "es", "c", ""),
    (7, "es", "c", None),
]


def _texts(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _word(c):
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def test_claims_in_every_language(spark, tmp_path):
    expected = Counter()
    for _, _, source, text in TEXTS:
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
            for kind, phrase in (("addition", "and the"), ("addition", "and a"), ("relation", "of the"), ("relation", "in the"), ("identity", "is the")):
                at = [m.start() for m in re.finditer(f"(?i)(?a:{phrase})", sentence)]
                if any(not _word((" " + sentence)[i]) and not _word((sentence + " ")[i + len(phrase)]) for i in at):
                    expected[source, kind] += 1
    got = {(r.source, r.claim_type): r.n_matches for r in queries.claim_counts(spark, _texts(spark, tmp_path)).collect()}
    assert got == dict(expected) and ("a", "addition") in got and ("b", "relation") in got


def test_entities_in_every_language(spark, tmp_path):
    got = {(r.doc_id, r.text, r.n_mentions) for r in queries.dictionary_entities(spark, _texts(spark, tmp_path)).collect()}
    assert got == {(1, "The", 1), (1, "And", 1), (2, "And", 1), (2, "With", 1), (3, "The", 1), (3, "This", 1), (3, "That", 1), (4, "The", 2)}


def test_section_claims(spark):
    rows = [
        (1, 0, "It was statistically  significant (P < 0.05).", "results"),
        (1, 1, "This leads to rain", "introduction"),
        (1, 2, "We found no evidence for it, due to chance", "other"),
        (1, 3, "This leads to thanks, p = 0.1", "acknowledgments"),
        (1, 4, "Nothing here is caused ", "results"),
        (2, 0, "Our\u00a0method failed to help", "appendix"),
        (2, 1, "Our\u00a0method", None),
        (2, 2, None, "results"),
    ]
    got = documents.section_claims(spark.createDataFrame(rows, "doc_id int, position int, sentence string, label string")).collect()
    assert sorted((r.doc_id, r.claim_id, r.position, r.claim_type, len(r.matched_patterns), r.confidence) for r in got) == [
        (1, "clm_001", 0, "statistical", 2, 0.8),
        (1, "clm_002", 1, "causal", 1, 0.4),
        (1, "clm_003", 2, "causal", 1, 0.8),
        (1, "clm_004", 2, "existence", 1, 0.8),
        (1, "clm_005", 2, "negation", 1, 0.8),
        (2, "clm_001", 1, "methodological", 1, 0.5),
    ]
    assert sum(map(len, documents.CLAIM_PATTERNS.values())) == 26


def test_components_of_blocks(spark):
    """Blocks are contracted where they lie; chains, loops, copies and null ends across blocks come out as one graph's."""
    rng = random.Random(16)
    pairs = [(rng.choice([None, *range(400)]), rng.choice([None, *range(400)])) for _ in range(260)]
    pairs += [(x, x + 1) for x in range(1000, 1300)] + [(2000, x) for x in range(1900, 2100)] + [(3000, 3000)] * 3
    rng.shuffle(pairs)
    names = [tuple(None if x is None else f"n{x}é" for x in p) for p in pairs]
    for rows, kind in ((pairs, "long"), (names, "string")):
        for n in (1, 7):
            got = components.connected_components(spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(n)).collect()
            expected = _union_find([p for p in rows if None not in p])
            assert len(got) == len(expected) and {tuple(r) for r in got} == set(expected.items())
    u, v = (pa.chunked_array([pa.array(c, pa.int64())]) for c in ([1, 2, 2, 9, 8], [2, 3, 3, 9, 7]))
    assert components._stars(u, v).to_pydict() == {"u": [2, 3, 8, 9], "v": [1, 1, 7, 9]}


def test_tables_are_written_in_shares(spark, monkeypatch):
    """With a known number of rows, no task gets more than its share, however few partitions the session has."""
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    monkeypatch.setattr(storage, "SHARE_BYTES", 1)
    before, least = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "1b")
    rows = storage.materialize(spark.range(4000).repartition("id"), "ids", 4000)
    spark.conf.unset(least)
    assert rows.count() == 4000 and rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 200
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_co_occurrence_is_dealt_by_its_pairs(spark, monkeypatch):
    """Pairs meet in as many parts as their number needs; null and repeated members give no pairs of their own."""
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    rng = random.Random(27)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(25)])) for _ in range(400)] + [(99, 1)] * 3
    got = graph.co_occurrence(spark.createDataFrame(rows, "doc_id long, cluster_id long"))
    expected = {}
    for d, a in rows:
        for e, b in rows:
            if d is not None and d == e and a is not None and b is not None and a < b:
                expected[a, b] = min(d, expected.get((a, b), d))
    parts = got.select(F.spark_partition_id().alias("p"), "*").collect()
    assert {(r.a, r.b): r.doc_id for r in parts} == expected and len(parts) == len(expected)
    assert len({r.p for r in parts}) > 20
    assert graph.co_occurrence(spark.createDataFrame([], "doc_id long, cluster_id long")).collect() == []
