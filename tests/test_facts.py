"""Sentences of phrases, and facts of every way, against brute force."""

import re

from pyspark.sql import functions as F

from quire.operators import facts as A
from quire.operators import triples as T


def _sentences(text, pattern):
    out = []
    for m in re.finditer(f"(?i){pattern}", text or ""):
        start = end = m.start()
        while start > 0 and text[start - 1] not in ".!?\n":
            start -= 1
        while end < len(text) and text[end] not in ".!?\n":
            end += 1
        if s := text[start : end + 1].strip():
            out.append(s)
    return out


TEXTS = ["We see Future  work. Future\nwork and future work!\nNone?", "future work", "", None, ".!future work?future work", "Limitations of it\n\n a limitation", "no. limitation", "x\x01y future work"]


def test_phrase_sentences(spark):
    """Several matches in one sentence, matches that go over a line end, no sentence at all."""
    for pattern in (r"future\s+work", r"\blimitations?\b"):
        rows = spark.createDataFrame(list(enumerate(TEXTS[:-1])), "i int, t string")
        got = {r.i: r.s or [] for r in rows.select("i", A.phrase_sentences(F.col("t"), pattern).alias("s")).collect()}
        assert got == {i: _sentences(t, pattern) for i, t in enumerate(TEXTS[:-1])}


def test_facts(spark):
    f = spark.createDataFrame
    sections = f([(1, "s1", "methodology", 0.9, " We do "), (1, "s2", "results", 0.9, "no"), (1, "s3", "limitations", 0.4, "low"), (1, "s4", "conclusion", 0.6, "  ")], "doc_id long, section_id string, label string, confidence double, content string")
    entities = f([(1, "e1", "tool", " Net ", 0.9, "c1", "lex"), (1, "e2", "person", "Ann", 0.9, "c1", "lex"), (1, "e3", "metric", "F1", 0.2, None, "lex"), (2, "e1", "method", "M", 0.9, "c1", "lex")], "doc_id long, entity_id string, label string, text string, confidence double, chunk_id string, source string")
    claims = f([(1, "k1", "negation", "It fails", 0.5, "c1"), (1, "k2", "causal", "so", 0.9, "c1"), (1, "k3", "existence", "low", 0.3, None)], "doc_id long, claim_id string, claim_type string, sentence string, confidence double, chunk_id string")
    chunks = f([(1, "c1", "It outperforms all. A novel method outperforms outperform."), (1, "c2", None)], "doc_id long, chunk_id string, text string")
    references = f([(1, "r1", "", "A survey of a model "), (1, "r2", None, None), (1, "r3", "Scores", "a dataset")], "doc_id long, ref_id string, title string, raw_text string")
    got = [(r.fact_id, r.fact_type, r.value, r.confidence, r.source_type, r.source_id, r.matched) for r in A.extract_facts(sections, entities, claims, chunks, references).orderBy("fact_id").collect()]
    second = "A novel method outperforms outperform."
    assert [g[1:] for g in got] == [
        ("method", "We do", 0.54, "section", "s1", "methodology"), ("method", "Net", 0.9, "entity", "e1", "lex"), ("limitation", "It fails", 0.4, "claim", "k1", "negation"),
        ("contribution", "It outperforms all.", 0.65, "pattern", "c1", "outperforms"), ("contribution", second, 0.65, "pattern", "c1", "outperforms"), ("contribution", second, 0.65, "pattern", "c1", "outperforms"),
        ("contribution", second, 0.65, "pattern", "c1", "novel_approach"), ("method", "A survey of a model", 0.5, "reference", "r1", "method_keyword"), ("contribution", "A survey of a model", 0.5, "reference", "r1", "survey_keyword"),
    ]
    assert [g[0] for g in got] == [f"fact_{i + 1:03d}" for i in range(9)]
    assert A.extract_facts(*[t.limit(0) for t in (sections, entities, claims, chunks, references)]).count() == 0


def test_contributions(spark):
    """The first method of the fact's chunk, else of its section, else the document itself."""
    f = spark.createDataFrame
    facts = f([(1, "f1", "contribution", "new", "c1", "s1"), (1, "f2", "contribution", "newer", "c2", "s1"), (1, "f3", "contribution", "x" * 200, None, "s2"), (1, "f4", "method", "m", "c1", "s1"), (1, "f5", "contribution", "y", None, None)], "doc_id long, fact_id string, fact_type string, value string, chunk_id string, section_id string")
    entities = f([(1, "e2", 2, "method", "B", 0.8, "c1"), (1, "e1", 1, "method", "A", 0.6, "c1"), (1, "e0", 0, "metric", "C", 0.9, "c2"), (1, "e9", 9, "method", "Z", 0.3, "c3")], "doc_id long, entity_id string, nth int, label string, text string, confidence double, chunk_id string")
    chunks, documents = f([(1, "c1", "s1"), (1, "c2", "s1"), (1, "c3", "s3")], "doc_id long, chunk_id string, section_id string"), f([(1, "Title")], "doc_id long, title string")
    got = {r.object_id: (r.subject_id, r.subject_text, r.confidence, r.chunk_id, len(r.object_text)) for r in T.contribution_triples(facts, entities, chunks, documents).collect()}
    assert got == {"obj_f1": ("e1", "A", 0.45, "c1", 3), "obj_f2": ("e1", "A", 0.45, "c1", 5), "obj_f3": ("sub_f3", "Title", 0.45, "s2", 120), "obj_f5": ("sub_f5", "Title", 0.45, "", 1)}
