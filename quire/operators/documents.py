"""Documents: identity, sentences, claims, entities, facts, indexes, integrity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.storage import materialize


#: Entries of a lexicon that may be broadcast; a larger one is joined by a shuffle.
LEXICON_ROWS = 200_000


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 of the text, and whether an earlier document has the same one."""
    hashed = materialize(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")), "hashes")  # each text once
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return hashed.join(first, "sha256").select("doc_id", "sha256", (F.col("doc_id") > F.col("first_id")).alias("is_duplicate"), "n_copies")


def sentence_table(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, position, sentence) and more columns of the document."""
    return docs.select("doc_id", *more, F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


def text_counts(docs: DataFrame) -> DataFrame:
    """Words, sentences and lines of each document."""
    return docs.select(
        "doc_id",
        T.word_count(F.col("text")).alias("n_words"),
        F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"),
        F.size(T.paragraphs(F.col("text"), r"\n")).cast("long").alias("n_lines"),
    )


def detect_claims(sentences: DataFrame, patterns: list[tuple[str, str]], *more: str) -> DataFrame:
    """(doc_id, position, claim_type, n_patterns, confidence) of the sentences that patterns match, and more of their columns.

    patterns: (claim_type, regular expression), at most some dozens. Two or more matches over all types give
    0.8, one 0.6.
    """
    types = sorted({t for t, _ in patterns})
    counted = F.array(
        *[
            F.struct(
                F.lit(t).alias("claim_type"),
                sum((F.col("sentence").rlike(p).cast("int") for u, p in patterns if u == t), F.lit(0)).alias("n_patterns"),
            )
            for t in types
        ]
    )
    hits = sentences.select("doc_id", *more, "position", F.filter(counted, lambda x: x["n_patterns"] > 0).alias("hits"))
    total = F.aggregate("hits", F.lit(0), lambda s, x: s + x["n_patterns"])
    return hits.where(F.size("hits") > 0).select(
        "doc_id", *more, "position", F.explode("hits").alias("hit"), F.when(total >= 2, 0.8).otherwise(0.6).alias("confidence")
    ).select("doc_id", *more, "position", "hit.claim_type", F.col("hit.n_patterns").cast("long").alias("n_patterns"), "confidence")


#: The claim types, each with its regular expressions, in the order that numbers claims. Fixed values.
CLAIM_PATTERNS = {
    "statistical": [r"p\s*[<>≤≥=]\s*0\.\d+", r"\d+%\s*CI", r"statistically\s+significant", r"effect\s+size", r"odds\s+ratio", r"hazard\s+ratio", r"confidence\s+interval"],
    "causal": [r"(?:causes?|caused)\s+", r"leads?\s+to", r"results?\s+in", r"due\s+to", r"associated\s+with"],
    "comparative": [r"outperforms?", r"(?:better|worse|superior|inferior)\s+(?:than|to)", r"state[- ]of[- ]the[- ]art", r"improvement\s+(?:of|over)"],
    "methodological": [r"we\s+(?:propose|introduce|present|develop)", r"novel\s+(?:approach|method|framework)", r"our\s+(?:approach|method|contribution)"],
    "existence": [r"we\s+(?:find|found|observe|show|demonstrate)", r"results?\s+(?:show|indicate|suggest|demonstrate)", r"(?:analysis|experiment)\s+(?:shows?|reveals?)"],
    "negation": [r"no\s+significant\s+(?:difference|effect|improvement)", r"(?:failed?|unable)\s+to", r"did\s+not\s+(?:find|observe|show)", r"no\s+(?:evidence|support)\s+for"],
}
#: Confidence of a single match by section; 0.5 in any other, no claim at 0. Fixed values.
SECTION_PRIORS = {
    "results": 0.7, "discussion": 0.7, "methodology": 0.65, "conclusion": 0.65, "limitations": 0.65, "future_work": 0.5,
    "introduction": 0.4, "related_work": 0.4, "other": 0.5, "acknowledgments": 0.0, "appendix": 0.0,
}


def section_claims(sentences: DataFrame, patterns: Mapping[str, list[str]] = CLAIM_PATTERNS, priors: Mapping[str, float] = SECTION_PRIORS) -> DataFrame:
    """(doc_id, claim_id, position, claim_type, matched_patterns, confidence): sentences that patterns match, by the sections' priors.

    sentences: (doc_id, position, sentence, label), label being the section's. Two or more matches over all types
    give 0.8 but in sections of prior 0, which give no claims. claim_id counts a document's claims, clm_001 on.
    """
    stripped = F.regexp_replace("sentence", r"(?U)^\s+|\s+$", "")
    typed = F.array(
        *[
            F.struct(
                F.lit(k).alias("nth"),
                F.lit(t).alias("claim_type"),
                F.array_compact(F.array(*[F.when(F.col("stripped").rlike("(?iU)" + p), F.lit(p)) for p in ps])).alias("matched_patterns"),
            )
            for k, (t, ps) in enumerate(patterns.items())
        ]
    )
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])[F.col("label")], F.lit(0.5))
    hits = (
        sentences.select("doc_id", "position", stripped.alias("stripped"), prior.alias("prior"))
        .where("prior > 0")
        .select("doc_id", "position", "prior", F.filter(typed, lambda x: F.size(x["matched_patterns"]) > 0).alias("hits"))
    )
    total = F.aggregate("hits", F.lit(0), lambda n, x: n + F.size(x["matched_patterns"]))
    claims = hits.select("doc_id", "position", F.when(total >= 2, 0.8).otherwise(F.col("prior")).alias("confidence"), F.explode("hits").alias("hit"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "hit.nth"))
    return claims.select("doc_id", F.format_string("clm_%03d", nth).alias("claim_id"), "position", "hit.claim_type", "hit.matched_patterns", "confidence")


def find_entities(docs: DataFrame, lexicon: DataFrame, token: str = r"[A-Za-z]+") -> DataFrame:
    """(doc_id, text, label, n_mentions) of single-token lexicon entries (term, label), by an equi join on tokens."""
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("text"))
    terms = lexicon.withColumnRenamed("term", "text")
    if terms.count() <= LEXICON_ROWS:  # then no token is shuffled that is not in it
        terms = F.broadcast(terms)
    found = tokens.join(terms, "text")
    return found.groupBy("doc_id", "text", "label").agg(F.count(F.lit(1)).alias("n_mentions"))


def deduplicate(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key; ties by the least order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def concordance(sections: DataFrame) -> DataFrame:
    """(doc_id, share) of section pairs in canonical order.

    sections: (doc_id, position, rank). A document has few sections: its pairs are bounded.
    """
    a = sections.select("doc_id", F.col("position").alias("i"), F.col("rank").alias("a"))
    b = sections.select("doc_id", F.col("position").alias("j"), F.col("rank").alias("b"))
    return a.join(b, "doc_id").where("i < j").groupBy("doc_id").agg(F.round(F.avg((F.col("a") <= F.col("b")).cast("double")), 4).alias("share"))


def nearest_interval(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(doc_id, point_id, section_id) of the interval that holds the page, the last one, else the nearest.

    points: (doc_id, point_id, page); intervals: (doc_id, section_id, position, first, last). Nulls where a
    document has no interval.
    """
    both = points.join(intervals, "doc_id", "left")
    far = F.greatest(F.col("first") - F.col("page"), F.col("page") - F.col("last"), F.lit(0))
    best = F.min(F.struct(far.alias("far"), F.when(far == 0, -F.col("position")).otherwise(F.col("position")).alias("tie"), "section_id"))
    return both.groupBy("doc_id", "point_id").agg(best.alias("best")).select("doc_id", "point_id", "best.section_id")


def orphans(children: DataFrame, parents: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key) of children whose parent is missing."""
    return children.join(parents.select(key).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), key)
