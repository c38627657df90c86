"""A corpus of documents as tables: postings, finders, statistics, registry, scores. Nulls in a key leave a row out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import words

#: Weights of the field scores in a document's quality, in this order. Fixed values.
FIELD_WEIGHTS = {
    "title": 0.20, "authors": 0.15, "abstract": 0.15, "sections": 0.15, "references": 0.15, "citations": 0.10, "entities": 0.05, "claims": 0.05,
}


def folded(name: Column) -> Column:
    """A name as indexes hold it: trimmed, lower-cased, null if empty."""
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def year_of(date: Column) -> Column:
    """The four digits a date text begins with, else null."""
    return F.nullif(F.regexp_extract(date.cast("string"), r"^(\d{4})", 1), F.lit(""))


def postings(keyed: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(index_name, key, doc_id), each once: the postings of several inverted indexes.

    keyed: by index name, a table with doc_id and the expression of its key. Postings stay rows, so that no key's
    documents are gathered anywhere; duplicates go by one shuffle for all indexes.
    """
    parts = [t.select(F.lit(name).alias("index_name"), key.cast("string").alias("key"), "doc_id") for name, (t, key) in keyed.items()]
    return reduce(DataFrame.unionByName, parts).where("key is not null").distinct()


def find(docs: DataFrame, rows: DataFrame, condition: Column) -> DataFrame:
    """The rows of docs of whose rows (doc_id, ...) any meets a condition."""
    return docs.join(rows.where(condition).select("doc_id"), "doc_id", "left_semi")


def histogram(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n_docs): different documents by key."""
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.countDistinct("doc_id").alias("n_docs"))


def confidence_statistics(rows: DataFrame) -> DataFrame:
    """One row: n, and mean, least, largest and sample deviation of confidence, to 4 digits."""
    return rows.agg(
        F.count("confidence").alias("n"),
        *[F.round(f("confidence"), 4).alias(f"{name}_confidence") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))],
    )


def citation_density(docs: DataFrame, *links: DataFrame) -> DataFrame:
    """One row: documents, different links (source_id, target_id) of all tables together, and links over n (n - 1)."""
    edges = reduce(DataFrame.unionByName, [t.select("source_id", "target_id") for t in links]).distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    n = docs.agg(F.count(F.lit(1)).alias("n_documents"))
    possible = F.col("n_documents") * (F.col("n_documents") - 1)
    return n.crossJoin(edges).select("n_documents", "n_edges", F.when(possible > 0, F.round(F.col("n_edges") / possible, 8)).otherwise(0.0).alias("density"))


def merge_coverage(parts: DataFrame, pairs: list[str]) -> DataFrame:
    """One row: for each pair x the sums x_with and x_total of all rows and their rate to 4 digits, 0 where empty."""
    sums = parts.agg(*[F.coalesce(F.sum(f"{p}_{k}"), F.lit(0)).alias(f"{p}_{k}") for p in pairs for k in ("with", "total")])
    rate = [F.when(F.col(f"{p}_total") > 0, F.round(F.col(f"{p}_with") / F.col(f"{p}_total"), 4)).otherwise(0.0).alias(f"{p}_rate") for p in pairs]
    return sums.select("*", *rate)


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, sha256, status, earlier_id) of new (doc_id, sha256): what becomes of each row as they come in by doc_id.

    duplicate: known or an earlier new row holds its hash, earlier_id being the least such id, a known one first; refused: its
    doc_id is taken by another; else added. Of repeated new rows of one id and hash one is told.
    """
    seen = known.groupBy("sha256").agg(F.min("doc_id").alias("known_id"))
    first = new.groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    taken = known.select("doc_id", F.lit(True).alias("taken")).distinct()
    told = new.distinct().join(first, "sha256").join(seen, "sha256", "left").join(taken, "doc_id", "left")
    earlier = F.coalesce("known_id", F.when(F.col("first_id") < F.col("doc_id"), F.col("first_id")))
    # of rows of one id that bring different hashes, one can be added
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("earlier_id").isNotNull(), "sha256"))
    status = F.when(F.col("earlier_id").isNotNull(), "duplicate").when(F.coalesce("taken", F.lit(False)) | (F.col("nth") > 1), "refused").otherwise("added")
    return told.withColumn("earlier_id", earlier).withColumn("nth", nth).select("doc_id", "sha256", status.alias("status"), "earlier_id")


def field_scores(per_document: DataFrame) -> DataFrame:
    """doc_id, score_references, score_citations, score_entities, score_claims from counts by document.

    per_document: doc_id, n_refs, n_resolved, n_fields (of five a reference), n_citations, n_linked, n_entities,
    entity_confidence (mean), n_labels (different ones, of 13), n_claims, claim_confidence (mean), n_claim_sections,
    n_sections. Without rows of a kind its score is 0.
    """
    def some(n: str, score: Column) -> Column:
        return F.when(F.col(n) > 0, F.round(score, 6)).otherwise(0.0)

    def upto(n: str, most: float) -> Column:
        return F.least(F.col(n) / most, F.lit(1.0))

    return per_document.select(
        "doc_id",
        some("n_refs", 0.5 * F.col("n_resolved") / F.col("n_refs") + 0.3 * F.col("n_fields") / (5 * F.col("n_refs")) + 0.2 * upto("n_refs", 5)).alias("score_references"),
        some("n_citations", 0.6 * F.col("n_linked") / F.col("n_citations") + 0.4).alias("score_citations"),
        some("n_entities", 0.5 * F.col("entity_confidence") + 0.3 * upto("n_entities", 10) + 0.2 * F.col("n_labels") / 13).alias("score_entities"),
        some("n_claims", 0.5 * F.col("claim_confidence") + 0.3 * upto("n_claims", 3) + 0.2 * F.col("n_claim_sections") / F.greatest("n_sections", F.lit(1))).alias("score_claims"),
    )


def overall(scores: DataFrame) -> Column:
    """The weighted sum of score_<field> columns, absent ones counting 0, held between 0 and 1."""
    total = sum((w * F.coalesce(f"score_{f}", F.lit(0.0)) for f, w in FIELD_WEIGHTS.items() if f"score_{f}" in scores.columns), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def quality(scores: DataFrame) -> DataFrame:
    """doc_id and overall."""
    return scores.select("doc_id", overall(scores).alias("overall"))


def _length(n: Column, least: int, most: int) -> Column:
    """1 for least to most words, less in proportion for fewer, and for more down to 0 at twice as many."""
    over = F.greatest(F.lit(0.0), 1.0 - (n - most) / float(most))
    return F.when(n < least, n / float(least)).when(n > most, over).otherwise(1.0)


def _clean(text: Column) -> Column:
    return (~text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F�]")).cast("double")


def title_score(title: Column, confidence: Column, primary: Column | bool = True) -> Column:
    """0.5 confidence (0.8 of it unless it came by a primary route), 0.3 for 5 to 30 words, 0.2 for no garbage; null as empty."""
    text = F.coalesce(title, F.lit(""))
    sure = F.when(F.lit(primary), confidence).otherwise(0.8 * confidence)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * sure + 0.3 * _length(F.size(words(text)), 5, 30) + 0.2 * _clean(text))), 6)


def abstract_score(abstract: Column) -> Column:
    """0.4 for being there, 0.3 for 50 to 500 words, 0.3 for no garbage; 0 for null and blank."""
    text = F.coalesce(abstract, F.lit(""))
    n = F.size(words(text))
    return F.when(n > 0, F.round(0.4 + 0.3 * _length(n, 50, 500) + 0.3 * _clean(text), 6)).otherwise(0.0)


def author_scores(authors: DataFrame) -> DataFrame:
    """(doc_id, score_authors): 0.4 for having any, 0.3 for the share with surnames, 0.3 for the share with affiliations.

    authors: (doc_id, surname, n_affiliations); documents without any are not in the result.
    """
    named = F.avg(F.when(F.trim("surname") != "", 1.0).otherwise(0.0))
    placed = F.avg(F.when(F.col("n_affiliations") > 0, 1.0).otherwise(0.0))
    return authors.groupBy("doc_id").agg(F.round(0.4 + 0.3 * named + 0.3 * placed, 6).alias("score_authors"))


def review_reasons(overall: Column, title: Column, sections: Column, linked: Column) -> Column:
    """Why a document needs a person's review; nulls give no reason."""
    return F.array_compact(
        F.array(
            F.when(overall < 0.5, "low_overall"),
            F.when(title < 0.4, "low_title"),
            F.when(sections < 0.4, "low_sections"),
            F.when(1 - linked > 0.3, "unlinked_citations"),
        )
    )


def deduplicate_facts(facts: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(value, fact_type, confidence): of a value and type the most confident; where all types of a value are equally sure, the first by priority alone.

    facts: (value, fact_type, confidence); values are compared trimmed and lower-cased.
    """
    best = facts.groupBy(folded(F.col("value")).alias("value"), "fact_type").agg(F.max("confidence").alias("confidence")).where("value is not null")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("fact_type")], F.lit(len(priority)))
    of = best.groupBy("value").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.min(F.struct(rank.alias("r"), "fact_type")).alias("first"))
    return best.join(of, "value").where("low < high or fact_type = first.fact_type").select("value", "fact_type", "confidence")


def deduplicate_triples(triples: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, confidence, n_evidence): equal triples as one, the most confident; evidence_id counts once."""
    return triples.groupBy("subject_id", "predicate", "object_id").agg(F.max("confidence").alias("confidence"), F.countDistinct("evidence_id").alias("n_evidence"))


def normalized_predicate(raw: Column, forms: dict[str, str]) -> Column:
    """The predicate that a verb form stands for, else the form itself, trimmed and lower-cased."""
    low = F.lower(F.trim(raw))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])[low], low)


def evidence_span(chunk: Column, source: Column) -> Column:
    """struct(start, end, basis) of source, trimmed, in chunk: `exact`, else in `any_case`, else with white space `collapsed`.

    Collapsed places count in the chunk's text with its white space collapsed. Null if source is absent, null or blank.
    """
    squeeze = lambda text: F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    asked = F.regexp_replace(source, r"(?U)^\s+|\s+$", "")

    def at(where: Column, what: Column, basis: str) -> Column:
        start = F.instr(where, what) - 1
        return F.when((what != "") & (start >= 0), F.struct(start.alias("start"), (start + F.char_length(what)).alias("end"), F.lit(basis).alias("basis")))

    return F.coalesce(
        at(chunk, asked, "exact"), at(F.lower(chunk), F.lower(asked), "any_case"), at(F.lower(squeeze(chunk)), F.lower(squeeze(asked)), "collapsed")
    )
