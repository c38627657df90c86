"""Whether a document's parts fit together, how complete they are, and what lies in each chunk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import once


def _missing(rows: DataFrame, item: str, key: str, known: DataFrame, rule: str, severity: str = "error", own: str | None = None) -> DataFrame:
    """Items whose key none of known has in their document; a null key is missing too."""
    keys = known.select("doc_id", F.col(own or key).alias(key)).distinct()
    gone = rows.join(keys, ["doc_id", key], "left_anti")
    return _found(gone, F.col(item), rule, severity)


def _found(rows: DataFrame, item: Column, rule: str, severity: str) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), item.cast("string").alias("item_id"))


def validate(sections: DataFrame, chunks: DataFrame, references: DataFrame, citations: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, rule, severity, item_id) of everything that does not fit; a document without rows is whole.

    sections: (doc_id, section_id); chunks: (doc_id, chunk_id, section_id, text, reading_order); references: (doc_id, ref_id); citations: (doc_id, citation_id,
    ref_id, chunk_id, section_id); entities: (doc_id, entity_id, chunk_id); claims: (doc_id, claim_id, chunk_id, section_id). Errors: chunk_section,
    citation_ref (a null ref_id is none), citation_chunk, entity_chunk, claim_chunk, claim_section, chunk_text (blank), reading_order_duplicate (once a
    document). Warnings: reading_order_gap (not 0 to n - 1, once a document), section_chunks (a section without any), citation_section (not its chunk's).
    """
    order = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("reading_order").alias("different"), F.min("reading_order").alias("low"), F.max("reading_order").alias("high")
    )
    whole = (F.col("different") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    own = chunks.select("doc_id", "chunk_id", F.col("section_id").alias("of")).where("coalesce(of, '') <> ''").distinct()
    astray = citations.join(own, ["doc_id", "chunk_id"]).where(~F.col("section_id").eqNullSafe(F.col("of")))
    none = F.lit(None)
    return reduce(DataFrame.unionByName, [
        _missing(chunks, "chunk_id", "section_id", sections, "chunk_section"),
        _missing(citations.where("ref_id is not null"), "citation_id", "ref_id", references, "citation_ref"),
        _missing(citations, "citation_id", "chunk_id", chunks, "citation_chunk"), _missing(entities, "entity_id", "chunk_id", chunks, "entity_chunk"),
        _missing(claims, "claim_id", "chunk_id", chunks, "claim_chunk"), _missing(claims, "claim_id", "section_id", sections, "claim_section"),
        _found(chunks.where(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")), F.col("chunk_id"), "chunk_text", "error"),
        _found(order.where("different < n"), none, "reading_order_duplicate", "error"), _found(order.where(~F.coalesce(whole, F.lit(False))), none, "reading_order_gap", "warning"),
        _missing(sections, "section_id", "section_id", chunks, "section_chunks", "warning"), _found(astray, F.col("citation_id"), "citation_section", "warning"),
    ])


def validate_rows(parts: DataFrame) -> DataFrame:
    """validate with a row for each document, for documents of few parts: parts has doc_id and the six tables as arrays of structs.

    Items of a document meet its keys one by one, so a document of many parts belongs to validate.
    """
    found = lambda rows, item, rule, severity: F.transform(rows, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), item(x).cast("string").alias("item_id")))

    def missing(rows: str | Column, item: str, key: str, known: str, rule: str, severity: str = "error") -> Column:
        gone = once(F.transform(known, lambda k: k[key]), lambda keys: F.filter(rows, lambda x: ~F.coalesce(F.array_contains(keys, x[key]), F.lit(False))))
        return found(gone, lambda x: x[item], rule, severity)

    orders, n = F.transform("chunks", lambda c: c["reading_order"]), F.size("chunks")
    once_a_document = lambda when, rule, severity: found(F.filter(F.array(F.lit(1)), lambda _: when), lambda _: F.lit(None), rule, severity)
    different = F.size(F.array_distinct(F.filter(orders, lambda o: o.isNotNull())))
    whole = (different == n) & (F.array_min(orders) == 0) & (F.array_max(orders) == n - 1)
    own = F.array_distinct(F.transform(F.filter("chunks", lambda c: F.coalesce(c["section_id"], F.lit("")) != ""), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["section_id"].alias("of"))))
    others = lambda x, held: F.filter(held, lambda o: (o["chunk_id"] == x["chunk_id"]) & ~x["section_id"].eqNullSafe(o["of"]))
    astray = once(own, lambda held: F.flatten(F.transform("citations", lambda x: F.transform(others(x, held), lambda _: x))))
    every = F.concat(
        missing("chunks", "chunk_id", "section_id", "sections", "chunk_section"), missing(F.filter("citations", lambda x: x["ref_id"].isNotNull()), "citation_id", "ref_id", "references", "citation_ref"),
        missing("citations", "citation_id", "chunk_id", "chunks", "citation_chunk"), missing("entities", "entity_id", "chunk_id", "chunks", "entity_chunk"),
        missing("claims", "claim_id", "chunk_id", "chunks", "claim_chunk"), missing("claims", "claim_id", "section_id", "sections", "claim_section"),
        found(F.filter("chunks", lambda c: ~F.coalesce(c["text"], F.lit("")).rlike(r"(?U)\S")), lambda c: c["chunk_id"], "chunk_text", "error"),
        once_a_document(different < n, "reading_order_duplicate", "error"), once_a_document((n > 0) & ~F.coalesce(whole, F.lit(False)), "reading_order_gap", "warning"),
        missing("sections", "section_id", "section_id", "chunks", "section_chunks", "warning"), found(astray, lambda x: x["citation_id"], "citation_section", "warning"),
    )
    # explode would have Spark build the arrays once more, to see which are empty
    return parts.select("doc_id", F.explode_outer(every).alias("x")).where("x is not null").select("doc_id", "x.*")


def counts_of_rows(parts: DataFrame) -> DataFrame:
    """(doc_id and the counts of completeness) of documents of a row each, as in validate_rows."""
    pages = F.flatten(F.transform(F.filter("chunks", lambda c: c["page_end"] >= c["page_start"]), lambda c: F.sequence(c["page_start"], c["page_end"])))
    counts = {
        "pages_with_text": F.array_distinct(pages), "sections_detected": F.col("sections"), "references_total": F.col("references"), "references_resolved": F.filter("references", lambda r: r["resolved"]),
        "citations_total": F.col("citations"), "citations_linked": F.filter("citations", lambda c: c["ref_id"].isNotNull()), "chunks_total": F.col("chunks"), "entities_total": F.col("entities"), "claims_total": F.col("claims"),
    }
    return parts.select("doc_id", *[F.size(v).cast("long").alias(k) for k, v in counts.items()])


def completeness(documents: DataFrame, sections: DataFrame, chunks: DataFrame, references: DataFrame, citations: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each of documents (doc_id, page_count): pages, pages with text, and how many of each part there are, references resolved and citations linked.

    chunks: (doc_id, page_start, page_end), a page counting once however many chunks touch it; references: (doc_id, resolved); citations: (doc_id, ref_id).
    """
    return completed(documents, counts(sections, chunks, references, citations, entities, claims))


def counts(sections: DataFrame, chunks: DataFrame, references: DataFrame, citations: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """The counts of completeness, by doc_id, of documents with any part."""
    pages = chunks.where("page_end >= page_start").select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    by_kind = {
        "pages_with_text": pages.select("doc_id", F.lit(True).alias("hit")), "sections_detected": sections.select("doc_id", F.lit(True).alias("hit")), "references_total": references.select("doc_id", F.lit(True).alias("hit")),
        "references_resolved": references.select("doc_id", F.coalesce("resolved", F.lit(False)).alias("hit")), "citations_total": citations.select("doc_id", F.lit(True).alias("hit")),
        "citations_linked": citations.select("doc_id", F.col("ref_id").isNotNull().alias("hit")), "chunks_total": chunks.select("doc_id", F.lit(True).alias("hit")),
        "entities_total": entities.select("doc_id", F.lit(True).alias("hit")), "claims_total": claims.select("doc_id", F.lit(True).alias("hit")),
    }
    every = reduce(DataFrame.unionByName, [t.withColumn("kind", F.lit(k)) for k, t in by_kind.items()]).where("hit")
    return every.groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in by_kind])


def completed(documents: DataFrame, counted: DataFrame) -> DataFrame:
    """documents with their counts, 0 for what they lack."""
    counts = [c for c in counted.columns if c != "doc_id"]
    return documents.select("doc_id", F.col("page_count").alias("total_pages")).join(counted, "doc_id", "left").fillna(0, counts)


def chunk_indices(chunks: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, entity_ids, claim_ids) of every chunk: the ids of what lies in it, in order; empty lists for none."""
    key = ["doc_id", "chunk_id"]
    gathered = lambda t, item, name: t.groupBy(*key).agg(F.array_sort(F.collect_list(F.col(item).cast("string"))).alias(name))
    found = chunks.select(*key).join(gathered(entities, "entity_id", "entity_ids"), key, "left").join(gathered(claims, "claim_id", "claim_ids"), key, "left")
    empty = F.array().cast("array<string>")
    return found.select(*key, F.coalesce("entity_ids", empty).alias("entity_ids"), F.coalesce("claim_ids", empty).alias("claim_ids"))
