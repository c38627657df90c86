"""Evidence of facts, triples and claims: where their texts stand, the chains they form, and how much of a document is covered.

Records of one chunk are aggregated before anything is joined to them, so a chunk of many claims and facts gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.corpus import evidence_span

#: The kind of evidence that a fact's or a claim's type is; derived and paraphrase for any other. Fixed values.
FACT_EVIDENCE = {"method": "derived", "dataset": "derived", "metric": "derived", "contribution": "paraphrase", "limitation": "paraphrase", "future_work": "paraphrase"}
CLAIM_EVIDENCE = {
    "statistical": "statistical", "causal": "paraphrase", "comparative": "paraphrase", "methodological": "paraphrase", "existence": "direct_quote", "negation": "direct_quote",
}


def _kind_of(types: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("type")], F.lit(other))


def evidence_records(facts: DataFrame, triples: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, evidence_id, source, evidence_type, source_text, chunk_id, section_id, page, char_start, char_end, span_basis, sha256, method, confidence).

    facts: (doc_id, fact_id, type, value, evidence_text, chunk_id, section_id, confidence); triples: (doc_id, triple_id, subject_text,
    predicate, object_text, chunk_id, confidence); claims: (doc_id, claim_id, type, sentence, chunk_id, section_id, page, confidence);
    chunks: (doc_id, chunk_id, text, page, method), chunk_id being unique in its document. A record lies somewhere if it has a chunk,
    a section or a page, and only then has a digest; a span is where the chunk holds its text (evidence_span). A chunk
    that is not there has no text and no page, and its method is grobid.
    """
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("int")
    columns = ["doc_id", "evidence_id", "source", "evidence_type", "source_text", "chunk_id", "section_id", "own_page", "confidence"]

    def rows(table: DataFrame, key: str, source: str, kind: Column, text: Column, section: Column, page: Column) -> DataFrame:
        return table.select("doc_id", F.concat(F.lit("ev_"), key).alias("evidence_id"), F.lit(source).alias("source"), kind.alias("evidence_type"), text.alias("source_text"), "chunk_id", section.alias("section_id"), page.alias("own_page"), "confidence").select(*columns)

    said = F.coalesce(F.nullif("evidence_text", F.lit("")), F.col("value"))
    everything = (
        rows(facts, "fact_id", "fact", _kind_of(FACT_EVIDENCE, "derived"), said, F.col("section_id"), nowhere)
        .unionByName(rows(triples, "triple_id", "triple", F.lit("derived"), F.concat_ws(" ", "subject_text", "predicate", "object_text"), none, nowhere))
        .unionByName(rows(claims, "claim_id", "claim", _kind_of(CLAIM_EVIDENCE, "paraphrase"), F.col("sentence"), F.col("section_id"), F.col("page").cast("int")))
    )
    found = everything.join(chunks.select("doc_id", "chunk_id", "text", F.col("page").cast("int").alias("page"), "method"), ["doc_id", "chunk_id"], "left")
    span = evidence_span(F.col("text"), F.col("source_text"))
    page = F.coalesce(F.nullif("page", F.lit(0)), "own_page", "page")
    told = found.withColumn("span", span).withColumn("page", page)
    located = F.col("chunk_id").isNotNull() | F.col("section_id").isNotNull() | F.col("page").isNotNull()
    return told.select(
        "doc_id", "evidence_id", "source", "evidence_type", "source_text", "chunk_id", "section_id", "page", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"),
        F.col("span.basis").alias("span_basis"), F.when(located, F.sha2("source_text", 256)).alias("sha256"), F.coalesce("method", F.lit("grobid")).alias("method"), "confidence",
    )


def evidence_chains(records: DataFrame, triples: DataFrame, uses: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, kind, target_id, evidence_id, n_records, confidence): chains of evidence, by the least confidence in each.

    records as evidence_records gives them; triples: (doc_id, triple_id, subject_id, object_id, confidence); uses: (doc_id, triple_id,
    fact_id), the facts that a triple rests on; entities: (doc_id, entity_id). Three kinds. claim: a claim with all facts and triples that lie
    somewhere and in its chunk (no chunk being one, too), if there are any. fact: a fact with a triple that uses it; evidence_id is the
    triple's. entity: a triple for its subject, or else its object, if that is an entity.
    """
    claim = records.where("source = 'claim'").select("doc_id", F.expr("substring(evidence_id, 4)").alias("target_id"), "evidence_id", F.coalesce("chunk_id", F.lit("")).alias("place"), "confidence")
    held = records.where("source <> 'claim' and sha256 is not null").groupBy("doc_id", F.coalesce("chunk_id", F.lit("")).alias("place"))
    around = held.agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"))
    by_claim = claim.join(around, ["doc_id", "place"]).select(
        "doc_id", F.lit("claim").alias("kind"), "target_id", "evidence_id", (F.col("n") + 1).alias("n_records"), F.least("confidence", "least").alias("confidence")
    )
    fact = records.where("source = 'fact'").select("doc_id", F.col("evidence_id").alias("target_id"), F.col("confidence").alias("least"))
    triple = records.where("source = 'triple'").select("doc_id", "evidence_id", "confidence")
    used = uses.distinct().select("doc_id", F.concat(F.lit("ev_"), "fact_id").alias("target_id"), F.concat(F.lit("ev_"), "triple_id").alias("evidence_id"))
    by_fact = used.join(fact, ["doc_id", "target_id"]).join(triple, ["doc_id", "evidence_id"]).select(
        "doc_id", F.lit("fact").alias("kind"), "target_id", "evidence_id", F.lit(2).cast("long").alias("n_records"), F.least("confidence", "least").alias("confidence")
    )
    known = entities.select("doc_id", F.col("entity_id").cast("string").alias("entity_id")).distinct()
    ends = triples.select("doc_id", F.concat(F.lit("ev_"), "triple_id").alias("evidence_id"), "confidence", F.posexplode(F.array(F.col("subject_id").cast("string"), F.col("object_id").cast("string"))).alias("nth", "entity_id"))
    first = ends.join(known, ["doc_id", "entity_id"]).groupBy("doc_id", "evidence_id", "confidence").agg(F.min_by("entity_id", "nth").alias("target_id"))
    by_entity = first.select("doc_id", F.lit("entity").alias("kind"), "target_id", "evidence_id", F.lit(1).cast("long").alias("n_records"), "confidence")
    return by_claim.unionByName(by_fact).unionByName(by_entity)


def evidence_coverage(documents: DataFrame, records: DataFrame, triples: DataFrame, entities: DataFrame, citations: DataFrame, references: DataFrame) -> DataFrame:
    """A row for each of documents (doc_id): total_, with_ and rate_ of claims, entities, citations and references, rates to 4 digits.

    A claim counts if it has a record, an entity if it is the subject of a triple, a citation if it has an intent, a reference if
    it is resolved. citations: (doc_id, intent); references: (doc_id, resolved).
    """
    subjects = triples.select("doc_id", F.col("subject_id").cast("string").alias("entity_id"), F.lit(1).alias("hit")).distinct()
    named = entities.select("doc_id", F.col("entity_id").cast("string").alias("entity_id")).join(subjects, ["doc_id", "entity_id"], "left")
    parts = {
        "claims": records.where("source = 'claim'").select("doc_id", F.lit(True).alias("hit")),
        "entities": named.select("doc_id", F.col("hit").isNotNull().alias("hit")),
        "citations": citations.select("doc_id", F.col("intent").isNotNull().alias("hit")),
        "references": references.select("doc_id", F.coalesce("resolved", F.lit(False)).alias("hit")),
    }
    each = None
    for kind, rows in parts.items():
        rows = rows.select("doc_id", F.lit(kind).alias("kind"), "hit")
        each = rows if each is None else each.unionByName(rows)
    counted = each.groupBy("doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"total_{k}") for k in parts], *[F.count(F.when((F.col("kind") == k) & F.col("hit"), 1)).alias(f"with_{k}") for k in parts]
    )
    rate = {f"rate_{k}": F.when(F.col(f"total_{k}") > 0, F.round(F.col(f"with_{k}") / F.col(f"total_{k}"), 4)).otherwise(0.0) for k in parts}
    return documents.select("doc_id").distinct().join(counted, "doc_id", "left").fillna(0).withColumns(rate)
