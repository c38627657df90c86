"""Queries of facts: documents with their lines of orders as entities and claims, and a page's title as a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import facts as A
from quire.plans.registry import _table, query
from quire.plans.relation_queries import with_counts
from quire.plans.resolution_queries import _TITLE

#: Phrases and title words that invented prose holds, in place of PHRASES and TITLE_WORDS.
PHRASES = {"contribution": {"and_the": r"and\s+the\s", "que": r"que\s"}, "limitation": {"not": r"not\s+", "nicht": r"nicht\s"}, "future_work": {"will": r"of\s+the"}}
TITLE_WORDS = [("the_keyword", "dataset", "the|der"), ("of_keyword", "method", "of|de|und"), ("and_keyword", "metric", "and|ea")]
_LABEL = {"en": "methodology", "de": "conclusion", "fr": "limitations", "es": "other"}
_KIND = {"PROMO": "method", "ECONOMY": "tool", "STANDARD": "dataset", "MEDIUM": "metric"}
_CLAIM = {"PROMO": "negation", "ECONOMY": "causal", "STANDARD": "existence", "MEDIUM": "statistical"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    of = lambda values, key: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(key)]
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"))
    lines = _table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    key, sure = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.round(1 - 8 * F.col("l_discount"), 2).alias("confidence")
    entities, claims = lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")
    titles = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("html", _TITLE, 1).alias("title"))
    refs = with_counts(spark, sf_dir, docs.select("doc_id"), "pages").withColumn("page", F.col("doc_id") % F.col("n_pages")).join(titles, "page")
    return A.extract_facts(
        docs.select("doc_id", F.lit("sec_001").alias("section_id"), of(_LABEL, "lang").alias("label"), F.lit(0.9).alias("confidence"), F.col("text").alias("content")),
        entities.select("doc_id", F.concat(F.lit("ent_"), key).alias("entity_id"), of(_KIND, "p_type").alias("label"), F.concat(F.lit(" "), "p_name").alias("text"), sure, F.lit("chk_000").alias("chunk_id"), F.lit("lexicon").alias("source")),
        claims.select("doc_id", F.concat(F.lit("clm_"), key).alias("claim_id"), of(_CLAIM, "p_type").alias("claim_type"), F.concat_ws(" ", "p_name", "p_brand").alias("sentence"), sure, F.lit("chk_000").alias("chunk_id")),
        docs.where("text is not null").select("doc_id", F.lit("chk_000").alias("chunk_id"), "text"),
        refs.select("doc_id", F.lit("ref_001").alias("ref_id"), F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise("").alias("title"), F.col("title").alias("raw_text")),
        PHRASES, TITLE_WORDS,
    )


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS fact_type, '{n}' AS matched, unnest(regexp_extract_all(regexp_replace(text, '(?i){p}', chr(1) || '\\0', 'g'), '[^.!?\\n]*[.!?\\n]?')) AS s FROM documents" for t, ps in PHRASES.items() for n, p in ps.items()
)
_TITLED = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS fact_type, title AS value, {A.OF_TITLE}::DOUBLE AS confidence, 'reference' AS source_type, 'ref_001' AS source_id, NULL AS chunk_id, '{n}' AS matched FROM r WHERE regexp_matches(title, '(?i)\\b(?:{w})\\b')" for n, t, w in TITLE_WORDS)
_SQL = rf"""WITH l AS (SELECT o_custkey AS doc_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, p_type, p_name, p_brand, l_returnflag AS f, round(1 - 8 * l_discount, 2) AS c
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)),
r AS (SELECT doc_id, trim(regexp_extract(html, '{_TITLE}', 1)) AS title FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)),
s AS (SELECT doc_id, fact_type, matched, trim(replace(s, chr(1), ''), {_BLANK}) AS value, unnest(generate_series(1, length(s) - length(replace(s, chr(1), '')))) AS i FROM ({_PHRASES}) WHERE contains(s, chr(1))),
f AS (SELECT doc_id, {_case("lang", {k: A.SECTIONS[v] for k, v in _LABEL.items() if v in A.SECTIONS})} AS fact_type, left(trim(text, {_BLANK}), {A.VALUE}) AS value, round(0.9 * {A.OF_SECTION}, 4)::DOUBLE AS confidence, 'section' AS source_type, 'sec_001' AS source_id,
    NULL AS chunk_id, {_case("lang", _LABEL)} AS matched FROM documents
UNION ALL SELECT doc_id, {_case("p_type", {k: A.ENTITIES[v] for k, v in _KIND.items()})}, p_name, c, 'entity', 'ent_' || k, 'chk_000', 'lexicon' FROM l WHERE f = 'R'
UNION ALL SELECT doc_id, {_case("p_type", {k: A.CLAIMS[v] for k, v in _CLAIM.items() if v in A.CLAIMS})}, p_name || ' ' || p_brand, round(c * {A.OF_CLAIM}, 4), 'claim', 'clm_' || k, 'chk_000', {_case("p_type", _CLAIM)} FROM l WHERE f = 'A'
UNION ALL SELECT doc_id, fact_type, value, {A.OF_PHRASE}, 'pattern', 'chk_000', 'chk_000', matched FROM s UNION ALL {_TITLED})"""
_KEPT = f"FROM f WHERE fact_type IS NOT NULL AND confidence >= {A.LEAST} AND value <> ''"


@query(_SQL + f" SELECT doc_id, fact_type, md5(value) AS digest, confidence, source_type, source_id, chunk_id, matched {_KEPT}")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts of all documents, their values by digest."""
    return facts(spark, sf_dir).withColumn("digest", F.md5("value")).drop("fact_id", "value")


@query(_SQL + f" SELECT source_type, fact_type, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs, round(avg(confidence), 4) AS mean_confidence {_KEPT} GROUP BY ALL")
def extracted_fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by how they were found and what they are."""
    return facts(spark, sf_dir).groupBy("source_type", "fact_type").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
