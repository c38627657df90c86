"""Queries of sections and chunks: documents and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import documents as D
from quire.operators import sections as S
from quire.plans.registry import _table, query

# A line of a document is a paragraph, as its texts have no blank lines. Counts are folded in two recursions, one over paragraphs, one over sentences.
CHUNKS_SQL = r"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, p, len(list_filter(string_split_regex(p, '\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
    FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE p <> ''),
m(doc_id, i, g, n) AS (SELECT doc_id, i, 0, w FROM p WHERE i = 1
    UNION ALL SELECT p.doc_id, p.i, CASE WHEN n >= 150 THEN g + 1 ELSE g END, CASE WHEN n >= 150 THEN w ELSE n + w END FROM m JOIN p ON p.doc_id = m.doc_id AND p.i = m.i + 1),
small AS (SELECT doc_id, arg_max(g, i) AS g FROM m GROUP BY doc_id HAVING arg_max(n, i) < 150 AND max(g) > 0),
b AS MATERIALIZED (SELECT p.doc_id, CASE WHEN small.g = m.g THEN m.g - 1 ELSE m.g END AS g, string_agg(p, chr(10) || chr(10) ORDER BY p.i) AS t, sum(w) AS w
    FROM p JOIN m ON p.doc_id = m.doc_id AND p.i = m.i LEFT JOIN small ON small.doc_id = p.doc_id GROUP BY ALL),
s AS MATERIALIZED (SELECT doc_id, g, s, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS i
    FROM (SELECT doc_id, g, unnest(k) AS s, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, g, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS k FROM b WHERE w > 600)) WHERE s <> ''),
c(doc_id, g, i, h, n) AS (SELECT doc_id, g, i, 0, w FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.g, s.i, CASE WHEN n + w > 600 THEN h + 1 ELSE h END, CASE WHEN n + w > 600 THEN w ELSE n + w END FROM c JOIN s ON s.doc_id = c.doc_id AND s.g = c.g AND s.i = c.i + 1),
chunk AS (SELECT doc_id, g, 0 AS h, t, w FROM b WHERE w <= 600
    UNION ALL SELECT s.doc_id, s.g, h, string_agg(s, ' ' ORDER BY s.i), sum(w) FROM s JOIN c ON s.doc_id = c.doc_id AND s.g = c.g AND s.i = c.i GROUP BY ALL),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, h) - 1 AS o, w, t FROM chunk) """


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("position"), F.col("text").alias("content"))
    return C.chunk_sections(docs, gap=r"\n")


@query(CHUNKS_SQL + "SELECT doc_id, 'chk_' || lpad(o::VARCHAR, greatest(3, length(o::VARCHAR))::INTEGER, '0') AS chunk_id, o AS reading_order, w::BIGINT AS word_count, md5(t) AS digest FROM r")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, by their digests."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", F.col("reading_order").cast("long").alias("reading_order"), "word_count", F.md5("text").alias("digest"))


@query(CHUNKS_SQL + "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(w) AS BIGINT) AS n_words, count(*) FILTER (w < 150) AS n_small, count(*) FILTER (w > 600) AS n_large FROM r")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, and how many are outside the bounds."""
    w = F.col("word_count")
    return _chunks(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum(w).alias("n_words"),
        F.count(F.when(w < 150, 1)).alias("n_small"), F.count(F.when(w > 600, 1)).alias("n_large"),
    )


#: A dictionary for invented prose: its frequent words stand for headers.
VARIANTS = {
    "introduction": ["the and", "le la", "introduction"], "related_work": ["related work", "of the thing"], "methodology": ["the attion", "der die", "method"],
    "results": ["results", "in the", "que de"], "conclusion": ["conclusion", "und das"],
}


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, position, header, body, level, parent): lines as sections, their first sentence as header; long headers stand below the last short one."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"), r"\n")).alias("position", "line"))
    parts = T.sentences(F.col("line"), line_ends=False)
    header = F.get(parts, F.lit(0))
    level = F.when(T.word_count(header) <= 4, 1).otherwise(2)
    last = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("doc_id", "position", header.alias("header"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("body"), level.alias("level"))
    above = F.max(F.when(F.col("level") == 1, F.col("position"))).over(last)
    return rows.withColumn("parent", F.when(F.col("level") == 2, above))


@query(None)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every line's section. Beyond SQL: set ratios and a fold over earlier labels; tests hold it against brute force."""
    return S.label_sections(line_sections(spark, sf_dir), VARIANTS)


#: Patterns that invented prose holds, in place of CLAIM_PATTERNS.
PATTERNS = {
    "statistical": [r"and\s+the", r"les?\s+"], "causal": [r"of\s+the", r"de\s+la", r"und\s+d"], "comparative": [r"th[ae]n\s+"], "methodological": [r"in\s+(?:the|der)", r"est\s+"],
    "existence": [r"is\s+a", r"que\s+"], "negation": [r"not\s+", r"no\s+", r"nicht\s+"],
}


@query(None)
def labelled_section_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the sentences of labelled sections, with the sections' priors."""
    sections = line_sections(spark, sf_dir)
    labels = S.label_sections(sections, VARIANTS).select("doc_id", F.col("position").alias("section"), "label")
    told = sections.select("doc_id", F.col("position").alias("section"), F.posexplode(T.sentences(F.concat_ws(" ", "header", "body"))).alias("nth", "sentence"))
    place = (F.col("section").cast("long") * 1_000_000 + F.col("nth")).alias("position")
    return D.section_claims(told.join(labels, ["doc_id", "section"]).select("doc_id", place, "sentence", "label"), PATTERNS)


_SENTENCES = r"""t AS (SELECT doc_id, lang, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30) || '|\n+'), lambda x: trim(x) <> '') AS k FROM documents),
s AS (SELECT doc_id, lang, trim(unnest(k), ' ' || chr(9) || chr(10) || chr(13)) AS s, generate_subscripts(k, 1) - 1 AS position FROM t)"""
_LABEL = {"en": "results", "de": "introduction", "fr": "conclusion", "es": "appendix"}
_HITS = ", ".join("".join(" + " * (i > 0) + f"CAST(regexp_matches(s, '(?i){p}') AS BIGINT)" for i, p in enumerate(ps)) + f" AS n{k}" for k, ps in enumerate(PATTERNS.values()))
_COUNTS = " + ".join(f"n{k}" for k in range(len(PATTERNS)))


@query(rf"""WITH {_SENTENCES}, h AS (SELECT doc_id, lang, position, {_HITS} FROM s WHERE lang <> 'es'),
c AS (SELECT doc_id, position, unnest([{", ".join(f"{{'k': {k}, 't': '{t}', 'n': n{k}}}" for k, t in enumerate(PATTERNS))}]) AS x,
    CASE WHEN {_COUNTS} >= 2 THEN 0.8 ELSE CASE lang {" ".join(f"WHEN '{k}' THEN {D.SECTION_PRIORS[v]}" for k, v in _LABEL.items())} END END AS confidence FROM h)
SELECT doc_id, 'clm_' || lpad(nth::VARCHAR, greatest(3, length(nth::VARCHAR))::INTEGER, '0') AS claim_id, position, claim_type, n_patterns, confidence FROM
    (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position, x.k) AS nth, position, x.t AS claim_type, x.n AS n_patterns, confidence::DOUBLE AS confidence FROM c WHERE x.n > 0)""")
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every document; its language stands for its sections' label, one of them for a label without claims."""
    docs = _table(spark, sf_dir, "documents")
    label = F.create_map(*[F.lit(x) for kv in _LABEL.items() for x in kv])[F.col("lang")]
    claims = D.section_claims(D.sentence_table(docs, "lang").select("doc_id", "position", "sentence", label.alias("label")), PATTERNS)
    return claims.select("doc_id", "claim_id", F.col("position").cast("long").alias("position"), "claim_type", F.size("matched_patterns").cast("long").alias("n_patterns"), "confidence")
