"""Queries of evidence: orders stand for documents, their lines for facts, triples and claims, the names on a half of an order for a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import evidence as E
from quire.plans.registry import _table, query


def corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Accepted lines are facts, new ones triples, returned ones claims; a line of 45 or more pieces has no chunk."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "*").join(_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    place = F.when(F.col("l_quantity") < 45, F.concat(F.lit("chk_"), F.col("l_linenumber") % 2)).alias("chunk_id")
    sure = F.round(1 - F.col("l_discount"), 2).alias("confidence")
    section = F.when(F.col("l_tax") > 0.04, F.lit("sec_001")).alias("section_id")
    kind = F.lower("p_type").alias("type")
    names = F.array_join(F.array_sort(F.collect_list("p_name")), "  ")
    facts, triples, claims = (lines.where(f"l_returnflag = '{f}'") for f in "ANR")
    facts = facts.select("doc_id", key.alias("fact_id"), kind, F.upper("p_name").alias("value"), F.when(F.col("l_tax") < 0.02, F.col("p_name")).alias("evidence_text"), place, section, sure, "l_partkey")
    triples = triples.select("doc_id", key.alias("triple_id"), F.split("p_name", " ")[0].alias("subject_text"), F.split("p_name", " ")[1].alias("predicate"), F.col("p_brand").alias("object_text"), place, F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("object_id"), sure)
    return {
        "facts": facts,
        "triples": triples,
        "claims": claims.select("doc_id", key.alias("claim_id"), kind, F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("\n "))).alias("sentence"), place, section, F.when(F.col("l_tax") > 0.06, F.col("l_linenumber")).alias("page"), sure),
        "chunks": lines.groupBy("doc_id", F.concat(F.lit("chk_"), F.col("l_linenumber") % 2).alias("chunk_id")).agg(names.alias("text"), F.min("l_linenumber").alias("page"), F.lit("ocr").alias("method")),
        "uses": triples.join(facts.select("doc_id", "fact_id", "l_partkey"), "doc_id").where("subject_id % 5 = l_partkey % 5").select("doc_id", "triple_id", "fact_id"),
        "entities": lines.where("l_quantity > 10").select("doc_id", F.when(F.col("p_size") > 25, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("entity_id")),
        "documents": _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")),
        "citations": lines.select("doc_id", F.when(F.col("l_tax") > 0.03, F.lit("uses")).alias("intent")),
        "references": lines.select("doc_id", (F.col("l_returnflag") == "A").alias("resolved")),
    }


_SQL = r"""WITH l AS MATERIALIZED (SELECT l_orderkey AS doc_id, lineitem.*, part.*, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, CASE WHEN l_quantity < 45 THEN 'chk_' || l_linenumber % 2 END AS chunk_id,
    CASE WHEN l_tax > 0.04 THEN 'sec_001' END AS section_id, round(1 - l_discount, 2) AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
ch AS (SELECT doc_id, 'chk_' || l_linenumber % 2 AS chunk_id, string_agg(p_name, '  ' ORDER BY p_name) AS text, min(l_linenumber) AS page FROM l GROUP BY ALL),
x AS (SELECT doc_id, 'ev_' || k AS id, 'fact' AS source, 'derived' AS et, CASE WHEN l_tax < 0.02 THEN p_name ELSE upper(p_name) END AS t, chunk_id, section_id, NULL AS own, c FROM l WHERE l_returnflag = 'A'
    UNION ALL SELECT doc_id, 'ev_' || k, 'triple', 'derived', p_name || ' ' || p_brand, chunk_id, NULL, NULL, c FROM l WHERE l_returnflag = 'N'
    UNION ALL SELECT doc_id, 'ev_' || k, 'claim', 'paraphrase', ' ' || replace(p_name, ' ', chr(10) || ' '), chunk_id, section_id, CASE WHEN l_tax > 0.06 THEN l_linenumber END, c FROM l WHERE l_returnflag = 'R'),
y AS (SELECT x.*, coalesce(ch.page, own) AS page, ch.text, trim(t, ' ' || chr(10)) AS q, regexp_replace(trim(t, ' ' || chr(10)), '\s+', ' ', 'g') AS f, regexp_replace(text, '\s+', ' ', 'g') AS g FROM x LEFT JOIN ch ON x.doc_id = ch.doc_id AND x.chunk_id = ch.chunk_id),
z AS (SELECT *, instr(text, q) AS i, instr(lower(text), lower(q)) AS j, instr(lower(g), lower(f)) AS k FROM y),
rec AS MATERIALIZED (SELECT doc_id, id AS evidence_id, source, et AS evidence_type, t AS source_text, chunk_id, section_id, page,
    CASE WHEN i > 0 THEN i - 1 WHEN j > 0 THEN j - 1 WHEN k > 0 THEN k - 1 END AS char_start, CASE WHEN i > 0 THEN i - 1 + length(q) WHEN j > 0 THEN j - 1 + length(q) WHEN k > 0 THEN k - 1 + length(f) END AS char_end,
    CASE WHEN i > 0 THEN 'exact' WHEN j > 0 THEN 'any_case' WHEN k > 0 THEN 'collapsed' END AS span_basis, CASE WHEN chunk_id IS NOT NULL OR section_id IS NOT NULL OR page IS NOT NULL THEN sha256(t) END AS sha256,
    CASE WHEN text IS NULL THEN 'grobid' ELSE 'ocr' END AS method, c AS confidence FROM z),
ent AS MATERIALIZED (SELECT doc_id, CASE WHEN p_size > 25 THEN l_partkey ELSE l_suppkey END AS entity_id FROM l WHERE l_quantity > 10) """


@query(_SQL + "SELECT * FROM rec")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all facts, triples and claims."""
    c = corpus(spark, sf_dir)
    return E.evidence_records(c["facts"], c["triples"], c["claims"], c["chunks"])


@query(_SQL + """, around AS (SELECT doc_id, coalesce(chunk_id, '') AS p, count(*) AS n, min(confidence) AS c FROM rec WHERE source <> 'claim' AND sha256 IS NOT NULL GROUP BY ALL),
tr AS (SELECT doc_id, k, l_partkey AS s, l_suppkey AS o, c FROM l WHERE l_returnflag = 'N')
SELECT doc_id, 'claim' AS kind, substr(evidence_id, 4) AS target_id, evidence_id, n + 1 AS n_records, least(confidence, c) AS confidence FROM rec JOIN around USING (doc_id) WHERE source = 'claim' AND p = coalesce(chunk_id, '')
UNION ALL SELECT doc_id, 'fact', 'ev_' || f, 'ev_' || t, 2, least(fr.confidence, tx.confidence) FROM (SELECT DISTINCT tr.doc_id, tr.k AS t, l.k AS f FROM tr JOIN l ON tr.doc_id = l.doc_id AND l_returnflag = 'A' AND s % 5 = l_partkey % 5)
    JOIN rec fr USING (doc_id) JOIN rec tx USING (doc_id) WHERE fr.source = 'fact' AND fr.evidence_id = 'ev_' || f AND tx.source = 'triple' AND tx.evidence_id = 'ev_' || t
UNION ALL SELECT doc_id, 'entity', CASE WHEN (doc_id, s) IN (SELECT (doc_id, entity_id) FROM ent) THEN s ELSE o END::VARCHAR, 'ev_' || k, 1, c FROM (SELECT DISTINCT * FROM tr)
    WHERE (doc_id, s) IN (SELECT (doc_id, entity_id) FROM ent) OR (doc_id, o) IN (SELECT (doc_id, entity_id) FROM ent)""")
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of claims, facts and entities."""
    c = corpus(spark, sf_dir)
    records = E.evidence_records(c["facts"], c["triples"], c["claims"], c["chunks"])
    return E.evidence_chains(records, c["triples"], c["uses"], c["entities"])


_PART = "coalesce({k}.n, 0) AS total_{k}, coalesce({k}.m, 0) AS with_{k}, CASE WHEN {k}.n > 0 THEN round({k}.m / {k}.n, 4) ELSE 0 END AS rate_{k}"


@query(_SQL + f""", claims AS (SELECT doc_id, count(*) AS n, count(*) AS m FROM rec WHERE source = 'claim' GROUP BY 1),
entities AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((doc_id, entity_id) IN (SELECT (doc_id, l_partkey) FROM l WHERE l_returnflag = 'N')) AS m FROM ent GROUP BY 1),
citations AS (SELECT doc_id, count(*) AS n, count(*) FILTER (l_tax > 0.03) AS m FROM l GROUP BY 1), "references" AS (SELECT doc_id, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS m FROM l GROUP BY 1)
SELECT o_orderkey AS doc_id, {", ".join(_PART.format(k=k) for k in ("claims", "entities", "citations"))}, {_PART.format(k="r").replace("_r", "_references")}
FROM orders LEFT JOIN claims ON o_orderkey = claims.doc_id LEFT JOIN entities ON o_orderkey = entities.doc_id LEFT JOIN citations ON o_orderkey = citations.doc_id LEFT JOIN "references" r ON o_orderkey = r.doc_id""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document has evidence."""
    c = corpus(spark, sf_dir)
    records = E.evidence_records(c["facts"], c["triples"], c["claims"], c["chunks"])
    return E.evidence_coverage(c["documents"], records, c["triples"], c["entities"], c["citations"], c["references"])
