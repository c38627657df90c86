"""Queries of document relations: customers stand for documents, their lines for entities, triples and claims, their orders for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relations as X
from quire.plans.registry import _table, query
from quire.plans.resolution_queries import _TITLE, similar_sql


def with_counts(spark: SparkSession, sf_dir: str, rows: DataFrame, *tables: str) -> DataFrame:
    """rows with n_<table>, the rows of each table: numbers are dealt out over all of them."""
    for t in tables:
        rows = rows.crossJoin(F.broadcast(_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(f"n_{t}"))))  # one row
    return rows


def corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Returned lines are entities (the part), accepted ones claims, others triples; a page's title is a document's of the same number."""
    titles = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("html", _TITLE, 1).alias("title"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("10.1/D"), "c_custkey").alias("doi"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("doc_id"), F.substring("o_orderpriority", 1, 1).alias("p"))
    lines = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "order").join(orders.select("order", "doc_id"), "order")
    lines = lines.join(_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    page = (F.col("order") % F.col("n_pages")).alias("page")
    asked = with_counts(spark, sf_dir, orders, "pages", "customer").select("doc_id", F.col("order").alias("ref_id"), "p", "n_customer", page).join(titles, "page")
    target = F.col("ref_id") * 7 % F.col("n_customer")
    claims = with_counts(spark, sf_dir, lines.where("l_returnflag = 'A'"), "pages").withColumn("page", F.col("l_partkey") % F.col("n_pages")).join(titles, "page")
    return {
        "documents": customers.join(titles, F.col("doc_id") == F.col("page"), "left").select("doc_id", "doi", "title"),
        "entities": lines.where("l_returnflag = 'R'").select("doc_id", F.concat(F.lit("Part "), "l_partkey").alias("canonical"), F.col("p_name").alias("norm"), F.when(F.col("p_type") == "PROMO", "method").otherwise("dataset").alias("label")),
        "references": asked.select(
            "doc_id", "ref_id", F.when(F.col("p") == "1", target).alias("target_id"),
            F.when(F.col("p") == "2", F.concat(F.lit(" 10.1/d"), target)).alias("doi"), F.when(F.col("p") == "5", F.col("title")).alias("title"),
        ),
        "triples": lines.where("l_returnflag = 'N'").select(
            "doc_id", F.col("l_partkey").alias("subject_id"), F.col("l_linestatus").alias("predicate"), F.floor(F.col("l_suppkey") / 20).alias("object_id"),
            (F.col("l_discount") > 0.05).alias("negated"), F.round(1 - F.col("l_tax"), 2).alias("confidence"),
        ),
        "claims": claims.select(
            "doc_id", F.concat_ws("-", "order", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), F.col("p_brand").alias("claim_type"),
            F.concat("title", F.when(F.col("l_linestatus") == "O", " is not so").otherwise("")).alias("sentence"), F.when(F.col("l_tax") > 0.04, F.col("p_name")).alias("statement"),
            F.array("p_type").alias("patterns"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        ),
    }


_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def _key(x: str) -> str:
    return _SORTED.format(x=rf"trim(regexp_replace(regexp_replace(lower(trim({x})), '\s+', ' ', 'g'), '[.,;:!?''\"()]+$', ''))")


_NEGATIONS = ", ".join("'" + w.replace("'", "''") + "'" for w in X.NEGATIONS)
_WEIGHT = X.STAGE_WEIGHTS
RELATIONS_SQL = rf"""WITH ti AS MATERIALIZED (SELECT page_id AS page, regexp_extract(html, '{_TITLE}', 1) AS title FROM pages),
d AS (SELECT c_custkey AS doc_id, '10.1/D' || c_custkey AS doi, title FROM customer LEFT JOIN ti ON c_custkey = page),
l AS MATERIALIZED (SELECT o_custkey AS doc_id, l_orderkey, lineitem.*, part.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
e AS MATERIALIZED (SELECT DISTINCT doc_id, 'part ' || l_partkey AS item, p_type = 'PROMO' AS method FROM l WHERE l_returnflag = 'R'),
r AS (SELECT o_custkey AS doc_id, o_orderkey AS ref_id, CASE WHEN o_orderpriority[1] = '1' THEN o_orderkey * 7 % (SELECT count(*) FROM customer) END AS target_id,
    CASE WHEN o_orderpriority[1] = '2' THEN '10.1/d' || o_orderkey * 7 % (SELECT count(*) FROM customer) END AS doi, CASE WHEN o_orderpriority[1] = '5' THEN title END AS title FROM orders JOIN ti ON page = o_orderkey % (SELECT count(*) FROM pages)),
cited AS (SELECT DISTINCT r.doc_id AS a, target_id AS b FROM r JOIN d ON d.doc_id = target_id WHERE r.doc_id <> target_id),
cand AS MATERIALIZED (SELECT DISTINCT i.doc_id AS a, j.doc_id AS b FROM e i JOIN e j ON i.item = j.item AND i.doc_id <> j.doc_id UNION SELECT a, b FROM cited),
tk AS MATERIALIZED (SELECT DISTINCT title, {_key("title")} AS k FROM ti WHERE length(trim(title)) > 5),
alike AS MATERIALIZED (SELECT x.title AS s, y.title AS t FROM tk x JOIN tk y ON {similar_sql("x.k", "y.k", 85)}),
cites AS (SELECT a, b, count(*) AS n FROM (SELECT r.doc_id AS a, d.doc_id AS b, ref_id FROM r JOIN d ON r.target_id = d.doc_id
    UNION SELECT r.doc_id, d.doc_id, ref_id FROM r JOIN d ON r.doi = lower(d.doi)
    UNION SELECT r.doc_id, d.doc_id, ref_id FROM r JOIN alike ON s = r.title JOIN d ON d.title = t) SEMI JOIN cand USING (a, b) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n, count(*) FILTER (method) AS m FROM e GROUP BY 1),
both_ AS (SELECT i.doc_id AS a, j.doc_id AS b, count(*) AS n, count(*) FILTER (i.method) AS m FROM e i JOIN e j ON i.item = j.item AND i.doc_id <> j.doc_id GROUP BY ALL),
share AS (SELECT a, b, both_.n / least(x.n, y.n) AS o, CASE WHEN both_.m > 0 THEN both_.m / least(x.m, y.m) END AS p FROM both_ JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id),
t AS (SELECT doc_id, l_partkey AS s, l_linestatus AS p, l_suppkey // 20 AS o, l_discount > 0.05 AS neg, round(1 - l_tax, 2) AS c FROM l WHERE l_returnflag = 'N'),
te AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.o = y.o AND x.neg = y.neg THEN 'supports' ELSE 'contradicts' END AS kind,
    (x.c + y.c) / 2 * CASE WHEN x.o <> y.o THEN 0.8 WHEN x.neg <> y.neg THEN 0.9 ELSE 1 END AS c FROM t x JOIN t y ON x.s = y.s AND x.p = y.p JOIN cand ON a = x.doc_id AND b = y.doc_id),
c AS MATERIALIZED (SELECT doc_id, p_brand AS kind, title || CASE WHEN l_linestatus = 'O' THEN ' is not so' ELSE '' END AS s, CASE WHEN l_tax > 0.04 THEN p_name END AS st, p_type AS p, round(1 - l_discount, 2) AS c
    FROM l JOIN ti ON page = l_partkey % (SELECT count(*) FROM pages) WHERE l_returnflag = 'A'),
w AS MATERIALIZED (SELECT s, {_key("s")} AS k, list_has_any(string_split_regex(lower(s), '\s+'), [{_NEGATIONS}]) AS neg FROM (SELECT DISTINCT s FROM c)),
ws AS MATERIALIZED (SELECT x.s, y.s AS t FROM w x JOIN w y ON {similar_sql("x.k", "y.k", 70)}),
v AS MATERIALIZED (SELECT st, {_key("st")} AS k FROM (SELECT DISTINCT st FROM c WHERE st IS NOT NULL)),
vs AS MATERIALIZED (SELECT x.st, y.st AS t FROM v x JOIN v y ON {similar_sql("x.k", "y.k", 80)}),
ce AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN wx.neg <> wy.neg THEN 'contradicts' ELSE 'supports' END AS kind, (x.c + y.c) / 2 * CASE WHEN wx.neg <> wy.neg THEN 0.85 ELSE 0.8 END AS c
    FROM cand JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id AND x.kind = y.kind JOIN w wx ON wx.s = x.s JOIN w wy ON wy.s = y.s
    WHERE NOT (wx.neg AND wy.neg) AND (x.p = y.p OR (x.s, y.s) IN (SELECT (s, t) FROM ws) OR (x.st, y.st) IN (SELECT (st, t) FROM vs))),
k AS (SELECT a, b, kind, 'triple' AS stage, {_WEIGHT["triple"]}::DOUBLE * max(max(c)) OVER (PARTITION BY a, b) AS confidence, count(*) AS n FROM te GROUP BY a, b, kind
    UNION ALL SELECT a, b, kind, 'claim', {_WEIGHT["claim"]}::DOUBLE * max(max(c)) OVER (PARTITION BY a, b), count(*) FROM ce GROUP BY a, b, kind),
rel AS (SELECT a AS source_id, b AS target_id, 'cites' AS relation_type, 'citation' AS stage, {_WEIGHT["citation"]}::DOUBLE AS confidence, n FROM cites
UNION ALL SELECT b, a, 'cited_by', 'citation', {_WEIGHT["citation"]}::DOUBLE, n FROM cites
UNION ALL SELECT a, b, 'compares_with', 'entity', {_WEIGHT["entity"]}::DOUBLE * o, 1 FROM share WHERE o >= 0.2
UNION ALL SELECT a, b, CASE WHEN p >= 0.4 THEN 'uses_method' ELSE 'extends' END, 'method', {_WEIGHT["method"]}::DOUBLE * p, 1 FROM share WHERE p >= 0.2
UNION ALL SELECT a, b, kind, stage, confidence, n FROM k)
"""


@query(RELATIONS_SQL + "SELECT source_id, target_id, relation_type, stage, round(confidence, 6) AS confidence, n FROM rel")
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations between documents."""
    return X.document_relations(**corpus(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(RELATIONS_SQL + "SELECT relation_type, stage, count(*) AS n_relations, CAST(sum(n) AS BIGINT) AS n_evidence, round(avg(confidence), 4) AS mean_confidence FROM rel GROUP BY ALL")
def relation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and evidence by type and stage."""
    return X.document_relations(**corpus(spark, sf_dir)).groupBy("relation_type", "stage").agg(
        F.count(F.lit(1)).alias("n_relations"), F.sum("n").alias("n_evidence"), F.round(F.avg("confidence"), 4).alias("mean_confidence")
    )
