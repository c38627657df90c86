"""Queries of the corpus layer: orders stand for documents, their lines for entities, claims and triples, customers for authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import corpus as K
from quire.operators import graph as G
from quire.plans.queries import _EDGES, _NODES, _edges, _nodes
from quire.plans.registry import _table, query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.col("o_orderpriority").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return orders.join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"), F.col("c_mktsegment").alias("venue")), "o_custkey", "left")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("claim_type"), F.col("l_linestatus").alias("predicate"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").alias("nth"), F.col("l_suppkey").alias("supplier"))
    return lines.join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("text"), F.col("p_type").alias("label")), "part", "left")


_DOCS = """d AS (SELECT o_orderkey AS doc_id, o_custkey, o_orderpriority AS field, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS price,
  o_orderstatus AS status, c_name AS author, c_mktsegment AS venue FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_MENTIONS = """m AS (SELECT l_orderkey AS doc_id, l_partkey AS part, l_returnflag AS claim_type, l_linestatus AS predicate, round(1 - l_discount, 2) AS confidence,
  l_linenumber AS nth, l_suppkey AS supplier, p_name AS text, p_type AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mentions = _documents(spark, sf_dir), _mentions(spark, sf_dir)
    return K.postings({
        "author": (docs, K.folded(F.col("author"))), "year": (docs, K.year_of(F.col("date"))), "field": (docs, F.col("field")),
        "venue": (docs, K.folded(F.col("venue"))), "status": (docs, F.col("status")), "entity_label": (mentions, F.col("label")),
        "entity_text": (mentions, F.lower("text")), "claim_type": (mentions, F.col("claim_type")), "predicate": (mentions, F.col("predicate")),
    })


_POSTINGS = f"""WITH {_DOCS}, {_MENTIONS} SELECT DISTINCT * FROM (SELECT 'author' AS index_name, lower(trim(author)) AS key, doc_id FROM d
UNION ALL SELECT 'year', substr(date, 1, 4), doc_id FROM d UNION ALL SELECT 'field', field, doc_id FROM d UNION ALL SELECT 'venue', lower(trim(venue)), doc_id FROM d
UNION ALL SELECT 'status', status, doc_id FROM d UNION ALL SELECT 'entity_label', label, doc_id FROM m UNION ALL SELECT 'entity_text', lower(text), doc_id FROM m
UNION ALL SELECT 'claim_type', claim_type, doc_id FROM m UNION ALL SELECT 'predicate', predicate, doc_id FROM m) WHERE key IS NOT NULL"""


@query(_POSTINGS)
def corpus_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


@query(f"SELECT index_name, key, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ({_POSTINGS}) GROUP BY ALL")
def corpus_index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).groupBy("index_name", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


_SHOWN = ["doc_id", "author", "date"]


@query(f"WITH {_DOCS}, {_MENTIONS} SELECT doc_id, author, date FROM d WHERE doc_id IN (SELECT doc_id FROM m WHERE label = 'PROMO')")
def find_by_entity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.find(_documents(spark, sf_dir), _mentions(spark, sf_dir), F.col("label") == "PROMO").select(*_SHOWN)


@query(f"WITH {_DOCS} SELECT doc_id, author, date FROM d WHERE lower(trim(author)) = 'customer#000000007'")
def find_by_author_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(K.folded(F.col("author")) == "customer#000000007").select(*_SHOWN)


@query(f"WITH {_DOCS} SELECT doc_id, author, date FROM d WHERE substr(date, 1, 4) = '1997'")
def find_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(K.year_of(F.col("date")) == "1997").select(*_SHOWN)


@query(f"WITH {_DOCS}, {_MENTIONS} SELECT doc_id, author, date FROM d WHERE doc_id IN (SELECT doc_id FROM m WHERE claim_type = 'R')")
def find_by_claim_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.find(_documents(spark, sf_dir), _mentions(spark, sf_dir), F.col("claim_type") == "R").select(*_SHOWN)


@query(f"WITH {_DOCS} SELECT doc_id, author, date FROM d WHERE field = '1-URGENT'")
def find_by_research_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(F.col("field") == "1-URGENT").select(*_SHOWN)


@query(f"WITH {_DOCS} SELECT substr(date, 1, 4) AS key, count(DISTINCT doc_id) AS n_docs FROM d WHERE date IS NOT NULL GROUP BY ALL")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.histogram(_documents(spark, sf_dir), K.year_of(F.col("date")))


@query(f"""WITH {_MENTIONS} SELECT count(confidence) AS n, round(avg(confidence), 4) AS mean_confidence, round(min(confidence), 4) AS min_confidence,
  round(max(confidence), 4) AS max_confidence, round(stddev_samp(confidence), 4) AS std_confidence FROM m""")
def mention_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.confidence_statistics(_mentions(spark, sf_dir))


@query("""WITH e AS (SELECT l_orderkey AS source_id, l_partkey AS target_id FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders),
c AS (SELECT count(*) AS n_edges FROM e), n AS (SELECT count(*) AS n_documents FROM orders)
SELECT n_documents, n_edges, round(n_edges / (n_documents * (n_documents - 1.0)), 8) AS density FROM n, c""")
def corpus_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return K.citation_density(orders, lines, orders.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id")))


@query(f"""WITH {_MENTIONS}, s AS (SELECT CAST(count(*) FILTER (WHERE label IS NOT NULL) AS BIGINT) AS entities_with, count(*) AS entities_total,
  CAST(count(*) FILTER (WHERE claim_type <> 'N') AS BIGINT) AS claims_with, count(claim_type) AS claims_total FROM m)
SELECT *, round(entities_with / entities_total, 4) AS entities_rate, round(claims_with / claims_total, 4) AS claims_rate FROM s""")
def merged_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    one = m.groupBy("doc_id").agg(F.count("label").alias("entities_with"), F.count(F.lit(1)).alias("entities_total"), F.count(F.when(F.col("claim_type") != "N", 1)).alias("claims_with"), F.count("claim_type").alias("claims_total"))
    return K.merge_coverage(one, ["entities", "claims"])


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 7 AS r FROM documents), k AS (SELECT doc_id, sha256 FROM h WHERE r = 0),
n AS (SELECT doc_id, sha256 FROM h WHERE r <> 0 UNION ALL SELECT doc_id, 'x' || sha256 FROM h WHERE r = 0 UNION ALL SELECT doc_id, 'y' || doc_id FROM h WHERE r = 1),
e AS (SELECT doc_id, n.sha256, coalesce((SELECT min(k.doc_id) FROM k WHERE k.sha256 = n.sha256), CASE WHEN min(doc_id) OVER (PARTITION BY n.sha256) < doc_id THEN min(doc_id) OVER (PARTITION BY n.sha256) END) AS earlier_id FROM n)
SELECT doc_id, sha256, earlier_id, CASE WHEN earlier_id IS NOT NULL THEN 'duplicate' WHEN doc_id IN (SELECT doc_id FROM k) OR row_number() OVER (PARTITION BY doc_id ORDER BY earlier_id IS NOT NULL, sha256) > 1
THEN 'refused' ELSE 'added' END AS status FROM e""")
def registry_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document is registered; the others come in, with ids that are taken and ids that come twice."""
    hashed = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    known, rest = hashed.where("doc_id % 7 = 0"), hashed.where("doc_id % 7 <> 0")
    taken = known.select("doc_id", F.concat(F.lit("x"), "sha256").alias("sha256"))
    twice = hashed.where("doc_id % 7 = 1").select("doc_id", F.concat(F.lit("y"), "doc_id").alias("sha256"))
    return K.register(known, rest.unionByName(taken).unionByName(twice))


@query(f"WITH {_DOCS} SELECT doc_id, author, date, price FROM d WHERE price >= 1000")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("price >= 1000").orderBy(F.desc("price"), "doc_id").select(*_SHOWN, "price")


@query(f"""WITH {_DOCS}, {_MENTIONS}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE claim_type <> 'N') AS res,
  CAST(sum(CASE WHEN text IS NOT NULL THEN 5 ELSE 3 END) AS BIGINT) AS f, count(*) FILTER (WHERE predicate = 'F') AS lk, avg(confidence) AS c, count(DISTINCT label) AS l,
  count(DISTINCT claim_type) AS cs FROM m GROUP BY doc_id),
s AS (SELECT doc_id, round(0.5 * res / n + 0.3 * f / (5 * n) + 0.2 * least(n / 5, 1.0), 6) AS score_references, round(0.6 * lk / n + 0.4, 6) AS score_citations,
  round(0.5 * c + 0.3 * least(n / 10, 1.0) + 0.2 * l / 13, 6) AS score_entities, round(0.5 * c + 0.3 * least(n / 3, 1.0) + 0.2 * cs / 3, 6) AS score_claims FROM p)
SELECT *, round(greatest(0.0, least(1.0, 0.15 * score_references + 0.10 * score_citations + 0.05 * score_entities + 0.05 * score_claims)), 4) AS overall FROM s""")
def document_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, citations, entities and claims of a document are its lines; the other four fields have no counterpart here."""
    n = F.count(F.lit(1))
    mentions = _mentions(spark, sf_dir).select("doc_id", "claim_type", "predicate", "confidence", "label", F.col("text").isNotNull().alias("named"))
    # lines come together once; distinct counts would have each of them sent three times
    counted = mentions.repartition("doc_id").groupBy("doc_id").agg(
        n.alias("n_refs"), F.count(F.when(F.col("claim_type") != "N", 1)).alias("n_resolved"), F.sum(F.when(F.col("named"), 5).otherwise(3)).alias("n_fields"),
        n.alias("n_citations"), F.count(F.when(F.col("predicate") == "F", 1)).alias("n_linked"), n.alias("n_entities"), F.avg("confidence").alias("entity_confidence"),
        F.size(F.collect_set("label")).alias("n_labels"), n.alias("n_claims"), F.avg("confidence").alias("claim_confidence"), F.size(F.collect_set("claim_type")).alias("n_claim_sections"), F.lit(3).alias("n_sections"),
    )
    scores = K.field_scores(counted)
    return scores.withColumn("overall", K.overall(scores))


_FIRST = "string_split(coalesce(text, ''), chr(10))[1]"


_GARBAGE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]"


def _length(n: str, least: int, most: int) -> str:
    return f"CASE WHEN {n} < {least} THEN {n} / {least} WHEN {n} > {most} THEN greatest(0, 1 - ({n} - {most}) / {most}) ELSE 1 END"


@query(f"""WITH t AS (SELECT doc_id, {_FIRST} AS title, coalesce(text, '') AS text, lang = 'en' AS main, CASE WHEN quality = 1 THEN CAST(0.9 AS DOUBLE) WHEN quality = 0 THEN 0.1 ELSE 0.5 END AS c FROM documents LEFT JOIN labels USING (doc_id)),
w AS (SELECT *, len(regexp_extract_all(title, '[^ \\t\\n\\r\\f\\v]+')) AS n, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS m FROM t),
s AS (SELECT doc_id, round(CAST(0.5 AS DOUBLE) * CASE WHEN main THEN c ELSE 0.8 * c END + 0.3 * {_length("n", 5, 30)} + 0.2 * CAST(NOT regexp_matches(title, '{_GARBAGE}') AS INT), 6) AS score_title,
  CASE WHEN m > 0 THEN round(CAST(0.4 AS DOUBLE) + 0.3 * {_length("m", 50, 500)} + 0.3 * CAST(NOT regexp_matches(text, '{_GARBAGE}') AS INT), 6) ELSE CAST(0 AS DOUBLE) END AS score_abstract FROM w)
SELECT *, concat_ws(',', CASE WHEN score_abstract < 0.5 THEN 'low_overall' END, CASE WHEN score_title < 0.4 THEN 'low_title' END) AS reasons FROM s""")
def title_and_abstract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first line as title, the whole text as abstract; the quality label as confidence, English as the primary route."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    sure = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.1).otherwise(0.5)
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    scored = docs.select("doc_id", K.title_score(title, sure, F.col("lang") == "en").alias("score_title"), K.abstract_score(F.col("text")).alias("score_abstract"))
    why = K.review_reasons(F.col("score_abstract"), F.col("score_title"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return scored.select("*", F.array_join(why, ",").alias("reasons"))


@query("""SELECT o_orderkey % 1000 AS doc_id, round(0.4 + 0.3 * avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0::DOUBLE ELSE 0 END) + 0.3 * avg(CASE WHEN o_custkey % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS score_authors FROM orders GROUP BY 1""")
def author_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for authors of a thousand documents; status P has a blank surname."""
    surname = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))
    return K.author_scores(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("doc_id"), surname.alias("surname"), (F.col("o_custkey") % 3).alias("n_affiliations")))


_PRIORITY = {"R": 0, "A": 1, "N": 2}


@query(f"""WITH {_MENTIONS}, b AS (SELECT lower(trim(text)) AS value, claim_type AS fact_type, max(confidence) AS confidence FROM m WHERE trim(text) <> '' GROUP BY ALL),
o AS (SELECT *, min(confidence) OVER w AS low, max(confidence) OVER w AS high, first_value(fact_type) OVER (PARTITION BY value ORDER BY CASE fact_type WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS f FROM b WINDOW w AS (PARTITION BY value))
SELECT value, fact_type, confidence FROM o WHERE low < high OR fact_type = f""")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _mentions(spark, sf_dir).select(F.col("text").alias("value"), F.col("claim_type").alias("fact_type"), "confidence")
    return K.deduplicate_facts(facts, _PRIORITY)


@query(f"WITH {_MENTIONS} SELECT claim_type AS fact_type, count(*) AS n_facts, round(avg(confidence), 4) AS mean_confidence FROM m GROUP BY ALL")
def fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).groupBy(F.col("claim_type").alias("fact_type")).agg(F.count(F.lit(1)).alias("n_facts"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query(f"WITH {_MENTIONS} SELECT doc_id, text AS value, confidence FROM m WHERE claim_type = 'A' AND confidence >= 0.95")
def facts_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).where("claim_type = 'A' and confidence >= 0.95").select("doc_id", F.col("text").alias("value"), "confidence")


_FORMS = {"a": "uses", "n": "uses", "r": "evaluated_on"}


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    return K.deduplicate_triples(m.select(F.col("supplier").alias("subject_id"), K.normalized_predicate(F.col("claim_type"), _FORMS).alias("predicate"), F.col("part").alias("object_id"), "confidence", F.col("doc_id").alias("evidence_id")))


_TRIPLES = f"""WITH {_MENTIONS}, t AS (SELECT supplier AS subject_id, CASE claim_type WHEN 'R' THEN 'evaluated_on' ELSE 'uses' END AS predicate, part AS object_id,
  max(confidence) AS confidence, count(DISTINCT doc_id) AS n_evidence FROM m GROUP BY ALL)"""


@query(_TRIPLES + " SELECT * FROM t")
def triple_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


@query(_TRIPLES + """ SELECT count(confidence) AS n, round(avg(confidence), 4) AS mean_confidence, round(min(confidence), 4) AS min_confidence, round(max(confidence), 4) AS max_confidence,
  round(stddev_samp(confidence), 4) AS std_confidence FROM t""")
def triple_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.confidence_statistics(_triples(spark, sf_dir))


@query(_TRIPLES + " SELECT predicate, count(*) AS n_triples FROM t GROUP BY ALL")
def predicate_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).groupBy("predicate").agg(F.count(F.lit(1)).alias("n_triples"))


@query(_TRIPLES + " SELECT * FROM t WHERE predicate = 'evaluated_on'")
def triples_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).where("predicate = 'evaluated_on'")


_ASKED = r"([A-Za-z]+)[ \n]+[A-Za-z]+"


@query(r"""WITH s AS (SELECT doc_id, text, regexp_extract(text, '([A-Za-z]+)[ \n]+[A-Za-z]+', 0) AS q FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, text, lower(text) AS low, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS flat, CASE doc_id % 3 WHEN 0 THEN q WHEN 1 THEN upper(q) ELSE replace(regexp_replace(q, '\s+', ' ', 'g'), ' ', '   ') END AS q FROM s WHERE q <> ''),
v AS (SELECT doc_id, instr(text, q) AS a, instr(low, lower(q)) AS b, instr(flat, regexp_replace(lower(q), '\s+', ' ', 'g')) AS c, length(q) AS n, length(regexp_replace(q, '\s+', ' ', 'g')) AS m FROM u)
SELECT doc_id, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END - 1 AS start, CASE WHEN a > 0 THEN a + n WHEN b > 0 THEN b + n ELSE c + m END - 1 AS "end",
  CASE WHEN a > 0 THEN 'exact' WHEN b > 0 THEN 'any_case' ELSE 'collapsed' END AS basis FROM v WHERE a > 0 OR b > 0 OR c > 0""")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document holds its first two words, asked for as they are, in upper case, or further apart and padded."""
    q = F.regexp_extract("text", _ASKED, 0)
    apart = F.concat(F.lit(" \n"), F.replace(F.regexp_replace(q, r"\s+", " "), F.lit(" "), F.lit("   ")), F.lit(" "))
    source = F.when(F.col("doc_id") % 3 == 0, q).when(F.col("doc_id") % 3 == 1, F.upper(q)).otherwise(apart)
    found = _table(spark, sf_dir, "documents").select("doc_id", K.evidence_span(F.col("text"), source).alias("span")).where("span is not null")
    return found.select("doc_id", "span.start", "span.end", "span.basis")


@query(f"WITH {_NODES} SELECT * FROM n WHERE node_type = 'document' ORDER BY weight DESC, node_id LIMIT 10")
def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.query_nodes(_nodes(spark, sf_dir), "node_type = 'document'", 10)


_REACH = "w AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM e UNION SELECT target_id, source_id FROM e)"


@query(f"""WITH RECURSIVE {_EDGES}, {_REACH}, b(node_id, distance) USING KEY (node_id) AS (SELECT 'd1', 0
  UNION SELECT w.v, min(b.distance) + 1 FROM b JOIN w ON u = node_id LEFT JOIN recurring.b AS k ON k.node_id = w.v WHERE k.node_id IS NULL GROUP BY w.v),
p(position, node_id) AS (SELECT distance, node_id FROM b WHERE node_id = 'd2' UNION ALL SELECT p.position - 1, (SELECT min(b.node_id) FROM b JOIN w ON w.v = b.node_id WHERE w.u = p.node_id AND b.distance = p.position - 1) FROM p WHERE p.position > 0)
SELECT position, node_id FROM p""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(_edges(spark, sf_dir), "d1", "d2")


@query(f"""WITH RECURSIVE {_EDGES}, {_REACH}, p(nodes, n) AS (SELECT ['d1'], 0 UNION ALL SELECT list_append(nodes, v), n + 1 FROM p JOIN w ON u = nodes[-1]
  WHERE n < 4 AND nodes[-1] <> 'd2' AND NOT list_contains(nodes, v))
SELECT array_to_string(nodes, '>') AS path, n AS n_edges FROM p WHERE nodes[-1] = 'd2'""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.simple_paths(_edges(spark, sf_dir), "d1", "d2", 4).select(F.array_join("nodes", ">").alias("path"), "n_edges")


_PARTS = """b(node, component) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM w GROUP BY u
  UNION SELECT w.v, min(b.component) FROM b JOIN w ON b.node = w.u JOIN recurring.b AS k ON k.node = w.v WHERE b.component < k.component GROUP BY w.v)"""


@query(f"""WITH RECURSIVE {_EDGES}, {_NODES}, {_REACH}, {_PARTS} SELECT n.node_id AS node, coalesce(b.component, n.node_id) AS component FROM n LEFT JOIN b ON b.node = n.node_id""")
def graph_components_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components_with_isolated(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, {_NODES}, {_REACH}, {_PARTS}, a AS (SELECT count(*) AS n_nodes FROM n),
g AS (SELECT count(*) AS n_edges, CAST(count(*) FILTER (WHERE source_id = target_id) AS BIGINT) AS n_self_loops, round(avg(confidence), 4) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM e),
c AS (SELECT count(*) AS k, sum(s) AS covered, max(s) AS largest FROM (SELECT component, count(*) AS s FROM b GROUP BY ALL))
SELECT n_nodes, n_edges, round(2.0 * n_edges / n_nodes, 4) AS avg_degree, round(least(n_edges / (n_nodes * (n_nodes - 1.0)), 1.0), 6) AS density, CAST(k + n_nodes - covered AS BIGINT) AS n_components,
  largest AS largest_component, n_self_loops, avg_confidence, min_confidence, max_confidence FROM a, g, c""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_statistics(_nodes(spark, sf_dir), _edges(spark, sf_dir))


_STAGES = {"A": "entity_edges", "N": "relation_edges"}


@query("""SELECT CASE l_returnflag WHEN 'A' THEN 'entity_edges' WHEN 'N' THEN 'relation_edges' ELSE 'unknown' END AS stage, count(*) AS n_edges FROM lineitem GROUP BY ALL""")
def edge_stage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge_id = F.concat_ws("_", "l_returnflag", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return _table(spark, sf_dir, "lineitem").groupBy(G.stage_of_edge(edge_id, _STAGES).alias("stage")).agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"""WITH {_EDGES}, {_NODES}, x AS (SELECT * FROM e UNION ALL SELECT 'd' || o_orderkey, 'd' || (o_orderkey + 1), 'next', 1.0 FROM orders),
i AS (SELECT a.node_type, count(*) AS k FROM x JOIN n a ON a.node_id = source_id JOIN n b ON b.node_id = target_id WHERE a.node_type = b.node_type GROUP BY ALL),
c AS (SELECT node_type, count(*) AS n_nodes FROM n GROUP BY ALL)
SELECT c.node_type, n_nodes, coalesce(k, 0) AS n_edges, round(coalesce(k, 0) / (n_nodes * (n_nodes - 1.0)), 10) AS density FROM c LEFT JOIN i ON c.node_type = i.node_type""")
def density_by_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the lines, each order is followed by the next."""
    key = F.col("o_orderkey")
    follow = _table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), key).alias("source_id"), F.concat(F.lit("d"), key + 1).alias("target_id"), F.lit("next").alias("relation_type"), F.lit(1.0).alias("confidence"))
    return G.density_by_type(_nodes(spark, sf_dir), _edges(spark, sf_dir).unionByName(follow))


@query(f"""WITH {_EDGES}, {_NODES}, t AS (SELECT unnest(CASE WHEN source_id = target_id THEN [source_id] ELSE [source_id, target_id] END) AS node_id FROM e),
g AS (SELECT node_id, count(*) AS degree FROM t GROUP BY ALL), top AS (SELECT * FROM g ORDER BY degree DESC, node_id LIMIT 100)
SELECT node_type, node_id, degree FROM top JOIN n USING (node_id)""")
def top_degree_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = G.degrees(_edges(spark, sf_dir)).orderBy(F.desc("degree"), "node_id").limit(100)
    return top.join(_nodes(spark, sf_dir).select("node_id", "node_type"), "node_id").select("node_type", "node_id", "degree")
