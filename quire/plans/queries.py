"""Registered queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import documents as D
from quire.operators import graph as G
from quire.plans.registry import _table, query

# Stop-word pairs stand in for claim patterns: the tables' prose is invented.
CLAIMS = [("addition", "(?i)\\band the\\b"), ("addition", "(?i)\\band a\\b"), ("relation", "(?i)\\bof the\\b"), ("relation", "(?i)\\bin the\\b"), ("identity", "(?i)\\bis the\\b")]
LEXICON = [("The", "method"), ("And", "dataset"), ("With", "metric"), ("This", "tool"), ("That", "task")]

_SENTENCES = r"""
s AS (SELECT doc_id, source, lang, unnest(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30) || '|\n+'),
        lambda x: trim(x) <> '')) AS sentence FROM documents)"""


def _whole_words(phrase: str) -> str:
    """A phrase in any ASCII case between non-letters: the same to Java and RE2, whose \\b and (?i) differ on accented letters."""
    return r"(?:^|[^\p{L}\p{M}\p{N}_])" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in phrase) + r"(?:[^\p{L}\p{M}\p{N}_]|\z)"


CLAIM_WORDS = [(t, _whole_words(p.removeprefix("(?i)\\b").removesuffix("\\b"))) for t, p in CLAIMS]


def _matches(kind: str) -> str:
    return " + ".join(f"CAST(regexp_matches(sentence, '{p}') AS INT)" for t, p in CLAIM_WORDS if t == kind)


@query(
    "WITH " + _SENTENCES + f""",
c AS (SELECT source, sentence, {_matches("addition")} AS a, {_matches("relation")} AS r, {_matches("identity")} AS i FROM s),
h AS (SELECT source, 'addition' AS claim_type, a AS n, a + r + i AS t FROM c WHERE a > 0 UNION ALL
  SELECT source, 'relation', r, a + r + i FROM c WHERE r > 0 UNION ALL SELECT source, 'identity', i, a + r + i FROM c WHERE i > 0)
SELECT source, claim_type, count(*) AS n_claims, CAST(sum(n) AS BIGINT) AS n_matches,
  round(avg(CASE WHEN t >= 2 THEN 0.8 ELSE 0.6 END), 4) AS avg_confidence FROM h GROUP BY ALL"""
)
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    claims = D.detect_claims(D.sentence_table(docs, "source"), CLAIM_WORDS, "source")
    return claims.groupBy("source", "claim_type").agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum("n_patterns").alias("n_matches"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS term FROM documents),
lex(term, label) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + """)
SELECT doc_id, term AS text, label, count(*) AS n_mentions FROM t JOIN lex USING (term) GROUP BY ALL"""
)
def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "term string, label string")
    return D.find_entities(_table(spark, sf_dir, "documents"), lexicon, r"[\p{L}\p{M}]+")


@query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents)
SELECT doc_id, sha256, doc_id > min(doc_id) OVER (PARTITION BY sha256) AS is_duplicate, count(*) OVER (PARTITION BY sha256) AS n_copies FROM h"""
)
def doc_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fingerprints(_table(spark, sf_dir, "documents"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS BIGINT) AS n_words,
  CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30) || '|\n+'), lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines FROM documents"""
)
def word_and_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_counts(_table(spark, sf_dir, "documents"))


@query(
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1"""
)
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return D.deduplicate(rows, ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey")


@query("""SELECT 'source' AS index_name, source AS key, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY ALL
UNION ALL SELECT 'language', lang, count(DISTINCT doc_id) FROM documents GROUP BY ALL
UNION ALL SELECT 'initial', upper(substr(text, 1, 1)), count(DISTINCT doc_id) FROM documents WHERE text <> '' GROUP BY ALL""")
def corpus_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = {"source": F.col("source"), "language": F.col("lang"), "initial": F.when(F.col("text") != "", T.initial(F.col("text")))}
    pairs = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(name).alias("index_name"), key.alias("key")) for name, key in parts.items()])).alias("entry"))
    # documents without a source or language count under the null key, those without text have no initial
    return pairs.select("doc_id", "entry.*").where("key is not null or index_name <> 'initial'").groupBy("index_name", "key").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("""SELECT count(*) AS n_documents, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_languages,
  round(avg(quality), 4) AS mean_quality, round(stddev_samp(quality), 4) AS std_quality, CAST(count(quality) AS BIGINT) AS n_labelled,
  round(count(quality) / (count(*) * (count(*) - 1.0)), 8) AS density
FROM documents LEFT JOIN labels USING (doc_id)""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_documents"),
        F.countDistinct("source").alias("n_sources"),
        F.countDistinct("lang").alias("n_languages"),
        F.round(F.avg("quality"), 4).alias("mean_quality"),
        F.round(F.stddev_samp("quality"), 4).alias("std_quality"),
        F.count("quality").alias("n_labelled"),
        F.round(F.count("quality") / (n * (n - 1)), 8).alias("density"),
    )


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def find_by_source_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "n_chars")
    return docs.join(_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""SELECT a.l_orderkey AS doc_id, round(avg(CAST(a.l_partkey <= b.l_partkey AS DOUBLE)), 4) AS share
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY ALL""")
def section_ordering_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.concordance(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("rank")))


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 60 AS point_id,
  (SELECT l.l_linenumber FROM lineitem l WHERE l.l_orderkey = o_orderkey
   ORDER BY greatest(l.l_linenumber * 7 - o_orderkey % 60, o_orderkey % 60 - l.l_linenumber * 7 - 6, 0),
     CASE WHEN greatest(l.l_linenumber * 7 - o_orderkey % 60, o_orderkey % 60 - l.l_linenumber * 7 - 6, 0) = 0 THEN -l.l_linenumber ELSE l.l_linenumber END LIMIT 1) AS section_id
FROM orders""")
def nearest_section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("o_orderkey") % 60
    points = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), page.alias("point_id"), page.alias("page"))
    line = F.col("l_linenumber")
    sections = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("section_id"), line.alias("position"), (line * 7).alias("first"), (line * 7 + 6).alias("last")).distinct()
    return D.nearest_interval(points, sections)


@query("""SELECT 'order_without_customer' AS rule, CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
UNION ALL SELECT 'customer_without_order', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'document_without_label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    a = orders.select("o_orderkey", F.col("o_custkey").alias("k")).join(customers.select(F.col("c_custkey").alias("k")), "k", "left_anti")
    b = D.orphans(customers.select(F.col("c_custkey").alias("id")), orders.select(F.col("o_custkey").alias("id")), "id", "customer_without_order")
    c = D.orphans(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "document_without_label")
    first = a.select(F.lit("order_without_customer").alias("rule"), F.col("o_orderkey").cast("long").alias("id"))
    return first.unionByName(b.select("rule", F.col("id").cast("long"))).unionByName(c)


@query(r"""WITH p AS (SELECT DISTINCT p_name, p_type FROM part)
SELECT p_name, regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') AS normal, count(DISTINCT p_type) AS n_labels FROM p GROUP BY ALL""")
def entity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy("p_name").agg(F.countDistinct("p_type").alias("n_labels")).select("p_name", T.normalize_text(F.col("p_name")).alias("normal"), "n_labels")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as a graph: an edge for each line."""
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_orderkey")).alias("source_id"),
        F.concat(F.lit("c"), F.col("l_partkey")).alias("target_id"),
        F.col("l_returnflag").alias("relation_type"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey")).alias("node_id"), F.lit("document").alias("node_type"), F.col("o_orderpriority").alias("label"), F.round("o_totalprice", 2).alias("weight"))
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("node_id"), F.lit("entity_cluster").alias("node_type"), F.col("p_name").alias("label"), F.round("p_retailprice", 2).alias("weight"))
    return orders.unionByName(parts)


_EDGES = "e AS (SELECT 'd' || l_orderkey AS source_id, 'c' || l_partkey AS target_id, l_returnflag AS relation_type, round(1 - l_discount, 2) AS confidence FROM lineitem)"
_NODES = """n AS (SELECT 'd' || o_orderkey AS node_id, 'document' AS node_type, o_orderpriority AS label, round(o_totalprice, 2) AS weight FROM orders
  UNION ALL SELECT 'c' || p_partkey, 'entity_cluster', p_name, round(p_retailprice, 2) FROM part)"""


@query(f"WITH {_EDGES} SELECT source_id, target_id, relation_type, max(confidence) AS confidence FROM e GROUP BY ALL")
def graph_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.deduplicate_edges(_edges(spark, sf_dir))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS c FROM lineitem)
SELECT a.c AS a, b.c AS b, min(a.doc_id) AS doc_id FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.c < b.c GROUP BY ALL""")
def entity_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_occurrence(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("cluster_id")))


@query(f"WITH {_NODES} SELECT * FROM n WHERE node_type = 'document' AND weight >= 1000 ORDER BY weight DESC, node_id LIMIT 100")
def query_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.query_nodes(_nodes(spark, sf_dir), "node_type = 'document' and weight >= 1000", 100)


@query(f"WITH {_EDGES} SELECT * FROM e WHERE relation_type IN ('A', 'R') AND confidence >= 0.95 ORDER BY confidence DESC, source_id, target_id, relation_type LIMIT 100")
def query_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.query_edges(_edges(spark, sf_dir), "relation_type in ('A', 'R') and confidence >= 0.95", 100)


@query(f"WITH {_NODES} SELECT * FROM n WHERE node_type = 'entity_cluster' ORDER BY weight DESC, node_id LIMIT 10")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.query_nodes(_nodes(spark, sf_dir), "node_type = 'entity_cluster'", 10)


@query(f"WITH {_EDGES} SELECT relation_type, count(*) AS n_edges FROM e GROUP BY ALL ORDER BY n_edges DESC, relation_type LIMIT 10")
def top_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_predicates(_edges(spark, sf_dir), 10)


@query(f"""WITH {_EDGES}, {_NODES}, k AS (SELECT node_id FROM n WHERE weight >= 950)
SELECT e.* FROM e WHERE source_id IN (SELECT node_id FROM k) AND target_id IN (SELECT node_id FROM k)""")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return G.subgraph(nodes, _edges(spark, sf_dir), nodes.where("weight >= 950"))[1].select("source_id", "target_id", "relation_type", "confidence")


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT source_id AS u, target_id AS v FROM e UNION SELECT target_id, source_id FROM e),
b AS (SELECT 'd1' AS node_id, 0 AS distance UNION SELECT v, distance + 1 FROM b JOIN w ON u = node_id WHERE distance < 2)
SELECT node_id, min(distance) AS distance FROM b GROUP BY node_id""")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distances(_edges(spark, sf_dir), spark.createDataFrame([("d1",)], "node_id string"), 2)


@query(f"""WITH RECURSIVE {_EDGES}, w AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM e UNION SELECT target_id, source_id FROM e),
b(node, component) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM w GROUP BY u
  UNION SELECT w.v, min(b.component) FROM b JOIN w ON b.node = w.u JOIN recurring.b AS k ON k.node = w.v WHERE b.component < k.component GROUP BY w.v)
SELECT node, component FROM b""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, t AS (SELECT unnest([source_id, target_id]) AS node_id FROM e),
g AS (SELECT node_id, count(*) AS d FROM t GROUP BY ALL), r AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM g)
SELECT round(avg(d), 4) AS mean_degree, min(CASE WHEN i = n // 2 + 1 THEN d END) AS median_degree, max(d) AS max_degree, min(d) AS min_degree FROM r""")
def degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_statistics(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, t AS (SELECT unnest([source_id, target_id]) AS node_id FROM e)
SELECT node_id, count(*) AS degree FROM t GROUP BY ALL ORDER BY degree DESC, node_id LIMIT 20""")
def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir)).orderBy(F.desc("degree"), "node_id").limit(20)


@query(f"WITH {_EDGES} SELECT relation_type, count(*) AS n_edges, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM e GROUP BY ALL")
def edge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _edges(spark, sf_dir).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n_edges"))
    total = counted.agg(F.sum("n_edges").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("relation_type", "n_edges", F.round(100.0 * F.col("n_edges") / F.col("total"), 4).alias("percent"))


@query(f"WITH {_EDGES} SELECT source_id, target_id, relation_type, count(*) AS n_copies FROM e GROUP BY ALL HAVING count(*) > 1")
def duplicate_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("source_id", "target_id", "relation_type").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


@query(f"""WITH {_EDGES}, p AS (SELECT source_id, target_id, count(DISTINCT relation_type) AS t, count(*) AS k FROM e GROUP BY ALL)
SELECT t AS n_types, count(*) AS n_pairs, CAST(sum(k) AS BIGINT) AS n_edges FROM p GROUP BY ALL""")
def multigraph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # edges are dealt out first: before, nearly all pairs differ, and a task would hold all of its own; types are few for any pair
    dealt = _edges(spark, sf_dir).select("source_id", "target_id", "relation_type").repartition("source_id", "target_id")
    pairs = dealt.groupBy("source_id", "target_id").agg(F.size(F.collect_set("relation_type")).cast("long").alias("n_types"), F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("n_types").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("k").alias("n_edges"))


@query("""WITH k AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) AS k, count(*) AS m FROM lineitem GROUP BY ALL)
SELECT doc_id, k AS n_clusters, k * (k - 1) // 2 AS n_pairs, m - k AS saved FROM k""")
def co_occurrence_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.countDistinct("l_partkey").alias("k"), F.count(F.lit(1)).alias("m"))
    return k.select("doc_id", F.col("k").alias("n_clusters"), F.expr("k * (k - 1) div 2").alias("n_pairs"), F.expr("m - k").alias("saved"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n_turns, CAST(min(turn) AS BIGINT) AS first_turn,
  max(turn) - min(turn) + 1 = count(DISTINCT turn) AS contiguous FROM conversations GROUP BY conv_id""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda x: x["role"]), ",").alias("roles"),
        F.count(F.lit(1)).alias("n_turns"),
        F.min("turn").cast("long").alias("first_turn"),
        (F.max("turn") - F.min("turn") + 1 == F.countDistinct("turn")).alias("contiguous"),
    )
