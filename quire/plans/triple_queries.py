"""Queries of triples: an order's lines are entities of two chunks, whose texts state relations between their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import triples as T
from quire.plans.registry import _table, query
from quire.plans.storage import materialize

_LABELS = {"PROMO": "method", "ECONOMY": "method", "STANDARD": "dataset", "MEDIUM": "dataset", "SMALL": "metric"}
_VERBS = ["outperforms", "improves upon", "Uses", "is better than", "evaluated  on", "and"]


def _key() -> Column:
    return F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))


def corpus(spark: SparkSession, sf_dir: str, once: bool = False) -> dict[str, DataFrame]:
    """Chunks by the parity of the line number, but for 45 and more pieces; a line's statement is `name verb last name`.

    once: lines are joined once and written, for queries that read both entities and chunks.
    """
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "*").join(_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    key = _key()
    chunk = F.when(F.col("l_quantity") < 45, F.concat(F.lit("chk_"), F.col("l_linenumber") % 2)).alias("chunk_id")
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])[F.col("p_type")], F.lit("other")).alias("label")
    rows = lines.select("doc_id", key.alias("k"), label, "p_name", chunk, "l_returnflag", "l_suppkey", F.round(1 - 6 * F.col("l_discount"), 2).alias("confidence")).distinct()
    if once:
        rows = materialize(rows, "rows")
    word = F.when(F.col("l_suppkey") % 2 == 0, F.col("p_name")).otherwise(F.split("p_name", " ")[1])
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (F.col("l_suppkey") % len(_VERBS)).cast("int") + 1)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "p_name", verb).alias("s")))), lambda x: x["s"]), " ")
    return {
        "entities": rows.select("doc_id", F.concat(F.lit("ent_"), "k").alias("entity_id"), F.col("k").alias("nth"), "label", word.alias("text"), "confidence", "chunk_id"),
        "chunks": rows.where("chunk_id is not null").groupBy("doc_id", "chunk_id").agg(said.alias("text")),
        "claims": rows.where("l_returnflag = 'R'").select(
            "doc_id", F.concat(F.lit("clm_"), "k").alias("claim_id"), F.element_at(F.array(*[F.lit(c) for c in (*T.CLAIMS, "odd")]), (F.col("l_suppkey") % 7).cast("int") + 1).alias("claim_type"),
            F.col("p_name").alias("sentence"), "confidence", "chunk_id",
        ),
        "documents": _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title")),
    }


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_SQL = f"""WITH l AS MATERIALIZED (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS k, coalesce({_case("p_type", _LABELS)}, 'other') AS label, p_name,
    CASE WHEN l_quantity < 45 THEN 'chk_' || l_linenumber % 2 END AS chunk, l_returnflag AS f, l_suppkey AS s, round(1 - 6 * l_discount, 2) AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS MATERIALIZED (SELECT doc_id, 'ent_' || k AS id, k, label, CASE WHEN s % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[2] END AS name, c, chunk FROM l),"""
_SIDES = " UNION ALL ".join(
    f"SELECT doc_id, chunk, {i} AS v, '{p}' AS p, unnest(regexp_extract_all(text, '(?i){T.relation_pattern(v)}', 1)) AS a, unnest(regexp_extract_all(text, '(?i){T.relation_pattern(v)}', 2)) AS b, "
    f"unnest(generate_series(1, len(regexp_extract_all(text, '(?i){T.relation_pattern(v)}')))) AS nn FROM t"
    for i, (v, p) in enumerate(T.RELATIONS)
)


def _side(c: str) -> str:
    return f"""SELECT DISTINCT ON (x.doc_id, x.chunk, v, nn) x.doc_id, x.chunk, v, nn, p, id, c FROM x JOIN e ON x.doc_id = e.doc_id AND x.chunk = e.chunk
        AND (list_contains(string_split_regex(lower({c}), '\\s+'), name) OR contains(name, ' ') AND contains(lower({c}), name)) ORDER BY x.doc_id, x.chunk, v, nn, k"""


@query(_SQL + rf"""t AS (SELECT doc_id, chunk, string_agg(p_name || ' ' || ['{"', '".join(_VERBS)}'][s % {len(_VERBS)} + 1], ' ' ORDER BY k) AS text FROM l WHERE chunk IS NOT NULL GROUP BY ALL),
x AS MATERIALIZED ({_SIDES}), s AS ({_side("a")}), o AS ({_side("b")})
SELECT s.doc_id, s.chunk AS chunk_id, s.id AS subject_id, s.p AS predicate, o.id AS object_id, round(least(s.c, o.c) * {T.STATED}, 4) AS confidence
FROM s JOIN o ON s.doc_id = o.doc_id AND s.chunk = o.chunk AND s.v = o.v AND s.nn = o.nn WHERE s.id <> o.id AND round(least(s.c, o.c) * {T.STATED}, 4) >= {T.LEAST}""")
def stated_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that texts state."""
    c = corpus(spark, sf_dir, once=True)
    return T.relation_triples(c["chunks"], c["entities"])


def _pairs_sql(label: str) -> str:
    predicate, near, far = T.PAIRED[label]
    return f"""SELECT doc_id, chunk_id, m AS subject_id, '{predicate}' AS predicate, o AS object_id, round(c * CASE WHEN near THEN {near} ELSE {far} END, 4) AS confidence FROM (
    SELECT a.doc_id, coalesce(a.chunk, b.chunk, '') AS chunk_id, a.id AS m, b.id AS o, least(a.c, b.c) AS c, a.chunk IS NOT DISTINCT FROM b.chunk AS near, coalesce(a.chunk = b.chunk, false) AS first,
        count(*) FILTER (coalesce(a.chunk = b.chunk, false)) OVER (PARTITION BY a.doc_id) AS n, row_number() OVER (PARTITION BY a.doc_id, coalesce(a.chunk = b.chunk, false) ORDER BY a.k, b.k) AS nn
    FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.label = 'method' AND b.label = '{label}') WHERE (first OR n + nn <= {T.PAIRS}) AND round(c * CASE WHEN near THEN {near} ELSE {far} END, 4) >= {T.LEAST}"""


@query(_SQL.rstrip(",") + f" {_pairs_sql('dataset')} UNION ALL {_pairs_sql('metric')}")
def paired_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with data sets and metrics."""
    e = corpus(spark, sf_dir)["entities"].where(F.col("label").isin("method", *T.PAIRED))
    # both labels read them, from both sides
    e = materialize(e.select("doc_id", "entity_id", "nth", "label", "confidence", "chunk_id"), "entities")
    return T.paired_triples(e, "dataset").unionByName(T.paired_triples(e, "metric"))


@query(_SQL + f"""m AS (SELECT DISTINCT ON (doc_id, chunk) doc_id, chunk, id, name FROM e WHERE label = 'method' AND chunk IS NOT NULL ORDER BY doc_id, chunk, k),
c AS (SELECT doc_id, 'clm_' || k AS claim_id, ['{"', '".join((*T.CLAIMS, "odd"))}'][s % 7 + 1] AS kind, p_name, c, chunk FROM l WHERE f = 'R')
SELECT c.doc_id, c.chunk AS chunk_id, coalesce(m.id, 'sub_' || claim_id) AS subject_id, coalesce(m.name, o_orderpriority) AS subject_text, {_case("kind", T.CLAIMS)} AS predicate, claim_id AS object_id, left(p_name, 150) AS object_text,
  kind = 'negation' AS negated, round(c * {T.CLAIMED}, 4) AS confidence FROM c JOIN orders ON o_orderkey = c.doc_id LEFT JOIN m ON m.doc_id = c.doc_id AND m.chunk = c.chunk WHERE kind <> 'odd' AND round(c * {T.CLAIMED}, 4) >= {T.LEAST}""")
def claim_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims say of their methods."""
    c = corpus(spark, sf_dir)
    return T.claim_triples(c["claims"], c["entities"], c["documents"])


@query(_SQL + """m AS (SELECT DISTINCT ON (doc_id, chunk) doc_id, chunk, id, name, c FROM e WHERE label = 'method' AND chunk IS NOT NULL ORDER BY doc_id, chunk, k),
f AS (SELECT doc_id, k, p_name || ' of ' || p_name AS v, chunk, 'sec_' || s % 2 AS sec FROM l WHERE f = 'A' AND label IN ('metric', 'other')),
x AS (SELECT f.*, m.id AS mid, m.name, m.c, m.chunk AS mc, n.id AS nid, n.name AS nname, n.c AS nc, n.chunk AS nch FROM f LEFT JOIN m ON m.doc_id = f.doc_id AND m.chunk = f.chunk LEFT JOIN m n ON n.doc_id = f.doc_id AND 'sec_' || right(n.chunk, 1) = sec)
SELECT x.doc_id, coalesce(mc, nch, chunk, sec) AS chunk_id, coalesce(mid, nid, 'sub_' || k) AS subject_id, coalesce(name, nname, o_orderpriority) AS subject_text, 'introduces' AS predicate, 'obj_' || k AS object_id, left(v, 120) AS object_text,
  k AS evidence_id, round(coalesce(c, nc, 0.6) * 0.75, 4) AS confidence FROM x JOIN orders ON o_orderkey = x.doc_id WHERE round(coalesce(c, nc, 0.6) * 0.75, 4) >= 0.3""")
def contribution_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What introduces the contributions; an order's chunks are its sections by their last digit."""
    c = corpus(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "*").join(_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    known = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])[F.col("p_type")]
    facts = lines.where("l_returnflag = 'A'").select(
        "doc_id", _key().alias("fact_id"), F.when(known.isNull() | (known == "metric"), "contribution").otherwise("method").alias("fact_type"),
        F.concat_ws(" of ", "p_name", "p_name").alias("value"), F.when(F.col("l_quantity") < 45, F.concat(F.lit("chk_"), F.col("l_linenumber") % 2)).alias("chunk_id"), F.concat(F.lit("sec_"), F.col("l_suppkey") % 2).alias("section_id"),
    ).distinct()
    chunks = c["chunks"].select("doc_id", "chunk_id", F.concat(F.lit("sec_"), F.substring("chunk_id", 5, 1)).alias("section_id"))
    return T.contribution_triples(facts, c["entities"], chunks, c["documents"])
