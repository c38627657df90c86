"""Queries of entity resolution: page titles and part names stand for mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import resolution as R
from quire.plans.registry import _table, query

ALIASES = [("small ring", "method", ["hot ring", "blue ring"]), ("red plate", "tool", ["hot plate"]), ("old rod", "dataset", ["large rod", "red plate", "Small  Widget."])]
_LABELS = {"com": "method", "net": "tool", "org": "dataset", "PROMO": "method", "ECONOMY": "tool", "STANDARD": "gene_protein", "MEDIUM": "person", "SMALL": "organization"}


def _named(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " ELSE 'other' END"


#: A title is an entity of the label its site's suffix stands for, a part's name one of the label its type stands for.
_TITLE, _SUFFIX = r"<title>([^<]*)</title>", r"^[a-z]+://[^/?#]*\.([a-z]+)(?:[/?#]|$)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("entity_id"), F.regexp_extract("html", _TITLE, 1).alias("text"), F.regexp_extract("url", _SUFFIX, 1).alias("kind"), F.lit(0.9).alias("confidence")
    )
    parts = _table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1_000_000_000_000).alias("entity_id"), F.col("p_name").alias("text"), F.col("p_type").alias("kind"), F.round(F.col("p_retailprice") / 2500, 4).alias("confidence")
    )
    return pages.unionByName(parts).select("entity_id", "text", F.expr(_named("kind")).alias("label"), "confidence")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_entities(mentions(spark, sf_dir), R.alias_table(spark, ALIASES))


def _norm(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({text})), '\s+', ' ', 'g'), '[.,;:!?''""()]+$', ''))".replace('""', '"')


def similar_sql(a: str, b: str, percent: int) -> str:
    """Whether 200 LCS / (|a| + |b|) >= percent for texts of at most 120 characters; levenshtein never exceeds the insertions and deletions."""
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(generate_series(1, length({a})), lambda i: CASE WHEN {a}[i] = c THEN (2::DOUBLE ** (i - 1))::HUGEINT ELSE 0::HUGEINT END))::HUGEINT)"
    full = f"((2::DOUBLE ** length({a}))::HUGEINT - 1)"
    left = f"list_reduce(list_prepend({full}, {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"levenshtein({a}, {b}) * 100 <= {100 - percent} * (length({a}) + length({b})) AND 200 * (length({a}) - bit_count({left})) >= {percent} * (length({a}) + length({b}))"


def reach_sql(edges: str, name: str) -> str:
    """CTE {name}(node, component) over the nodes of edges (a, b), by closure."""
    return f"""{name}_two AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
{name}_all(a, b) AS (SELECT a, b FROM {name}_two UNION SELECT r.a, e.b FROM {name}_all r JOIN {name}_two e ON r.b = e.a),
{name} AS (SELECT a AS node, least(a, min(b)) AS component FROM {name}_all GROUP BY a)"""


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in R.COMPATIBLE)
#: Groups of equal text and label are the nodes of the first closure, entities that are alone those of the second.
RESOLVED_SQL = rf"""WITH RECURSIVE m AS (SELECT entity_id, text, {_named("kind")} AS label, confidence FROM (SELECT page_id AS entity_id, regexp_extract(html, '{_TITLE}', 1) AS text,
    regexp_extract(url, '{_SUFFIX}', 1) AS kind, 0.9::DOUBLE AS confidence FROM pages
    UNION ALL SELECT p_partkey + 1000000000000, p_name, p_type, round(p_retailprice / 2500, 4) FROM part)),
x(nth, canonical, alias_label, variant) AS (VALUES {", ".join(f"({i}, '{c}', '{lab}', '{v}')" for i, (c, lab, vs) in enumerate(ALIASES) for v in [c, *vs])}),
al AS (SELECT {_norm("variant")} AS norm, arg_min({_norm("canonical")}, nth) AS canonical, arg_min(alias_label, nth) AS alias_label FROM x GROUP BY 1),
ok(p, q) AS (VALUES {_PAIRS}),
n AS MATERIALIZED (SELECT m.*, {_norm("text")} AS norm FROM m),
g AS MATERIALIZED (SELECT n.norm, label, min(entity_id) AS first, max(entity_id) AS last, any_value(canonical) AS canonical, any_value(alias_label) AS alias_label FROM n LEFT JOIN al ON n.norm = al.norm GROUP BY n.norm, label),
hit AS (SELECT * FROM g WHERE label = alias_label OR (label, alias_label) IN (SELECT (p, q) FROM ok)),
e1 AS MATERIALIZED (SELECT first AS a, first AS b FROM g
    UNION ALL SELECT i.first, j.first FROM g i JOIN g j ON i.norm = j.norm AND i.first < j.last AND (i.label, j.label) IN (SELECT (p, q) FROM ok)
    UNION ALL SELECT i.first, j.first FROM hit i JOIN hit j ON i.canonical = j.canonical AND i.alias_label = j.alias_label),
{reach_sql("e1", "c1")},
one AS MATERIALIZED (SELECT n.*, component, count(*) OVER (PARTITION BY component) AS size FROM n JOIN g ON n.norm = g.norm AND n.label = g.label JOIN c1 ON node = first),
t AS MATERIALIZED (SELECT entity_id, label, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS s FROM one WHERE size = 1 AND norm <> ''),
e2 AS MATERIALIZED (SELECT i.entity_id AS a, j.entity_id AS b FROM t i JOIN t j ON i.label = j.label AND i.entity_id < j.entity_id AND {similar_sql("i.s", "j.s", 85)}),
{reach_sql("e2", "c2")},
r AS MATERIALIZED (SELECT coalesce(c2.component, one.component) AS cluster_id, entity_id, text, label, confidence, norm FROM one LEFT JOIN c2 ON node = entity_id),
members AS (SELECT r.*, CASE WHEN count(*) OVER (PARTITION BY cluster_id) = 1 THEN NULL WHEN count(*) OVER (PARTITION BY cluster_id, r.norm) > 1 THEN 'exact'
    WHEN al.norm IS NOT NULL THEN 'alias' ELSE 'fuzzy' END AS method FROM r LEFT JOIN al ON r.norm = al.norm) """


@query(RESOLVED_SQL + "SELECT cluster_id, entity_id, norm, method FROM members")
def entity_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and name with what it is one with."""
    return resolved(spark, sf_dir).select("cluster_id", "entity_id", "norm", "method")


@query(RESOLVED_SQL + """, l AS (SELECT cluster_id, label, count(*) AS n, min(entity_id) AS first FROM members GROUP BY ALL)
SELECT cluster_id, arg_max(trim(text), (length(trim(text)), trim(text))) AS canonical_text, any_value(best) AS label, count(*) AS size, min(confidence) AS confidence,
count(DISTINCT trim(text)) AS n_variants, CASE WHEN bool_or(method = 'exact') AND bool_or(method <> 'exact') THEN 'hybrid' WHEN bool_or(method = 'alias') THEN 'alias'
WHEN bool_or(method = 'fuzzy') THEN 'fuzzy' ELSE 'exact' END AS method FROM members JOIN (SELECT cluster_id, arg_min(label, (-n, first)) AS best FROM l GROUP BY 1) USING (cluster_id)
WHERE method IS NOT NULL GROUP BY cluster_id""")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of two or more, described."""
    return R.entity_clusters(resolved(spark, sf_dir))


@query(RESOLVED_SQL + """SELECT count(*) AS n_entities, count(method) AS n_resolved, count(DISTINCT cluster_id) FILTER (method IS NOT NULL) AS n_clusters, round(count(method) / count(*), 4) AS rate,
count(*) FILTER (method = 'exact') AS n_exact, count(*) FILTER (method = 'alias') AS n_alias, count(*) FILTER (method = 'fuzzy') AS n_fuzzy FROM members""")
def entity_resolution_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities were resolved, and how."""
    members = resolved(spark, sf_dir)
    by = [F.count(F.when(F.col("method") == m, 1)).alias(f"n_{m}") for m in ("exact", "alias", "fuzzy")]
    return members.agg(
        F.count(F.lit(1)).alias("n_entities"), F.count("method").alias("n_resolved"), F.count_distinct(F.when(F.col("method").isNotNull(), F.col("cluster_id"))).alias("n_clusters"),
        F.round(F.count("method") / F.count(F.lit(1)), 4).alias("rate"), *by,
    )
