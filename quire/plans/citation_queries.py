"""Queries of citation linking: the first sentence of each line of a document cites, page titles stand for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import citations as L
from quire.operators import references as M
from quire.plans.registry import _table, query
from quire.plans.relation_queries import with_counts
from quire.plans.resolution_queries import _TITLE

_MARKERS = ["[{a}, 3-5]", "(Smith et al., {y})", "[{a}] and Li, {y}", ""]


def corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Six references a document: titles of pages, years and authors by number; markers and targets by a sentence's place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"), r"\n")).alias("nth", "line"))
    kind, a, y = F.col("nth") % len(_MARKERS), (F.col("nth") % 9).cast("string"), (F.col("nth") % 7 + 1990).cast("string")
    marker = F.element_at(F.array(*[F.lit(m) for m in _MARKERS]), kind + 1)
    marker = F.replace(F.replace(marker, F.lit("{a}"), a), F.lit("{y}"), y)
    target = F.when(F.col("nth") % 5 == 0, F.concat(F.lit("#b"), (F.col("nth") % 8).cast("string"), F.lit(" #b1")))
    number = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("number")
    titles = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("html", _TITLE, 1).alias("title"))
    refs = with_counts(spark, sf_dir, docs.select("doc_id", number), "pages").withColumn("page", (F.col("doc_id") * 7 + F.col("number")) % F.col("n_pages")).join(titles, "page")
    authors = F.when(F.col("number") % 2 == 0, F.array(F.lit("Smith, A"), F.lit("Li, B"))).otherwise(F.array(F.lit("Brown, C")))
    cut = C.chunk_sections(docs.select("doc_id", F.lit(0).alias("position"), F.col("text").alias("content")), gap=r"\n")
    return {
        "citations": lines.select(
            "doc_id", "nth", marker.alias("marker"), F.get(T.sentences(F.col("line"), line_ends=False), F.lit(0)).alias("sentence"), target.alias("target"),
            F.lit(0).alias("section_index"), (F.col("nth") % 3).alias("paragraph_index"),
        ),
        "references": refs.select("doc_id", F.format_string("ref_%03d", "number").alias("ref_id"), "title", (F.col("number") + 1989).cast("string").alias("year"), authors.alias("authors")),
        "raw_references": docs.select("doc_id", number).withColumn("target", F.concat(F.lit("b"), F.col("number").cast("string"))),
        "chunks": cut.select("doc_id", F.col("reading_order").alias("place"), "chunk_id", F.lit("sec_001").alias("section_id"), "paragraph_index", "text", F.lit(1).alias("page")),
        "sections": docs.select("doc_id", F.lit(0).alias("position"), F.lit("sec_001").alias("section_id")),
    }


@query(None)
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge from a citation to what it means. Beyond SQL in its set ratios; a test holds it against brute force."""
    return L.link_citations(**corpus(spark, sf_dir))


@query(None)
def citation_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by how their reference and their chunk were found."""
    return L.link_citations(**corpus(spark, sf_dir)).groupBy("how", "chunk_how").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count("ref_id").alias("n_linked"), F.count("intent").alias("n_intents")
    )


def bibliography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as references to the pages their numbers lead to, their titles whole, in capitals, cut or of another kind; pages as the catalogue."""
    titles = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.regexp_extract("html", _TITLE, 1).alias("title"))
    name = lambda n: F.concat(F.lit("Given Fam"), (n % 23).cast("string"))
    year = lambda n: (n % 20 + 1990).cast("string")
    works = titles.select(
        "item_id", "title", F.array(name(F.col("item_id"))).alias("authors"), year(F.col("item_id")).alias("year"),
        F.when(F.col("item_id") % 11 > 0, F.concat(F.lit("doi:10.1000/P"), F.col("item_id").cast("string"))).alias("doi"),
    )
    order = F.col("o_orderkey")
    orders = with_counts(spark, sf_dir, _table(spark, sf_dir, "orders"), "pages").withColumn("item_id", order % F.col("n_pages")).join(titles, "item_id")
    cut = F.when(order % 4 == 0, F.col("title")).when(order % 4 == 1, F.concat(F.upper("title"), F.lit("."))).when(order % 4 == 2, F.regexp_replace("title", r"^\S+\s", ""))
    refs = orders.select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("ref_"), order.cast("string")).alias("ref_id"), cut.alias("title"),
        F.when(order % 3 > 0, F.array(name(F.col("item_id") + order % 2))).alias("authors"), F.when(order % 5 > 0, year(F.col("item_id") + F.floor(order % 5 / 4))).alias("year"),
        F.when(order % 2 == 0, F.lit("Journal")).alias("venue"), F.when(order % 13 == 0, F.concat(F.lit("10.5/"), order.cast("string"))).alias("doi"), F.lit("printed").alias("raw_text"),
    )
    return refs, works


@query(None)
def reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every reference was resolved to. Beyond SQL in its set ratios; a test holds it against brute force."""
    return M.resolve_references(*bibliography(spark, sf_dir))


@query(None)
def reference_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by status and source."""
    return M.resolve_references(*bibliography(spark, sf_dir)).groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


#: Names, DOIs and years are plain expressions; SQL says the same in its own words.
@query(r"""WITH o AS (SELECT o_orderkey AS ref, CASE o_orderkey % 4 WHEN 0 THEN ' https://doi.org/10.1000/A%2F' || o_orderkey || '.' WHEN 1 THEN 'DOI: 10.1000/b–' || o_orderkey || ')' WHEN 2 THEN 'none ' || o_orderkey ELSE 'see 10.12/c' END AS doi,
    CASE o_orderkey % 4 WHEN 0 THEN 'Ann ' || o_orderstatus || 'x  Lee' WHEN 1 THEN 'Lee ,  A' WHEN 2 THEN 'AnnLee' ELSE o_orderstatus END AS name, o_clerk_year AS raw FROM (SELECT *, 'in ' || o_orderdate::DATE || ' or 2099' AS o_clerk_year FROM orders))
SELECT ref, CASE ref % 4 WHEN 0 THEN '10.1000/a/' || ref WHEN 1 THEN '10.1000/b-' || ref END AS doi, CASE ref % 4 WHEN 0 THEN 'Lee, Ann ' || regexp_extract(name, ' (\S)x', 1) || 'x' WHEN 1 THEN 'Lee, A' WHEN 2 THEN 'Lee, Ann' ELSE name END AS name,
    CASE WHEN ref % 4 = 3 THEN lower(name) ELSE 'lee' END AS surname, regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1) AS year FROM o""")
def reference_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised DOIs, names, surnames and years of references made of orders."""
    n = F.col("o_orderkey").cast("string")
    nth = F.col("o_orderkey") % 4
    doi = F.when(nth == 0, F.concat(F.lit(" https://doi.org/10.1000/A%2F"), n, F.lit("."))).when(nth == 1, F.concat(F.lit("DOI: 10.1000/b–"), n, F.lit(")"))).when(nth == 2, F.concat(F.lit("none "), n)).otherwise("see 10.12/c")
    name = F.when(nth == 0, F.concat(F.lit("Ann "), "o_orderstatus", F.lit("x  Lee"))).when(nth == 1, "Lee ,  A").when(nth == 2, "AnnLee").otherwise(F.col("o_orderstatus"))
    raw = F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or 2099"))
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ref"), T.normalize_doi(doi).alias("doi"), M.author_name(name).alias("name"), M.surname(name).alias("surname"), T.reference_year(F.lit(None).cast("string"), raw).alias("year")
    )
