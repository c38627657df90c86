"""Lines that many documents share, dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import materialize

#: Places of one frequent line that a task may well hold, and the parts of all frequent places that count as hot.
PLAIN_PLACES = 1000
HOT_PARTS = 4096
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _split(docs: DataFrame) -> DataFrame:
    """docs with _lines; a null or empty text has one empty line."""
    return docs.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("_own", F.xxhash64("text"))


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, _own, pos, hash) of every line whose key has at least `least` code points."""
    lines = _split(docs.select("doc_id", "text")).select("doc_id", "_own", F.posexplode("_lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "_own", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least).select("doc_id", "_own", "pos", F.unhex(F.md5("key")).alias("hash"))


def frequent_lines(docs: DataFrame, documents: int, least: int = 1) -> DataFrame:
    """(hash, n_docs) of line keys that at least so many documents, by different doc_id, hold (null as one of them)."""
    each = _hashed(docs, least).select("hash", "doc_id").distinct()
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= documents)


def drop_frequent_lines(docs: DataFrame, documents: int = 10, least: int = 1) -> DataFrame:
    """docs with text less its frequent lines, n_lines before and n_dropped.

    Line keys (line_key) of at least `least` code points that at least so many documents hold lose all their lines
    everywhere; what stays is joined by line feeds. Null and empty texts are one empty line, whose key is too short to be
    counted, so the text becomes empty. Keys are compared by 128-bit hashes. Rows of one doc_id count as one document and each is
    rewritten by its own text; a null doc_id is one document. Other columns pass through; an empty table stays empty.
    """
    often = materialize(frequent_lines(docs, documents, least), "lines")
    total = often.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    # a line with under one in HOT_PARTS of the frequent places gets no salt: those that do are fewer than HOT_PARTS
    salts = F.ceil(F.col("n_docs") / max(PLAIN_PLACES, total / HOT_PARTS)).cast("long")
    hot = often.select("hash", salts.alias("salts")).where("salts > 1")
    dealt = _hashed(docs, least).join(F.broadcast(hot), "hash", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "_own", "pos"), "salts")))
    spread = often.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    hits = dealt.join(spread, ["hash", "salt"]).groupBy("doc_id", "_own").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    hits = hits.withColumnRenamed("doc_id", "_id").withColumnRenamed("_own", "_of")
    both = _split(docs).join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_of")), "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    n = F.size("_lines")
    # the runs of lines between one dropped line and the next
    kept = F.flatten(
        F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n)), lambda a, b: F.slice(F.col("_lines"), a + 2, b - a - 1))
    )
    told = {"text": F.array_join(kept, "\n"), "n_lines": n.cast("long"), "n_dropped": F.size(gone).cast("long")}
    return both.select(*[F.col(c) for c in docs.columns if c not in told], *[v.alias(k) for k, v in told.items()])


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents dropped; the rest by its digest. Odd rows as drop_frequent_lines says."""
    left = drop_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM f)) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM f)), '')) AS kept_sha256 FROM k GROUP BY id"""
