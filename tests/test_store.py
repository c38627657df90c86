"""The store under failures and retries, and the registry's answers."""

import pytest
from pyspark.sql import functions as F

from quire.operators import corpus as K
from quire.sources import store as S
from quire.streaming.ingest import ingest


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_batches_and_keys(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert S.read_store(spark, root).count() == 0 and S.find_duplicate(spark, root, "x") is None
    assert S.append_batch(spark, root, "a", _docs(spark, (1, "one"), (2, "two"), (3, "one"), (None, "none"), (4, None), (1, "one")))
    assert not S.append_batch(spark, root, "a", _docs(spark, (9, "nine")))
    assert S.append_batch(spark, root, "b", _docs(spark, (1, "other text of a taken id"), (5, "two"), (6, "six")))
    got = {r.doc_id: r.text for r in S.read_store(spark, root).collect()}
    assert got == {1: "one", 2: "two", 4: "", 6: "six"}
    assert S.find_duplicate(spark, root, S.get_document(spark, root, 2).first().sha256) == 2


def test_killed_writer_leaves_nothing(spark, tmp_path):
    """A batch that dies while it is written, or before its commit, is not read, and its retry is whole."""
    root = f"file://{tmp_path}/store"
    broken = _docs(spark, (1, "a"), (2, "b")).withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error("lost")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        S.append_batch(spark, root, "a", broken)
    _docs(spark, (7, "orphan")).withColumn("sha256", F.lit("x")).write.parquet(f"{root}/data/a-never-committed")
    assert S.read_store(spark, root).count() == 0
    assert S.append_batch(spark, root, "a", _docs(spark, (1, "a"), (2, "b")))
    assert {r.doc_id for r in S.read_store(spark, root).collect()} == {1, 2}


def test_stream_is_idempotent(spark, tmp_path):
    """A stream that has lost its checkpoint sends all again, and each row stays once."""
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/store"
    _docs(spark, (1, "a"), (2, "b")).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(source)
    ingest(stream(), root, f"{tmp_path}/check").awaitTermination()
    _docs(spark, (3, "c"), (1, "a")).write.mode("append").parquet(source)
    ingest(stream(), root, f"{tmp_path}/check").awaitTermination()
    assert sorted(r.doc_id for r in S.read_store(spark, root).collect()) == [1, 2, 3]
    ingest(stream(), root, f"{tmp_path}/lost").awaitTermination()
    assert sorted(r.doc_id for r in S.read_store(spark, root).collect()) == [1, 2, 3]


def test_registry(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (9, "b")], "doc_id long, sha256 string")
    new = spark.createDataFrame([(1, "z"), (3, "a"), (4, "b"), (5, "c"), (6, "c"), (7, "d"), (7, "e"), (7, "d")], "doc_id long, sha256 string")
    got = {(r.doc_id, r.sha256): (r.status, r.earlier_id) for r in K.register(known, new).collect()}
    assert got == {
        (1, "z"): ("refused", None), (3, "a"): ("duplicate", 1), (4, "b"): ("duplicate", 2), (5, "c"): ("added", None),
        (6, "c"): ("duplicate", 5), (7, "d"): ("added", None), (7, "e"): ("refused", None),
    }


def test_evidence_spans(spark):
    rows = [("a  b\nc d", "b c"), ("a b", " b "), ("A B", "b"), ("abc", ""), ("abc", None), (None, "a"), ("abc", "x"), ("x  Y z", "  x y ")]
    got = spark.createDataFrame(rows, "c string, s string").select(K.evidence_span(F.col("c"), F.col("s")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [(2, 5, "collapsed"), (2, 3, "exact"), (2, 3, "any_case"), None, None, None, None, (0, 3, "collapsed")]
