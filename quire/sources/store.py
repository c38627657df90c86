"""A store of documents that only ever grows by whole batches.

A batch is a folder of Parquet files, and it counts once a commit names it: a small file of the batch's own name, put in place
by a rename that fails if it is there. What a lost driver or a failed task leaves behind is in no commit and so is never read; a
batch that is sent again after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.corpus import register

SCHEMA = "doc_id long, sha256 string, text string"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each committed batch, by the batch's name."""
    path, fs = _files(spark, root)
    folder = path(f"{root}/commits")
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json"):
            stream = fs.open(status.getPath())
            found[name.removesuffix(".json")] = json.loads(bytes(stream.readAllBytes()).decode())["folder"]
            stream.close()
    return found


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, sha256, text) of all committed batches; none yet is an empty table."""
    folders = sorted(committed(spark, root).values())
    return spark.read.schema(SCHEMA).parquet(*[f"{root}/data/{f}" for f in folders]) if folders else spark.createDataFrame([], SCHEMA)


def find_duplicate(spark: SparkSession, root: str, sha256: str) -> int | None:
    """The least doc_id that holds a hash, or null."""
    return read_store(spark, root).where(F.col("sha256") == sha256).agg(F.min("doc_id")).first()[0]


def get_document(spark: SparkSession, root: str, doc_id: int) -> DataFrame:
    """The row of a doc_id, or none."""
    return read_store(spark, root).where(F.col("doc_id") == doc_id)


def append_batch(spark: SparkSession, root: str, batch: str, docs: DataFrame) -> bool:
    """Add those of docs (doc_id, text) whose id and text the store lacks; False if the batch is there already.

    Null texts are empty, rows without a doc_id are left out, of equal texts the least doc_id stays. One writer at a time: of two
    that send one batch one commit stands, and the other raises.
    """
    if batch in committed(spark, root):
        return False
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    known = read_store(spark, root).select("doc_id", "sha256")
    added = register(known, rows.select("doc_id", "sha256")).where("status = 'added'").select("doc_id", "sha256")
    folder = f"{batch}-{uuid.uuid4().hex[:12]}"
    rows.dropDuplicates(["doc_id", "sha256"]).join(added, ["doc_id", "sha256"]).select("doc_id", "sha256", "text").write.parquet(f"{root}/data/{folder}")
    path, fs = _files(spark, root)
    draft, final = path(f"{root}/drafts/{folder}.json"), path(f"{root}/commits/{batch}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"folder": folder}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise FileExistsError(f"batch {batch} was committed meanwhile")
    return True
