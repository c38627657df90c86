"""Shared working storage: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task of a table written with a known number of rows should get, bytes of files it should read at most, and bytes of a shuffle
#: up to which small shares are put together; ids compress so well that Spark's own 64 MB of them are gigabytes in a task.
TASK_ROWS, TASK_BYTES, SHARE_BYTES = 500_000, 32 << 20, 2 << 20


def workspace(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on this machine alone (tests, a laptop) a temporary folder
    is taken and remembered for the session; a cluster without the setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.quire.workspace", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.quire.workspace", base)
    return base.rstrip("/")


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: those of the session, or more, so that a task's share does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def materialize(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the workspace and read it again: lineage ends there, every executor can read it."""
    return read_back(df, write_work(df, name, rows))


def write_work(df: DataFrame, name: str = "table", rows: int | None = None) -> str:
    """Write df to a fresh folder of the workspace; returns its path. rows: about how many rows are shuffled for it, if known."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"
    settings = {CLEAN_SHUFFLES: "true"}
    if rows is not None:
        settings |= {
            "spark.sql.shuffle.partitions": str(partitions_for(spark, rows)), "spark.sql.files.maxPartitionBytes": f"{TASK_BYTES}b",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{SHARE_BYTES}b",
        }
    with _set(spark, settings):
        df.write.parquet(path)
    if (made := _written.get()) is not None:
        made.append(path)
    return path


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of the tables that are written inside; a scope around this one gets them too."""
    made: list[str] = []
    outer = _written.get()
    token = _written.set(made)
    try:
        yield made
    finally:
        _written.reset(token)
        if outer is not None:
            outer.extend(made)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside.

    With CLEAN_SHUFFLES, Spark deletes an execution's shuffle files when it ends: what was written is all that is read later.
    Otherwise they stay until the driver collects its garbage, and a job of many steps fills the disks.
    """
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_back(df: DataFrame, path: str) -> DataFrame:
    """Read what write_work wrote, with df's schema and so without a job that infers it."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a workspace folder that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
