"""Queries of the store: events of one kind after another come in as batches, each of them twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import _table, query
from quire.plans.storage import workspace
from quire.sources.store import append_batch, read_store


@query("""WITH e AS (SELECT event_id AS doc_id, coalesce(props, '') || '/' || user_id AS text, event_type FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY event_type, doc_id) AS nth FROM e) SELECT doc_id, sha256(text) AS sha256 FROM f WHERE nth = 1""")
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after all batches: of equal texts the first that came."""
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat_ws("/", F.coalesce("props", F.lit("")), F.col("user_id").cast("string")).alias("text"), "event_type")
    root = f"{workspace(spark)}/quire/store-{uuid.uuid4().hex[:12]}"
    for kind in sorted(r[0] for r in events.select("event_type").distinct().collect()):  # a handful of kinds
        for _ in range(2):
            append_batch(spark, root, kind, events.where(F.col("event_type") == kind).select("doc_id", "text"))
    return read_store(spark, root).select("doc_id", "sha256")
