"""A stream of documents into a store, each once however often a batch is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quire.sources.store import append_batch


def ingest(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of (doc_id, text) to the store at root, what is there now, and end.

    A batch that was written but not noted in the checkpoint comes again under its number and finds its commit.
    """
    write = lambda docs, number: append_batch(docs.sparkSession, root, f"stream-{number:09d}", docs)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
