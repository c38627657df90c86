"""Connected components of an undirected graph, as rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.plans.storage import discard, read_back, write_work

#: Edges that a task contracts at a time; a fixed value, so that its memory does not grow with the input.
BLOCK = 500_000


def _low(edges: DataFrame) -> DataFrame:
    """The smallest neighbour below every u that has one."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
    """Every node of a block of edges with the smallest node it reaches within the block; a node that is that itself only if nothing else is there."""
    ends = pa.chunked_array(u.chunks + v.chunks).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order), dtype=order.dtype)
    ends_of = rank[ends.indices.to_numpy()].astype(np.int64)
    a, b = ends_of[: len(u)], ends_of[len(u) :]
    top = np.arange(len(order))
    while True:
        x, y = top[a], top[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := top[top], top):
            top = up
    node = np.arange(len(order))
    told = (top != node) | (np.bincount(top, minlength=len(order)) == 1)
    names = ends.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([names.take(pa.array(node[told])), names.take(pa.array(top[told]))], ["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= BLOCK:
            block, held, n = pa.Table.from_batches(held), [], 0
            yield _stars(block["u"], block["v"])
    if n:
        block = pa.Table.from_batches(held)
        yield _stars(block["u"], block["v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Blocks of edges are contracted to stars first, where they lie. Then the large-star and small-star steps
    alternate until the edges no longer change. Each step is an aggregate and a join, so no node's neighbours
    are gathered anywhere; each round is written to the workspace, which cuts the lineage, in as many parts as
    the last round's edges need. Rows with a null end are ignored, self loops give their node a component,
    repeated edges count once, an empty input gives an empty result. Raises if max_rounds pass without an end.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    whole, mark = _written(pairs.mapInArrow(_contracted, pairs.schema), 0)
    pairs, path = read_back(pairs, whole), None
    loops = pairs.where("u = v").select("u").distinct()
    # u is always the larger end
    current = pairs.where("u <> v")
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # large star: neighbours above v move to the smallest of v's neighbourhood, which is v itself or lies below it
        large = current.join(_low(current).withColumnsRenamed({"u": "v", "m": "low"}), "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        # small star: u and its neighbours below it move to the smallest of them
        low = _low(large)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = low.withColumnRenamed("m", "v").unionByName(moved).distinct()
        new_path, new_mark = _written(step, 2 * mark[0])
        if path:
            discard(spark, path)
        current, path = read_back(step, new_path), new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = members.unionByName(roots)
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def _written(edges: DataFrame, rows: int) -> tuple[str, tuple[int, int]]:
    """Where edges were written, and their count with a sum of hashes, observed on the way; rows: about how many are shuffled for them."""
    seen = Observation()
    path = write_work(
        edges.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ),
        "edges",
        rows,
    )
    return path, (seen.get["n"], int(seen.get["h"] or 0))
