"""Positions of rows in groups of any size, a third of all rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.storage import materialize


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `rank`: each row's place in its group from 0, by the columns of order, nulls first.

    group holds no nulls; rows is read twice (once to sample its ranges). Rows are dealt out by ranges of group and
    order, so a large group lies in many tasks; only groups that go on over the end of a part take an offset, at most
    one for each part, which is why these are broadcast. Rows that are equal in order follow each other in any way.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its part
    placed = materialize(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name
    )
    runs = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", F.sum("_n").over(earlier).alias("_before")).where("_before is not null")
    first = F.min("_at").over(Window.partitionBy(group, "_part"))
    return (
        placed.withColumn("_at", F.col("_at") - first)
        .join(F.broadcast(runs), [group, "_part"], "left")
        .withColumn("rank", F.col("_at") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_at", "_before")
    )
