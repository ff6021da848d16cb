"""Places of rows in an order of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.operators.graph import settled

_WITHIN = 33  # bits of monotonically_increasing_id that count inside a partition


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with column `name`, their place from 1 in the order, which must tell all rows apart.

    Rows are sorted by ranges and counted by partition; a row's place is its place inside its
    partition and the sizes of those before. Only the sizes, one for each partition, pass one task.
    """
    placed = settled(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _WITHIN)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")
