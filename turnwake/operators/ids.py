"""Dense numbers for keys, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def dense_ids(rows: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """(keys, ``name``): the distinct keys numbered from 0 in their order, nulls first.

    Keys are dealt into ranges and sorted there; each has its place in its range, and a range begins where the
    counts of the ranges before it end. Only these counts, one a range, come to the driver.
    """
    inside = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number that Spark gives is the partition's in the upper bits and the row's place in it in the lower 33.
    placed = settled(inside.withColumn("__n", F.monotonically_increasing_id()))
    part, place = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    begin, starts = 0, []
    for r in counts:
        starts.append((r["part"], begin))
        begin += r["n"]
    first = rows.sparkSession.createDataFrame(starts, "__part long, __first long")
    numbered = placed.withColumn("__part", part).join(F.broadcast(first), "__part")  # a row a range
    return numbered.select(*keys, (F.col("__first") + place).alias(name))
