"""Numbers of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.scratch import checkpointed


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` as the column ``name``.

    The rows are computed once, into a checkpoint, dealt by ranges of that order, sorted within each and checkpointed
    again. A row's number is that within its range after the counts of the ranges before, of which one number a range
    comes to the driver; equal keys of any number only make their range longer. A column of that name is replaced.
    """
    dealt = checkpointed(checkpointed(rows.drop(name)).repartitionByRange(*order).sortWithinPartitions(*order))
    # a row's id holds its partition's number above 33 bits, and below them its number in the partition
    numbers = dealt.withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(numbers.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_n")).collect())
    before = accumulate((n for _, n in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    out = numbers.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row a partition
    return out.withColumn(name, F.col("_before") + within + 1).drop("_part", "_at", "_before")
