"""Schemas and validation of segments and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

CHANNELS = ("L", "R", "MIX")
KINDS = ("speech", "breath", "sfx", "silence")

SEGMENT = StructType([StructField("case_id", StringType()), StructField("ord", LongType()), StructField("id", StringType()), StructField("start_ms", LongType()), StructField("end_ms", LongType()), StructField("channel", StringType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("needs_review", BooleanType())])


def segment_id(number):
    """``seg_000001`` for 1; more digits where they are needed."""
    return F.format_string("seg_%06d", number)


def violations(segments: DataFrame) -> DataFrame:
    """``case_id, id, rule``: a row for each broken invariant of a segment, and for each repeated id of a case."""
    rules = [
        ("id is empty", F.coalesce(F.col("id"), F.lit("")) == ""),
        ("start_ms is negative or missing", F.col("start_ms").isNull() | (F.col("start_ms") < 0)),
        ("end_ms is not after start_ms", F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("start_ms"))),
        ("channel is unknown", F.col("channel").isNull() | ~F.col("channel").isin(*CHANNELS)),
        ("kind is unknown", F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)),
        ("text is missing", F.col("text").isNull()),
    ]
    broken = segments.select("case_id", "id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))).alias("rule"))
    repeated = segments.groupBy("case_id", "id").count().where("count > 1").select("case_id", "id", F.lit("id is repeated").alias("rule"))
    return broken.unionByName(repeated)


def interval_violations(intervals: DataFrame) -> DataFrame:
    """Detected intervals must be sorted by ``index`` and disjoint (touching is allowed)."""
    from pyspark.sql import Window

    before = F.max("end_ms").over(Window.partitionBy("case_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    checked = intervals.withColumn("_before", before)
    return checked.where("end_ms <= start_ms or start_ms < 0 or start_ms < _before").select("case_id", "index", F.lit("interval is empty, unsorted or overlaps").alias("rule"))


def assert_valid(*frames: DataFrame) -> None:
    """Raise on the first violation found in any of the frames."""
    found = reduce(DataFrame.unionByName, [f.select("case_id", "rule") for f in frames]).limit(1).collect()
    if found:
        raise ValueError(f"case {found[0]['case_id']}: {found[0]['rule']}")
