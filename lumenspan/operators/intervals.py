"""Interval set algebra by case: union, sweep (difference, intersection), split, slice, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.schemas import segment_id


def union(intervals: DataFrame, max_gap_ms: int = 0, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Merged intervals: a new one begins where a start is more than ``max_gap_ms`` after all ends so far.

    Touching intervals merge. Empty ones are dropped.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = intervals.where("end_ms > start_ms").select(*keys, "start_ms", "end_ms", F.coalesce((F.col("start_ms") - before > max_gap_ms).cast("int"), F.lit(1)).alias("begins"))
    island = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """``case_id, start_ms, end_ms, in_a, in_b``: time cut at every boundary, where either side is active.

    Boundaries are summed by (case, time) before the running sums, so repeats cost nothing.
    """
    edges = None
    for df, da, db in ((a, 1, 0), (b, 0, 1)):
        for column, sign in (("start_ms", 1), ("end_ms", -1)):
            one = df.where("end_ms > start_ms").select("case_id", F.col(column).alias("t"), F.lit(da * sign).alias("da"), F.lit(db * sign).alias("db"))
            edges = one if edges is None else edges.unionByName(one)
    steps = edges.groupBy("case_id", "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy("case_id").orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = steps.select("case_id", F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), (F.sum("da").over(upto) > 0).alias("in_a"), (F.sum("db").over(upto) > 0).alias("in_b"))
    return cut.where("end_ms is not null and (in_a or in_b)")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fragments of the union of ``a`` outside ``b``."""
    return union(sweep(a, b).where("in_a and not in_b"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return union(sweep(a, b).where("in_a and in_b"))


def rescued(base: DataFrame, rescue: DataFrame, min_ms: int) -> DataFrame:
    """The base intervals as they are, and the gaps between them that the rescue set covers for ``min_ms`` or more."""
    gaps = difference(rescue, base).where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    return indexed(base.select("case_id", "start_ms", "end_ms").unionByName(gaps.select("case_id", "start_ms", "end_ms")))


def indexed(intervals: DataFrame) -> DataFrame:
    """Number the intervals of a case from 0 by time."""
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("start_ms", "end_ms")) - 1
    return intervals.withColumn("index", at.cast("long"))


def split_long(intervals: DataFrame, max_ms: int) -> DataFrame:
    """Cut intervals into pieces of at most ``max_ms``."""
    at = F.explode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(max_ms).cast("long"))).alias("at")
    cut = intervals.where("end_ms > start_ms").withColumn("piece", at)
    return cut.withColumn("end_ms", F.least(F.col("piece") + max_ms, F.col("end_ms"))).withColumn("start_ms", F.col("piece")).drop("piece")


def fixed_chunks(durations: DataFrame, max_ms: int = 180_000) -> DataFrame:
    """``case_id, duration_ms`` → chunks that cover it; none for 0."""
    return indexed(split_long(durations.select("case_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms")), max_ms))


def padded(intervals: DataFrame, pad_ms: int, duration_ms: Column) -> DataFrame:
    return intervals.withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") - pad_ms)).withColumn("end_ms", F.least(duration_ms, F.col("end_ms") + pad_ms))


def _renumbered(segments: DataFrame, *order: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return segments.withColumn("ord", at.cast("long")).withColumn("id", segment_id("ord"))


def time_slice(segments: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Segments clipped to a range and moved to its start; clipped ones are flagged; ids are new by time, channel, text."""
    if start_ms < 0 or end_ms <= start_ms:
        raise ValueError("a slice needs 0 <= start_ms < end_ms")
    inside = segments.where((F.col("end_ms") > start_ms) & (F.col("start_ms") < end_ms))
    clipped = (F.col("start_ms") < start_ms) | (F.col("end_ms") > end_ms)
    cut = inside.withColumn("needs_review", F.col("needs_review") | clipped).withColumn("end_ms", F.least("end_ms", F.lit(end_ms)) - start_ms).withColumn("start_ms", F.greatest("start_ms", F.lit(start_ms)) - start_ms)
    return _renumbered(cut, "start_ms", "end_ms", "channel", "text")


def freeze(segments: DataFrame) -> DataFrame:
    """Segments by (start, end, id) with new ids and no review flags."""
    return _renumbered(segments, "start_ms", "end_ms", "id").withColumn("needs_review", F.lit(False))


def review_flags(segments: DataFrame, long_ms: int = 30_000) -> DataFrame:
    """Flag what was flagged, spoken segments without text, and those longer than ``long_ms``."""
    empty = (F.col("kind") == "speech") & (F.trim("text") == "")
    return segments.withColumn("needs_review", F.col("needs_review") | empty | (F.col("end_ms") - F.col("start_ms") > long_ms))


def replace_segment(segments: DataFrame, replacement: DataFrame) -> DataFrame:
    """Take out the segments that ``replacement`` names by (case_id, replaces) and put its rows in; ids anew by time.

    Cases without a replacement keep their ids.
    """
    cases = replacement.select("case_id").distinct()
    gone = replacement.select("case_id", F.col("replaces").alias("id")).distinct()
    kept = segments.join(gone, ["case_id", "id"], "left_anti").join(cases, "case_id", "left_semi")
    made = _renumbered(kept.unionByName(replacement.drop("replaces"), allowMissingColumns=True), "start_ms", "end_ms", "channel", "text")
    return segments.join(cases, "case_id", "left_anti").unionByName(made.select(*segments.columns))
