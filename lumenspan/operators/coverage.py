"""Coverage of reference speech by detected intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.intervals import sweep, union
from lumenspan.operators.matching import speech


def coverage(ref: DataFrame, detected: DataFrame) -> DataFrame:
    """A row a case: durations of both unions and their overlap, recall, precision, and lengths of the raw chunks."""
    a, b = speech(ref).select("case_id", "start_ms", "end_ms"), detected.select("case_id", "start_ms", "end_ms")
    length = F.col("end_ms") - F.col("start_ms")
    took = lambda c: F.coalesce(F.sum(F.when(c, length)), F.lit(0))
    swept = sweep(a, b).groupBy("case_id").agg(took(F.col("in_a")).alias("reference_speech_duration_ms"), took(F.col("in_b")).alias("detected_speech_duration_ms"), took(F.col("in_a") & F.col("in_b")).alias("overlap_duration_ms"))
    chunks = b.groupBy("case_id").agg(F.count("*").alias("detected_interval_count"), F.max(length).alias("detected_max_interval_ms"), F.avg(length).alias("detected_mean_interval_ms"))
    out = swept.join(chunks, "case_id", "left").na.fill(0, ["detected_interval_count"])
    r, d, o = F.col("reference_speech_duration_ms"), F.col("detected_speech_duration_ms"), F.col("overlap_duration_ms")
    return out.select("case_id", r, d, o, (r - o).alias("missed_reference_duration_ms"), (d - o).alias("extra_detected_duration_ms"), F.when(r > 0, o / r).alias("reference_recall"), F.when(d > 0, o / d).alias("detected_precision"), "detected_interval_count", "detected_max_interval_ms", "detected_mean_interval_ms")


def suite(cases: DataFrame, *keys: str) -> DataFrame:
    """Duration-weighted totals; the mean chunk is the merged duration by the number of raw chunks. The number of chunks
    is unknown (null) if that of any case is."""
    sums = ["reference_speech_duration_ms", "detected_speech_duration_ms", "overlap_duration_ms", "missed_reference_duration_ms", "extra_detected_duration_ms", "detected_interval_count"]
    out = cases.groupBy(*keys).agg(F.count("*").alias("case_count"), *[F.sum(c).alias(c) for c in sums[:-1]], F.when(F.count("*") == F.count(sums[-1]), F.sum(sums[-1])).alias(sums[-1]), F.max("detected_max_interval_ms").alias("detected_max_interval_ms"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("detected_mean_interval_ms", over("detected_speech_duration_ms", "detected_interval_count")).withColumn("reference_recall", over("overlap_duration_ms", "reference_speech_duration_ms")).withColumn("detected_precision", over("overlap_duration_ms", "detected_speech_duration_ms"))


def fragments(ref: DataFrame, detected: DataFrame) -> DataFrame:
    """``case_id, kind, start_ms, end_ms``: missed and extra stretches of time."""
    swept = sweep(speech(ref).select("case_id", "start_ms", "end_ms"), detected.select("case_id", "start_ms", "end_ms"))
    kind = F.when(F.col("in_a") & ~F.col("in_b"), F.lit("missed")).when(F.col("in_b") & ~F.col("in_a"), F.lit("extra"))
    return union(swept.withColumn("kind", kind).where("kind is not null"), keys=("case_id", "kind"))


def compared(ref: DataFrame, heads: DataFrame, detected: dict[str, DataFrame]) -> DataFrame:
    """A ranked row a label: the suite's durations, ratios and counts, with the audio's duration, the number of
    reference segments and of their merged intervals, and how many stretches were missed and are extra.

    ``heads``: ``case_id, duration_ms``. All labels are swept together, as cases of their own. Labels are few.
    """
    spoken, labels = speech(ref), F.explode(F.array(*map(F.lit, detected))).alias("label")
    key = lambda df: df.withColumn("case_id", F.struct("label", F.col("case_id").cast("string").alias("case_id"))).drop("label")
    refs = key(ref.select("*", labels))
    found = key(reduce(DataFrame.unionByName, [d.select("case_id", "start_ms", "end_ms", F.lit(label).alias("label")) for label, d in detected.items()]))
    by_case = coverage(refs, found).withColumn("label", F.col("case_id.label"))
    suites = suite(by_case, "label")
    stretches = fragments(refs, found).groupBy(F.col("case_id.label").alias("label")).agg(*[F.sum((F.col("kind") == kind).cast("long")).alias(name) for kind, name in (("missed", "missed_reference_interval_count"), ("extra", "extra_detected_interval_count"))])
    whole = spoken.agg(F.count("*").alias("reference_segment_count")).crossJoin(union(spoken.select("case_id", "start_ms", "end_ms")).agg(F.count("*").alias("reference_interval_count"))).crossJoin(heads.agg(F.sum("duration_ms").alias("audio_duration_ms")))
    names = ["missed_reference_interval_count", "extra_detected_interval_count"]
    return ranked(suites.join(stretches, "label", "left").na.fill(0, names).crossJoin(whole))  # a row a label, and one


def ranked(suites: DataFrame) -> DataFrame:
    """Suites (with ``label``) by missed, extra, recall, precision and label."""
    from pyspark.sql import Window

    high = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).desc()
    order = Window.orderBy("missed_reference_duration_ms", "extra_detected_duration_ms", high("reference_recall"), high("detected_precision"), "label")
    return suites.withColumn("rank", F.row_number().over(order))
