"""Audits of reference transcripts: overlaps, long and flagged segments, coverage, and the queue they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.effort import score_of
from lumenspan.operators.intervals import union
from lumenspan.operators.matching import overlapping, speech

# Thresholds and priorities.
OVERLAP_MS, LONG_MS, HIGH_COVERAGE = 100, 31_000, 0.95
PRIORITY = {"reference-needs-review": 5000.0, "reference-exact-boundary-overlap": 4000.0, "reference-same-channel-overlap": 3000.0, "reference-long-segment": 2000.0}


def overlap_pairs(segments: DataFrame, min_ms: int = OVERLAP_MS) -> DataFrame:
    """Pairs of a case's spoken segments that overlap by ``min_ms`` or more, the earlier one (start, end, id) left."""
    side = speech(segments).select("case_id", "id", "start_ms", "end_ms", "channel")
    key = lambda p: F.struct(f"{p}_start_ms", f"{p}_end_ms", f"{p}_id")
    pairs = overlapping(side, side, ("left", "right"), key("left") < key("right")).where(F.col("overlap_ms") >= min_ms)
    same = F.col("left_channel") == F.col("right_channel")
    exact = (F.col("left_start_ms") == F.col("right_start_ms")) & (F.col("left_end_ms") == F.col("right_end_ms"))
    return pairs.select("case_id", "left_id", "right_id", F.greatest("left_start_ms", "right_start_ms").alias("start_ms"), F.least("left_end_ms", "right_end_ms").alias("end_ms"), "overlap_ms", "left_channel", "right_channel", same.alias("same_channel"), exact.alias("exact_boundary"))


def audit(segments: DataFrame, durations: DataFrame, min_ms: int = OVERLAP_MS, long_ms: int = LONG_MS) -> DataFrame:
    """A row a case: counts of pairs, long and flagged segments, covered time and the share of the audio."""
    spoken = speech(segments)
    length = F.col("end_ms") - F.col("start_ms")
    base = spoken.groupBy("case_id").agg(F.count("*").alias("speech_segment_count"), F.sum(F.col("needs_review").cast("long")).alias("review_count"), F.sum((length >= long_ms).cast("long")).alias("long_segment_count"), F.max(length).alias("max_segment_duration_ms"))
    n = lambda c: F.sum(c.cast("long"))
    pairs = overlap_pairs(segments, min_ms).groupBy("case_id").agg(F.count("*").alias("overlap_pair_count"), n(F.col("same_channel")).alias("same_channel_overlap_pair_count"), n(~F.col("same_channel")).alias("cross_channel_overlap_pair_count"), n(F.col("exact_boundary")).alias("exact_boundary_overlap_pair_count"), n(F.col("exact_boundary") & F.col("same_channel")).alias("exact_boundary_same_channel_overlap_pair_count"), F.sum("overlap_ms").alias("pair_overlap_duration_ms"))
    covered = union(spoken.select("case_id", "start_ms", "end_ms")).groupBy("case_id").agg(F.sum(length).alias("speech_union_duration_ms"))
    out = base.join(covered, "case_id", "left").join(pairs, "case_id", "left").na.fill(0).join(durations, "case_id", "left")
    return out.withColumn("speech_coverage_ratio", F.when(F.col("duration_ms") > 0, F.col("speech_union_duration_ms") / F.col("duration_ms")))


def flags(audited: DataFrame, high: float = HIGH_COVERAGE) -> DataFrame:
    """``case_id, flag, count``: a row for each flag raised (``count`` is null for the coverage warning)."""
    made = [("review_flag_segments", "review_count"), ("same_channel_overlap", "same_channel_overlap_pair_count"), ("exact_boundary_overlap", "exact_boundary_same_channel_overlap_pair_count"), ("long_segment", "long_segment_count")]
    each = [F.when(F.col(c) > 0, F.struct(F.lit(name).alias("flag"), F.col(c).alias("count"))) for name, c in made]
    each.append(F.when(F.col("speech_coverage_ratio") >= high, F.struct(F.lit("near_full_speech_coverage").alias("flag"), F.lit(None).cast("long").alias("count"))))
    return audited.select("case_id", F.explode(F.array_compact(F.array(*each))).alias("x")).select("case_id", "x.*")


def suite(audited: DataFrame) -> DataFrame:
    """Totals; the duration is null if any case's is."""
    sums = ["speech_segment_count", "review_count", "long_segment_count", "overlap_pair_count", "same_channel_overlap_pair_count", "cross_channel_overlap_pair_count", "exact_boundary_overlap_pair_count", "exact_boundary_same_channel_overlap_pair_count", "pair_overlap_duration_ms", "speech_union_duration_ms"]
    total = F.when(F.count("*") == F.count("duration_ms"), F.sum("duration_ms")).alias("duration_ms")
    return audited.agg(F.count("*").alias("case_count"), *[F.sum(c).alias(c) for c in sums], total)


def queue(segments: DataFrame, min_ms: int = OVERLAP_MS, long_ms: int = LONG_MS) -> DataFrame:
    """Review items: flagged segments, long ones, and same-channel pairs; reasons add up, seconds count up to 99."""
    spoken = speech(segments)
    none = F.lit(None).cast("string")
    single = lambda df, reason: df.select("case_id", F.col("id").alias("reference_id"), none.alias("candidate_id"), "start_ms", "end_ms", F.array(F.lit(reason)).alias("reasons"))
    flagged = single(spoken.where("needs_review"), "reference-needs-review")
    long = single(spoken.where(F.col("end_ms") - F.col("start_ms") >= long_ms), "reference-long-segment")
    reasons = F.array_compact(F.array(F.when(F.col("exact_boundary"), F.lit("reference-exact-boundary-overlap")), F.lit("reference-same-channel-overlap")))
    pairs = overlap_pairs(segments, min_ms).where("same_channel").select("case_id", F.col("left_id").alias("reference_id"), F.col("right_id").alias("candidate_id"), "start_ms", "end_ms", reasons.alias("reasons"))
    score = score_of(F.col("reasons"), PRIORITY) + F.least(F.lit(99.0), F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0))
    return flagged.unionByName(long).unionByName(pairs).withColumn("priority_score", score)
