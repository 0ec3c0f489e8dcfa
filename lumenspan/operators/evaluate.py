"""Evaluation of candidate transcripts: timing, channels, text error rates, artifacts, gates, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import text as T
from lumenspan.operators.matching import speech
from lumenspan.schemas import CHANNELS

# The product gate.
PRODUCT_GATE = {"max_practical_cer": 0.10, "min_500ms_ratio": 0.90, "min_channel_accuracy": 0.85, "max_mix_ratio": 0.50, "max_edit_ratio": 0.15, "max_review_ratio": 0.0}


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is no denominator."""
    return F.when(whole > 0, part / whole)


def timing(pairs: DataFrame, *keys: str) -> DataFrame:
    """Boundary errors of pairs by ``keys`` (none: in all). Means are taken over the pairs themselves, so a roll-up is
    weighted by pairs."""
    start, end = F.abs(F.col("ref_start_ms") - F.col("cand_start_ms")), F.abs(F.col("ref_end_ms") - F.col("cand_end_ms"))
    within = lambda ms: F.coalesce(F.sum((start <= ms).cast("long") + (end <= ms).cast("long")), F.lit(0))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("paired_segments"), F.sum(start).alias("s"), F.sum(end).alias("e"), F.max(F.greatest(start, end)).alias("max_boundary_error_ms"), within(250).alias("within_250ms_count"), within(500).alias("within_500ms_count"))
    n, two = F.col("paired_segments"), F.col("paired_segments") * 2
    return out.select(*keys, "paired_segments", ratio(F.col("s"), n).alias("mean_start_error_ms"), ratio(F.col("e"), n).alias("mean_end_error_ms"), ratio(F.col("s") + F.col("e"), two).alias("mean_boundary_error_ms"), "max_boundary_error_ms", "within_250ms_count", ratio(F.col("within_250ms_count"), two).alias("within_250ms_ratio"), "within_500ms_count", ratio(F.col("within_500ms_count"), two).alias("within_500ms_ratio"))


def channel_accuracy(pairs: DataFrame, *keys: str) -> DataFrame:
    """Accuracy over pairs with a side on both ends; the share of MIX over all pairs."""
    sides = F.col("ref_channel").isin("L", "R") & F.col("cand_channel").isin("L", "R")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("paired_segments"), count(sides).alias("comparable_segments"), count(sides & (F.col("ref_channel") == F.col("cand_channel"))).alias("correct"), count(F.col("cand_channel") == "MIX").alias("candidate_mix_segments"))
    return out.select(*keys, "paired_segments", "comparable_segments", ratio(F.col("correct"), F.col("comparable_segments")).alias("accuracy"), "candidate_mix_segments", (F.col("candidate_mix_segments") / F.greatest(F.lit(1), F.col("paired_segments"))).alias("candidate_mix_ratio"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``ref_channel, cand_channel, n``: all nine cells, zeros too."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in CHANNELS for b in CHANNELS], "ref_channel string, cand_channel string")
    return cells.join(pairs.groupBy("ref_channel", "cand_channel").agg(F.count("*").alias("n")), ["ref_channel", "cand_channel"], "left").select("ref_channel", "cand_channel", F.coalesce("n", F.lit(0)).alias("n"))


def document_text(segments: DataFrame, normal: Column, name: str) -> DataFrame:
    """Spoken texts of a case, joined in document order."""
    held = speech(segments).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", normal.alias("t")))).alias("xs"))
    return held.select("case_id", F.array_join(F.transform("xs", lambda x: x.t), "").alias(name))


def error_rates(ref: DataFrame, cand: DataFrame, normal=T.practical) -> DataFrame:
    """``case_id, edit_distance, reference_characters, candidate_characters, cer`` over whole documents."""
    both = document_text(ref, normal(F.col("text")), "r").join(document_text(cand, normal(F.col("text")), "c"), "case_id", "full")
    both = both.select("case_id", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("c", F.lit("")).alias("c"))
    counted = both.select("case_id", T.long_distance("r", "c").alias("edit_distance"), F.char_length("r").cast("long").alias("reference_characters"), F.char_length("c").cast("long").alias("candidate_characters"))
    return counted.withColumn("cer", T.error_rate(F.col("edit_distance"), F.col("reference_characters"), F.col("candidate_characters")))


def rolled_error_rate(rates: DataFrame) -> DataFrame:
    """Micro-average over cases."""
    out = rates.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edit_distance", "reference_characters", "candidate_characters")])
    return out.withColumn("cer", T.error_rate(F.col("edit_distance"), F.col("reference_characters"), F.col("candidate_characters")))


def artifacts(cand: DataFrame, normal=T.practical) -> DataFrame:
    """Spoken segments with the flags of machine-made text."""
    made = speech(cand).withColumn("n", normal(F.col("text")))
    chars = F.char_length("n").cast("long")
    out = made.select("case_id", "id", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), chars.alias("chars"), T.not_japanese(F.col("n")).alias("non_japanese_text"), T.dense(chars, F.col("end_ms") - F.col("start_ms")).alias("high_text_density"), T.repeated(F.col("n")).alias("repeated_text"))
    return out.withColumn("artifact", F.col("non_japanese_text") | F.col("high_text_density") | F.col("repeated_text"))


def artifact_rollup(flags: DataFrame, *keys: str) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"{c}_segments")
    names = ("artifact", "non_japanese_text", "high_text_density", "repeated_text")
    out = flags.groupBy(*keys).agg(F.count("*").alias("candidate_segments"), *map(count, names))
    for c in names:
        out = out.withColumn(f"{c}_segment_ratio", F.col(f"{c}_segments") / F.greatest(F.lit(1), F.col("candidate_segments")))
    return out


def review_share(cand: DataFrame, over_speech: bool) -> DataFrame:
    """Flagged candidate segments by all of them (a single report) or by spoken ones (a suite)."""
    spoken = (F.col("kind") == "speech") & (F.col("text") != "")
    whole = F.sum(spoken.cast("long")) if over_speech else F.count("*")
    return cand.agg(F.coalesce(F.sum(F.col("needs_review").cast("long")), F.lit(0)).alias("candidate_review_count"), (F.coalesce(F.sum(F.col("needs_review").cast("long")), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(whole, F.lit(0)))).alias("candidate_review_ratio"))


def gate_failures(gate: dict[str, float] = PRODUCT_GATE) -> Column:
    """Names of the failed limits of a row with the metrics named below; a missing metric fails as unavailable."""
    metric = {"max_practical_cer": "practical_cer", "min_500ms_ratio": "time_aligned_500ms_ratio", "min_channel_accuracy": "channel_accuracy", "max_mix_ratio": "mix_ratio", "max_edit_ratio": "edit_ratio", "max_review_ratio": "review_ratio"}
    tests = []
    for name, limit in gate.items():
        value = F.col(metric[name])
        bad = value > F.lit(float(limit)) if name.startswith("max") else value < F.lit(float(limit))
        tests.append(F.when(value.isNull(), F.lit(f"{metric[name]} is unavailable")).when(bad, F.lit(f"{metric[name]} fails {name}")))
    return F.array_compact(F.array(*tests))


def ranked(reports: DataFrame) -> DataFrame:
    """Reports by edit ratio, error rate, 500 ms share, channel accuracy (missing last) and label; ``rank`` from 1."""
    from pyspark.sql import Window

    high = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).desc()
    order = Window.orderBy("edit_ratio", "practical_cer", high("time_aligned_500ms_ratio"), high("channel_accuracy"), "label")
    return reports.withColumn("rank", F.row_number().over(order))
