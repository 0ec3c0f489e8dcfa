"""Intervals that a detector found: files of them, checked, or by the energy of audio files read in blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.channels import energy_intervals
from lumenspan.operators.intervals import split_long
from lumenspan.schemas import interval_violations
from lumenspan.sources.audio import BLOCK, opened

# Defaults of speech by energy.
THRESHOLD_DBFS, WINDOW_MS, MIN_SILENCE_MS, MIN_SPEECH_MS, PAD_MS = -48.0, 100, 800, 200, 400


def amplitude(dbfs: float) -> float:
    """The sample value of a level."""
    return 32767 * 10 ** (dbfs / 20)


def read(spark: SparkSession, path: str, case_id: str = "single") -> DataFrame:
    """``case_id, index, start_ms, end_ms, rule`` of a JSON document with an array ``intervals`` (of one case), or of
    JSON lines with ``case_id, start_ms, end_ms`` (``index`` is the order of a case's lines). Times that aren't whole
    numbers are null and have a rule; see :func:`problems`."""
    values = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("at"))
    whole = lambda v, c: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) == "BIGINT", F.try_variant_get(v, f"$.{c}", "long")).alias(c)
    document = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).withColumn("xs", F.try_variant_get("v", "$.intervals", "array<variant>"))
    one = document.where("xs is not null").select(F.lit(case_id).alias("case_id"), F.posexplode("xs").alias("index", "v")).select("case_id", F.col("index").cast("long"), whole(F.col("v"), "start_ms"), whole(F.col("v"), "end_ms"))
    lines = values.join(document.where("xs is null").select(F.lit(True).alias("_lines")), F.lit(True), "left_semi")  # at most one row decides
    lines = lines.select(F.try_variant_get("v", "$.case_id", "string").alias("case_id"), F.col("at").alias("index"), whole(F.col("v"), "start_ms"), whole(F.col("v"), "end_ms"))
    return one.unionByName(lines)


def problems(intervals: DataFrame, heads: DataFrame) -> DataFrame:
    """``case_id, rule``: intervals without whole times, that are empty, unsorted, overlap, end after their audio, or are
    of a case without audio (``heads``: ``case_id, duration_ms``)."""
    unread = intervals.where("start_ms is null or end_ms is null or case_id is null").select("case_id", F.lit("an interval needs a case and whole times").alias("rule"))
    known = heads.select("case_id", "duration_ms")
    late = intervals.join(known, "case_id").where("end_ms > duration_ms").select("case_id", F.lit("an interval ends after the audio").alias("rule"))
    lacking = intervals.select("case_id").distinct().join(known, "case_id", "left_anti").select("case_id", F.lit("no audio for the intervals' case").alias("rule"))
    return unread.unionByName(interval_violations(intervals).select("case_id", "rule")).unionByName(late).unionByName(lacking)


def windows(heads: DataFrame, window_ms: int = WINDOW_MS, block: int = BLOCK) -> DataFrame:
    """``case_id, start_ms, end_ms, all_sq, n``: sums of squares over all channels of each window, and its samples.

    Files are cut into blocks of whole windows, each read by its byte range in a task of its own. Audio that isn't 16-bit
    has no windows.
    """
    if window_ms <= 0:
        raise ValueError("window_ms must be positive")
    step = F.greatest(F.lit(1), F.rint(F.col("sample_rate") * window_ms / 1000).cast("long"))
    size = F.greatest(F.lit(1), F.floor(block / F.col("step"))) * F.col("step")
    cut = heads.where("sample_width = 2 and frame_count > 0").withColumn("step", step).withColumn("size", size)
    cut = cut.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1, F.col("size")))).repartition("audio", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                width, n = 2 * r["channels"], min(r["size"], r["frame_count"] - r["first"])
                with opened(r["audio"]) as f:
                    data = f.read_at(n * width, r["data_at"] + r["first"] * width)
                frames = np.frombuffer(data, "<i2").reshape(-1, r["channels"])
                starts = np.arange(0, len(frames), r["step"])
                squares = np.add.reduceat((frames.astype(np.int64) ** 2).sum(axis=1), starts)
                ends = np.minimum(starts + r["step"], len(frames))
                ms = lambda x, r=r: np.rint((r["first"] + x) / r["sample_rate"] * 1000).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["case_id"]] * starts.size), pa.array(ms(starts)), pa.array(ms(ends)), pa.array(squares), pa.array((ends - starts) * r["channels"])], ["case_id", "start_ms", "end_ms", "all_sq", "n"])

    return cut.select("case_id", "audio", "data_at", "channels", "sample_rate", "frame_count", "step", "size", "first").mapInArrow(run, "case_id string, start_ms long, end_ms long, all_sq long, n long")


def by_energy(heads: DataFrame, threshold_dbfs: float = THRESHOLD_DBFS, window_ms: int = WINDOW_MS, min_silence_ms: int = MIN_SILENCE_MS, min_speech_ms: int = MIN_SPEECH_MS, pad_ms: int = PAD_MS, max_chunk_ms: int | None = None) -> DataFrame:
    """``case_id, index, start_ms, end_ms`` of speech by energy; a case in which nothing is left, or whose audio isn't
    16-bit, is speech as a whole."""
    if min(min_silence_ms, min_speech_ms, pad_ms) < 0 or (max_chunk_ms is not None and max_chunk_ms <= 0):
        raise ValueError("times must not be negative, and a longest chunk must be positive")
    level = F.sqrt(F.col("all_sq") / F.col("n")).alias("level")
    found = energy_intervals(windows(heads, window_ms).select("case_id", "start_ms", "end_ms", level), heads.select("case_id", "duration_ms"), amplitude(threshold_dbfs), min_silence_ms, min_speech_ms, pad_ms)
    return found if max_chunk_ms is None else split_long(found, max_chunk_ms)
