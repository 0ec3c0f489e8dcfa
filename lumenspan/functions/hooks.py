"""Where models plug in: Python callables over binary audio, with fixed results. Fakes stand in for tests.

A hook is called once a row inside ``mapInArrow``; what it needs to load, it loads once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.schemas import segment_id


def detect(audio: DataFrame, hook: Callable[[bytes], list[tuple[int, int]]]) -> DataFrame:
    """``case_id, content`` → ``case_id, index, start_ms, end_ms``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c.as_py(), n, s, e) for c, a in zip(batch.column("case_id"), batch.column("content"), strict=True) for n, (s, e) in enumerate(hook(a.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["case_id", "index", "start_ms", "end_ms"])

    return audio.select(F.col("case_id").cast("string"), "content").mapInArrow(run, "case_id string, index long, start_ms long, end_ms long")


def transcribe(clips: DataFrame, hook: Callable[[bytes, str], list[dict]]) -> DataFrame:
    """``case_id, channel, offset_ms, content`` clips → segments on the source's timeline, all flagged for review.

    Ids are new by (start, end, channel, text); segments without text are dropped.
    """
    from pyspark.sql import Window

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case, channel, offset, content in zip(*(batch.column(k) for k in ("case_id", "channel", "offset_ms", "content")), strict=True):
                rows += [(case.as_py(), offset.as_py() + s["start_ms"], offset.as_py() + s["end_ms"], channel.as_py(), s["text"]) for s in hook(content.as_py(), channel.as_py()) if s["text"].strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["case_id", "start_ms", "end_ms", "channel", "text"])

    said = clips.select(F.col("case_id").cast("string"), "channel", F.col("offset_ms").cast("long"), "content").mapInArrow(run, "case_id string, start_ms long, end_ms long, channel string, text string")
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("start_ms", "end_ms", "channel", "text")).cast("long")
    return said.withColumn("ord", at).select("case_id", "ord", segment_id("ord").alias("id"), "start_ms", "end_ms", "channel", F.lit("speech").alias("kind"), "text", F.lit(True).alias("needs_review"))


def aligned(segments: DataFrame, words: DataFrame, context_ms: int = 0, min_ms: int = 80, min_share: float = 0.5) -> DataFrame:
    """Segments with bounds from aligned words (``case_id, id, start_s, end_s`` within the clip), where those cover
    enough; others keep theirs."""
    bounds = words.groupBy("case_id", "id").agg(F.min(F.bround(F.col("start_s") * 1000)).cast("long").alias("a"), F.max(F.bround(F.col("end_s") * 1000)).cast("long").alias("b"))
    clip_start = F.greatest(F.lit(0), F.col("start_ms") - context_ms)
    length = F.col("end_ms") + context_ms - clip_start
    joined = segments.join(bounds, ["case_id", "id"], "left")
    a = F.greatest(F.lit(0), F.least(length, F.col("a")))
    b = F.greatest(a + 1, F.least(length, F.col("b")))
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (b - a >= min_ms) & ((b - a) / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) >= min_share)
    start, end = F.when(good, clip_start + a).otherwise(F.col("start_ms")), F.when(good, clip_start + b).otherwise(F.col("end_ms"))
    return joined.select(*[start.alias(c) if c == "start_ms" else end.alias(c) if c == "end_ms" else F.col(c) for c in segments.columns])


def alignment_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row a segment: how its bounds, duration and review flag moved."""
    joined = before.alias("x").join(after.alias("y"), ["case_id", "id"])
    start, end = F.col("y.start_ms") - F.col("x.start_ms"), F.col("y.end_ms") - F.col("x.end_ms")
    changed = (start != 0) | (end != 0)
    return joined.select("case_id", "id", start.alias("start_delta_ms"), end.alias("end_delta_ms"), (end - start).alias("duration_delta_ms"), changed.alias("changed"), (F.col("x.needs_review") != F.col("y.needs_review")).alias("review_flag_changed"))


def alignment_diagnostics(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """How far bounds moved, by ``keys`` (case by default). Counts within a limit are of boundaries, two a segment."""
    moves = alignment_moves(before, after)
    s, e = F.abs("start_delta_ms"), F.abs("end_delta_ms")
    within = lambda ms: F.sum((s <= ms).cast("long") + (e <= ms).cast("long"))
    n = lambda c: F.sum(F.col(c).cast("long"))
    out = moves.groupBy(*(keys or ("case_id",))).agg(F.count("*").alias("segments"), (F.count("*") * 2).alias("boundary_count"), F.sum(s + e).alias("delta_sum_ms"), F.max(F.greatest(s, e)).alias("max_delta_ms"), within(250).alias("within_250ms"), within(500).alias("within_500ms"), n("changed").alias("changed"), n("review_flag_changed").alias("review_flag_changes"))
    share = lambda c: F.col(c) / F.col("boundary_count")
    return out.withColumn("mean_delta_ms", share("delta_sum_ms")).withColumn("within_250ms_ratio", share("within_250ms")).withColumn("within_500ms_ratio", share("within_500ms"))
