"""Review packs: what to listen to, its bounds, names and lengths, and the clips themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import safe_name
from lumenspan.sources import wav

# Fixed value: context on either side of a clip.
CONTEXT_MS = 500
FOCUS = ("review_clip_start_ms", "review_clip_end_ms")


def pack_violations(queue: DataFrame) -> DataFrame:
    """``case_id, rule``: items whose range is empty, or whose focus is half given, empty or outside of the item."""
    a, b = (F.col(c) if c in queue.columns else F.lit(None).cast("long") for c in FOCUS)
    empty = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("start_ms"))
    rule = F.when(empty, F.lit("the item's range is empty")).when(a.isNull() != b.isNull(), F.lit("the focus needs both bounds")).when((a < F.col("start_ms")) | (b > F.col("end_ms")) | (b <= a), F.lit("the focus isn't within the item"))
    return queue.select("case_id", rule.alias("rule")).where("rule is not null")


def clip_name(rank: Column, case_id: Column, reason: Column, reference_id: Column, candidate_id: Column) -> Column:
    parts = [F.format_string("%06d", rank), F.coalesce(F.nullif(case_id, F.lit("")), F.lit("single")), F.coalesce(reason, F.lit("unknown")), F.coalesce(reference_id, F.lit("no-ref")), F.coalesce(candidate_id, F.lit("no-cand"))]
    return F.concat(safe_name(F.array_join(F.array(*parts), "__")), F.lit(".wav"))


def review_pack(queue: DataFrame, durations: DataFrame, context_ms: int = CONTEXT_MS) -> DataFrame:
    """A ranked queue with ``focus_start_ms, focus_end_ms, clip_start_ms, clip_end_ms, clip_file``.

    The focus is the item's review clip if it has one, else the item; the clip is the focus with its context, within
    the audio (``case_id, duration_ms``). Items of cases without audio keep null clips; :func:`missing_audio` lists them.
    """
    a, b = (F.col(c) if c in queue.columns else F.lit(None).cast("long") for c in FOCUS)
    joined = queue.join(durations.select("case_id", F.col("duration_ms").alias("_audio_ms")), "case_id", "left")
    focused = joined.withColumn("has_focus", a.isNotNull() | b.isNotNull()).withColumn("focus_start_ms", F.coalesce(a, F.col("start_ms"))).withColumn("focus_end_ms", F.coalesce(b, F.col("end_ms")))
    known = F.col("_audio_ms").isNotNull()
    start = F.when(known, F.greatest(F.lit(0), F.col("focus_start_ms") - context_ms)).cast("long")
    end = F.when(known, F.least(F.col("_audio_ms"), F.col("focus_end_ms") + context_ms)).cast("long")
    name = clip_name(F.col("priority_rank"), F.col("case_id").cast("string"), F.try_element_at("reasons", F.lit(1)), F.col("reference_id"), F.col("candidate_id"))
    return focused.withColumn("clip_start_ms", start).withColumn("clip_end_ms", end).withColumn("clip_file", name).drop("_audio_ms")


def missing_audio(pack: DataFrame) -> DataFrame:
    return pack.where("clip_start_ms is null").select("case_id").distinct().withColumn("rule", F.lit("the case has no audio"))


def duration_summary(pack: DataFrame, *keys: str) -> DataFrame:
    """Sums of items, focuses and clips, the longest clip, and how many items have a focus; zeros for an empty pack."""
    clip = F.col("clip_end_ms") - F.col("clip_start_ms")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pack.groupBy(*keys).agg(F.count("*").alias("clip_count"), total(F.col("end_ms") - F.col("start_ms")).alias("source_item_duration_ms_sum"), total(F.col("focus_end_ms") - F.col("focus_start_ms")).alias("effective_item_duration_ms_sum"), total(clip).alias("clip_duration_ms_sum"), F.coalesce(F.max(clip), F.lit(0)).alias("clip_duration_ms_max"), total(F.col("has_focus").cast("long")).alias("focus_item_count"))


def flagged_queue(segments: DataFrame, case_order: DataFrame | None = None) -> DataFrame:
    """Flagged segments as review items: the score is the duration, the rank the order of cases and segments.

    ``case_order`` (``case_id, place``) orders cases, else their ids do. Ranks are counts of cases before and a number
    within the case, so no task holds all items.
    """
    place = case_order.select("case_id", F.col("place").alias("_place")) if case_order is not None else segments.select("case_id").distinct().withColumn("_place", F.col("case_id"))
    held = segments.where("needs_review").join(place, "case_id")
    counts = held.groupBy("case_id", "_place").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_place", "case_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    ranked = held.drop("_place").withColumn("_number", number).join(counts.select("case_id", before.alias("_before")), "case_id")
    none = F.lit(None).cast("string")
    return ranked.select("case_id", F.col("id").alias("reference_id"), none.alias("candidate_id"), "start_ms", "end_ms", F.array(F.lit("reference-needs-review")).alias("reasons"), F.col("text").alias("reference_text"), F.lit("").alias("candidate_text"), F.col("channel").alias("reference_channel"), none.alias("candidate_channel"), (F.col("end_ms") - F.col("start_ms")).cast("double").alias("priority_score"), (F.col("_before") + F.col("_number")).alias("priority_rank"))


def neighbours(segments: DataFrame) -> DataFrame:
    """``case_id, id, previous_review_id, next_review_id``: the flagged segments around each, going round the document;
    a segment is never its own neighbour."""
    by = Window.partitionBy("case_id").orderBy("ord")
    flagged = F.when(F.col("needs_review"), F.col("id"))
    after, before = by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda w: F.first(flagged, ignorenulls=True).over(w)
    last = lambda w: F.last(flagged, ignorenulls=True).over(w)
    return segments.select("case_id", "ord", "id", F.coalesce(last(before), last(after)).alias("previous_review_id"), F.coalesce(first(after), first(before)).alias("next_review_id"))


def clock(ms: Column) -> Column:
    """``m:ss.mmm``."""
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)


def clips(pack: DataFrame, audio: DataFrame) -> DataFrame:
    """``clip_file, content``: the clips of a pack, each audio file (``case_id, content``) decoded once.

    The bounds of a case travel to its audio; a clip whose range holds no audio raises.
    """
    bounds = F.array_sort(F.collect_list(F.struct("clip_file", "clip_start_ms", "clip_end_ms")))
    wanted = pack.where("clip_start_ms is not null").groupBy("case_id").agg(bounds.alias("clips"))
    joined = audio.select("case_id", "content").join(wanted, "case_id").select("content", "clips")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wants in zip(batch.column("content"), batch.column("clips"), strict=True):
                source = content.as_py()
                for c in wants.as_py():
                    cut = wav.cut(source, c["clip_start_ms"], c["clip_end_ms"])
                    yield pa.RecordBatch.from_arrays([pa.array([c["clip_file"]]), pa.array([cut], pa.binary())], ["clip_file", "content"])

    return joined.mapInArrow(run, "clip_file string, content binary")
