"""Review effort: items that need an edit, their priority, queues and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import practical
from lumenspan.operators.matching import flat, sides
from lumenspan.operators.ranking import numbered

# Priority of reasons, and the timing threshold.
PRIORITY = {"missing_reference": 5000.0, "extra_candidate": 4000.0, "text": 3000.0, "timing": 2000.0, "channel": 1000.0}
TIMING_MS = 500
ITEM = ["case_id", "reference_id", "candidate_id", "start_ms", "end_ms", "reasons", "reference_text", "candidate_text", "reference_channel", "candidate_channel", "start_delta_ms", "end_delta_ms"]


def score_of(reasons: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(reasons, F.lit(0.0), lambda a, r: a + F.coalesce(F.element_at(table, r), F.lit(0.0)))


def _distance(a: str, b: str) -> Column:
    """Edit distance; of texts of which one stands whole within the other it is the difference of their lengths."""
    within = F.contains(a, b) | F.contains(b, a)
    return F.when(within, F.abs(F.char_length(a) - F.char_length(b))).otherwise(F.levenshtein(a, b))


def compared_sides(ref: DataFrame, cand: DataFrame, normal=practical) -> DataFrame:
    """Rows of :func:`matching.sides`, flattened, with their ``start_delta_ms, end_delta_ms``, whether their
    ``text_differs``, and ``text_distance``.

    ``normal`` is the text form that pairs are compared in, each side once; time ranges are joined once. Nothing but the
    score reads the distance, so what counts or filters by reasons doesn't compute it.
    """
    with_norm = lambda df: df.withColumn("norm", normal(F.col("text")))
    rows = flat(sides(with_norm(ref), with_norm(cand)))
    pair = (F.col("side") == 0) & F.col("met")
    start, end = F.col("cand_start_ms") - F.col("ref_start_ms"), F.col("cand_end_ms") - F.col("ref_end_ms")
    differs = F.coalesce(F.col("ref_norm") != F.col("cand_norm"), F.lit(False))
    return rows.withColumns({"start_delta_ms": F.when(pair, start), "end_delta_ms": F.when(pair, end), "text_differs": pair & differs, "text_distance": F.when(pair & differs, _distance("ref_norm", "cand_norm")).otherwise(F.lit(0)).cast("long")})


def reasoned(rows: DataFrame) -> DataFrame:
    """Rows of :func:`compared_sides` with their ``reasons`` (none: an empty array); channels may have been changed."""
    pair = (F.col("side") == 0) & F.col("met")
    late = (F.abs("start_delta_ms") > TIMING_MS) | (F.abs("end_delta_ms") > TIMING_MS)
    of_pair = F.array_compact(F.array(F.when(F.col("text_differs"), F.lit("text")), F.when(F.col("ref_channel") != F.col("cand_channel"), F.lit("channel")), F.when(late, F.lit("timing"))))
    alone = F.when(~F.col("met"), F.array(F.when(F.col("side") == 0, F.lit("missing_reference")).otherwise(F.lit("extra_candidate")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reasons", F.when(pair, of_pair).otherwise(alone))


def edits(ref: DataFrame, cand: DataFrame, normal=practical) -> DataFrame:
    """Every segment of either side with its best overlap and its reasons for an edit."""
    return reasoned(compared_sides(ref, cand, normal))


def queue_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`edits` that need an edit, as review items with their score."""
    start, end = F.least("ref_start_ms", "cand_start_ms"), F.greatest("ref_end_ms", "cand_end_ms")
    text = lambda c: F.coalesce(c, F.lit("")).alias({"ref_text": "reference_text", "cand_text": "candidate_text"}[c])
    out = rows.where(F.size("reasons") > 0).select("case_id", F.col("ref_id").alias("reference_id"), F.col("cand_id").alias("candidate_id"), start.alias("start_ms"), end.alias("end_ms"), "reasons", text("ref_text"), text("cand_text"), F.col("ref_channel").alias("reference_channel"), F.col("cand_channel").alias("candidate_channel"), "start_delta_ms", "end_delta_ms", "text_distance")
    duration = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    delta = F.greatest(F.abs(F.coalesce("start_delta_ms", F.lit(0))), F.abs(F.coalesce("end_delta_ms", F.lit(0))))
    score = score_of(F.col("reasons"), PRIORITY) + F.least(F.lit(999.0), F.col("text_distance").cast("double")) + F.least(F.lit(999.0), delta / F.lit(10.0)) + F.least(F.lit(99.0), duration / F.lit(1000.0))
    return out.select(*ITEM, duration.alias("duration_ms"), score.alias("priority_score"))


def items(ref: DataFrame, cand: DataFrame, normal=practical) -> DataFrame:
    """A row for each pair with a reason, each missing reference and each extra candidate, with its score."""
    return queue_of(edits(ref, cand, normal))


def ranked(queue: DataFrame) -> DataFrame:
    """``priority_rank`` by score, case, time and ids."""
    order = [F.col("priority_score").desc(), F.col("case_id"), F.coalesce("start_ms", F.lit(0)), F.coalesce("end_ms", F.lit(0)), F.coalesce("reference_id", F.lit("")), F.coalesce("candidate_id", F.lit(""))]
    return numbered(queue, order, "priority_rank")


def rollup(rows: DataFrame) -> DataFrame:
    """Counts and ratios by case of the rows of :func:`edits`; the denominator is references and extras, at least 1."""
    has = lambda r: F.sum(F.array_contains("reasons", r).cast("long"))
    counts = {"reference_segments": F.sum((F.col("side") == 0).cast("long")), "candidate_segments": F.sum((F.col("side") == 1).cast("long"))}
    counts |= {name: has(reason) for name, reason in EDITS.items()} | {"segments_needing_edit": F.sum((F.size("reasons") > 0).cast("long"))}
    return edit_ratios(rows.groupBy("case_id").agg(*[c.alias(n) for n, c in counts.items()]))


#: Counts of segments by the reason that they have.
EDITS = {"text_edit_segments": "text", "channel_edit_segments": "channel", "timing_edit_segments": "timing", "missing_reference_segments": "missing_reference", "extra_candidate_segments": "extra_candidate"}


def edit_ratios(counts: DataFrame) -> DataFrame:
    whole = F.greatest(F.lit(1), F.col("reference_segments") + F.col("extra_candidate_segments"))
    names = {"segments_needing_edit": "segments_needing_edit_ratio"} | {n: n.removesuffix("_segments") + "_segment_ratio" for n in EDITS}
    return counts.withColumns({ratio: F.col(n) / whole for n, ratio in names.items()})


def compared(references: DataFrame, queues: dict[str, DataFrame]) -> DataFrame:
    """``case_id, reference_id, label, passed, reasons``: each reference under each label; no item means passed."""
    failures = labelled(queues).where("reference_id is not null").groupBy("case_id", "reference_id", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    labels = F.explode(F.array(*map(F.lit, queues))).alias("label")  # as many rows a reference as there are labels
    grid = references.select("case_id", F.col("id").alias("reference_id"), labels)
    return grid.join(failures, ["case_id", "reference_id", "label"], "left").select("case_id", "reference_id", "label", F.col("reasons").isNull().alias("passed"), F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), ",").alias("reasons"))


def labelled(queues: dict[str, DataFrame]) -> DataFrame:
    """Items of all queues with their queue's ``label`` and its ``place``."""
    kept = ["case_id", "reference_id", "start_ms", "end_ms", "reasons", "reference_channel"]
    return reduce(DataFrame.unionByName, [q.select(*kept, F.lit(label).alias("label"), F.lit(n).alias("place")) for n, (label, q) in enumerate(queues.items())])


def repeated_references(queues: dict[str, DataFrame]) -> DataFrame:
    """``case_id, label, rule``: a reference may have one item in a queue."""
    held = labelled(queues).where("reference_id is not null").groupBy("case_id", "reference_id", "label").count()
    return held.where("count > 1").select("case_id", "label", F.lit("a reference has several items in a queue").alias("rule"))


def issues(queues: dict[str, DataFrame]) -> DataFrame:
    """References that some queue has an item for, over the labels: ``failed_count, passed_count, failed_labels,
    reason_counts`` (a map), time and channel as the first of the queues has them, and ``rank``: most failures first,
    then most reasons, case, time and id. Null cases are a case; reasons count by label, each once an item."""
    key = ["case_id", "reference_id"]
    items = labelled(queues).where("reference_id is not null")
    # reasons are exploded, with one row for an item without any, so that everything comes from two small aggregations
    each = items.select(*key, "place", "start_ms", "end_ms", "reference_channel", "label", F.explode_outer(F.array_distinct("reasons")).alias("reason"))
    by_reason = each.groupBy(*key, "reason").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"), F.min(F.struct("place", "start_ms", "end_ms", "reference_channel")).alias("top"))
    known = F.filter(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: x.reason.isNotNull())
    held = by_reason.groupBy(*key).agg(F.map_from_entries(known).alias("reason_counts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("failed_labels"), F.min("top").alias("top"))
    failed, length = F.size("failed_labels").cast("long"), F.col("top.end_ms") - F.col("top.start_ms")
    duration = F.when(length.isNotNull(), F.greatest(F.lit(0), length))
    out = held.select(*key, "top.start_ms", "top.end_ms", duration.alias("duration_ms"), "top.reference_channel", failed.alias("failed_count"), (F.lit(len(queues)) - failed).alias("passed_count"), "failed_labels", "reason_counts")
    total = F.aggregate(F.map_values("reason_counts"), F.lit(0).cast("long"), lambda a, n: a + n)
    return numbered(out, [F.col("failed_count").desc(), total.desc(), F.col("case_id"), F.coalesce("start_ms", F.lit(0)), F.col("reference_id")], "rank")


def label_totals(queues: dict[str, DataFrame]) -> DataFrame:
    """By label: references with an item, and how many of its items have each reason; extras count without a reference.
    A label without items has zeros."""
    labels = next(iter(queues.values())).sparkSession.createDataFrame([(x,) for x in queues], "label string")
    has = lambda r: F.sum((F.array_contains("reasons", r) & F.col("reference_id").isNotNull()).cast("long"))
    extras = F.sum(F.col("reference_id").isNull().cast("long"))
    counts = labelled(queues).groupBy("label").agg(F.sum(F.col("reference_id").isNotNull().cast("long")).alias("reference_failures"), *[has(r).alias(r) for r in PRIORITY if r != "extra_candidate"], extras.alias("extra_candidate"))
    return labels.join(counts, "label", "left").na.fill(0)


MERGE_KEY = ["case_id", "reference_id", "candidate_id", "start_ms", "end_ms"]
#: Fields of an item of which a merge keeps the first that isn't empty.
FIRST = ["reference_text", "candidate_text", "reference_channel", "candidate_channel", "start_delta_ms", "end_delta_ms", "duration_ms"]


def merged(*queues: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One queue: items of one key (nulls equal) are one item, with all reasons as first seen, the largest score, and
    of other fields the first value that isn't empty, by queue and then the item's place in it (``item_index``), or its
    rank where the queue has none. With ``names`` of the queues, ``source_reports`` are those that an item came from.

    Items are combined by key and reason first, then by key, before each shuffle, so a key that a large part of all items
    share is no large group. ``other`` fields (a map of JSON values) merge like the rest.
    """
    fields = [c for c in FIRST if all(c in q.columns for q in queues)]
    places = []
    for n, q in enumerate(queues):
        index = F.col("item_index") if "item_index" in q.columns else F.lit(0)
        # without an index the rank is that of the score, and ranks of one key differ by score alone
        at = F.struct(F.lit(n).alias("q"), index.cast("long").alias("i"), (-F.col("priority_score")).alias("r"), "reasons").alias("at")
        places.append(q.select("*", at))
    item = [*MERGE_KEY, "priority_score", *fields, "at"]
    every = reduce(DataFrame.unionByName, [q.select(*item, F.posexplode_outer("reasons").alias("pos", "reason")) for q in places])
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    first = lambda c: F.min(F.when(said(c), F.struct("at", F.col(c).alias("v")))).alias(c)
    counted = F.sum((F.coalesce("pos", F.lit(0)) == 0).cast("long")).alias("n")
    by_reason = every.groupBy(*MERGE_KEY, "reason").agg(F.min(F.struct("at", "pos")).alias("seen"), F.max("priority_score").alias("priority_score"), counted, F.collect_set("at.q").alias("from"), *map(first, fields))
    ordered = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seen", "reason"))), lambda x: x.reason), lambda r: r.isNotNull())
    least = lambda c: F.min(c).getField("v").alias(c)
    out = by_reason.groupBy(*MERGE_KEY).agg(ordered.alias("reasons"), F.max("priority_score").alias("priority_score"), F.sum("n").alias("merged_input_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("from")))).alias("_from"), *map(least, fields))
    if names is not None:
        out = out.withColumn("source_reports", F.transform("_from", lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)))
    if all("other" in q.columns for q in queues):
        out = _with_other(out, reduce(DataFrame.unionByName, [q.select(*MERGE_KEY, "at", F.explode("other").alias("field", "v")) for q in places]))
    return ranked(out.drop("_from"))


def _with_other(merged_items: DataFrame, entries: DataFrame) -> DataFrame:
    """``other``: of each key and field the first JSON value that isn't empty, else the last empty one."""
    empty, seen = F.col("v").isin("null", '""'), F.struct("at", "v")
    by_field = entries.groupBy(*MERGE_KEY, "field").agg(F.coalesce(F.min(F.when(~empty, seen)), F.max(seen)).getField("v").alias("v"))
    maps = by_field.groupBy(*MERGE_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("other"))
    other = maps.select(*[F.col(c).alias(f"_{c}") for c in MERGE_KEY], "other")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MERGE_KEY])
    return merged_items.join(other, same, "left").drop(*[f"_{c}" for c in MERGE_KEY])


def case_summaries(queue: DataFrame) -> DataFrame:
    """By case: items, positive duration, first start, last end, best score and rank. Items without a case are left out."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    return queue.where("case_id is not null").groupBy("case_id").agg(F.count("*").alias("item_count"), F.sum(length).alias("review_duration_ms"), F.min("start_ms").alias("first_start_ms"), F.max("end_ms").alias("last_end_ms"), F.max("priority_score").alias("top_priority_score"), F.min("priority_rank").alias("top_priority_rank"))


def case_reason_counts(queue: DataFrame) -> DataFrame:
    """:func:`case_summaries` with ``reason_counts`` (a map) and ``place``, the order of the cases' best ranks."""
    counts = queue.where("case_id is not null").select("case_id", F.explode("reasons").alias("reason")).groupBy("case_id", "reason").agg(F.count("*").alias("n"))
    maps = counts.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    held = case_summaries(queue).join(maps, "case_id", "left")
    return numbered(held, [F.col("top_priority_rank").asc_nulls_last(), F.col("case_id")], "place")


def reason_counts(queue: DataFrame) -> DataFrame:
    return queue.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def review_clips(queue: DataFrame, durations: DataFrame, context_ms: int = 500) -> DataFrame:
    """Bounds of each item's clip: the item and its context, within the audio (``case_id, duration_ms``)."""
    joined = queue.join(durations.select("case_id", F.col("duration_ms").alias("_audio_ms")), "case_id")
    start, end = F.greatest(F.lit(0), F.col("start_ms") - context_ms), F.least(F.col("_audio_ms"), F.col("end_ms") + context_ms)
    return joined.withColumn("clip_start_ms", start).withColumn("clip_end_ms", end).drop("_audio_ms")
