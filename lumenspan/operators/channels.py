"""Side attribution by energy: the decision, its audits, evidence windows, parameter sweeps, speech detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.operators.intervals import indexed, padded, union

# Defaults of the attribution and of review clips.
THRESHOLD_DB, QUIET_DBFS = 8.0, -40.0
CLIP_MS, PROBE_MS, HOP_MS = 5000, 1000, 1000
AUDIT_PRIORITY = {"reference-channel-energy-mismatch": 3500.0, "reference-channel-energy-uncertain": 2500.0}


def quiet(db: Column, limit: Column) -> Column:
    """Whether a side is quiet enough; a null limit asks nothing."""
    return limit.isNull() | (db <= limit)


def decision(left: Column, right: Column, threshold: Column, limit: Column) -> tuple[Column, Column]:
    """The louder side and the reason, or MIX and why not."""
    delta = left - right
    to_left, to_right = (delta >= threshold) & quiet(right, limit), (-delta >= threshold) & quiet(left, limit)
    side = F.when(to_left, F.lit("L")).when(to_right, F.lit("R")).otherwise(F.lit("MIX"))
    reason = F.when(to_left, F.lit("left_dominant")).when(to_right, F.lit("right_dominant")).when(F.abs(delta) < threshold, F.lit("below_threshold")).otherwise(F.lit("quieter_side_active"))
    return side, reason


def attributed(segments: DataFrame, threshold_db: float = THRESHOLD_DB, quiet_dbfs: float | None = QUIET_DBFS) -> DataFrame:
    """Segments with ``left_dbfs, right_dbfs``: spoken MIX segments take the decided side; ``reason`` says what happened."""
    checked([threshold_db], [quiet_dbfs])
    side, reason = decision(F.col("left_dbfs"), F.col("right_dbfs"), F.lit(threshold_db), F.lit(quiet_dbfs).cast("double"))
    spoken, mixed = F.col("kind") == "speech", F.col("channel") == "MIX"
    return segments.withColumn("original_channel", F.col("channel")).withColumn("reason", F.when(~spoken, F.lit("skipped_non_speech")).when(~mixed, F.lit("skipped_existing_channel")).otherwise(reason)).withColumn("channel", F.when(spoken & mixed, side).otherwise(F.col("channel")))


def checked(thresholds: list[float], quiets: list[float | None]) -> None:
    """Settings must be given, and no threshold may be under 0."""
    if not thresholds or not quiets:
        raise ValueError("at least one threshold and one quiet limit are needed")
    if min(thresholds) < 0:
        raise ValueError("a threshold must not be negative")


def reference_audit(segments: DataFrame, threshold_db: float = THRESHOLD_DB, quiet_dbfs: float | None = QUIET_DBFS) -> DataFrame:
    """Spoken L and R segments against the energy: match, mismatch or uncertain."""
    side, reason = decision(F.col("left_dbfs"), F.col("right_dbfs"), F.lit(threshold_db), F.lit(quiet_dbfs).cast("double"))
    out = segments.where("kind = 'speech' and text <> '' and channel in ('L', 'R')").withColumn("energy_channel", side).withColumn("reason", reason)
    status = F.when(F.col("energy_channel") == "MIX", F.lit("uncertain")).when(F.col("energy_channel") == F.col("channel"), F.lit("match")).otherwise(F.lit("mismatch"))
    return out.withColumn("status", status)


def reference_queue(audited: DataFrame) -> DataFrame:
    """Mismatches and uncertain segments; the score is the reason's weight and all seconds."""
    reason = F.concat(F.lit("reference-channel-energy-"), F.col("status"))
    weights = F.create_map(*[F.lit(x) for pair in AUDIT_PRIORITY.items() for x in pair])
    return audited.where("status <> 'match'").withColumn("reasons", F.array(reason)).withColumn("priority_score", F.element_at(weights, reason) + F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0))


def candidate_audit(segments: DataFrame, threshold_db: float = THRESHOLD_DB, quiet_dbfs: float | None = QUIET_DBFS) -> DataFrame:
    """All spoken segments: match, missed_attribution, wrong_side, mix_match or over_attribution."""
    side, reason = decision(F.col("left_dbfs"), F.col("right_dbfs"), F.lit(threshold_db), F.lit(quiet_dbfs).cast("double"))
    out = segments.where("kind = 'speech' and text <> ''").withColumn("energy_channel", side).withColumn("reason", reason)
    e, c = F.col("energy_channel"), F.col("channel")
    status = F.when((e == "MIX") & (c == "MIX"), F.lit("mix_match")).when(e == "MIX", F.lit("over_attribution")).when(e == c, F.lit("match")).when(c == "MIX", F.lit("missed_attribution")).otherwise(F.lit("wrong_side"))
    return out.withColumn("status", status)


def summary(audited: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and the ratios of either audit (null without a denominator)."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    out = audited.groupBy(*keys).agg(F.count("*").alias("segments"), *map(n, ("match", "mismatch", "uncertain", "missed_attribution", "wrong_side", "mix_match", "over_attribution")))
    labelled = F.col("match") + F.col("mismatch") + F.col("missed_attribution") + F.col("wrong_side")
    unsure = F.col("mix_match") + F.col("over_attribution")
    over = lambda a, b: F.when(b > 0, F.col(a) / b)
    return out.withColumn("energy_labeled_count", labelled).withColumn("match_ratio", over("match", labelled)).withColumn("mix_ratio", over("missed_attribution", labelled)).withColumn("wrong_side_ratio", over("wrong_side", labelled)).withColumn("over_attribution_ratio", over("over_attribution", unsure))


def setting_id(threshold_db: float, quiet_dbfs: float | None) -> str:
    """``th8_quietm40``; made here, as Java writes shortest numbers otherwise."""
    safe = lambda x: f"{x:g}".replace("-", "m").replace(".", "p")
    return f"th{safe(threshold_db)}_quiet{'none' if quiet_dbfs is None else safe(quiet_dbfs)}"


def settings(thresholds: list[float], quiets: list[float | None]) -> Column:
    """Each pair of settings as an array of structs ``setting, threshold_db, quiet_dbfs``."""
    checked(thresholds, quiets)
    return F.array(*[F.struct(F.lit(setting_id(t, q)).alias("setting"), F.lit(float(t)).alias("threshold_db"), F.lit(q).cast("double").alias("quiet_dbfs")) for t in thresholds for q in quiets])


def swept(segments: DataFrame, thresholds: list[float], quiets: list[float | None], reset: bool = True, prefix: str = "") -> DataFrame:
    """The attribution under each pair of settings, from energies measured once: a row a segment and setting. Spoken
    segments' channels are reset to MIX first, or with ``reset`` off only MIX ones take a side. Settings are a literal
    list, so no join is needed. ``prefix`` is that of the segment's columns; rows without a segment there keep nulls."""
    col = lambda c: F.col(prefix + c)
    each = segments.withColumn("s", F.explode(settings(thresholds, quiets))).select(*segments.columns, "s.*")
    side, reason = decision(col("left_dbfs"), col("right_dbfs"), F.col("threshold_db"), F.col("quiet_dbfs"))
    spoken, mixed = col("kind") == "speech", F.lit(reset) | (col("channel") == "MIX")
    told = F.when(~spoken, F.lit("skipped_non_speech")).when(~mixed, F.lit("skipped_existing_channel")).otherwise(reason)
    return each.withColumn("reason", told).withColumn("original_channel", F.when(spoken & F.lit(reset), F.lit("MIX")).otherwise(col("channel"))).withColumn(prefix + "channel", F.when(spoken & mixed, side).otherwise(col("channel")))


def diagnostics(attributed_segments: DataFrame, *keys: str) -> DataFrame:
    """How many segments changed side, by ``keys``."""
    changed = F.col("original_channel") != F.col("channel")
    out = attributed_segments.groupBy(*keys).agg(F.count("*").alias("segment_count"), F.sum((F.col("kind") == "speech").cast("long")).alias("speech_segments"), F.sum(((F.col("kind") == "speech") & (F.col("original_channel") == "MIX")).cast("long")).alias("mix_speech_segments"), F.sum(changed.cast("long")).alias("changed_segments"))
    return out.withColumn("changed_segment_ratio", F.when(F.col("segment_count") > 0, F.col("changed_segments") / F.col("segment_count")))


def histograms(attributed_segments: DataFrame, *keys: str) -> DataFrame:
    """``field, value, n``: how often each reason, channel before and channel after occurs."""
    each = [F.struct(F.lit(field).alias("field"), F.coalesce(F.col(column), F.lit("unknown")).alias("value")) for field, column in (("reason", "reason"), ("original_channel", "original_channel"), ("attributed_channel", "channel"))]
    return attributed_segments.select(*keys, F.explode(F.array(*each)).alias("x")).groupBy(*keys, "x.field", "x.value").agg(F.count("*").alias("n"))


def level_of(sum_sq: Column, n: Column) -> Column:
    """dBFS of summed squares over samples, floored at an RMS of 1 (about -90.3)."""
    return F.lit(20.0) * F.log10(F.greatest(F.lit(1.0), F.sqrt(sum_sq / F.greatest(F.lit(1), n))) / F.lit(32767.0))


def probes(segments: DataFrame) -> DataFrame:
    """``case_id, id, start_ms, end_ms``: the 1 s stretches of segments over 5 s, each second, and one that ends with the segment."""
    long = segments.where(F.col("end_ms") - F.col("start_ms") > CLIP_MS)
    starts = F.array_distinct(F.concat(F.sequence(F.col("start_ms"), F.col("end_ms") - PROBE_MS, F.lit(HOP_MS).cast("long")), F.array(F.col("end_ms") - PROBE_MS)))
    return long.select("case_id", "id", F.explode(starts).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + PROBE_MS)


def evidence_clips(segments: DataFrame, sums: DataFrame, quiet_dbfs: float | None = QUIET_DBFS) -> DataFrame:
    """Where to listen: segments over 5 s get the 5 s around their strongest probe, within the segment.

    ``sums``: ``case_id, start_ms, end_ms, left_sq, right_sq, n`` of the ranges of :func:`probes`, of exactly their
    frames. The best evidence for ``energy_channel`` wins, the earliest of equals; a probe without frames counts as silence.
    """
    held = sums.select(F.col("case_id").alias("_case"), F.col("start_ms").alias("probe"), F.col("end_ms").alias("_to"), level_of(F.col("left_sq"), F.col("n")).alias("l"), level_of(F.col("right_sq"), F.col("n")).alias("r"))
    sides = segments.select(F.col("case_id").alias("_c"), F.col("id").alias("_i"), "energy_channel", F.col("start_ms").alias("_s"))
    asked = probes(segments).join(sides, (F.col("case_id") == F.col("_c")) & (F.col("id") == F.col("_i")))
    met = asked.join(held, (F.col("case_id").cast("string") == F.col("_case").cast("string")) & (F.col("start_ms") == F.col("probe")) & (F.col("end_ms") == F.col("_to")))
    limit = F.lit(quiet_dbfs).cast("double")
    bonus = lambda db: F.when(quiet(db, limit), F.lit(100.0)).otherwise(F.lit(0.0))
    delta = F.col("l") - F.col("r")
    score = F.when(F.col("energy_channel") == "L", bonus(F.col("r")) + delta).when(F.col("energy_channel") == "R", bonus(F.col("l")) - delta).otherwise(-F.abs(delta))
    best = met.groupBy("case_id", "id").agg(F.min(F.struct((-score).alias("s"), "probe")).alias("b")).select("case_id", "id", F.floor((F.col("b.probe") * 2 + PROBE_MS) / 2).alias("_mid"))
    clip = F.least(F.greatest(F.col("_mid") - CLIP_MS // 2, F.col("start_ms")), F.col("end_ms") - CLIP_MS)
    whole = F.col("_mid").isNull()
    out = segments.join(best, ["case_id", "id"], "left").withColumn("clip_start_ms", F.when(whole, F.col("start_ms")).otherwise(clip))
    return out.withColumn("clip_end_ms", F.when(whole, F.col("end_ms")).otherwise(F.col("clip_start_ms") + CLIP_MS)).drop("_mid")


def energy_intervals(windows: DataFrame, durations: DataFrame, threshold: float, min_silence_ms: int = 800, min_speech_ms: int = 200, pad_ms: int = 400) -> DataFrame:
    """Speech by energy: ``windows`` (``case_id, start_ms, end_ms, level``) at or over the threshold, gaps up to
    ``min_silence_ms`` closed, short ones dropped, padded within ``durations`` (``case_id, duration_ms``).

    A case in which nothing is left is speech as a whole.
    """
    loud = windows.where(F.col("level") >= threshold).select("case_id", "start_ms", "end_ms")
    held = union(loud, min_silence_ms).where(F.col("end_ms") - F.col("start_ms") >= min_speech_ms)
    cut = padded(held.join(durations, "case_id"), pad_ms, F.col("duration_ms")).select("case_id", "start_ms", "end_ms")
    whole = durations.where("duration_ms > 0").join(cut.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return indexed(cut.unionByName(whole))


def hysteresis(frames: DataFrame, frame_ms: int = 20, threshold: float = 0.5, off: float | None = None, min_speech_ms: int = 250, min_silence_ms: int = 100, pad_ms: int = 30) -> DataFrame:
    """``case_id, at, p`` frame probabilities → intervals: on at the threshold, off after enough frames under ``off``.

    The state machine is window functions: a stretch of frames under ``off``, unbroken by one at the threshold, ends
    speech once it has ``min_silence`` frames under it, counted from its first frame. A case's frames are sorted, never
    gathered in one value.
    """
    low = max(threshold - 0.15, 0.01) if off is None else off
    need_silence, need_speech = max(1, -(-min_silence_ms // frame_ms)), max(1, -(-min_speech_ms // frame_ms))
    order = Window.partitionBy("case_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = frames.withColumn("i", F.row_number().over(order) - 1)
    n = n.withColumn("last_on", F.max(F.when(F.col("p") >= threshold, F.col("i"))).over(upto))
    quiet_frames = n.withColumn("silence", F.min(F.when(F.col("p") < low, F.col("i"))).over(Window.partitionBy("case_id", "last_on").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ended = quiet_frames.withColumn("off", F.col("last_on").isNotNull() & (F.col("p") < low) & (F.col("i") - F.col("silence") + 1 >= need_silence))
    stretch = ended.groupBy("case_id", "last_on").agg(F.min(F.when(F.col("off"), F.col("silence"))).alias("silence"), F.max("i").alias("last")).where("last_on is not null")
    # a stretch is a frame at the threshold and what follows until the next such frame; speech goes on over stretches that don't end it
    over = Window.partitionBy("case_id").orderBy("last_on")
    begins = F.coalesce(F.lag(F.col("silence").isNotNull()).over(over), F.lit(True))
    run = stretch.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = run.groupBy("case_id", "run").agg(F.min("last_on").alias("start"), F.max("silence").alias("silence"), F.max("last").alias("last"))
    found = found.select("case_id", "start", F.coalesce("silence", F.col("last") + 1).alias("end")).where(F.col("end") - F.col("start") >= need_speech)
    durations = frames.groupBy("case_id").agg((F.count("*") * frame_ms).alias("duration_ms"))
    raw = found.select("case_id", (F.col("start") * frame_ms).cast("long").alias("start_ms"), (F.col("end") * frame_ms).cast("long").alias("end_ms"))
    return indexed(union(padded(raw.join(durations, "case_id"), pad_ms, F.col("duration_ms")).select("case_id", "start_ms", "end_ms")))
