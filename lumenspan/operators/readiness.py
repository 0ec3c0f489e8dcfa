"""Pipeline readiness: five stages with reasons, and the stage to work on next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages in order.
STAGES = ("reference", "vad_chunking", "alignment", "channel_attribution", "text_asr")


def next_stage(found: DataFrame) -> DataFrame:
    """The first failing stage, else the first unknown one; no row if all pass."""
    rank = F.when(F.col("status") == "fail", F.lit(0)).otherwise(F.lit(1))
    return found.where("status <> 'pass'").agg(F.min_by("stage", F.struct(rank, "place")).alias("next_stage")).where("next_stage is not null")


def _found(name: str, row: DataFrame, reasons: list[Column], warnings: list[Column] = ()) -> DataFrame:
    """A stage's row from its report's one row; no row in the report: unknown."""
    text = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    held = row.limit(1).select(text(reasons).alias("reasons"), text(list(warnings)).alias("warnings"), F.lit(True).alias("given"))
    one = row.sparkSession.range(1).select(F.lit(name).alias("stage"), F.lit(STAGES.index(name)).alias("place"))
    out = one.join(held, F.lit(True), "left")  # one row each
    status = F.when(F.col("given").isNull(), F.lit("unknown")).when(F.size("reasons") > 0, F.lit("fail")).otherwise(F.lit("pass"))
    empty = F.array().cast("array<string>")
    return out.select("stage", "place", status.alias("status"), F.coalesce("reasons", empty).alias("reasons"), F.coalesce("warnings", empty).alias("warnings"))


def _best(rows: DataFrame) -> DataFrame:
    """The first of ranked reports."""
    return rows.agg(F.min_by(F.struct(*rows.columns), "rank").alias("x")).where("x is not null").select("x.*")


def _over(column: str, text: str) -> Column:
    return F.when(F.col(column) > 0, F.concat(F.lit(f"{text}: "), F.col(column).cast("string")))


def reference_stage(audit: DataFrame, channel_audit: DataFrame | None = None, required_type: str | None = None) -> DataFrame:
    """From a suite's audit (one row; ``reference_type`` and ``near_full_coverage_cases`` where known) and, if given, the
    summary of its channel audit."""
    row = audit
    reasons = [_over("review_count", "review flags remain"), _over("same_channel_overlap_pair_count", "same-channel overlaps remain"), _over("exact_boundary_same_channel_overlap_pair_count", "exact-boundary overlaps remain"), _over("long_segment_count", "long segments remain")]
    if required_type is not None:
        kind = F.col("reference_type") if "reference_type" in row.columns else F.lit(None).cast("string")
        reasons.append(F.when(kind.isNull(), F.lit("the reference type is unavailable")).when(kind != required_type, F.concat(F.lit("the reference type is "), kind)))
    if channel_audit is not None:
        row = row.crossJoin(channel_audit.select(F.col("mismatch").alias("_mismatch"), F.col("uncertain").alias("_uncertain")).limit(1))  # one row each
        reasons += [_over("_mismatch", "channels conflict with the energy"), _over("_uncertain", "channels have uncertain energy")]
    warnings = [_over("near_full_coverage_cases", "cases that are speech nearly throughout")] if "near_full_coverage_cases" in row.columns else []
    return _found("reference", row, reasons, warnings)


def coverage_stage(ranked: DataFrame) -> DataFrame:
    """From ranked coverage suites: the first that passes its gate, else the first; without a gate nothing may be missed."""
    if "gate_passed" not in ranked.columns:
        return _found("vad_chunking", _best(ranked), [_over("missed_reference_duration_ms", "reference speech is missed (ms)")])
    order = F.struct(~F.col("gate_passed"), F.col("rank"))
    chosen = ranked.agg(F.min_by(F.struct(*ranked.columns), order).alias("x")).where("x is not null").select("x.*")
    failed = ~F.col("gate_passed")
    return _found("vad_chunking", chosen, [F.when(failed, F.lit("no candidate passes the coverage gate")), F.when(failed, F.array_join("gate_failures", "; "))])


def _limit(limits: dict[str, float], name: str, column: str) -> list[Column]:
    if name not in limits:
        return []
    value, bound = F.col(column), F.lit(float(limits[name]))
    bad = value > bound if name.startswith("max") else value < bound
    return [F.when(value.isNull(), F.lit(f"{column} is unavailable")).when(bad, F.lit(f"{column} fails {name}"))]


def alignment_stage(ranked: DataFrame, limits: dict[str, float]) -> DataFrame:
    gated = _limit(limits, "min_500ms_ratio", "time_aligned_500ms_ratio")
    return _found("alignment", _best(ranked), gated or [_over("timing_edit_segment_ratio", "timing edits remain")])


def channel_stage(ranked: DataFrame, limits: dict[str, float]) -> DataFrame:
    gated = _limit(limits, "min_channel_accuracy", "channel_accuracy") + _limit(limits, "max_mix_ratio", "mix_ratio")
    return _found("channel_attribution", _best(ranked), gated or [_over("channel_edit_segment_ratio", "channel edits remain")])


def energy_stage(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Channels judged by the summary of a candidate audit against the energy, which stands in for reviewed labels."""
    none = F.when(F.col("energy_labeled_count") == 0, F.lit("no segment has a side by its energy"))
    gated = _limit(limits, "min_channel_accuracy", "match_ratio") + _limit(limits, "max_mix_ratio", "mix_ratio")
    whole = F.when(F.col("match_ratio").isNull() | (F.col("match_ratio") < 1) | (F.coalesce("mix_ratio", F.lit(0.0)) > 0), F.lit("channels differ from the energy"))
    return _found("channel_attribution", summary, [none, *(gated or [whole])], [F.lit("channels are judged by energy, not by reviewed labels")])


def text_stage(ranked: DataFrame, limits: dict[str, float]) -> DataFrame:
    gated = _limit(limits, "max_practical_cer", "practical_cer") + _limit(limits, "max_edit_ratio", "edit_ratio") + _limit(limits, "max_review_ratio", "review_ratio")
    return _found("text_asr", _best(ranked), gated or [_over("text_edit_segment_ratio", "text edits remain"), _over("edit_ratio", "segments that need an edit remain")])


def assembled(spark, audit: DataFrame | None = None, channel_audit: DataFrame | None = None, coverage: DataFrame | None = None, evals: DataFrame | None = None, alignment: DataFrame | None = None, channels: DataFrame | None = None, candidate_audit: DataFrame | None = None, limits: dict[str, float] | None = None, required_type: str | None = None) -> DataFrame:
    """All five stages from the reports that there are. A comparison of its own for alignment or channels stands before
    the general one, and a candidate audit before either for channels."""
    limits, nothing = limits or {}, spark.createDataFrame([], "rank int")
    unknown = lambda name: _found(name, nothing, [])
    aligned, sided = alignment if alignment is not None else evals, channels if channels is not None else evals
    rows = [
        unknown("reference") if audit is None else reference_stage(audit, channel_audit, required_type),
        unknown("vad_chunking") if coverage is None else coverage_stage(coverage),
        unknown("alignment") if aligned is None else alignment_stage(aligned, limits),
        energy_stage(candidate_audit, limits) if candidate_audit is not None else unknown("channel_attribution") if sided is None else channel_stage(sided, limits),
        unknown("text_asr") if evals is None else text_stage(evals, limits),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary(found: DataFrame) -> DataFrame:
    """One row: whether all stages before the text pass, whether all do, the next stage, and those that fail or are unknown."""
    before = F.col("stage") != "text_asr"
    names = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", "stage")))), lambda x: x.stage)
    rank = F.when(F.col("status") == "fail", F.lit(0)).otherwise(F.lit(1))
    following = F.min_by(F.col("stage"), F.when(F.col("status") != "pass", F.struct(rank, F.col("place"))))
    ready = F.min(F.when(before, F.col("status") == "pass"))
    return found.agg(ready.alias("asr_only_ready"), F.min(F.col("status") == "pass").alias("production_ready"), following.alias("next_stage"), names(F.col("status") == "fail").alias("blocking_stages"), names(F.col("status") == "unknown").alias("unknown_stages"))
