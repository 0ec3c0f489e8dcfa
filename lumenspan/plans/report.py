"""Evaluation reports: every metric family of candidates against references, by case and over a suite.

All metrics are ratios of counts and sums that add up over cases. :func:`measured` gathers those sums in one plan, two
aggregations by case: one over segments and their best overlaps, from one overlap join, and one over both sides'
documents, texts in every form at once. Reports by case, of the suite and by setting take their ratios from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import text as T
from lumenspan.operators import channels, comparison, effort, evaluate, gates, matching

MODES = {"strict": T.strict, "practical": T.practical, "relaxed": T.relaxed}
ARTIFACTS = ("artifact", "non_japanese_text", "high_text_density", "repeated_text")


def _count(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("long"))


def _pair_terms(rs: Column, re: Column, cs: Column, ce: Column, rc: Column, cc: Column) -> dict[str, Column]:
    """What one pair of segments adds to each sum."""
    start, end = F.abs(rs - cs), F.abs(re - ce)
    sides = rc.isin("L", "R") & cc.isin("L", "R")
    near = lambda ms: (start <= ms).cast("long") + (end <= ms).cast("long")
    return {"paired_segments": F.lit(1).cast("long"), "start_error": start, "end_error": end, "max_boundary_error_ms": F.greatest(start, end), "within_250ms_count": near(250), "within_500ms_count": near(500), "comparable_segments": sides.cast("long"), "correct": (sides & (rc == cc)).cast("long"), "candidate_mix_segments": (cc == "MIX").cast("long")}


def segment_sums(edits: DataFrame, *keys: str) -> DataFrame:
    """Sums over the rows of :func:`effort.edits`: segments, reasons, and best overlaps."""
    has = {n: _count(F.array_contains("reasons", r)) for n, r in effort.EDITS.items()}
    pair = (F.col("side") == 0) & F.col("met")
    terms = _pair_terms(*[F.col(f"{s}_{c}") for s, c in (("ref", "start_ms"), ("ref", "end_ms"), ("cand", "start_ms"), ("cand", "end_ms"), ("ref", "channel"), ("cand", "channel"))])
    aligned = {f"aligned_{n}": (F.max if n.startswith("max") else F.sum)(F.when(pair, t)) for n, t in terms.items()}
    sums = {"reference_segments": _count(F.col("side") == 0), "candidate_segments": _count(F.col("side") == 1), **has, "segments_needing_edit": _count(F.size("reasons") > 0), **aligned}
    return edits.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def document_sums(ref: DataFrame, cand: DataFrame, normal) -> DataFrame:
    """Sums over whole documents by case: edit distances and lengths in each text form, pairs by position, artifacts, flags.

    Both sides' segments meet in one shuffle; a case's spoken segments are one value a side, as its texts are.
    """
    columns = ["case_id", "ord", "start_ms", "end_ms", "channel", "kind", "text", "needs_review"]
    both = ref.select(*columns, F.lit(0).alias("side")).unionByName(cand.select(*columns, F.lit(1).alias("side")))
    both = both.withColumns({f"_{m}": f(F.col("text")) for m, f in MODES.items()})
    both = both.withColumn("_normal", normal(F.col("text")) if normal not in MODES.values() else F.col(next(f"_{m}" for m, f in MODES.items() if f is normal)))
    spoken = (F.col("kind") == "speech") & (F.col("text") != "")
    of_cand, chars, length = (F.col("side") == 1) & spoken, F.char_length("_normal"), F.col("end_ms") - F.col("start_ms")
    flags = {"non_japanese_text": T.not_japanese(F.col("_normal")), "high_text_density": T.dense(chars, length), "repeated_text": T.repeated(F.col("_normal"))}
    flags = {"artifact": reduce(Column.__or__, flags.values()), **flags}
    held = lambda side: F.array_sort(F.collect_list(F.when((F.col("side") == side) & spoken, F.struct("ord", "start_ms", "end_ms", "channel", *[f"_{m}" for m in MODES]))))
    by_case = both.groupBy("case_id").agg(
        held(0).alias("r"), held(1).alias("c"), *[_count(of_cand & test).alias(f"asr_{n}_segments") for n, test in flags.items()],
        _count((F.col("side") == 1) & F.col("needs_review")).alias("candidate_review_count"), _count(F.col("side") == 1).alias("candidate_rows"),
    )
    whole = lambda side, m: F.array_join(F.transform(side, lambda x: x[f"_{m}"]), "")
    n = F.least(F.size("r"), F.size("c"))
    zipped = F.zip_with(F.slice("r", F.lit(1), n), F.slice("c", F.lit(1), n), lambda a, b: F.struct(*[t.alias(k) for k, t in _pair_terms(a.start_ms, a.end_ms, b.start_ms, b.end_ms, a.channel, b.channel).items()]))
    rest = [c for c in by_case.columns if c not in ("r", "c")]
    texts = by_case.select(*rest, zipped.alias("z"), *[whole(side, m).alias(f"{side}_{m}") for m in MODES for side in "rc"])
    add = lambda k: F.aggregate("z", F.lit(0).cast("long"), lambda s, x: s + x[k])
    places = [F.array_max(F.transform("z", lambda x: x[k])).alias(f"positional_{k}") if k.startswith("max") else add(k).alias(f"positional_{k}") for k in _pair_terms(*[F.lit(0)] * 4, F.lit(""), F.lit(""))]
    modes = [c for m in MODES for c in (T.long_distance(f"r_{m}", f"c_{m}").alias(f"{m}_edit_distance"), F.char_length(f"r_{m}").cast("long").alias(f"{m}_reference_characters"), F.char_length(f"c_{m}").cast("long").alias(f"{m}_candidate_characters"))]
    return texts.select(*rest, *places, *modes)


def measured(ref: DataFrame, cand: DataFrame, normal=T.practical) -> DataFrame:
    """A row of sums for each case of either side."""
    segments = segment_sums(effort.edits(matching.speech(ref), matching.speech(cand), normal), "case_id")
    return document_sums(ref, cand, normal).join(segments, "case_id", "left")


def summed(sums: DataFrame, *keys: str) -> DataFrame:
    """Rows of :func:`measured` added up by ``keys`` (none: in all), with ``case_count``."""
    names = [c for c in sums.columns if c not in ("case_id", *keys)]
    add = [(F.max(c) if "_max_" in c else F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in names]
    return sums.groupBy(*keys).agg(F.count("*").alias("case_count"), *add)


def rated(sums: DataFrame, keys: tuple[str, ...], review_over: str, paired: tuple[str, ...] = ("aligned", "positional")) -> DataFrame:
    """The ratios of sums, null where there is no denominator; ``review_over`` names what flagged segments are a share
    of, ``paired`` the kinds of pairs that the sums have."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.col(k) for k in keys]
    for m in MODES:
        counts = [zero(f"{m}_{c}") for c in ("edit_distance", "reference_characters", "candidate_characters")]
        out += [*[x.alias(f"{m}_{c}") for x, c in zip(counts, ("edit_distance", "reference_characters", "candidate_characters"), strict=True)], T.error_rate(*counts).alias(f"{m}_cer")]
    for p in paired:
        n, start, end = zero(f"{p}_paired_segments"), F.col(f"{p}_start_error"), F.col(f"{p}_end_error")
        out += [n.alias(f"{p}_paired_segments"), evaluate.ratio(start, n).alias(f"{p}_mean_start_error_ms"), evaluate.ratio(end, n).alias(f"{p}_mean_end_error_ms"), evaluate.ratio(start + end, 2 * n).alias(f"{p}_mean_boundary_error_ms"), F.col(f"{p}_max_boundary_error_ms")]
        out += [c for ms in (250, 500) for c in (zero(f"{p}_within_{ms}ms_count").alias(f"{p}_within_{ms}ms_count"), evaluate.ratio(F.col(f"{p}_within_{ms}ms_count"), 2 * n).alias(f"{p}_within_{ms}ms_ratio"))]
        sided, mixed = zero(f"{p}_comparable_segments"), zero(f"{p}_candidate_mix_segments")
        out += [sided.alias(f"{p}_channel_comparable_segments"), evaluate.ratio(F.col(f"{p}_correct"), sided).alias(f"{p}_channel_accuracy"), mixed.alias(f"{p}_channel_candidate_mix_segments"), (mixed / F.greatest(F.lit(1), n)).alias(f"{p}_channel_candidate_mix_ratio")]
    counts = ["reference_segments", "candidate_segments", *effort.EDITS, "segments_needing_edit"]
    out += [zero(c).alias(c) for c in counts]
    for a in ARTIFACTS:
        out += [zero(f"asr_{a}_segments").alias(f"asr_{a}_segments"), (zero(f"asr_{a}_segments") / F.greatest(F.lit(1), zero("candidate_segments"))).alias(f"asr_{a}_segment_ratio")]
    out += [zero("candidate_review_count").alias("candidate_review_count"), (zero("candidate_review_count") / F.greatest(F.lit(1), zero(review_over))).alias("candidate_review_ratio")]
    rows = effort.edit_ratios(sums.select(*out))
    return comparison.with_reasons(rows.withColumn("reference_match_ratio", evaluate.ratio(F.col("aligned_paired_segments"), F.col("reference_segments"))))


def evaluated(ref: DataFrame, cand: DataFrame, normal=T.practical) -> DataFrame:
    """A wide row a case: error rates of three text forms, timing and channels of pairs by overlap and by position,
    review effort with its leading reason, artifacts, and the share of flagged candidate segments (of all of them).

    A case that one side lacks is kept; means and shares of pairs that aren't there are null.
    """
    return rated(measured(ref, cand, normal), ("case_id",), "candidate_rows")


def suite(ref: DataFrame, cand: DataFrame, normal=T.practical) -> DataFrame:
    """The same over all cases, as one row: texts by characters, timing by pairs, effort by segments.

    Flagged segments count by spoken candidate segments here.
    """
    return rated(summed(measured(ref, cand, normal)), ("case_count",), "candidate_segments")


def both(ref: DataFrame, cand: DataFrame, normal=T.practical) -> DataFrame:
    """Reports by case and of the suite (null ``case_id``, ``is_suite``) from one plan, by grouping sets over the sums."""
    sums = measured(ref, cand, normal)
    names = [c for c in sums.columns if c != "case_id"]
    add = [(F.max(c) if "_max_" in c else F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in names]
    total = F.grouping("case_id") == 1
    rows = sums.groupingSets([[F.col("case_id")], []], F.col("case_id")).agg(total.alias("is_suite"), F.count("*").alias("case_count"), *add)
    rows = rows.withColumn("_reviewable", F.when(F.col("is_suite"), F.col("candidate_segments")).otherwise(F.col("candidate_rows")))
    return rated(rows, ("case_id", "is_suite", "case_count"), "_reviewable")


#: Metrics under the names that gates and comparisons read.
GATED = {"practical_cer": "practical_cer", "time_aligned_500ms_ratio": "aligned_within_500ms_ratio", "channel_accuracy": "aligned_channel_accuracy", "mix_ratio": "aligned_channel_candidate_mix_ratio", "edit_ratio": "segments_needing_edit_ratio", "review_ratio": "candidate_review_ratio"}


def gated(reports: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Reports with ``gate_failures`` and ``gate_passed`` under the limits given."""
    named = reports.select("*", *[F.col(column).alias(name) for name, column in GATED.items() if name not in reports.columns])
    return gates.annotated(named, evaluate.gate_failures(limits))


def ranked(rows: DataFrame) -> DataFrame:
    """Labelled suites with their rank; a row a suite, so they are sorted in one task."""
    return evaluate.ranked(rows.select("*", *[F.col(column).alias(name) for name, column in GATED.items() if name not in rows.columns]))


def compared(suites: dict[str, DataFrame]) -> DataFrame:
    """Suites by label as ranked rows."""
    return ranked(reduce(DataFrame.unionByName, [s.withColumn("label", F.lit(label)) for label, s in suites.items()]))


def channel_sweep(ref: DataFrame, cand: DataFrame, thresholds: list[float], quiets: list[float | None], reset: bool = False, normal=T.practical) -> DataFrame:
    """Candidates (with ``left_dbfs, right_dbfs``) attributed and evaluated under each pair of settings: a ranked suite
    row a setting, with how many segments changed side.

    Settings are a key from the attribution on. Times and texts are compared once, before the settings multiply the rows,
    and only what depends on channels is summed by setting; audio was measured once before. With ``reset`` all spoken
    segments are MIX first. Pairs by position aren't part of it.
    """
    keys = ["setting", "threshold_db", "quiet_dbfs"]
    pairs = effort.compared_sides(matching.speech(ref), matching.speech(cand), normal)
    sums = segment_sums(effort.reasoned(channels.swept(pairs, thresholds, quiets, reset, "cand_")), "case_id", *keys).drop("threshold_db", "quiet_dbfs")
    documents = document_sums(ref, cand, normal)
    documents = documents.drop(*[c for c in documents.columns if c.startswith("positional_")])
    each = documents.withColumn("s", F.explode(channels.settings(thresholds, quiets))).select("s.*", *documents.columns)
    suites = rated(summed(each.join(sums, ["case_id", "setting"], "left"), *keys), (*keys, "case_count"), "candidate_segments", ("aligned",))
    moved = channels.diagnostics(channels.swept(cand, thresholds, quiets, reset), "setting")
    moved = moved.select("setting", F.col("segment_count").alias("total_segments"), "changed_segments")
    return ranked(suites.join(moved, "setting").withColumn("label", F.col("setting")))
