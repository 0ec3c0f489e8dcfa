"""Sets of review cases: slicing, freezing, attaching candidates, status against the index, and evaluation manifests.

An index is a DataFrame with a row a case: ``case_id, audio, reference`` and, where known, ``candidate, candidate_id,
segments, review_count, reference_type, reference_notes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.operators.gates import UNSPECIFIED
from lumenspan.operators.intervals import freeze
from lumenspan.schemas import assert_valid, segment_id

# Fixed value: endings that a candidate file may have.
ENDINGS = (".master.json", ".json", ".srt")


def optional(rows: DataFrame, column: str, kind: str = "string") -> Column:
    """A column, or nulls where the table lacks it."""
    return F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)


def repeated_cases(index: DataFrame) -> DataFrame:
    return index.groupBy("case_id").count().where("count > 1 or case_id is null or cast(case_id as string) = ''").select("case_id", F.lit("case ids must be unique and not empty").alias("rule"))


def sliced(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """Each planned case (``case_id, source_id, start_ms, end_ms``) cut out of its source's segments: clipped, moved to
    the slice's start, clipped ones flagged, ids anew by time, channel and text. A source may serve many cases."""
    p = plan.select("case_id", F.col("source_id").alias("_source"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    met = segments.withColumnRenamed("case_id", "_source").join(p, "_source").where((F.col("end_ms") > F.col("_from")) & (F.col("start_ms") < F.col("_to")))
    clipped = (F.col("start_ms") < F.col("_from")) | (F.col("end_ms") > F.col("_to"))
    cut = met.select("case_id", (F.greatest("start_ms", "_from") - F.col("_from")).alias("start_ms"), (F.least("end_ms", "_to") - F.col("_from")).alias("end_ms"), "channel", "kind", "text", (F.col("needs_review") | clipped).alias("needs_review"))
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("start_ms", "end_ms", "channel", "text")).cast("long")
    return cut.withColumn("ord", at).select("case_id", "ord", segment_id("ord").alias("id"), "start_ms", "end_ms", "channel", "kind", "text", "needs_review")


def counts(segments: DataFrame) -> DataFrame:
    """By case: segments, flagged ones, flagged time, and the first flagged in document order."""
    flagged = F.col("needs_review")
    length = F.when(flagged, F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    return segments.groupBy("case_id").agg(F.count("*").alias("segments"), F.coalesce(F.sum(flagged.cast("long")), F.lit(0)).alias("review_count"), F.coalesce(F.sum(length), F.lit(0)).alias("review_duration_ms"), F.min_by("id", F.when(flagged, F.col("ord"))).alias("first_review_id"))


def recounted(index: DataFrame, segments: DataFrame) -> DataFrame:
    """The index with ``segments`` and ``review_count`` as the references have them (0 without any)."""
    fresh = counts(segments).select("case_id", "segments", "review_count")
    kept = index.drop("segments", "review_count")
    return kept.join(fresh, "case_id", "left").na.fill(0, ["segments", "review_count"])


def prepared(segments: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and segments of the planned cases."""
    name = F.col("case_id").rlike("/") | F.col("case_id").isin(".", "..")
    assert_valid(repeated_cases(plan), plan.where(name).select("case_id", F.lit("the case id must be a bare file name").alias("rule")), plan.where("start_ms < 0 or end_ms <= start_ms").select("case_id", F.lit("the slice is empty").alias("rule")))
    cut = sliced(segments, plan)
    stem = F.col("case_id")
    index = plan.select("case_id", F.concat(stem, F.lit(".wav")).alias("audio"), F.concat(stem, F.lit(".master.json")).alias("reference"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.coalesce(optional(plan, "reference_type"), F.lit(UNSPECIFIED)).alias("reference_type"), optional(plan, "reference_notes").alias("reference_notes"))
    return recounted(index, cut), cut


def saved_reference(index: DataFrame, segments: DataFrame, replacement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and segments with the replacement's cases in place of their own; cases that the index lacks raise."""
    assert_valid(replacement.select("case_id").distinct().join(index, "case_id", "left_anti").select("case_id", F.lit("the index lacks the case").alias("rule")))
    kept = segments.join(replacement.select("case_id").distinct(), "case_id", "left_anti")
    now = kept.unionByName(replacement.select(*segments.columns))
    return recounted(index, now), now


def frozen(index: DataFrame, segments: DataFrame, reference_type: str | None = None, reference_notes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Index and segments with all references frozen: ids anew by time, no flags; the type and notes given, if any."""
    held = freeze(segments.join(index.select("case_id"), "case_id", "left_semi"))
    out = recounted(index, held)
    for name, value in (("reference_type", reference_type), ("reference_notes", reference_notes)):
        out = out.withColumn(name, F.lit(value) if value is not None else optional(index, name))
    return out, held


def attach_plan(index: DataFrame, listing: DataFrame) -> DataFrame:
    """``case_id, candidate``: the one file of ``listing`` (``path``) that bears the case's name and a known ending.

    Cases with no file, or with several, raise.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ending = "|".join(e.replace(".", r"\.") for e in ENDINGS)
    named = listing.select("path", F.regexp_extract(name, rf"^(.*?)(?:{ending})$", 1).alias("case_id")).where("case_id <> ''")
    met = index.select("case_id").join(named, "case_id", "left").groupBy("case_id").agg(F.count("path").alias("n"), F.min("path").alias("candidate"))
    rule = F.when(F.col("n") == 0, F.lit("no candidate file bears the case's name")).when(F.col("n") > 1, F.lit("several candidate files bear the case's name"))
    assert_valid(repeated_cases(index), met.select("case_id", rule.alias("rule")).where("rule is not null"))
    return met.select("case_id", "candidate")


def attach_errors(index: DataFrame, plan: DataFrame) -> DataFrame:
    """``case_id, rule``: the plan must name exactly the index's cases, each once."""
    a, b = index.select("case_id").distinct(), plan.select("case_id").distinct()
    gone = a.join(b, "case_id", "left_anti").withColumn("rule", F.lit("the plan lacks the case"))
    more = b.join(a, "case_id", "left_anti").withColumn("rule", F.lit("the index lacks the case"))
    return gone.unionByName(more).unionByName(repeated_cases(plan))


def attached(index: DataFrame, plan: DataFrame, candidate_id: str | None = None) -> DataFrame:
    """The index with each case's candidate; a candidate's own id wins over the plan's, and that over the file's stem."""
    assert_valid(attach_errors(index, plan))
    stem = F.regexp_extract(F.element_at(F.split("candidate", "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    chosen = plan.select("case_id", "candidate", F.coalesce(optional(plan, "candidate_id"), F.lit(candidate_id), stem).alias("candidate_id"))
    return index.drop("candidate", "candidate_id").join(chosen, "case_id")


def status(index: DataFrame, files: DataFrame, references: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The index against what there is: counts, and ``issues`` as an array of texts.

    ``files`` (``path``) lists existing files under the index's own paths; ``references`` and ``candidates`` are the
    segments that could be read. Counts of the index that differ from a reference's are issues.
    """
    there = files.select("path").distinct()
    out = index
    for column in ("audio", "reference", "candidate"):
        named = there.select(F.col("path").alias(f"_{column}"))
        out = out.withColumn("_path", optional(index, column)).join(named, F.col("_path") == F.col(f"_{column}"), "left").withColumn(f"{column}_exists", F.when(F.col("_path").isNotNull(), F.col(f"_{column}").isNotNull())).drop("_path", f"_{column}")
    held = counts(references).select("case_id", *[F.col(c).alias(f"reference_{c}") for c in ("segments", "review_count", "review_duration_ms")], "first_review_id")
    out = out.join(held, "case_id", "left").na.fill(0, ["reference_segments", "reference_review_count", "reference_review_duration_ms"])
    if candidates is not None:
        theirs = counts(candidates).select("case_id", *[F.col(c).alias(f"candidate_{c}") for c in ("segments", "review_count", "review_duration_ms")])
        out = out.join(theirs, "case_id", "left")
    gone = [F.when(~F.col(f"{c}_exists"), F.concat(F.lit(f"{c} file is missing: "), optional(out, c))) for c in ("audio", "reference", "candidate")]
    differs = [F.when(F.col("reference_exists") & (optional(out, a, "long") != F.col(b)), F.concat(F.lit("reference has "), F.col(b).cast("string"), F.lit(f" {a}, the index "), optional(out, a))) for a, b in (("segments", "reference_segments"), ("review_count", "reference_review_count"))]
    missing = sum((F.coalesce((~F.col(f"{c}_exists")).cast("int"), F.lit(0)) for c in ("audio", "reference", "candidate")), F.lit(0))
    return out.withColumn("missing_file_count", missing.cast("long")).withColumn("issues", F.array_compact(F.array(*gone, *differs)))


def status_summary(found: DataFrame) -> DataFrame:
    """One row: cases, missing files, cases with issues, flagged segments and time, the next case to review (the first
    with flags by id), and ``ok``."""
    flagged = F.when(F.col("reference_review_count") > 0, F.col("case_id"))
    out = found.agg(F.count("*").alias("case_count"), F.coalesce(F.sum("missing_file_count"), F.lit(0)).alias("missing_file_count"), F.coalesce(F.sum((F.size("issues") > 0).cast("long")), F.lit(0)).alias("case_issue_count"), F.coalesce(F.sum("reference_review_count"), F.lit(0)).alias("reference_review_count"), F.coalesce(F.sum("reference_review_duration_ms"), F.lit(0)).alias("reference_review_duration_ms"), F.min(flagged).alias("next_review_case_id"))
    return out.withColumn("ok", (F.col("missing_file_count") == 0) & (F.col("case_issue_count") == 0))


def eval_manifest(index: DataFrame, found: DataFrame | None = None, reference_type: str | None = None, reference_notes: str | None = None, fail_on_review: bool = False) -> DataFrame:
    """``case_id, reference, candidate, candidate_id, reference_type, reference_notes`` of an index with candidates.

    With a status given, issues raise, and so do flags if ``fail_on_review``. A type or notes given here win over the
    index's; a case without a type is unspecified.
    """
    lacking = index.where(optional(index, "candidate").isNull()).select("case_id", F.lit("the case has no candidate").alias("rule"))
    checks = [repeated_cases(index), lacking]
    if found is not None:
        checks.append(found.where(F.size("issues") > 0).select("case_id", F.element_at("issues", 1).alias("rule")))
        if fail_on_review:
            checks.append(found.where("reference_review_count > 0").select("case_id", F.lit("review flags remain").alias("rule")))
    assert_valid(*checks)
    stem = F.regexp_extract(F.element_at(F.split("candidate", "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    kind = F.coalesce(F.lit(reference_type), optional(index, "reference_type"), F.lit(UNSPECIFIED))
    return index.select("case_id", "reference", "candidate", F.coalesce(optional(index, "candidate_id"), stem).alias("candidate_id"), kind.alias("reference_type"), F.coalesce(F.lit(reference_notes), optional(index, "reference_notes")).alias("reference_notes"))


def alignment_summary(cases: DataFrame) -> DataFrame:
    """All cases of :func:`lumenspan.functions.hooks.alignment_diagnostics` as one row; means weigh by boundaries."""
    sums = ["segments", "boundary_count", "delta_sum_ms", "within_250ms", "within_500ms", "changed", "review_flag_changes"]
    out = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.coalesce(F.max("max_delta_ms"), F.lit(0)).alias("max_delta_ms"))
    share = lambda c: F.when(F.col("boundary_count") > 0, F.col(c) / F.col("boundary_count"))
    return out.withColumn("mean_delta_ms", share("delta_sum_ms")).withColumn("within_250ms_ratio", share("within_250ms")).withColumn("within_500ms_ratio", share("within_500ms"))
