"""Comparison of evaluated candidates: rows with their leading reason of review, labels, older reports' ratios."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons in the order that ties take, and the columns of their ratios and counts.
REASONS = ("text", "channel", "timing", "missing_reference", "extra_candidate")
RATIO = {"text": "text_edit_segment_ratio", "channel": "channel_edit_segment_ratio", "timing": "timing_edit_segment_ratio", "missing_reference": "missing_reference_segment_ratio", "extra_candidate": "extra_candidate_segment_ratio"}


def reason_ranking(ratios: dict[str, str] | None = None) -> Column:
    """Array of (reason, ratio), the largest ratio first, equals in the order of ``REASONS``."""
    names = ratios or RATIO
    held = F.array(*[F.struct((-F.col(names[r]).cast("double")).alias("minus"), F.lit(n).alias("n"), F.lit(r).alias("reason")) for n, r in enumerate(REASONS)])
    return F.transform(F.array_sort(held), lambda x: F.struct(x.reason.alias("reason"), (-x.minus).alias("ratio")))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Rows with the five ratios, and ``reason_ranking, dominant_reason, dominant_ratio`` (null if no ratio is over 0)."""
    out = rows.withColumn("reason_ranking", reason_ranking())
    top = F.element_at("reason_ranking", 1)
    return out.withColumn("dominant_reason", F.when(top.ratio > 0, top.reason)).withColumn("dominant_ratio", F.when(top.ratio > 0, top.ratio))


def backfilled(rows: DataFrame) -> DataFrame:
    """Reports that have counts alone: a missing ratio is its count by references and extras, at least 1."""
    whole = F.greatest(F.lit(1), F.col("reference_segments") + F.col("extra_candidate_segments"))
    for reason in REASONS:
        name = RATIO[reason]
        made = F.col(name.removesuffix("_segment_ratio") + "_segments") / whole
        rows = rows.withColumn(name, F.coalesce(F.col(name), made) if name in rows.columns else made)
    return rows


def labels(paths: Iterable[str]) -> list[str]:
    """A label a report: its file's stem, with ``#2``, ``#3`` and so on where a label is taken."""
    used: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for path in paths:
        stem = PurePosixPath(path).stem
        n = counts.get(stem, 0) + 1
        while (label := stem if n == 1 else f"{stem}#{n}") in used:
            n += 1
        counts[stem] = n
        used.add(label)
        out.append(label)
    return out


def single_candidate(cases: DataFrame, *keys: str) -> DataFrame:
    """``candidate_id`` by ``keys`` where all cases that name one name the same, else null."""
    one = F.when(F.min("candidate_id") == F.max("candidate_id"), F.min("candidate_id"))
    return cases.groupBy(*keys).agg(one.alias("candidate_id"))


def case_set_errors(reports: dict[str, DataFrame]) -> DataFrame:
    """``label, case_id, rule``: cases that some of the reports lack."""
    every = None
    for label, report in reports.items():
        one = report.select("case_id").distinct().withColumn("label", F.lit(label))
        every = one if every is None else every.unionByName(one)
    has = every.groupBy("case_id").agg(F.collect_set("label").alias("has")).where(F.size("has") < len(reports))
    lacking = F.explode(F.array_except(F.array(*map(F.lit, reports)), F.col("has"))).alias("label")
    return has.select(lacking, "case_id", F.lit("the report lacks the case").alias("rule"))
