"""Gates: limits, failures as text, and enforcement. Reports are written before a gate raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.evaluate import PRODUCT_GATE

# The reference type of the product gate, and that of cases without one.
PRODUCT_REFERENCE, UNSPECIFIED = "human-reviewed", "unspecified"


class GateError(ValueError):
    """A gate that didn't hold."""


def thresholds(product: bool = False, **explicit: float | None) -> dict[str, float]:
    """Limits in force: explicit ones over the product gate's; ratios must lie within 0 and 1."""
    unknown = explicit.keys() - PRODUCT_GATE.keys()
    if unknown:
        raise ValueError(f"unknown limits: {', '.join(sorted(unknown))}")
    chosen = dict(PRODUCT_GATE) if product else {}
    chosen |= {k: v for k, v in explicit.items() if v is not None}
    for name, value in chosen.items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must lie within 0 and 1")
    return {k: chosen[k] for k in PRODUCT_GATE if k in chosen}


def limited(value: Column, name: str, most: float | None = None, least: float | None = None, missing_fails: bool = True) -> list[Column]:
    """Failure texts of one metric (null: none)."""
    out = []
    if most is not None or least is not None:
        if missing_fails:
            out.append(F.when(value.isNull(), F.lit(f"{name} is unavailable")))
        if most is not None:
            out.append(F.when(value > most, F.lit(f"{name} is over {most:g}")))
        if least is not None:
            out.append(F.when(value < least, F.lit(f"{name} is under {least:g}")))
    return out


def coverage_gate(suites: DataFrame, max_interval_ms: int | None = None, max_missed_ms: int | None = None, min_recall: float | None = None, min_precision: float | None = None) -> DataFrame:
    """Coverage rows with ``gate_failures`` and ``gate_passed``; no limit given: neither column is added.

    A missing longest interval doesn't fail; missing ratios do.
    """
    if max_interval_ms is not None and max_interval_ms <= 0:
        raise ValueError("max_interval_ms must be positive")
    if max_missed_ms is not None and max_missed_ms < 0:
        raise ValueError("max_missed_ms must not be negative")
    for name, value in (("min_recall", min_recall), ("min_precision", min_precision)):
        if value is not None and not 0 <= value <= 1:
            raise ValueError(f"{name} must lie within 0 and 1")
    tests = [
        *limited(F.col("detected_max_interval_ms"), "detected_max_interval_ms", most=max_interval_ms, missing_fails=False),
        *limited(F.col("missed_reference_duration_ms"), "missed_reference_duration_ms", most=max_missed_ms),
        *limited(F.col("reference_recall"), "reference_recall", least=min_recall),
        *limited(F.col("detected_precision"), "detected_precision", least=min_precision),
    ]
    return annotated(suites, F.array_compact(F.array(*tests))) if tests else suites


def annotated(rows: DataFrame, failures: Column) -> DataFrame:
    return rows.withColumn("gate_failures", failures).withColumn("gate_passed", F.size("gate_failures") == 0)


def reference_type_failures(cases: DataFrame, required: str = PRODUCT_REFERENCE) -> DataFrame:
    """``case_id, reference_type`` of cases with another type; none counts as unspecified."""
    kind = F.coalesce(F.nullif("reference_type", F.lit("")), F.lit(UNSPECIFIED))
    return cases.select("case_id", kind.alias("reference_type")).where(F.col("reference_type") != required)


def with_reference_types(rows: DataFrame, cases: DataFrame, required: str, by_case: bool) -> DataFrame:
    """Reports whose cases have another reference type fail too: a report by case by its own, a suite by how many and
    which is the first, so that what is told doesn't grow with the cases."""
    text = F.concat(F.lit("case "), "case_id", F.lit(" has reference type "), "reference_type")
    other = reference_type_failures(cases, required).select("case_id", text.alias("_text"))
    known = F.col("gate_failures") if "gate_failures" in rows.columns else F.array().cast("array<string>")
    if by_case:
        joined = rows.join(other, "case_id", "left")
        more = F.when(F.col("_text").isNull(), F.array().cast("array<string>")).otherwise(F.array("_text"))
        return annotated(joined, F.concat(known, more)).drop("_text")
    counted = other.agg(F.count("*").alias("_n"), F.min("_text").alias("_text"))
    more = F.when(F.col("_n") == 0, F.array().cast("array<string>")).when(F.col("_n") == 1, F.array("_text")).otherwise(F.array(F.concat(F.col("_text"), F.lit(", and "), F.col("_n") - 1, F.lit(" more have another than "), F.lit(required))))
    return annotated(rows.crossJoin(counted), F.concat(known, more)).drop("_n", "_text")  # one row each


def enforce(rows: DataFrame, label: str = "label", shown: int = 20) -> None:
    """Raise if a row of an annotated report failed; the message names the count and the first ``shown`` rows."""
    if "gate_passed" not in rows.columns:
        raise ValueError("no limit was given, so nothing can be enforced")
    failed = rows.where("not gate_passed")
    first = failed.select(F.col(label).cast("string"), F.array_join("gate_failures", "; ")).orderBy(label).limit(shown).collect()
    if first:
        raise GateError(f"the gate failed for {failed.count()} rows: " + " | ".join(f"{a}: {b}" for a, b in first))


def enforce_empty(queue: DataFrame, name: str) -> None:
    """Raise if a queue has items; the message counts their reasons."""
    counts = queue.select(F.explode_outer("reasons").alias("reason")).groupBy("reason").count().orderBy("reason").collect()
    if counts:
        raise GateError(f"the {name} gate failed: " + ", ".join(f"{r['reason']} {r['count']}" for r in counts))
