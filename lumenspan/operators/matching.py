"""Joins of timed segments: overlap, best overlap, position.

Overlap joins go by time buckets: each side is exploded into the buckets that it touches (most segments touch one),
sides meet on (case, bucket), and a pair counts only in the later of its first buckets. A case with very many segments
so spreads over as many keys as it has buckets, and no pair is made that doesn't share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def speech(segments: DataFrame) -> DataFrame:
    """Spoken segments: kind speech and a text that isn't empty (white space counts as text)."""
    return segments.where("kind = 'speech' and text <> ''")


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _side(segments: DataFrame, prefix: str, bucket_ms: int) -> DataFrame:
    named = segments.select(*[F.col(c).alias(c if c == "case_id" else f"{prefix}_{c}") for c in segments.columns])
    first = F.floor(F.col(f"{prefix}_start_ms") / bucket_ms)
    last = F.greatest(first, F.floor((F.col(f"{prefix}_end_ms") - 1) / bucket_ms))
    return named.withColumn(f"{prefix}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("ref", "cand"), condition: Column | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """All pairs of a case that overlap in time, once each; columns take the sides' names, ``overlap_ms`` is added."""
    a, b = names
    x, y = _side(left, a, bucket_ms), _side(right, b, bucket_ms)
    meets = (F.col(f"{a}_start_ms") < F.col(f"{b}_end_ms")) & (F.col(f"{b}_start_ms") < F.col(f"{a}_end_ms")) & (F.col("bucket") == F.greatest(f"{a}_first", f"{b}_first"))
    joined = x.join(y, ["case_id", "bucket"]).where(meets if condition is None else meets & condition)
    return joined.withColumn("overlap_ms", overlap_ms(F.col(f"{a}_start_ms"), F.col(f"{a}_end_ms"), F.col(f"{b}_start_ms"), F.col(f"{b}_end_ms"))).drop("bucket", f"{a}_first", f"{b}_first")


def sides(ref: DataFrame, cand: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``case_id, side, ord, met, ref, cand, overlap_ms``: a row for each segment of either side, from one overlap join.

    A reference (side 0) comes with the candidate that overlaps it most, the first in document order of equals, or
    null; a candidate (side 1) alone; ``met`` says whether the other side has a segment that overlaps it. A segment
    stands in a row for each bucket that it touches, met there or not, and one aggregation by (case, side, order), which
    combines before the shuffle, decides over all of them. ``ord`` tells a case's segments of one side apart.
    """
    x, y = _side(ref, "ref", bucket_ms), _side(cand, "cand", bucket_ms).withColumnsRenamed({"case_id": "_case", "bucket": "_bucket"})
    first = F.greatest("ref_first", "cand_first")
    meets = (F.col("case_id") == F.col("_case")) & (F.col("bucket") == F.col("_bucket")) & (F.col("ref_start_ms") < F.col("cand_end_ms")) & (F.col("cand_start_ms") < F.col("ref_end_ms")) & (F.col("bucket") == first)
    joined = x.join(y, meets, "full")
    r = F.struct(*[F.col(f"ref_{c}").alias(c) for c in ref.columns if c != "case_id"])
    c = F.struct(*[F.col(f"cand_{c}").alias(c) for c in ["ord", *[c for c in cand.columns if c not in ("case_id", "ord")]]])
    has_ref, has_cand = F.col("ref_ord").isNotNull(), F.col("cand_ord").isNotNull()
    shared = F.least("ref_end_ms", "cand_end_ms") - F.greatest("ref_start_ms", "cand_start_ms")
    best = lambda known: F.when(known, F.struct((-shared).alias("minus"), c.alias("cand")))
    row = lambda case, side, ord_, met, ref_, best_: F.struct(F.col(case).alias("case_id"), F.lit(side).alias("side"), F.col(ord_).alias("ord"), met.alias("met"), ref_.alias("ref"), best_.alias("best"))
    of_ref = F.when(has_ref, row("case_id", 0, "ref_ord", has_cand, F.when(has_ref, r), best(has_ref & has_cand)))
    of_cand = F.when(has_cand, row("_case", 1, "cand_ord", has_ref, F.when(~has_cand, r), F.when(has_cand, F.struct(F.lit(None).cast("long").alias("minus"), c.alias("cand")))))
    rows = joined.select(F.explode(F.array_compact(F.array(of_ref, of_cand))).alias("s")).select("s.*")
    held = rows.groupBy("case_id", "side", "ord").agg(F.max("met").alias("met"), F.any_value("ref").alias("ref"), F.min("best").alias("best"))
    return held.select("case_id", "side", "ord", "met", "ref", F.col("best.cand").alias("cand"), (-F.col("best.minus")).alias("overlap_ms"))


def flat(rows: DataFrame) -> DataFrame:
    """Rows of :func:`sides` with the segments' fields as columns ``ref_*`` and ``cand_*``."""
    fields = [F.col(f"{side}.{f.name}").alias(f"{side}_{f.name}") for side in ("ref", "cand") for f in rows.schema[side].dataType.fields]
    return rows.select("case_id", "side", "met", *fields, "overlap_ms")


def best_overlap(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Each reference segment with the candidate that overlaps it most; ties go to the first in document order.

    A minimum of (-overlap, order) combines before the shuffle, and is the same however rows are dealt.
    """
    pairs = overlapping(ref, cand)
    mine = [c for c in pairs.columns if c.startswith("ref_")]
    theirs = [c for c in pairs.columns if c.startswith("cand_") and c != "cand_ord"]
    best = F.min(F.struct((-F.col("overlap_ms")).alias("minus"), "cand_ord", *theirs)).alias("x")
    out = pairs.groupBy("case_id", *mine).agg(best)
    return out.select("case_id", *mine, *[F.col(f"x.{c}").alias(c) for c in ["cand_ord", *theirs]], (-F.col("x.minus")).alias("overlap_ms"))


def positional(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """The i-th reference segment with the i-th candidate, in document order, up to the shorter of the two."""
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    x = ref.select("case_id", at.alias("at"), *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c != "case_id"])
    y = cand.select("case_id", at.alias("at"), *[F.col(c).alias(f"cand_{c}") for c in cand.columns if c != "case_id"])
    return x.join(y, ["case_id", "at"])


def missing(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Reference segments that no candidate overlaps."""
    met = overlapping(ref, cand).select("case_id", F.col("ref_ord").alias("ord")).distinct()
    return ref.join(met, ["case_id", "ord"], "left_anti")


def extra(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidate segments that overlap no reference."""
    met = overlapping(ref, cand).select("case_id", F.col("cand_ord").alias("ord")).distinct()
    return cand.join(met, ["case_id", "ord"], "left_anti")


def bijection_errors(left: DataFrame, right: DataFrame) -> DataFrame:
    """``case_id, id, rule``: ids of one side that the other lacks, and ids that the right side repeats."""
    key = ["case_id", "id"]
    return (
        left.select(*key).join(right.select(*key), key, "left_anti").withColumn("rule", F.lit("missing"))
        .unionByName(right.select(*key).join(left.select(*key), key, "left_anti").distinct().withColumn("rule", F.lit("unknown")))
        .unionByName(right.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("rule")))
    )
