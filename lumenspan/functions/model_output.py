"""What models say, as segments: fenced JSON, tagged text, frame outputs, word times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import TAG, cleaned, tagged_tokens
from lumenspan.schemas import CHANNELS, KINDS, segment_id

FENCED = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
ITEM = "array<struct<start_ms: variant, end_ms: variant, channel: variant, kind: variant, text: variant, needs_review: variant>>"


def json_body(content: Column) -> Column:
    """Model output as a variant: the text itself, else what a code fence around it holds; null if neither is JSON."""
    inside = F.regexp_extract(content, FENCED, 1)
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(F.when(inside != "", inside)))


def model_segments(outputs: DataFrame) -> DataFrame:
    """``case_id, content`` → segments in the model's order, and ``problem`` for what isn't valid.

    An output that isn't JSON, or has no array of segments, gives one row with a problem and no segment. Times must be
    JSON integers, the rest strings; ``needs_review`` is false where it is absent. An empty array gives no row.
    """
    read = outputs.select("case_id", json_body(F.col("content")).alias("v"))
    items = F.try_variant_get("v", "$.segments", ITEM)
    whole = F.when(F.col("v").isNull(), F.lit("the output isn't JSON")).when(items.isNull(), F.lit("the output has no array of segments"))
    bad = read.select("case_id", F.lit(None).cast("int").alias("at"), F.lit(None).cast(ITEM[6:-1]).alias("s"), whole.alias("whole")).where("whole is not null")
    rows = read.where(items.isNotNull()).select("case_id", F.posexplode(items).alias("at", "s"), F.lit(None).cast("string").alias("whole")).unionByName(bad)
    is_a = lambda c, kind: F.coalesce(F.schema_of_variant(c) == kind, F.lit(False))
    value = lambda c, kind: F.try_variant_get(c, "$", kind)
    start, end = value(F.col("s.start_ms"), "long"), value(F.col("s.end_ms"), "long")
    channel, kind, text = (value(F.col(f"s.{c}"), "string") for c in ("channel", "kind", "text"))
    problem = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(~is_a(F.col("s.start_ms"), "BIGINT") | ~is_a(F.col("s.end_ms"), "BIGINT"), F.lit("a time isn't an integer"))
        .when(~is_a(F.col("s.channel"), "STRING") | ~is_a(F.col("s.kind"), "STRING") | ~is_a(F.col("s.text"), "STRING"), F.lit("channel, kind and text must be strings"))
        .when((start < 0) | (end <= start), F.lit("the time range isn't valid"))
        .when(~channel.isin(*CHANNELS), F.lit("channel is unknown"))
        .when(~kind.isin(*KINDS), F.lit("kind is unknown"))
    )
    number = (F.col("at") + 1).cast("long")
    return rows.select("case_id", number.alias("ord"), segment_id(number).alias("id"), start.alias("start_ms"), end.alias("end_ms"), channel.alias("channel"), kind.alias("kind"), text.alias("text"), F.coalesce(value(F.col("s.needs_review"), "boolean"), F.lit(False)).alias("needs_review"), problem.alias("problem"))


def plain_text(tagged: Column) -> Column:
    """Tagged text without its tags and its marks of silence."""
    return F.trim(F.regexp_replace(F.regexp_replace(tagged, TAG, " "), r"(^|\s)_($|\s)", " "))


def _stretches(tokens: Column, start_ms: Column) -> Column:
    """Tokens parted at silence: array of (at, end_ms, text); a stretch begins where the silence before it ends."""
    numbered = F.transform(tokens, lambda t, i: F.struct(t.text.alias("text"), t.end_ms.alias("end_ms"), i.alias("i")))
    silent = F.filter(numbered, lambda t: F.replace(t.text, F.lit(" "), F.lit("")) == "_")
    first = F.array(F.struct(F.lit(0).alias("from"), start_ms.cast("long").alias("at")))
    begins = F.concat(first, F.transform(silent, lambda s: F.struct((s.i + 1).alias("from"), F.greatest(start_ms, start_ms + s.end_ms).cast("long").alias("at"))))

    def one(b: Column, k: Column) -> Column:
        to = F.coalesce(F.try_element_at(silent, k + 1).i, F.size(tokens))
        said = F.slice(tokens, b["from"] + 1, F.greatest(F.lit(0), to - b["from"]))
        end = F.array_max(F.concat(F.array(b["at"]), F.transform(said, lambda t: (start_ms + t.end_ms).cast("long"))))
        return F.struct(b["at"].alias("at"), end.alias("end_ms"), F.array_join(F.transform(said, lambda t: t.text), " ").alias("text"))

    return F.transform(begins, one)


def tagged_segments(outputs: DataFrame) -> DataFrame:
    """``case_id, channel, text, start_ms, end_ms, duration_ms`` of a clip → segments, all flagged for review.

    Text with time tags is parted at silence; without tags, or where nothing of it is left, the clip is one segment.
    Times stay within the clip; what clean-up empties is dropped.
    """
    within = lambda c: F.greatest(F.lit(0), F.least(c, F.col("duration_ms"))).cast("long")
    held = outputs.withColumn("_tokens", tagged_tokens(F.col("text"), F.col("duration_ms")))
    parts = F.transform(_stretches(F.col("_tokens"), F.col("start_ms")), lambda p: F.struct(p["at"].alias("at"), p.end_ms.alias("end_ms"), cleaned(p.text).alias("text")))
    good = F.filter(parts, lambda p: (p.text != "") & (p.end_ms > p["at"]))
    whole = F.array(F.struct(F.col("start_ms").cast("long").alias("at"), F.col("end_ms").cast("long").alias("end_ms"), cleaned(plain_text(F.col("text"))).alias("text")))
    chosen = F.when(F.size(good) > 0, good).otherwise(F.filter(whole, lambda p: p.text != ""))
    rows = held.select("case_id", "channel", "duration_ms", F.posexplode(chosen).alias("n", "p"))
    number = (F.col("n") + 1).cast("long")
    return rows.select("case_id", number.alias("ord"), segment_id(number).alias("id"), within(F.col("p.at")).alias("start_ms"), within(F.col("p.end_ms")).alias("end_ms"), "channel", F.lit("speech").alias("kind"), F.col("p.text").alias("text"), F.lit(True).alias("needs_review"))


def activated(values: Column, activation: str) -> Column:
    """Frame outputs as probabilities: ``sigmoid`` or ``identity``, kept within 0 and 1."""
    if activation not in ("sigmoid", "identity"):
        raise ValueError("the activation is sigmoid or identity")
    p = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) if activation == "sigmoid" else x.cast("double")
    return F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p(x))))


def word_bounds(starts_s: Column, ends_s: Column, duration_ms: Column, min_ms: int = 80) -> Column:
    """Bounds of a clip's speech from its words' times: (start_ms, end_ms, aligned); the whole clip if there are none,
    or if they cover under ``min_ms``."""
    ms = lambda x: F.bround(x * 1000).cast("long")
    first = F.array_min(F.transform(F.array_compact(starts_s), ms))
    last = F.array_max(F.transform(F.array_compact(ends_s), ms))
    start = F.greatest(F.lit(0), F.least(duration_ms, first)).cast("long")
    end = F.greatest(start + 1, F.least(duration_ms, last)).cast("long")
    good = F.coalesce(first.isNotNull() & last.isNotNull() & (end - start >= min_ms), F.lit(False))
    return F.struct(F.when(good, start).otherwise(F.lit(0)).cast("long").alias("start_ms"), F.when(good, end).otherwise(duration_ms).cast("long").alias("end_ms"), good.alias("aligned"))
