"""SRT subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.schemas import segment_id

# The timing line, and the labels that may lead a cue's text.
TIMING = r"^(\d{2}):([0-5]\d):([0-5]\d)[,.](\d{3})\s*-->\s*(\d{2}):([0-5]\d):([0-5]\d)[,.](\d{3})(?:\s+.*)?$"
LABELS = r"(?i)^\s*((?:\[(?:(?:L|R|LR|MIX)(?::[A-Z0-9_:-]*)?|SPEAKER_[A-Z0-9_:-]*)\]\s*)+)"
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def timestamp(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; hours take the digits they need."""
    div = lambda by: F.floor(ms / by)
    return F.format_string("%02d:%02d:%02d,%03d", div(3_600_000), div(60_000) % 60, div(1000) % 60, ms % 1000)


def milliseconds(line: Column, first_group: int) -> Column:
    """A timing line's start (group 1) or end (group 5)."""
    part = lambda k: F.regexp_extract(line, TIMING, first_group + k).cast("long")
    return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3)


def parse(documents: DataFrame) -> DataFrame:
    """``case_id, content`` → segments, and ``problem`` where a cue isn't valid (then it has no times).

    Cues are parted by empty lines; a number line is optional. The last L or R label of the run that leads the first
    line of text is the channel, else MIX; labels of other lines are text. Minutes and seconds go up to 59. Documents without cues give no row; null content counts as empty.
    """
    blocks = F.filter(F.transform(F.split(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"), lambda b: F.btrim(b, F.lit(" \t\n\r\x0b\x0c"))), lambda b: b != "")
    cues = documents.select("case_id", F.posexplode(blocks).alias("at", "block")).withColumn("lines", F.split("block", LINE))
    numbered = F.trim(F.element_at("lines", 1)).rlike(r"^\p{Nd}+$")
    cues = cues.withColumn("lines", F.when(numbered, F.slice("lines", F.lit(2), F.greatest(F.lit(0), F.size("lines") - 1))).otherwise(F.col("lines")))
    line, said = F.trim(F.try_element_at("lines", F.lit(1))), F.slice("lines", F.lit(2), F.greatest(F.lit(0), F.size("lines") - 1))
    first = F.btrim(F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")), F.lit(" \t\x0b\x0c"))
    labels = F.regexp_extract(first, LABELS, 1)
    others = F.transform(F.slice(said, F.lit(2), F.greatest(F.lit(0), F.size(said) - 1)), lambda x: F.rtrim(x))
    text = F.array_join(F.concat(F.array(F.regexp_replace(first, LABELS, "")), others), "\n")
    sides = F.regexp_extract_all(F.upper(labels), F.lit(r"\[(L|R)(?::[A-Z0-9_:-]*)?\]"), F.lit(1))
    problem = F.when(F.size("lines") < 2, F.lit("a cue needs timing and text")).when(~line.rlike(TIMING), F.lit("the timing line isn't valid"))
    backwards = milliseconds(line, 5) <= milliseconds(line, 1)
    problem = F.when(problem.isNotNull(), problem).when(backwards, F.lit("a cue must end after it starts"))
    known = problem.isNull()
    made = cues.select("case_id", (F.col("at") + 1).cast("long").alias("ord"), F.when(known, milliseconds(line, 1)).alias("start_ms"), F.when(known, milliseconds(line, 5)).alias("end_ms"), F.coalesce(F.try_element_at(sides, F.lit(-1)), F.lit("MIX")).alias("channel"), F.btrim(text, F.lit(" \t\n\r\x0b\x0c")).alias("text"), problem.alias("problem"))
    return made.select("case_id", "ord", segment_id("ord").alias("id"), "start_ms", "end_ms", "channel", F.lit("speech").alias("kind"), "text", F.lit(False).alias("needs_review"), "problem")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files; the case is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return parse(files.select(name.alias("case_id"), F.col("value").alias("content")))


def formatted(segments: DataFrame, kinds: tuple[str, ...] = ("speech",), texts: DataFrame | None = None) -> DataFrame:
    """``case_id, content``: cues by (start, end, id), numbered from 1, those without text left out.

    ``texts`` (``case_id, id, text``) replaces texts, as translations do.
    """
    held = segments.where(F.col("kind").isin(*kinds))
    if texts is not None:
        held = held.join(texts.select("case_id", "id", F.col("text").alias("_new")), ["case_id", "id"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    rows = held.where("text <> ''").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id", "text"))).alias("xs"))
    cue = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), timestamp(x.start_ms), F.lit(" --> "), timestamp(x.end_ms), F.lit("\n"), x.text)
    return rows.select("case_id", F.concat(F.array_join(F.transform("xs", cue), "\n\n"), F.lit("\n")).alias("content"))
