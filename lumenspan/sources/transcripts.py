"""Transcripts of many cases by their files: subtitles by the ending ``.srt``, anything else as master JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.schemas import assert_valid
from lumenspan.sources import documents, srt

COLUMNS = ["case_id", "ord", "id", "start_ms", "end_ms", "channel", "kind", "text", "needs_review"]


def from_contents(files: DataFrame) -> DataFrame:
    """``case_id, path, content`` → segments; what can't be read raises. Cues that aren't valid name their case."""
    is_srt = F.lower("path").endswith(".srt")
    cues = srt.parse(files.where(is_srt).select("case_id", "content"))
    good = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", F.col("case_id"), F.col("problem"))).cast("boolean"))
    return cues.where(good).select(*COLUMNS).unionByName(documents.parse_masters(files.where(~is_srt).select("case_id", F.col("content").alias("value"))).select(*COLUMNS))


def read(spark: SparkSession, cases: DataFrame, column: str, folder: str | None = None) -> DataFrame:
    """Segments of the files that ``column`` of a manifest names; ``folder`` holds all of them (by default their paths
    are listed on the driver, as Spark's file sources need them). A file may serve several cases; missing ones raise."""
    named = cases.where(F.col(column).isNotNull()).select("case_id", F.regexp_replace(column, "^file:/*", "/").alias("_path"))
    paths = folder or [r[0] for r in named.select("_path").distinct().collect()]
    if not paths:
        return from_contents(spark.createDataFrame([], "case_id string, path string, content string"))
    texts = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/*", "/").alias("path"), F.col("value").alias("content"))
    met = named.join(texts, F.col("_path") == F.col("path"), "left")
    assert_valid(met.where("path is null").select("case_id", F.concat(F.lit("no such file: "), "_path").alias("rule")))
    return from_contents(met.select("case_id", "path", "content"))
