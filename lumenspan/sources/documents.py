"""JSON documents: master transcripts, translations, manifests, audio maps, snapshot digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.sources.audio import opened

#: Format tags of master documents end so.
MASTER = "-master-v1"
SEGMENTS = "array<struct<id: string, start_ms: variant, end_ms: variant, channel: string, kind: string, text: string, needs_review: variant>>"


def read_masters(spark: SparkSession, path: str) -> DataFrame:
    """Segments of master documents, a case a file, in document order.

    Times must be JSON integers: ``true``, ``1.0`` and strings raise, as does an unknown format.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.master)?(?:\.[^.]*)?$", 1)
    return parse_masters(spark.read.text(path, wholetext=True).select(name.alias("case_id"), "value"))


def parse_masters(files: DataFrame) -> DataFrame:
    """:func:`read_masters` of ``case_id, value``."""
    parsed = files.select("case_id", F.parse_json("value").alias("v"))
    checked = parsed.withColumn("format", F.try_variant_get("v", "$.format", "string")).withColumn("ok", F.coalesce(F.col("format").endswith(MASTER), F.lit(False)))
    checked = checked.where(F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown document format in "), F.col("case_id"))).cast("boolean")))
    rows = checked.select("case_id", F.posexplode(F.variant_get("v", "$.segments", SEGMENTS)).alias("ord", "s"))
    whole = lambda c: F.when(F.schema_of_variant(c) == "BIGINT", F.variant_get(c, "$", "long")).otherwise(F.raise_error(F.concat(F.lit("a time isn't an integer in "), F.col("case_id"))).cast("long"))
    review = F.coalesce(F.try_variant_get("s.needs_review", "$", "boolean"), F.lit(False))
    return rows.select("case_id", F.col("ord").cast("long"), "s.id", whole(F.col("s.start_ms")).alias("start_ms"), whole(F.col("s.end_ms")).alias("end_ms"), "s.channel", "s.kind", "s.text", review.alias("needs_review"))


def master_json(segments: DataFrame, headers: DataFrame, tag: str) -> DataFrame:
    """``case_id, json`` with a format tag; ``headers`` has ``case_id, source_language, duration_ms``."""
    fields = ["id", "start_ms", "end_ms", "channel", "kind", "text", "needs_review"]
    held = segments.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("s")))).alias("xs"))
    joined = headers.join(held, "case_id", "left")
    body = F.struct(F.lit(tag).alias("format"), "source_language", F.struct("duration_ms").alias("audio"), F.coalesce(F.transform("xs", lambda x: x.s), F.array()).alias("segments"))
    return joined.select("case_id", F.to_json(body).alias("json"))


def translation_items(segments: DataFrame) -> DataFrame:
    """What goes to translation: ids and texts of spoken segments."""
    return segments.where("kind = 'speech'").select("case_id", "id", "text")


def audio_map(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, audio`` of an audio map: items with ``case_id``, a case index's items with ``id``, or an object of
    paths by case. Relative paths are of the file's folder. Missing names and repeated cases raise."""
    from lumenspan.schemas import assert_valid
    from lumenspan.sources.manifests import resolved

    v = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.parse_json("value").alias("v"))
    listed = F.try_variant_get("v", "$.items", "array<struct<case_id: string, id: string, audio: string>>")
    items = F.transform(listed, lambda x: F.struct(F.coalesce(x.case_id, x.id).alias("case_id"), x.audio.alias("audio")))
    plain = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string, string>")), lambda e: F.struct(e.key.alias("case_id"), e.value.alias("audio")))
    known = F.coalesce(items, plain)
    wrong = v.where(known.isNull()).select(F.lit(None).cast("string").alias("case_id"), F.lit("the audio map is neither items nor paths by case").alias("rule"))
    rows = v.select("folder", F.explode(known).alias("x")).select("folder", "x.*")
    empty = rows.where("coalesce(case_id, '') = '' or coalesce(audio, '') = ''").select("case_id", F.lit("an audio map needs a case and a path").alias("rule"))
    again = rows.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("the case is repeated in the audio map").alias("rule"))
    assert_valid(wrong, empty, again)
    return rows.select("case_id", resolved(F.col("folder"), F.col("audio")).alias("audio"))


def snapshot_digest(spark: SparkSession, path: str, chunk: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """``path, sha256, size_bytes`` of each file under a folder, and the root digest over them by path.

    Spark lists the files without their content; a task hashes a file by reads of ``chunk`` bytes, so files of any size
    take no more memory than that. Every file is a task of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/") + "/"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                digest, at = hashlib.sha256(), 0
                with opened(unquote(name)) as f:
                    while data := f.read_at(chunk, at):
                        digest.update(data)
                        at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()]), pa.array([at], pa.int64())], ["path", "sha256", "size_bytes"])

    hashed = files.repartition(F.col("path")).mapInArrow(run, "path string, sha256 string, size_bytes long")
    each = hashed.withColumn("path", F.substring_index("path", root, -1))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x.path, F.lit("\0"), x.sha256, F.lit("\0")))
    return each, each.agg(F.sha2(F.array_join(lines, ""), 256).alias("root_sha256"), F.count("*").alias("files"))
