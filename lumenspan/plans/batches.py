"""Models over whole sets of cases: forced alignment of candidates, and transcription that goes on where it stopped."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions import hooks
from lumenspan.operators.intervals import fixed_chunks, review_flags, split_long
from lumenspan.operators.matching import bijection_errors
from lumenspan.plans.workflow import Model
from lumenspan.schemas import assert_valid
from lumenspan.scratch import checkpointed
from lumenspan.sources import audio as files
from lumenspan.sources import detections, wav

#: An aligner: the path of a case's audio and its segments → ``id, start_ms, end_ms`` of each.
Aligner = Callable[[str, list[dict]], list[dict]]
FIELDS = ["id", "start_ms", "end_ms", "channel", "kind", "text", "needs_review"]


def command(argv: list[str], tag: str = "lumenspan-master-v1") -> Aligner:
    """An aligner that is a program: it reads ``{"audio_file", "master"}`` as JSON and writes ``{"segments"}``."""
    if not argv:
        raise ValueError("an alignment command is needed")

    def run(path: str, segments: list[dict]) -> list[dict]:
        request = json.dumps({"audio_file": path, "master": {"format": tag, "segments": segments}}, ensure_ascii=False)
        done = subprocess.run(argv, input=request, capture_output=True, text=True, check=False)  # noqa: S603 - the user's own program
        if done.returncode:
            raise ValueError(f"the alignment command failed: {done.stderr.strip() or done.stdout.strip() or 'no message'}")
        try:
            return json.loads(done.stdout)["segments"]
        except (json.JSONDecodeError, KeyError, TypeError) as e:
            raise ValueError(f"the alignment command's output can't be read: {e}") from None

    return run


def _times(case_id: str, found: object) -> list[dict]:
    """An aligner's rows; other than lists of ids with whole times raise."""
    if not isinstance(found, list):
        raise ValueError(f"case {case_id}: aligned segments must be a list")
    for x in found:
        ok = isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"]
        if not ok or any(not isinstance(x.get(k), int) or isinstance(x.get(k), bool) for k in ("start_ms", "end_ms")):
            raise ValueError(f"case {case_id}: an aligned segment needs an id and whole times")
    return [{"case_id": case_id, "id": x["id"], "start_ms": x["start_ms"], "end_ms": x["end_ms"]} for x in found]


def aligned_times(segments: DataFrame, audio: DataFrame, aligner: Aligner) -> DataFrame:
    """``case_id, id, start_ms, end_ms`` of every segment that the aligner told.

    A case's segments meet its audio's path (``case_id, audio``) in one task, and the aligner is called once a case;
    cases are dealt evenly. What was told is kept in a checkpoint, so that no case is aligned twice.
    """
    item = F.struct("ord", F.struct(*FIELDS).alias("s"))
    held = segments.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.s).alias("segments"))
    joined = held.join(audio.select(F.col("case_id").cast("string").alias("case_id"), "audio"), "case_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = _times(r["case_id"], aligner(r["audio"], r["segments"]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return checkpointed(joined.select("case_id", "segments", "audio").repartition("case_id").mapInArrow(run, "case_id string, id string, start_ms long, end_ms long"))


def aligned_cases(segments: DataFrame, audio: DataFrame, aligner: Aligner) -> tuple[DataFrame, DataFrame]:
    """Segments with the aligner's bounds, flagged where those are too long, and a row of diagnostics a case.

    The aligner must tell every segment of a case once and no other: what it leaves out, repeats or makes up raises, as
    does a case without audio.
    """
    text = F.col("case_id").cast("string")
    lacking = segments.select(text.alias("case_id")).distinct().join(audio.select(text.alias("case_id")), "case_id", "left_anti")
    assert_valid(lacking.select("case_id", F.lit("the case has no audio").alias("rule")))
    told = aligned_times(segments, audio, aligner)
    wrong = bijection_errors(segments.select(text.alias("case_id"), "id"), told.select("case_id", "id"))
    assert_valid(wrong.select("case_id", F.concat(F.lit("alignment: segment "), F.col("id"), F.lit(" is "), F.col("rule")).alias("rule")))
    times = told.select(F.col("case_id").alias("_case"), F.col("id").alias("_id"), F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"))
    joined = segments.join(times, (segments["case_id"].cast("string") == F.col("_case")) & (segments["id"] == F.col("_id")))
    moved = {"start_ms": F.col("_start").alias("start_ms"), "end_ms": F.col("_end").alias("end_ms")}
    after = review_flags(joined.select(*[moved.get(c, segments[c]) for c in segments.columns]))
    counts = after.groupBy("case_id").agg(F.sum(F.col("needs_review").cast("long")).alias("review_count"))
    return after, hooks.alignment_diagnostics(segments, after).join(counts, "case_id")


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier run left, or none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def transcribed_cases(index: DataFrame, model: Model, folder: str) -> DataFrame:
    """Transcribe the cases of an index (``case_id, audio``) that ``folder`` doesn't have yet, and give the index of all
    candidates: ``case_id, audio, segments, review_count``.

    Segments go to ``folder/segments``, a partition a case that a case's run replaces, and only then is the case noted in
    ``folder/cases``; so a run that was stopped goes on with the cases that aren't noted, a case that it had begun is made
    anew, and a case in which nothing was said is done too. Audio is cut by range reads, a chunk a call of the model.
    """
    spark, notes, parts = index.sparkSession, f"{folder}/cases", f"{folder}/segments"
    wanted = index.select(F.col("case_id").cast("string").alias("case_id"), "audio")
    repeated = wanted.groupBy("case_id").count().where("count > 1 or case_id is null").select("case_id", F.lit("case ids must be unique").alias("rule"))
    assert_valid(repeated, wanted.where("audio is null").select("case_id", F.lit("the case has no audio").alias("rule")))
    done = _saved(spark, notes)
    todo = checkpointed(wanted if done is None else wanted.join(done.select("case_id"), "case_id", "left_anti"))
    if not todo.isEmpty():
        said = checkpointed(_said(todo, model))
        said.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(parts)
        counts = said.groupBy("case_id").agg(F.count("*").alias("segments"), F.sum(F.col("needs_review").cast("long")).alias("review_count"))
        todo.select("case_id").join(counts, "case_id", "left").na.fill(0).write.mode("append").parquet(notes)
    return wanted.join(spark.read.parquet(notes), "case_id")


def _said(cases: DataFrame, model: Model) -> DataFrame:
    """Segments of whole files: chunks by energy where the model hears the mix, else even ones; both sides apart if there are two."""
    heads = checkpointed(files.headers(cases))
    assert_valid(files.problems(heads, channels=1))
    if model.mix_first:
        e = model.energy
        chunks = detections.by_energy(heads, e.threshold_dbfs, e.window_ms, e.min_silence_ms, e.min_speech_ms, e.pad_ms, e.max_chunk_ms)
    else:
        chunks = fixed_chunks(heads.select("case_id", "duration_ms"))
    if model.max_chunk_ms is not None:
        chunks = split_long(chunks, model.max_chunk_ms)
    clips = files.clips(chunks.select("case_id", "start_ms", "end_ms"), heads)
    mix_first = model.mix_first

    def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = wav.split(r["content"])
                for side in ("MIX",) if mix_first or len(parts) == 1 else ("L", "R"):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((r["case_id"], pa.string()), (side, pa.string()), (r["start_ms"], pa.int64()), (parts[side], pa.binary()))], ["case_id", "channel", "offset_ms", "content"])

    heard = clips.mapInArrow(sides, "case_id string, channel string, offset_ms long, content binary")
    said = checkpointed(hooks.transcribe(heard, model.hook))
    return review_flags(_attributed(said, heads) if mix_first else said)


def _attributed(segments: DataFrame, heads: DataFrame) -> DataFrame:
    """Segments of the mix take the louder side where the audio is stereo, without a limit on the other."""
    from lumenspan.operators.channels import attributed

    stereo = heads.where("channels >= 2")
    made = attributed(files.segment_levels(segments, stereo), quiet_dbfs=None)
    known = F.col("left_dbfs").isNotNull()
    return made.withColumn("channel", F.when(known, F.col("channel")).otherwise(F.col("original_channel"))).select(*segments.columns)


def candidate_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of the cases that ``folder`` has noted as done."""
    held = _saved(spark, f"{folder}/segments")
    notes = spark.read.parquet(f"{folder}/cases").select("case_id")
    if held is None:
        return spark.createDataFrame([], "case_id string, ord long, id string, start_ms long, end_ms long, channel string, kind string, text string, needs_review boolean")
    rows = held.withColumn("case_id", F.col("case_id").cast("string")).join(notes, "case_id", "left_semi")
    return rows.select("case_id", *[c for c in rows.columns if c != "case_id"])
