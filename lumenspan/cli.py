"""Commands over transcripts, case sets, audio and projects: ``python -m lumenspan COMMAND ...``.

A command's rows are printed as JSON lines, or written by Spark as JSON under ``-o``. A failed gate ends with status 1
after its report has been written.
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators import audit, cases, channels, coverage, effort, gates, intervals, packs, readiness
from lumenspan.operators.evaluate import PRODUCT_GATE
from lumenspan.plans import batches, report, workflow
from lumenspan.schemas import assert_valid, violations
from lumenspan.session import get_session
from lumenspan.scratch import checkpointed
from lumenspan.sources import audio, detections, documents, manifests, reviews, srt, transcripts
from lumenspan.sources.projects import Projects

Command = Callable[[SparkSession, argparse.Namespace], DataFrame | None]
COMMANDS: dict[str, tuple[Command, list[tuple[tuple, dict]]]] = {}


def arg(*names: str, **settings) -> tuple[tuple, dict]:
    return names, settings


def command(name: str, *arguments: tuple[tuple, dict]) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = f, list(arguments)
        return f

    return add


LIMITS = [arg("--product-gate", action="store_true"), *[arg("--" + k.replace("_", "-"), type=float) for k in PRODUCT_GATE]]


def _limits(a: argparse.Namespace) -> dict[str, float]:
    return gates.thresholds(a.product_gate, **{k: getattr(a, k) for k in PRODUCT_GATE})


def _one(spark: SparkSession, path: str, case: str = "single") -> DataFrame:
    """Valid segments of one file."""
    held = transcripts.read(spark, spark.createDataFrame([(case, os.path.abspath(path))], "case_id string, file string"), "file")
    assert_valid(violations(held))
    return held


def _master(spark: SparkSession, segments: DataFrame, a: argparse.Namespace) -> DataFrame:
    head = segments.sparkSession.createDataFrame([("single",)], "case_id string").join(segments.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")), "case_id", "left")
    return documents.master_json(segments, head.select("case_id", F.lit(a.source_language).alias("source_language"), "duration_ms"), a.tag)


def _document(rows: DataFrame, column: str, path: str) -> None:
    """One document to one file."""
    first = rows.select(column).first()
    with open(path, "w", encoding="utf-8") as f:
        f.write("" if first is None else first[0])


LANGUAGE, TAG = arg("--source-language", default="ja"), arg("--tag", default="lumenspan-master-v1")


@command("srt-to-json", arg("input"), LANGUAGE, TAG)
def srt_to_json(spark: SparkSession, a: argparse.Namespace) -> None:
    _document(_master(spark, _one(spark, a.input), a), "json", a.output)


@command("json-to-srt", arg("input"), arg("--translated"))
def json_to_srt(spark: SparkSession, a: argparse.Namespace) -> None:
    held, texts = _one(spark, a.input), None
    if a.translated:
        v = spark.read.text(a.translated, wholetext=True).select(F.parse_json("value").alias("v"))
        texts = v.select(F.lit("single").alias("case_id"), F.explode(F.variant_get("v", "$.items", "array<struct<id: string, text: string>>")).alias("x")).select("case_id", "x.*")
        from lumenspan.operators.matching import bijection_errors

        assert_valid(bijection_errors(documents.translation_items(held).select("case_id", "id"), texts.select("case_id", "id")))
    _document(srt.formatted(held, texts=texts), "content", a.output)


@command("export-translation-json", arg("input"), arg("--tag", default="lumenspan-translation-v1"))
def export_translation(spark: SparkSession, a: argparse.Namespace) -> None:
    _document(_translation(_one(spark, a.input), a.tag), "json", a.output)


def _translation(segments: DataFrame, tag: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))), lambda x: F.struct(x.id.alias("id"), x.text.alias("text")))
    return segments.where("kind = 'speech'").agg(F.to_json(F.struct(F.lit(tag).alias("format"), items.alias("items"))).alias("json"))


@command("freeze-reference", arg("input"), LANGUAGE, TAG)
def freeze_reference(spark: SparkSession, a: argparse.Namespace) -> None:
    _document(_master(spark, intervals.freeze(_one(spark, a.input)), a), "json", a.output)


@command("slice-case", arg("input"), arg("--start-ms", type=int, required=True), arg("--end-ms", type=int, required=True), arg("--audio"), arg("--audio-output"), LANGUAGE, TAG)
def slice_case(spark: SparkSession, a: argparse.Namespace) -> None:
    cut = intervals.time_slice(_one(spark, a.input), a.start_ms, a.end_ms)
    if a.audio:
        one = spark.createDataFrame([("single", os.path.abspath(a.audio), a.start_ms, a.end_ms)], "case_id string, audio string, start_ms long, end_ms long")
        clip = audio.clips(one.drop("audio"), audio.headers(one)).first()["content"]
        with open(a.audio_output, "wb") as f:
            f.write(clip)
    _document(_master(spark, cut, a), "json", a.output)


@command("eval-transcript", arg("reference"), arg("candidate"), *LIMITS)
def eval_transcript(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _gated(report.evaluated(_one(spark, a.reference), _one(spark, a.candidate)), a)


def _gated(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    limits = _limits(a)
    return report.gated(rows, limits) if limits else rows


def _sides(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = manifests.read(spark, manifest, "eval")
    ref, cand = (transcripts.read(spark, held, c) for c in ("reference", "candidate"))
    assert_valid(violations(ref), violations(cand))
    return held, ref, cand


@command("eval-manifest", arg("manifest"), arg("--by-case", action="store_true"), arg("--require-reference-type"), *LIMITS)
def eval_manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    held, ref, cand = _sides(spark, a.manifest)
    required = a.require_reference_type or (gates.PRODUCT_REFERENCE if a.product_gate else None)
    out = report.evaluated(ref, cand) if a.by_case else report.suite(ref, cand)
    out = _gated(out.withColumn("label", F.col("case_id") if a.by_case else F.lit("suite")), a)
    if required:
        out = gates.with_reference_types(out, held, required, by_case=a.by_case)
    return out


@command("compare-evals", arg("manifests", nargs="+"), *LIMITS)
def compare_evals(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from lumenspan.operators.comparison import labels

    sides = {label: _sides(spark, m)[1:] for label, m in zip(labels(a.manifests), a.manifests, strict=True)}
    return _gated(report.compared({k: report.suite(*v) for k, v in sides.items()}), a)


def _queue(spark: SparkSession, manifest: str) -> DataFrame:
    from lumenspan.functions.text import practical
    from lumenspan.operators.matching import speech

    _, ref, cand = _sides(spark, manifest)
    return effort.items(speech(ref), speech(cand), normal=practical)


@command("review-effort", arg("manifest"), arg("--document", help="also write the queue as one JSON document"), arg("--tag", default="lumenspan-review-effort-v1"), arg("--source-case-index"))
def review_effort(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    queue = effort.ranked(_queue(spark, a.manifest))
    if a.document:
        _document(reviews.document(queue, a.tag, source_case_index=a.source_case_index), "json", a.document)
    return queue.orderBy("priority_rank")


@command("merge-review-effort", arg("reports", nargs="+", help="documents of review items, or folders of JSON lines"), arg("--document", help="also write the queue as one JSON document"), arg("--tag", default="lumenspan-review-effort-v1"))
def merge_review_effort(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Queues merged item by item, with the files that each item came from."""
    lines = [os.path.isdir(p) for p in a.reports]
    index = reviews.case_index(spark, [p for p, many in zip(a.reports, lines, strict=True) if not many])
    merged = effort.merged(*[reviews.read(spark, p, many) for p, many in zip(a.reports, lines, strict=True)], names=a.reports)
    if a.document:
        _document(reviews.document(merged, a.tag, source_case_index=index), "json", a.document)
    return merged.orderBy("priority_rank")


@command("compare-review-effort", arg("manifests", nargs="+"), arg("--totals", action="store_true", help="a row a candidate instead of a row a reference"))
def compare_review_effort(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """References that some candidate fails at, most failures first; the manifests must have the same cases."""
    from lumenspan.operators.comparison import case_set_errors, labels

    names = labels(a.manifests)
    assert_valid(case_set_errors({n: _sides(spark, m)[0] for n, m in zip(names, a.manifests, strict=True)}))
    queues = {n: checkpointed(_queue(spark, m)) for n, m in zip(names, a.manifests, strict=True)}
    assert_valid(effort.repeated_references(queues))
    return effort.label_totals(queues).orderBy("label") if a.totals else effort.issues(queues).orderBy("rank")


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases of an index and their references' segments, which must be valid."""
    held = manifests.read(spark, path, "index")
    ref = transcripts.read(spark, held, "reference")
    assert_valid(violations(ref))
    return held, ref


def _durations(held: DataFrame) -> DataFrame:
    return audio.headers(held).select("case_id", "duration_ms")


@command("audit-review-case-references", arg("index"), arg("--queue", action="store_true"), arg("--min-overlap-ms", type=int, default=audit.OVERLAP_MS), arg("--long-segment-ms", type=int, default=audit.LONG_MS), arg("--fail-on-items", action="store_true"))
def audit_references(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    held, ref = _index(spark, a.index)
    queue = audit.queue(ref, a.min_overlap_ms, a.long_segment_ms)
    a.after = (lambda: gates.enforce_empty(queue, "reference audit")) if a.fail_on_items else None
    return queue if a.queue else audit.audit(ref, _durations(held), a.min_overlap_ms, a.long_segment_ms)


@command("review-case-status", arg("index"))
def review_case_status(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Files are looked for on the driver; a transcript that is there but can't be read raises."""
    held = manifests.read(spark, a.index, "index")
    local = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    named = {p for r in held.select("audio", "reference", "candidate").collect() for p in r if p}
    files = spark.createDataFrame([(p,) for p in sorted(named) if os.path.isfile(local(p))], "path string")
    there = lambda c: held.join(files, F.col(c) == F.col("path"), "left_semi")
    return cases.status(held, files, transcripts.read(spark, there("reference"), "reference"), transcripts.read(spark, there("candidate"), "candidate")).orderBy("place")


@command("review-case-pack", arg("index"), arg("--context-ms", type=int, default=packs.CONTEXT_MS), arg("--clips"))
def review_case_pack(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    held, ref = _index(spark, a.index)
    pack = packs.review_pack(packs.flagged_queue(ref, held), _durations(held), a.context_ms)
    assert_valid(packs.pack_violations(pack))
    if a.clips:
        _clips(pack, held, a.clips)
    return pack.orderBy("priority_rank")


def _clips(pack: DataFrame, held: DataFrame, path: str) -> None:
    ranges = pack.select("case_id", "priority_rank", "clip_file", F.col("clip_start_ms").alias("start_ms"), F.col("clip_end_ms").alias("end_ms"))
    audio.clips(ranges, audio.headers(held)).write.mode("errorifexists").parquet(path)


def _audio_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """``case_id, audio`` of whichever of an audio file, an audio map and a case index is given; a file serves all cases."""
    given = [x for x in (a.audio, a.audio_map, a.source_case_index) if x]
    if len(given) != 1:
        raise ValueError("give one of --audio, --audio-map and --source-case-index")
    if a.audio:
        return spark.createDataFrame([(None, os.path.abspath(a.audio))], "case_id string, audio string")
    return documents.audio_map(spark, given[0])


@command("review-pack", arg("report", help="a document of review items, or a folder of JSON lines"), arg("--audio"), arg("--audio-map"), arg("--source-case-index"), arg("--context-ms", type=int, default=packs.CONTEXT_MS), arg("--clips"))
def review_pack(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What to listen to for each item of a queue, and the clips."""
    queue = reviews.read(spark, a.report, os.path.isdir(a.report))
    queue = queue.withColumn("priority_rank", F.coalesce("priority_rank", F.col("item_index") + 1)) if "priority_rank" in queue.columns else queue.withColumn("priority_rank", F.col("item_index") + 1)
    assert_valid(packs.pack_violations(queue))
    named = _audio_of(spark, a)
    if a.audio:
        known = queue.select("case_id").distinct()
        if known.where("case_id is not null").limit(2).count() > 1:
            raise ValueError("a queue of several cases needs an audio map")
        named = known.select(F.coalesce("case_id", F.lit("single")).alias("case_id")).crossJoin(named.select("audio"))  # one row each
        queue = queue.withColumn("case_id", F.coalesce("case_id", F.lit("single")))
    pack = packs.review_pack(queue, _durations(named), a.context_ms)
    assert_valid(packs.missing_audio(pack))
    if a.clips:
        _clips(pack, named, a.clips)
    return pack.orderBy("priority_rank")


@command("build-candidate-attach-plan", arg("index"), arg("folder"), arg("--candidate-id"), arg("--tag", default="lumenspan-attach-plan-v1"))
def build_attach_plan(spark: SparkSession, a: argparse.Namespace) -> None:
    listing = spark.createDataFrame([(os.path.abspath(e.path),) for e in os.scandir(a.folder) if e.is_file()], "path string")
    plan = cases.attach_plan(manifests.read(spark, a.index, "index"), listing)
    _document(manifests.document(plan, "attach", a.tag, candidate_id=a.candidate_id), "json", a.output)


@command("attach-review-case-candidates", arg("index"), arg("plan"), arg("--tag", default="lumenspan-case-set-v1"))
def attach_candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    held, plan = manifests.read(spark, a.index, "index"), manifests.read(spark, a.plan, "attach")
    _document(manifests.document(cases.attached(held, plan), "index", a.tag), "json", a.output)


@command("build-eval-manifest", arg("index"), arg("--reference-type"), arg("--reference-notes"), arg("--fail-on-review", action="store_true"), arg("--tag", default="lumenspan-eval-manifest-v1"))
def build_eval_manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    held = manifests.read(spark, a.index, "index")
    found = review_case_status(spark, a)
    made = cases.eval_manifest(held, found, a.reference_type, a.reference_notes, a.fail_on_review).join(held.select("case_id", "place"), "case_id")
    _document(manifests.document(made, "eval", a.tag), "json", a.output)


LIMITS_OF_COVERAGE = [arg("--max-detected-interval-ms", type=int), arg("--max-missed-reference-ms", type=int), arg("--min-reference-recall", type=float), arg("--min-detected-precision", type=float)]
ENERGY = [arg("--energy-threshold-dbfs", type=float, default=detections.THRESHOLD_DBFS), arg("--energy-window-ms", type=int, default=detections.WINDOW_MS), arg("--energy-min-silence-ms", type=int, default=detections.MIN_SILENCE_MS), arg("--energy-min-speech-ms", type=int, default=detections.MIN_SPEECH_MS), arg("--energy-pad-ms", type=int, default=detections.PAD_MS), arg("--energy-max-chunk-ms", type=int)]


def _detected(spark: SparkSession, held: DataFrame, path: str | None, a: argparse.Namespace) -> DataFrame:
    """Detected intervals: those of a file, which must be valid, or by the audio's energy."""
    heads = audio.headers(held)
    if path is not None:
        found = detections.read(spark, path)
        assert_valid(detections.problems(found, heads))
        return found
    return detections.by_energy(heads, a.energy_threshold_dbfs, a.energy_window_ms, a.energy_min_silence_ms, a.energy_min_speech_ms, a.energy_pad_ms, a.energy_max_chunk_ms)


def _covered(found: DataFrame, a: argparse.Namespace) -> DataFrame:
    return gates.coverage_gate(found, a.max_detected_interval_ms, a.max_missed_reference_ms, a.min_reference_recall, a.min_detected_precision)


@command("vad-coverage", arg("audio"), arg("reference"), arg("--intervals", help="a JSON document of intervals; default: by energy"), *ENERGY, *LIMITS_OF_COVERAGE)
def vad_coverage(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Coverage of one transcript by detected intervals of its audio."""
    held = spark.createDataFrame([("single", os.path.abspath(a.audio))], "case_id string, audio string")
    return _covered(coverage.coverage(_one(spark, a.reference), _detected(spark, held, a.intervals, a)), a).withColumn("label", F.lit("single"))


@command("vad-coverage-cases", arg("index"), arg("--intervals", help="JSON lines of case_id, start_ms, end_ms; default: by energy"), arg("--by-case", action="store_true"), *ENERGY, *LIMITS_OF_COVERAGE)
def vad_coverage_cases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    held, ref = _index(spark, a.index)
    found = coverage.coverage(ref, _detected(spark, held, a.intervals, a))
    return _covered(found.withColumn("label", F.col("case_id")) if a.by_case else coverage.suite(found).withColumn("label", F.lit("suite")), a)


def _quiet(text: str) -> float | None:
    return None if text == "none" else float(text)


SIDES = [arg("--threshold-db", type=float, default=channels.THRESHOLD_DB), arg("--quiet-channel-max-dbfs", type=_quiet, default=channels.QUIET_DBFS, help="'none' asks nothing of the quieter side")]


def _levels(held: DataFrame, segments: DataFrame, audio_column: str = "audio") -> DataFrame:
    """Segments with the levels of both sides, measured once; the audio must be stereo and have all spoken ranges."""
    heads = checkpointed(audio.headers(held.select("case_id", F.col(audio_column).alias("audio"))))
    lacking = segments.select("case_id").distinct().join(heads, "case_id", "left_anti").select("case_id", F.lit("the case has no audio").alias("rule"))
    assert_valid(audio.problems(heads), lacking)
    levels = checkpointed(audio.segment_levels(segments, heads))
    assert_valid(audio.silent_ranges(levels))
    return levels


@command("attribute-channels", arg("input"), arg("audio"), *SIDES, arg("--diagnostics-output", help="a row a segment with its levels and the reason, as JSON lines"), LANGUAGE, TAG)
def attribute_channels(spark: SparkSession, a: argparse.Namespace) -> None:
    """A file's spoken MIX segments take the side that its audio decides."""
    held, named = _one(spark, a.input), spark.createDataFrame([("single", os.path.abspath(a.audio))], "case_id string, audio string")
    made = channels.attributed(_levels(named, held), a.threshold_db, a.quiet_channel_max_dbfs)
    if a.diagnostics_output:
        told = made.select("id", "start_ms", "end_ms", "kind", "original_channel", F.col("channel").alias("attributed_channel"), "reason", "left_dbfs", "right_dbfs", (F.col("left_dbfs") - F.col("right_dbfs")).alias("delta_db"))
        told.write.mode("errorifexists").json(a.diagnostics_output)
    _document(_master(spark, made.select(*held.columns), a), "json", a.output)


@command("audit-review-case-channels", arg("index"), arg("--queue", action="store_true"), arg("--by-case", action="store_true"), arg("--fail-on-items", action="store_true"), *SIDES)
def audit_channels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Labelled sides of references against their audio: counts and ratios, or the queue with where to listen."""
    channels.checked([a.threshold_db], [a.quiet_channel_max_dbfs])
    held, ref = _index(spark, a.index)
    found = channels.reference_audit(_levels(held, ref), a.threshold_db, a.quiet_channel_max_dbfs)
    queue = channels.reference_queue(found)
    a.after = (lambda: gates.enforce_empty(queue, "channel audit")) if a.fail_on_items else None
    if a.queue:
        heads = audio.headers(held)
        clips = channels.evidence_clips(queue, audio.range_sums(channels.probes(queue), heads), a.quiet_channel_max_dbfs)
        # what the clip sounds like, of exactly its frames
        heard = audio.segment_levels(clips.select("case_id", "id", F.col("clip_start_ms").alias("start_ms"), F.col("clip_end_ms").alias("end_ms")), heads)
        heard = heard.select("case_id", "id", F.col("left_dbfs").alias("clip_left_dbfs"), F.col("right_dbfs").alias("clip_right_dbfs"), (F.col("left_dbfs") - F.col("right_dbfs")).alias("clip_delta_db"))
        return clips.join(heard, ["case_id", "id"], "left").orderBy(F.desc("priority_score"), "case_id", "ord")
    return channels.summary(found, *["case_id"] * a.by_case)


def _candidates(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """References of an evaluation manifest, and its candidates with the levels of the map's audio."""
    _, ref, cand = _sides(spark, a.manifest)
    return ref, _levels(documents.audio_map(spark, a.audio_map), cand)


@command("audit-candidate-channels", arg("manifest"), arg("--audio-map", required=True), arg("--by-case", action="store_true"), *SIDES)
def audit_candidate_channels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    channels.checked([a.threshold_db], [a.quiet_channel_max_dbfs])
    found = channels.candidate_audit(_candidates(spark, a)[1], a.threshold_db, a.quiet_channel_max_dbfs)
    return channels.summary(found, *["case_id"] * a.by_case)


@command("sweep-channel-attribution", arg("manifest"), arg("--audio-map", required=True), arg("--threshold-db", type=float, action="append"), arg("--quiet-channel-max-dbfs", type=_quiet, action="append"), arg("--reset-speech-channels-to-mix", action="store_true"), *LIMITS)
def sweep_channels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Candidates attributed anew under each pair of settings, evaluated, ranked and, with limits, gated."""
    thresholds, quiets = a.threshold_db or [channels.THRESHOLD_DB], a.quiet_channel_max_dbfs or [channels.QUIET_DBFS]
    channels.checked(thresholds, quiets)
    rows = report.channel_sweep(*_candidates(spark, a), thresholds, quiets, a.reset_speech_channels_to_mix)
    return _gated(rows, a).drop("reason_ranking").orderBy("rank")


def _case_set(index: DataFrame, segments: DataFrame, folder: str, a: argparse.Namespace) -> None:
    """``index.json`` and a reference document a case in a new folder."""
    os.makedirs(folder)
    _case_documents(index, segments, folder, a)
    name = F.concat(F.lit(folder + "/"), "case_id", F.lit(".master.json"))
    _document(manifests.document(index.withColumn("reference", name), "index", a.index_tag), "json", f"{folder}/index.json")


def _case_documents(index: DataFrame, segments: DataFrame, folder: str, a: argparse.Namespace) -> None:
    """A document a case; one at a time passes the driver."""
    assert_valid(index.where(F.col("case_id").rlike("/") | F.col("case_id").isin(".", "..")).select("case_id", F.lit("the case id must be a bare file name").alias("rule")))
    head = index.select("case_id").join(segments.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")), "case_id", "left")
    made = documents.master_json(segments, head.select("case_id", F.lit(a.source_language).alias("source_language"), "duration_ms"), a.tag)
    for r in made.toLocalIterator():
        with open(f"{folder}/{r['case_id']}.master.json", "w", encoding="utf-8") as f:
            f.write(r["json"])


INDEX_TAG = arg("--index-tag", default="lumenspan-case-set-v1")


@command("freeze-case-references", arg("index"), arg("--reference-type"), arg("--reference-notes"), LANGUAGE, TAG, INDEX_TAG)
def freeze_case_references(spark: SparkSession, a: argparse.Namespace) -> None:
    held, ref = _index(spark, a.index)
    assert_valid(violations(ref))
    _case_set(*cases.frozen(held, ref, a.reference_type, a.reference_notes), os.path.abspath(a.output), a)


@command("prepare-review-cases", arg("plan"), LANGUAGE, TAG, INDEX_TAG)
def prepare_review_cases(spark: SparkSession, a: argparse.Namespace) -> None:
    """Slices of sources as a case set of their own: an index, a reference and a clip a case, in a new folder."""
    plan = manifests.read(spark, a.plan, "slices")
    ref = transcripts.read(spark, plan, "reference")
    assert_valid(violations(ref))
    folder = os.path.abspath(a.output)
    index, cut = cases.prepared(ref, plan.withColumn("source_id", F.col("case_id")))
    clips = audio.clips(plan.select("case_id", "start_ms", "end_ms"), audio.headers(plan))
    _case_set(index.withColumn("audio", F.concat(F.lit(folder + "/"), "audio")), cut, folder, a)
    for r in clips.select("case_id", "content").toLocalIterator():  # a clip at a time
        with open(f"{folder}/{r['case_id']}.wav", "wb") as f:
            f.write(r["content"])


COMMAND = arg("--command", dest="program", required=True, help="a program that reads {audio_file, master} and writes {segments} as JSON")


@command("align-transcript", arg("input"), arg("audio"), COMMAND, LANGUAGE, TAG)
def align_transcript(spark: SparkSession, a: argparse.Namespace) -> None:
    """A file's segments with the bounds that an aligner tells."""
    named = spark.createDataFrame([("single", os.path.abspath(a.audio))], "case_id string, audio string")
    after, _ = batches.aligned_cases(_one(spark, a.input), named, batches.command(shlex.split(a.program)))
    _document(_master(spark, after, a), "json", a.output)


@command("align-review-case-candidates", arg("index"), COMMAND, arg("--candidate-id"), arg("--attach-tag", default="lumenspan-attach-plan-v1"), LANGUAGE, TAG)
def align_candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every candidate of a case set aligned: a document a case, the plan to attach them, and ``diagnostics`` by case."""
    held = manifests.read(spark, a.index, "index")
    assert_valid(held.where("candidate is null").select("case_id", F.lit("the case has no candidate").alias("rule")))
    cand = transcripts.read(spark, held, "candidate")
    assert_valid(violations(cand))
    paths = held.select("case_id", F.regexp_replace("audio", "^file:/*", "/").alias("audio"))
    after, told = batches.aligned_cases(cand, paths, batches.command(shlex.split(a.program)))
    folder = os.path.abspath(a.output)
    os.makedirs(folder)
    _case_documents(held, after, folder, a)
    stem = F.regexp_extract(F.element_at(F.split("candidate", "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    ids = F.lit(a.candidate_id) if a.candidate_id else F.concat(F.coalesce("candidate_id", stem), F.lit("-aligned"))
    plan = held.select("case_id", "place", F.concat(F.lit(folder + "/"), "case_id", F.lit(".master.json")).alias("candidate"), ids.alias("candidate_id"))
    _document(manifests.document(plan, "attach", a.attach_tag), "json", f"{folder}/attach-plan.json")
    told.write.json(f"file://{folder}/diagnostics")


@command("save-review-case-reference", arg("index"), arg("case"), arg("input"), LANGUAGE, TAG, INDEX_TAG)
def save_case_reference(spark: SparkSession, a: argparse.Namespace) -> None:
    """The case set with one case's reference replaced, in a new folder."""
    held, ref = _index(spark, a.index)
    _case_set(*cases.saved_reference(held, ref, _one(spark, a.input, a.case)), os.path.abspath(a.output), a)


@command("vad-compare-coverage", arg("index"), arg("intervals", nargs="+", help="files of JSON lines of case_id, start_ms, end_ms"), *LIMITS_OF_COVERAGE)
def vad_compare_coverage(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from lumenspan.operators.comparison import labels

    held, ref = _index(spark, a.index)
    heads, found = checkpointed(audio.headers(held)), {}
    for label, path in zip(labels(a.intervals), a.intervals, strict=True):
        found[label] = detections.read(spark, path)
        assert_valid(detections.problems(found[label], heads))
    return _covered(coverage.compared(ref, heads, found), a).orderBy("rank")


def _told(spark: SparkSession, path: str | None, **columns: str) -> DataFrame | None:
    """Rows that another command wrote under ``-o``, with the columns that are asked for (null where all were)."""
    if path is None:
        return None
    rows = spark.read.json(path)
    return rows.withColumns({c: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind) for c, kind in columns.items()})


COMPARED = {"rank": "int", "practical_cer": "double", "time_aligned_500ms_ratio": "double", "channel_accuracy": "double", "mix_ratio": "double", "edit_ratio": "double", "review_ratio": "double", "timing_edit_segment_ratio": "double", "channel_edit_segment_ratio": "double", "text_edit_segment_ratio": "double"}


@command("pipeline-readiness", arg("--reference-audit"), arg("--reference-channel-audit"), arg("--vad-comparison"), arg("--eval-comparison"), arg("--alignment-comparison"), arg("--channel-comparison"), arg("--candidate-channel-audit"), arg("--require-reference-type"), arg("--fail-unless-asr-only-ready", action="store_true"), arg("--summary", action="store_true"), *LIMITS)
def pipeline_readiness(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The five stages from what other commands wrote: audits by case, audit summaries, and comparisons."""
    cases_of = _told(spark, a.reference_audit, **dict.fromkeys(("review_count", "same_channel_overlap_pair_count", "exact_boundary_same_channel_overlap_pair_count", "long_segment_count", "speech_segment_count", "overlap_pair_count", "cross_channel_overlap_pair_count", "exact_boundary_overlap_pair_count", "pair_overlap_duration_ms", "speech_union_duration_ms", "duration_ms"), "long"), speech_coverage_ratio="double")
    near = None if cases_of is None else cases_of.agg(F.sum((F.col("speech_coverage_ratio") >= audit.HIGH_COVERAGE).cast("long")).alias("near_full_coverage_cases"))
    sides = {c: "long" for c in ("match", "mismatch", "uncertain", "energy_labeled_count")} | {"match_ratio": "double", "mix_ratio": "double"}
    found = readiness.assembled(
        spark, None if cases_of is None else audit.suite(cases_of).crossJoin(near), _told(spark, a.reference_channel_audit, **sides), _told(spark, a.vad_comparison, rank="int", missed_reference_duration_ms="long"),
        *[_told(spark, p, **COMPARED) for p in (a.eval_comparison, a.alignment_comparison, a.channel_comparison)], _told(spark, a.candidate_channel_audit, **sides), _limits(a), a.require_reference_type,
    )
    held = checkpointed(found)
    if a.fail_unless_asr_only_ready:
        a.after = lambda: gates.enforce(readiness.summary(held).select(F.lit("readiness").alias("label"), F.col("asr_only_ready").alias("gate_passed"), F.concat(F.col("blocking_stages"), F.col("unknown_stages")).alias("gate_failures")))
    return readiness.summary(held) if a.summary else held.orderBy("place")


@command("model-digest", arg("folder"))
def model_digest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return documents.snapshot_digest(spark, os.path.abspath(a.folder))[1]


ROOT = arg("--project-root", default="projects")


@command("project-create-audio", arg("input"), arg("--mime-type", default="audio/wav"), ROOT)
def project_create_audio(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    with open(a.input, "rb") as f:
        made = Projects(spark, os.path.abspath(a.project_root)).create_from_audio(os.path.basename(a.input), a.mime_type, f.read())
    return spark.createDataFrame([(made,)], "project_id string")


@command("project-create", arg("input"), LANGUAGE, ROOT)
def project_create(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    made = Projects(spark, os.path.abspath(a.project_root)).create_from_segments(_one(spark, a.input), a.source_language, os.path.basename(a.input))
    return spark.createDataFrame([(made,)], "project_id string")


@command("project-save", arg("project"), arg("input"), ROOT)
def project_save(spark: SparkSession, a: argparse.Namespace) -> None:
    Projects(spark, os.path.abspath(a.project_root)).save_segments(a.project, _one(spark, a.input))


@command("project-show", ROOT)
def project_show(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return Projects(spark, os.path.abspath(a.project_root)).summary()


@command("project-analyze", arg("project"), ROOT)
def project_analyze(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    store = Projects(spark, os.path.abspath(a.project_root))
    store.analyse(a.project)
    return store.chunks(a.project).withColumnRenamed("case_id", "project_id").orderBy("index")


HEARD = [arg("--command", dest="program", required=True, help="a program that reads a clip as WAV, its channel as last argument, and writes {segments} as JSON"), arg("--hears-mix", action="store_true", help="give it the mix, cut by energy, and attribute sides after"), arg("--max-chunk-ms", type=int)]


def _model(a: argparse.Namespace) -> workflow.Model:
    return workflow.Model(workflow.program(shlex.split(a.program)), a.hears_mix, a.max_chunk_ms)


@command("project-transcribe", arg("project"), *HEARD, ROOT)
def project_transcribe(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A project's analysed audio as its segments."""
    store = Projects(spark, os.path.abspath(a.project_root))
    store.save_segments(a.project, checkpointed(workflow.transcribed(store.channels(a.project), store.chunks(a.project), _model(a))))
    return store.segments(a.project).orderBy("ord")


@command("project-retranscribe", arg("project"), arg("--segment", action="append", required=True), *HEARD, ROOT)
def project_retranscribe(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Some of a project's segments heard again; ids that it doesn't have are an error."""
    store = Projects(spark, os.path.abspath(a.project_root))
    held, wanted = store.segments(a.project), spark.createDataFrame([(a.project, x) for x in dict.fromkeys(a.segment)], "case_id string, id string")
    assert_valid(wanted.join(held, ["case_id", "id"], "left_anti").select("case_id", F.concat(F.lit("the project has no segment "), "id").alias("rule")))
    store.save_segments(a.project, checkpointed(workflow.retranscribed(held, store.channels(a.project), wanted, _model(a))))
    return store.segments(a.project).orderBy("ord")


@command("transcribe-review-case-candidates", arg("index"), *HEARD, arg("--candidate-id", required=True), arg("--attach-tag", default="lumenspan-attach-plan-v1"), LANGUAGE, TAG)
def transcribe_candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every case's audio as a candidate: a document a case, the plan to attach them, and rows under ``work``, from
    which a command that was stopped goes on."""
    held = manifests.read(spark, a.index, "index")
    folder = os.path.abspath(a.output)
    os.makedirs(folder, exist_ok=True)
    work = f"file://{folder}/work"
    batches.transcribed_cases(held.select("case_id", "audio"), _model(a), work)
    named = held.withColumn("case_id", F.col("case_id").cast("string"))
    _case_documents(named, batches.candidate_segments(spark, work), folder, a)
    plan = named.select("case_id", "place", F.concat(F.lit(folder + "/"), "case_id", F.lit(".master.json")).alias("candidate"), F.lit(a.candidate_id).alias("candidate_id"))
    _document(manifests.document(plan, "attach", a.attach_tag), "json", f"{folder}/attach-plan.json")


@command("project-export-srt", arg("project"), ROOT)
def project_export_srt(spark: SparkSession, a: argparse.Namespace) -> None:
    _document(srt.formatted(Projects(spark, os.path.abspath(a.project_root)).segments(a.project)), "content", a.output)


@command("project-export-master", arg("project"), LANGUAGE, TAG, ROOT)
def project_export_master(spark: SparkSession, a: argparse.Namespace) -> None:
    held = Projects(spark, os.path.abspath(a.project_root)).segments(a.project)
    _document(_master(spark, held.withColumn("case_id", F.lit("single")), a), "json", a.output)


@command("project-export-translation", arg("project"), arg("--tag", default="lumenspan-translation-v1"), ROOT)
def project_export_translation(spark: SparkSession, a: argparse.Namespace) -> None:
    _document(_translation(Projects(spark, os.path.abspath(a.project_root)).segments(a.project), a.tag), "json", a.output)


WRITES_A_FILE = {transcribe_candidates, align_transcript, align_candidates, prepare_review_cases, project_export_master, project_export_translation, srt_to_json, json_to_srt, export_translation, freeze_reference, slice_case, build_attach_plan, attach_candidates, build_eval_manifest, project_export_srt, attribute_channels, freeze_case_references, save_case_reference}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenspan")
    subs = out.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        one = subs.add_parser(name)
        for names, settings in arguments:
            one.add_argument(*names, **settings)
        one.add_argument("-o", "--output", required=f in WRITES_A_FILE)
        one.set_defaults(run=f, after=None)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        session = spark or get_session()
        rows = a.run(session, a)
        if rows is not None:
            if a.output:
                rows.write.mode("errorifexists").json(a.output)
            else:
                for r in rows.toLocalIterator():
                    print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))
            if "gate_passed" in rows.columns:
                gates.enforce(rows, "label" if "label" in rows.columns else "case_id")
        if a.after:
            a.after()
    except (OSError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
