"""Model output, comparison, gates, packs, case sets, manifests, projects and the audio workflow, on golden values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SEG, segs

from lumenspan.functions import hooks
from lumenspan.functions import model_output as M
from lumenspan.operators import cases, channels, comparison, gates, packs
from lumenspan.plans import workflow
from lumenspan.sources import manifests, wav
from lumenspan.sources.projects import Projects, safe_extension


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def tone(*parts, rate=1000):
    """Stereo audio at a sample a millisecond: (milliseconds, left, right) of constant samples."""
    return wav.encode(np.concatenate([np.tile([a, b], (n, 1)) for n, a, b in parts]).astype(np.int16), rate)


def test_model_segments_and_their_problems(spark):
    good = {"start_ms": 0, "end_ms": 10, "channel": "L", "kind": "speech", "text": "x"}
    fenced = "```json\n" + json.dumps({"segments": [good, good | {"needs_review": True}]}) + "\n```"
    outs = [("a", fenced), ("b", "no"), ("c", "{}"), ("d", json.dumps({"segments": [good | {"start_ms": True}, good | {"channel": "X"}, good | {"end_ms": 0}, good | {"text": 1}]})), ("e", '{"segments": []}'), ("f", None)]
    got = M.model_segments(spark.createDataFrame(outs, "case_id string, content string")).orderBy("case_id", "ord").collect()
    assert [(r.case_id, r.id, r.start_ms, r.end_ms, r.needs_review, r.problem) for r in got if r.case_id == "a"] == [("a", "seg_000001", 0, 10, False, None), ("a", "seg_000002", 0, 10, True, None)]
    assert [(r.case_id, r.problem) for r in got if r.case_id != "a"] == [("b", "the output isn't JSON"), ("c", "the output has no array of segments"), ("d", "a time isn't an integer"), ("d", "channel is unknown"), ("d", "the time range isn't valid"), ("d", "channel, kind and text must be strings"), ("f", "the output isn't JSON")]


def test_tagged_text_parts_at_silence(spark):
    outs = [("a", "_ [T:25] ねえ [T:50] ここ [T:70] _ [T:110] きて [T:160]", 0, 2000, 2000), ("b", "ねえ", 0, 500, 500), ("c", "", 0, 500, 500), ("d", "_ [T:25] _ [T:40]", 0, 500, 500)]
    df = spark.createDataFrame(outs, "case_id string, text string, start_ms long, end_ms long, duration_ms long").withColumn("channel", F.lit("L"))
    got = rows(M.tagged_segments(df).orderBy("case_id", "ord"), "case_id", "id", "start_ms", "end_ms", "text", "needs_review")
    assert got == [("a", "seg_000001", 250, 700, "ねえここ", True), ("a", "seg_000002", 1100, 1600, "きて", True), ("b", "seg_000001", 0, 500, "ねえ", True)]


def test_activation_and_word_bounds(spark):
    one = spark.range(1)
    r = one.select(M.activated(F.array(F.lit(0.0), F.lit(100.0)), "sigmoid").alias("s"), M.activated(F.array(F.lit(-1.0), F.lit(2.0)), "identity").alias("i")).first()
    assert (r.s[0], round(r.s[1], 9), r.i) == (0.5, 1.0, [0.0, 1.0])
    with pytest.raises(ValueError):
        M.activated(F.array(), "relu")
    bounds = lambda a, b: one.select(M.word_bounds(F.array(*map(F.lit, a)).cast("array<double>"), F.array(*map(F.lit, b)).cast("array<double>"), F.lit(1000)).alias("x")).first().x
    assert tuple(bounds([0.2, 0.1], [0.3, 0.9])) == (100, 900, True)
    assert tuple(bounds([0.2], [0.25])) == tuple(bounds([], [])) == (0, 1000, False)


def test_reason_ranking_labels_and_backfill(spark):
    names = "label string, text_edit_segments long, channel_edit_segments long, timing_edit_segments long, missing_reference_segments long, extra_candidate_segments long, reference_segments long"
    df = comparison.with_reasons(comparison.backfilled(spark.createDataFrame([("a", 1, 2, 2, 0, 1, 3), ("b", 0, 0, 0, 0, 0, 0)], names)))
    a, b = df.orderBy("label").collect()
    assert (a.dominant_reason, a.dominant_ratio, [x.reason for x in a.reason_ranking]) == ("channel", 0.5, ["channel", "timing", "text", "extra_candidate", "missing_reference"])
    assert (b.dominant_reason, b.dominant_ratio) == (None, None)
    assert comparison.labels(["x/a.json", "y/a.json", "a#2.json", "a.json"]) == ["a", "a#2", "a#2#2", "a#3"]
    ids = spark.createDataFrame([("r", "m"), ("r", None), ("s", "m"), ("s", "n")], "label string, candidate_id string")
    assert sorted(rows(comparison.single_candidate(ids, "label"), "label", "candidate_id")) == [("r", "m"), ("s", None)]
    sets = comparison.case_set_errors({"p": spark.createDataFrame([("1",), ("2",)], "case_id string"), "q": spark.createDataFrame([("1",)], "case_id string")})
    assert rows(sets, "label", "case_id") == [("q", "2")]


def test_gates(spark):
    assert gates.thresholds(True, max_practical_cer=0.2, min_500ms_ratio=None)["max_practical_cer"] == 0.2
    assert gates.thresholds() == {}
    for bad in ({"max_mix_ratio": 1.5}, {"other": 0.1}):
        with pytest.raises(ValueError):
            gates.thresholds(**bad)
    suites = spark.createDataFrame([("a", None, 0, 1.0, None), ("b", 9000, 5, 0.5, 0.9)], "label string, detected_max_interval_ms long, missed_reference_duration_ms long, reference_recall double, detected_precision double")
    held = gates.coverage_gate(suites, max_interval_ms=8000, max_missed_ms=0, min_recall=0.9, min_precision=0.8).orderBy("label").collect()
    assert [(r.gate_passed, r.gate_failures) for r in held] == [(False, ["detected_precision is unavailable"]), (False, ["detected_max_interval_ms is over 8000", "missed_reference_duration_ms is over 0", "reference_recall is under 0.9"])]
    with pytest.raises(gates.GateError, match="2 rows"):
        gates.enforce(gates.coverage_gate(suites, min_precision=0.95))
    gates.enforce(gates.coverage_gate(suites, max_missed_ms=5))
    with pytest.raises(ValueError):
        gates.enforce(gates.coverage_gate(suites))
    typed = spark.createDataFrame([("a", "human-reviewed"), ("b", None), ("c", "")], "case_id string, reference_type string")
    assert sorted(rows(gates.reference_type_failures(typed), "case_id", "reference_type")) == [("b", "unspecified"), ("c", "unspecified")]
    queue = spark.createDataFrame([(["x"],), ([],)], "reasons array<string>")
    with pytest.raises(gates.GateError, match="x 1"):
        gates.enforce_empty(queue, "audit")
    gates.enforce_empty(queue.limit(0), "audit")


QUEUE = "case_id string, reference_id string, candidate_id string, start_ms long, end_ms long, reasons array<string>, priority_rank long, review_clip_start_ms long, review_clip_end_ms long"


def test_review_pack_bounds_names_and_clips(spark):
    queue = spark.createDataFrame([("a", "seg_000001", None, 1000, 2000, ["text"], 1, None, None), ("a", None, "c/1", 2500, 3000, ["timing"], 2, 2600, 2800), (None, None, None, 0, 10, [], 3, None, None)], QUEUE)
    durations = spark.createDataFrame([("a", 3000)], "case_id string, duration_ms long")
    pack = packs.review_pack(queue, durations).orderBy("priority_rank")
    assert rows(pack, "clip_start_ms", "clip_end_ms", "clip_file") == [(500, 2500, "000001__a__text__seg_000001__no-cand.wav"), (2100, 3000, "000002__a__timing__no-ref__c-1.wav"), (None, None, "000003__single__unknown__no-ref__no-cand.wav")]
    assert rows(packs.missing_audio(pack), "case_id") == [(None,)]
    s = packs.duration_summary(pack.where("case_id = 'a'")).first()
    assert (s.clip_count, s.source_item_duration_ms_sum, s.effective_item_duration_ms_sum, s.clip_duration_ms_sum, s.clip_duration_ms_max, s.focus_item_count) == (2, 1500, 1200, 2900, 2000, 1)
    assert packs.duration_summary(pack.limit(0)).first().clip_duration_ms_sum == 0
    audio = spark.createDataFrame([("a", bytearray(tone((3000, 5, 6))))], "case_id string, content binary")
    got = {r.clip_file: wav.info(bytes(r.content))["duration_ms"] for r in packs.clips(pack, audio).collect()}
    assert sorted(got.values()) == [900, 2000]
    bad = spark.createDataFrame([("a", None, None, 5, 5, [], 1, None, None), ("b", None, None, 0, 9, [], 2, 1, None), ("c", None, None, 0, 9, [], 3, 1, 10)], QUEUE)
    assert [r for r in rows(packs.pack_violations(bad).orderBy("case_id"), "case_id", "rule")] == [("a", "the item's range is empty"), ("b", "the focus needs both bounds"), ("c", "the focus isn't within the item")]


def flagged(df, *ids):
    return df.withColumn("needs_review", F.col("id").isin(*ids))


def test_flagged_queue_and_neighbours(spark):
    a = flagged(segs(spark, [(0, 10, "L", "x"), (10, 30, "L", "y"), (30, 60, "R", "z")], "a"), "seg_000001", "seg_000003")
    b = flagged(segs(spark, [(0, 7, "L", "x")], "b"), "seg_000001")
    order = spark.createDataFrame([("b", 0), ("a", 1)], "case_id string, place long")
    assert rows(packs.flagged_queue(a.unionByName(b), order).orderBy("priority_rank"), "case_id", "reference_id", "priority_score", "priority_rank") == [("b", "seg_000001", 7.0, 1), ("a", "seg_000001", 10.0, 2), ("a", "seg_000003", 30.0, 3)]
    assert rows(packs.neighbours(a.unionByName(b)).orderBy("case_id", "ord"), "previous_review_id", "next_review_id") == [("seg_000003", "seg_000003"), ("seg_000001", "seg_000003"), ("seg_000001", "seg_000001"), (None, None)]
    assert spark.range(1).select(packs.clock(F.lit(65_007))).first()[0] == "1:05.007"


def test_prepare_freeze_save_and_attach(spark):
    source = segs(spark, [(0, 1000, "L", "x"), (900, 2000, "R", "y"), (3000, 4000, "L", "z")], "s")
    plan = spark.createDataFrame([("c1", "s", 500, 2500), ("c2", "s", 2500, 5000), ("c3", "s", 5000, 6000)], "case_id string, source_id string, start_ms long, end_ms long")
    index, cut = cases.prepared(source, plan)
    assert sorted(rows(index, "case_id", "segments", "review_count", "reference")) == [("c1", 2, 1, "c1.master.json"), ("c2", 1, 0, "c2.master.json"), ("c3", 0, 0, "c3.master.json")]
    assert rows(cut.orderBy("case_id", "ord"), "case_id", "id", "start_ms", "end_ms", "needs_review") == [("c1", "seg_000001", 0, 500, True), ("c1", "seg_000002", 400, 1500, False), ("c2", "seg_000001", 500, 1500, False)]
    with pytest.raises(ValueError, match="bare"):
        cases.prepared(source, plan.withColumn("case_id", F.concat(F.lit("x/"), "case_id")))
    kept, held = cases.frozen(index, cut, "human-reviewed")
    assert {r.review_count for r in kept.collect()} == {0} and {r.reference_type for r in kept.collect()} == {"human-reviewed"}
    assert held.where("needs_review").count() == 0
    now, _ = cases.saved_reference(index, cut, segs(spark, [(0, 5, "L", "new")], "c3"))
    assert sorted(rows(now, "case_id", "segments")) == [("c1", 2), ("c2", 1), ("c3", 1)]
    with pytest.raises(ValueError, match="lacks"):
        cases.saved_reference(index, cut, segs(spark, [(0, 5, "L", "new")], "c9"))
    listing = spark.createDataFrame([("d/c1.srt",), ("d/c2.master.json",), ("d/c3.json",), ("d/other.txt",)], "path string")
    found = cases.attach_plan(index, listing)
    assert sorted(rows(found, "case_id", "candidate")) == [("c1", "d/c1.srt"), ("c2", "d/c2.master.json"), ("c3", "d/c3.json")]
    for path, rule in (("d/c1.json", "several"), (None, "no candidate")):
        other = listing.unionByName(spark.createDataFrame([(path,)], "path string")) if path else listing.where("path not like '%c1%'")
        with pytest.raises(ValueError, match=rule):
            cases.attach_plan(index, other)
    both = cases.attached(index, found.withColumn("candidate_id", F.when(F.col("case_id") == "c1", F.lit("own"))), "model")
    assert sorted(rows(both, "case_id", "candidate_id")) == [("c1", "own"), ("c2", "model"), ("c3", "model")]
    with pytest.raises(ValueError):
        cases.attached(index, found.where("case_id <> 'c2'"))
    made = cases.eval_manifest(cases.attached(index, found))
    assert sorted(rows(made, "case_id", "candidate_id", "reference_type")) == [("c1", "c1", "unspecified"), ("c2", "c2.master", "unspecified"), ("c3", "c3", "unspecified")]


def test_status_counts_and_issues(spark):
    index = spark.createDataFrame([("a", "a.wav", "a.json", 2, 1), ("b", "b.wav", "b.json", 5, None)], "case_id string, audio string, reference string, segments long, review_count long")
    files = spark.createDataFrame([("a.wav",), ("a.json",), ("b.json",)], "path string")
    refs = flagged(segs(spark, [(0, 10, "L", "x"), (10, 30, "L", "y")], "a"), "seg_000002").unionByName(segs(spark, [(0, 4, "L", "x")], "b"))
    found = cases.status(index, files, refs)
    assert rows(found.orderBy("case_id"), "reference_review_duration_ms", "first_review_id", "missing_file_count", "issues") == [(20, "seg_000002", 0, []), (0, None, 1, ["audio file is missing: b.wav", "reference has 1 segments, the index 5"])]
    s = cases.status_summary(found).first()
    assert (s.case_count, s.missing_file_count, s.case_issue_count, s.reference_review_count, s.next_review_case_id, s.ok) == (2, 1, 1, 1, "a", False)
    with pytest.raises(ValueError, match="no candidate|missing"):
        cases.eval_manifest(index.withColumn("candidate", F.lit("c")), found)


def test_alignment_counts_boundaries(spark):
    before, after = segs(spark, [(0, 1000, "L", "x")]), segs(spark, [(120, 40100, "L", "x")])
    one = hooks.alignment_diagnostics(before, after)
    r = one.first()
    assert (r.mean_delta_ms, r.max_delta_ms, r.boundary_count, r.within_250ms, r.within_250ms_ratio, r.changed) == (19610.0, 39100, 2, 1, 0.5, 1)
    s = cases.alignment_summary(one).first()
    assert (s.mean_delta_ms, s.boundary_count, s.within_250ms_ratio) == (19610.0, 2, 0.5)
    assert cases.alignment_summary(one.limit(0)).first().mean_delta_ms is None


def test_channel_histograms(spark):
    df = channels.attributed(segs(spark, [(0, 9, "MIX", "x"), (0, 9, "L", "y")]).withColumn("left_dbfs", F.lit(-10.0)).withColumn("right_dbfs", F.lit(-50.0)))
    assert sorted(rows(channels.histograms(df), "field", "value", "n")) == [("attributed_channel", "L", 2), ("original_channel", "L", 1), ("original_channel", "MIX", 1), ("reason", "left_dominant", 1), ("reason", "skipped_existing_channel", 1)]
    assert channels.diagnostics(df).first().mix_speech_segments == 1


def test_manifests_are_checked_and_written(spark, tmp_path):
    def file(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    case = {"id": "a", "reference": "r.json", "candidate": "/abs/c.srt"}
    good = file("good.json", {"format": "eval-v1", "reference_type": "machine", "cases": [case, case | {"id": "b", "reference_type": "human"}]})
    got = manifests.read(spark, good, "eval").orderBy("place").collect()
    assert [(r.case_id, r.candidate, r.reference_type) for r in got] == [("a", "/abs/c.srt", "machine"), ("b", "/abs/c.srt", "human")]
    assert got[0].reference.endswith(f"{tmp_path.name}/r.json")
    slot = {"id": "a", "audio": "a.wav", "reference": "r", "start_ms": 0, "end_ms": 9}
    for name, kind, value, rule in (
        ("x1", "eval", {"format": "f", "cases": [case, case]}, "repeated"),
        ("x2", "eval", {"format": "f", "cases": []}, "entries"),
        ("x3", "eval", {"cases": [case]}, "tag"),
        ("x4", "eval", {"format": "f", "cases": [case | {"candidate": ""}]}, "candidate"),
        ("x5", "slices", {"format": "f", "cases": [slot | {"end_ms": 0}]}, "empty"),
        ("x6", "slices", {"format": "f", "cases": [slot | {"start_ms": True}]}, "integer"),
        ("x7", "slices", {"format": "f", "cases": [slot | {"candidate_id": "m"}]}, "needs a candidate"),
        ("x8", "index", {"format": "f", "items": [{"id": "a", "audio": "w", "reference": "r", "segments": "2"}]}, "integer"),
        ("x9", "attach", {"format": "f", "candidates": [{"case_id": 1, "candidate": "c"}]}, "case_id"),
    ):
        with pytest.raises(ValueError, match=rule):
            manifests.read(spark, file(name, value), kind)
    table = spark.createDataFrame([("a", "r", "c", None)], "case_id string, reference string, candidate string, candidate_id string")
    assert json.loads(manifests.document(table, "eval", "f", reference_type="x", reference_notes=None).first().json) == {"format": "f", "reference_type": "x", "cases": [{"id": "a", "reference": "r", "candidate": "c"}]}


def test_projects_save_and_analyse(spark, tmp_path):
    store = Projects(spark, f"file://{tmp_path}/store")
    assert store.summary().count() == 0
    one = store.create_from_segments(segs(spark, [(0, 10, "L", "x"), (10, 20, "R", "y")]), "ja")
    other = store.create_from_audio("Some.WAV", "audio/wav", tone((500, 100, 300)))
    assert rows(store.segments(one).orderBy("ord"), "case_id", "text") == [(one, "x"), (one, "y")]
    store.save_segments(one, store.segments(one).where("text = 'x'"))
    assert rows(store.segments(one), "text") == [("x",)] and store.segments(other).count() == 0
    store.save_segments(one, store.segments(one).limit(0))
    assert store.segments(one).count() == 0
    assert store.analyse(other, 200)["duration_ms"] == 500
    assert store.table("chunks").count() == 3 and wav.decode(store.audio(other, "MIX"))[0][0, 0] == 200
    assert wav.decode(store.audio(other))[0].shape == (500, 2)
    for bad in (lambda: store.project("../x"), lambda: store.project("0" * 32), lambda: store.audio(one), lambda: store.create_from_audio("a", "", b"x"), lambda: store.save_segments(one, segs(spark, [(5, 5, "L", "x")]))):
        with pytest.raises(ValueError):
            bad()
    assert [safe_extension(x) for x in ("a.MP3", "a", ".wav", "a.toolongending", "a.b c", "x/y.tar.gz")] == [".mp3", ".bin", ".bin", ".bin", ".bin", ".gz"]


def test_a_save_counts_once_its_entry_is_there(spark, tmp_path):
    store = Projects(spark, f"file://{tmp_path}/store")
    one = store.create_from_segments(segs(spark, [(0, 10, "L", "x"), (10, 20, "R", "y")]), "ja", duration_ms=20)
    # a save that stopped before its entry is never read
    store._put("segments", one, segs(spark, [(0, 10, "L", "half")]))
    assert rows(store.segments(one).orderBy("ord"), "text") == [("x",), ("y",)] and store.summary().first().segments == 2
    # a reader that has begun keeps what it read through a save; older versions go
    began = store.segments(one)
    store.save_segments(one, began.withColumn("text", F.concat("text", F.lit("2"))))
    assert rows(began.orderBy("ord"), "text") == [("x",), ("y",)]
    versions = lambda: len(list((tmp_path / "store" / "segments" / f"project_id={one}").iterdir()))
    assert versions() == 3
    for _ in range(3):
        store.save_segments(one, store.segments(one).withColumn("text", F.concat("text", F.lit("+"))))
    assert versions() == 3 and rows(store.segments(one).orderBy("ord"), "text") == [("x2+++",), ("y2+++",)]  # two and the stopped one
    # two changes that began from the same entry: neither undoes the other's table, of one table one stays whole
    number = store._known(one)["number"]
    store._note(one, number + 1, segments=store._put("segments", one, segs(spark, [(0, 5, "L", "a"), (5, 9, "L", "a")])))
    store._note(one, number + 1, duration_ms=99)
    store._note(one, number + 1, segments=store._put("segments", one, segs(spark, [(0, 5, "L", "b"), (5, 9, "L", "b")])))
    assert store.project(one)["duration_ms"] == 99 and store.project(one)["source_language"] == "ja"
    assert rows(store.segments(one), "text") in ([("a",)] * 2, [("b",)] * 2)
    assert store.table("segments").count() == 2


def test_transcription_workflow(spark):
    def heard(content, channel):
        frames, _ = wav.decode(content)
        return [{"start_ms": 0, "end_ms": len(frames), "text": f"{channel} {len(frames)}"}]

    audio = spark.createDataFrame([("a", bytearray(tone((1000, 9000, 1), (1500, 0, 0), (1000, 1, 9000))))], "case_id string, content binary")
    info, parts = wav.analysed(audio)
    assert info.first().duration_ms == 3500
    chunks = spark.createDataFrame([("a", 0, 2000), ("a", 2000, 3500)], "case_id string, start_ms long, end_ms long")
    both = workflow.transcribed(parts, chunks, workflow.Model(heard))
    assert rows(both.orderBy("ord"), "start_ms", "end_ms", "channel", "text") == [(0, 2000, "L", "L 2000"), (0, 2000, "R", "R 2000"), (2000, 3500, "L", "L 1500"), (2000, 3500, "R", "R 1500")]
    mix = workflow.transcribed(parts, chunks, workflow.Model(heard, mix_first=True, max_chunk_ms=1000))
    assert rows(mix.orderBy("ord"), "id", "start_ms", "end_ms", "channel", "text") == [("seg_000001", 0, 1000, "L", "MIX 1000"), ("seg_000002", 1000, 1200, "MIX", "MIX 200"), ("seg_000003", 2300, 3300, "R", "MIX 1000"), ("seg_000004", 3300, 3500, "R", "MIX 200")]
    again = workflow.retranscribed(both, parts, spark.createDataFrame([("a", "seg_000003")], "case_id string, id string"), workflow.Model(heard, max_chunk_ms=1000))
    assert rows(again.orderBy("ord"), "id", "start_ms", "end_ms", "channel", "text") == [("seg_000001", 0, 2000, "L", "L 2000"), ("seg_000002", 0, 2000, "R", "R 2000"), ("seg_000003", 2000, 3000, "L", "L 1000"), ("seg_000004", 2000, 3500, "R", "R 1500"), ("seg_000005", 3000, 3500, "L", "L 500")]
    silent = workflow.retranscribed(both, parts, spark.createDataFrame([("a", "seg_000003")], "case_id string, id string"), workflow.Model(lambda content, channel: []))
    assert silent.count() == 4
    tops = rows(wav.peaks(audio, 7).orderBy("bucket"), "peak")
    assert [round(p * 32768) for (p,) in tops] == [9000, 9000, 0, 0, 0, 9000, 9000]
