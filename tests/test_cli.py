"""The command line, end to end in temporary folders."""

import json
import sys

import numpy as np
import pytest

from lumenspan.cli import main
from lumenspan.sources import wav

REF = "1\n00:00:00,000 --> 00:00:01,000\n[L]ねえ\n\n2\n00:00:01,500 --> 00:00:02,500\n[R]きて\n"


@pytest.fixture
def home(tmp_path):
    def file(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return file


def test_conversions_and_slices(spark, home, tmp_path, capsys):
    source, out = home("a.srt", REF), str(tmp_path / "a.json")
    assert main(["srt-to-json", source, "-o", out], spark) == 0
    made = json.loads(open(out).read())
    assert [(s["id"], s["channel"], s["text"], s["start_ms"]) for s in made["segments"]] == [("seg_000001", "L", "ねえ", 0), ("seg_000002", "R", "きて", 1500)]
    items = str(tmp_path / "t.json")
    assert main(["export-translation-json", out, "-o", items], spark) == 0
    assert json.loads(open(items).read())["items"] == [{"id": "seg_000001", "text": "ねえ"}, {"id": "seg_000002", "text": "きて"}]
    done = home("done.json", json.dumps({"format": "x", "items": [{"id": "seg_000001", "text": "hey"}, {"id": "seg_000002", "text": "come"}]}))
    assert main(["json-to-srt", out, "--translated", done, "-o", str(tmp_path / "b.srt")], spark) == 0
    assert "hey" in (tmp_path / "b.srt").read_text() and "ねえ" not in (tmp_path / "b.srt").read_text()
    less = home("less.json", json.dumps({"format": "x", "items": [{"id": "seg_000001", "text": "hey"}]}))
    assert main(["json-to-srt", out, "--translated", less, "-o", str(tmp_path / "c.srt")], spark) == 1
    assert not (tmp_path / "c.srt").exists()
    audio = home("a.wav", wav.encode(np.zeros((3000, 2), np.int16), 1000))
    assert main(["slice-case", out, "--start-ms", "500", "--end-ms", "2000", "--audio", audio, "--audio-output", str(tmp_path / "s.wav"), "-o", str(tmp_path / "s.json")], spark) == 0
    assert wav.info((tmp_path / "s.wav").read_bytes())["duration_ms"] == 1500
    assert [(s["start_ms"], s["end_ms"], s["needs_review"]) for s in json.loads((tmp_path / "s.json").read_text())["segments"]] == [(0, 500, True), (1000, 1500, True)]
    assert main(["freeze-reference", str(tmp_path / "s.json"), "-o", str(tmp_path / "f.json")], spark) == 0
    assert not any(s["needs_review"] for s in json.loads((tmp_path / "f.json").read_text())["segments"])
    assert main(["srt-to-json", home("bad.srt", "1\nno time\nx\n"), "-o", out], spark) == 1
    capsys.readouterr()


def test_case_set_to_gated_evaluation(spark, home, tmp_path, capsys):
    for name in ("c1", "c2"):
        home(f"{name}.wav", wav.encode(np.zeros((3000, 2), np.int16), 1000))
        home(f"{name}.srt", REF)
    (tmp_path / "cands").mkdir()
    home("cands/c1.srt", REF)
    home("cands/c2.srt", REF.replace("きて", "まって"))
    item = lambda n: {"id": n, "audio": f"{n}.wav", "reference": f"{n}.srt"}
    index = home("index.json", json.dumps({"format": "x", "reference_type": "human-reviewed", "items": [item("c1"), item("c2")]}))
    plan, full, manifest = (str(tmp_path / n) for n in ("plan.json", "full.json", "manifest.json"))
    assert main(["build-candidate-attach-plan", index, str(tmp_path / "cands"), "-o", plan], spark) == 0
    assert main(["attach-review-case-candidates", index, plan, "-o", full], spark) == 0
    assert main(["build-eval-manifest", full, "-o", manifest], spark) == 0
    assert [c["id"] for c in json.loads(open(manifest).read())["cases"]] == ["c1", "c2"]
    capsys.readouterr()
    assert main(["eval-manifest", manifest, "--by-case"], spark) == 0
    one, two = sorted(map(json.loads, capsys.readouterr().out.splitlines()), key=lambda r: r["case_id"])
    assert (one["practical_cer"], two["practical_cer"], two["segments_needing_edit"], two["dominant_reason"], two["reference_match_ratio"]) == (0.0, 0.5, 1, "text", 1.0)
    assert main(["eval-manifest", manifest, "--product-gate"], spark) == 1
    got = capsys.readouterr()
    suite = json.loads(got.out)
    assert (suite["case_count"], suite["practical_edit_distance"], suite["practical_cer"], suite["gate_passed"]) == (2, 2, 0.25, False)
    assert suite["gate_failures"] == ["practical_cer fails max_practical_cer", "edit_ratio fails max_edit_ratio"] and "gate" in got.err
    assert main(["eval-manifest", manifest, "--max-practical-cer", "0.3", "--require-reference-type", "machine"], spark) == 1
    assert main(["eval-manifest", manifest, "--max-practical-cer", "0.3"], spark) == 0
    capsys.readouterr()
    assert main(["review-effort", manifest], spark) == 0
    assert [(json.loads(x)["case_id"], json.loads(x)["reasons"]) for x in capsys.readouterr().out.splitlines()] == [("c2", ["text"])]
    assert main(["review-case-status", full], spark) == 0
    assert [json.loads(x)["issues"] for x in capsys.readouterr().out.splitlines()] == [[], []]
    assert main(["audit-review-case-references", full, "--fail-on-items"], spark) == 0
    (tmp_path / "vad.json").write_text('{"case_id": "c1", "start_ms": 0, "end_ms": 2500}\n{"case_id": "c2", "start_ms": 0, "end_ms": 1000}\n')
    capsys.readouterr()
    assert main(["vad-coverage-cases", full, "--intervals", str(tmp_path / "vad.json"), "--min-reference-recall", "0.9"], spark) == 1
    assert json.loads(capsys.readouterr().out)["missed_reference_duration_ms"] == 1000
    assert main(["eval-manifest", home("no.json", "{}")], spark) == 1


def test_projects(spark, home, tmp_path, capsys):
    root = str(tmp_path / "store")
    audio = home("a.wav", wav.encode(np.zeros((400, 2), np.int16), 1000))
    assert main(["project-create-audio", audio, "--project-root", root], spark) == 0
    made = json.loads(capsys.readouterr().out)["project_id"]
    assert main(["project-analyze", made, "--project-root", root], spark) == 0
    assert json.loads(capsys.readouterr().out)["end_ms"] == 400
    assert main(["project-save", made, home("a.srt", REF), "--project-root", root], spark) == 0
    assert main(["project-export-srt", made, "--project-root", root, "-o", str(tmp_path / "o.srt")], spark) == 0
    assert "きて" in (tmp_path / "o.srt").read_text()
    assert main(["project-show", "--project-root", root], spark) == 0
    assert json.loads(capsys.readouterr().out)["segments"] == 2
    assert main(["project-analyze", "nope", "--project-root", root], spark) == 1


def test_transcription_by_a_program(spark, home, tmp_path, capsys):
    program = home("asr.py", "import sys, wave, io, json\nw = wave.open(io.BytesIO(sys.stdin.buffer.read()))\nn = w.getnframes() * 1000 // w.getframerate()\nprint(json.dumps({'segments': [{'start_ms': 0, 'end_ms': n, 'text': f'{sys.argv[-1]} {n}'}]}))\n")
    run, root = f"{sys.executable} {program}", str(tmp_path / "store")
    rows = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    frames = np.full((2500, 2), 9000, np.int16)
    audio = home("a.wav", wav.encode(frames, 1000))
    assert main(["project-create-audio", audio, "--project-root", root], spark) == 0
    made = rows()[0]["project_id"]
    assert main(["project-transcribe", made, "--command", run, "--project-root", root], spark) == 1  # not analysed
    assert main(["project-analyze", made, "--project-root", root], spark) == 0
    capsys.readouterr()
    assert main(["project-transcribe", made, "--command", run, "--max-chunk-ms", "2000", "--project-root", root], spark) == 0
    got = [(r["id"], r["start_ms"], r["end_ms"], r["channel"], r["text"]) for r in rows()]
    assert got == [("seg_000001", 0, 2000, "L", "L 2000"), ("seg_000002", 0, 2000, "R", "R 2000"), ("seg_000003", 2000, 2500, "L", "L 500"), ("seg_000004", 2000, 2500, "R", "R 500")]
    assert main(["project-retranscribe", made, "--segment", "seg_000002", "--command", run, "--max-chunk-ms", "1500", "--project-root", root], spark) == 0
    assert sorted((r["start_ms"], r["end_ms"], r["channel"], r["text"]) for r in rows()) == [(0, 1500, "R", "R 1500"), (0, 2000, "L", "L 2000"), (1500, 2000, "R", "R 500"), (2000, 2500, "L", "L 500"), (2000, 2500, "R", "R 500")]
    assert main(["project-retranscribe", made, "--segment", "seg_000099", "--command", run, "--project-root", root], spark) == 1
    assert main(["project-transcribe", made, "--command", f"{sys.executable} -c 1", "--project-root", root], spark) == 1
    home("r.srt", REF)
    index, out = home("index.json", json.dumps({"format": "x", "items": [{"id": c, "audio": "a.wav", "reference": "r.srt"} for c in ("p", "q")]})), tmp_path / "set"
    assert main(["transcribe-review-case-candidates", index, "--command", run, "--candidate-id", "m", "-o", str(out)], spark) == 0
    plan = json.loads((out / "attach-plan.json").read_text())
    assert [(c["case_id"], c["candidate_id"]) for c in plan["candidates"]] == [("p", "m"), ("q", "m")]
    assert [s["text"] for s in json.loads((out / "q.master.json").read_text())["segments"]] == ["L 2500", "R 2500"]
    # a rerun hears nothing anew: a program that fails isn't called
    assert main(["transcribe-review-case-candidates", index, "--command", f"{sys.executable} -c 1", "--candidate-id", "m", "-o", str(out)], spark) == 0


def test_channel_commands_case_sets_and_coverage(spark, home, tmp_path, capsys):
    # the left side speaks in the first second, the right one in the rest; the second label is wrong
    frames = np.zeros((2500, 2), np.int16)
    frames[:1000, 0], frames[1000:, 1] = 8000, 8000
    audio = home("c1.wav", wav.encode(frames, 1000))
    srt = REF.replace("[R]", "[L]")
    home("c1.srt", srt)
    index = home("index.json", json.dumps({"format": "x", "reference_type": "human-reviewed", "items": [{"id": "c1", "audio": "c1.wav", "reference": "c1.srt", "candidate": "c1.srt"}]}))
    rows = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert main(["audit-review-case-channels", index], spark) == 0
    (got,) = rows()
    assert (got["match"], got["mismatch"], got["uncertain"], got["match_ratio"]) == (1, 1, 0, 0.5)
    assert main(["audit-review-case-channels", index, "--queue", "--fail-on-items"], spark) == 1
    (got,) = rows()
    assert (got["text"], got["reasons"], got["clip_start_ms"], got["clip_end_ms"]) == ("きて", ["reference-channel-energy-mismatch"], 1500, 2500)
    home("c1.map.json", json.dumps({"c1": "c1.wav"}))
    manifest, amap = home("m.json", json.dumps({"format": "x", "cases": [{"id": "c1", "reference": "ref.srt", "candidate": "c1.srt"}]})), str(tmp_path / "c1.map.json")
    home("ref.srt", REF)
    assert main(["audit-candidate-channels", manifest, "--audio-map", amap, "--by-case"], spark) == 0
    (got,) = rows()
    assert (got["case_id"], got["match"], got["wrong_side"]) == ("c1", 1, 1)
    sweep = ["sweep-channel-attribution", manifest, "--audio-map", amap, "--threshold-db", "8", "--threshold-db", "200"]
    assert main([*sweep, "--quiet-channel-max-dbfs", "none"], spark) == 0  # labelled candidates keep their sides
    assert [(r["setting"], r["changed_segments"], r["aligned_channel_accuracy"], r["rank"]) for r in rows()] == [("th200_quietnone", 0, 0.5, 1), ("th8_quietnone", 0, 0.5, 2)]
    assert main([*sweep, "--reset-speech-channels-to-mix", "--min-channel-accuracy", "0.9"], spark) == 1
    assert [(r["setting"], r["changed_segments"], r["aligned_channel_accuracy"], r["segments_needing_edit"], r["gate_passed"]) for r in rows()] == [("th8_quietm40", 2, 1.0, 0, True), ("th200_quietm40", 0, None, 2, False)]
    assert main([*sweep, "--threshold-db", "-1"], spark) == 1
    home("mono.wav", wav.encode(frames[:, :1], 1000))
    assert main(["audit-candidate-channels", manifest, "--audio-map", home("mono.json", json.dumps({"c1": "mono.wav"}))], spark) == 1
    assert "stereo" in capsys.readouterr().err
    assert main(["audit-candidate-channels", manifest, "--audio-map", home("other.json", json.dumps({"c2": "c1.wav"}))], spark) == 1
    home("short.wav", wav.encode(frames[:1200], 1000))
    assert main(["audit-candidate-channels", manifest, "--audio-map", home("short.json", json.dumps({"c1": "short.wav"}))], spark) == 1
    assert "no audio" in capsys.readouterr().err
    made = str(tmp_path / "sided.json")
    assert main(["attribute-channels", home("mix.srt", srt.replace("[L]", "[MIX]")), audio, "-o", made], spark) == 0
    assert [s["channel"] for s in json.loads(open(made).read())["segments"]] == ["L", "R"]
    frozen, saved = str(tmp_path / "frozen"), str(tmp_path / "saved")
    assert main(["freeze-case-references", index, "--reference-type", "machine", "-o", frozen], spark) == 0
    assert main(["save-review-case-reference", f"{frozen}/index.json", "c1", home("new.srt", REF.split("\n\n")[0] + "\n"), "-o", saved], spark) == 0
    capsys.readouterr()
    for folder, count in ((frozen, 2), (saved, 1)):
        assert main(["review-case-status", f"{folder}/index.json"], spark) == 0
        assert rows()[0]["issues"] == []
        assert len(json.loads(open(f"{folder}/c1.master.json").read())["segments"]) == count
    assert main(["save-review-case-reference", index, "c9", home("new.srt", srt), "-o", str(tmp_path / "no")], spark) == 1
    whole, half = home("whole.json", '{"case_id": "c1", "start_ms": 0, "end_ms": 2500}\n'), home("half.json", '{"case_id": "c1", "start_ms": 0, "end_ms": 1000}\n')
    capsys.readouterr()
    assert main(["vad-compare-coverage", index, half, whole, "--min-reference-recall", "0.9"], spark) == 1
    got = rows()
    assert [(r["rank"], r["label"], r["missed_reference_duration_ms"], r["gate_passed"]) for r in got] == [(1, "whole", 0, True), (2, "half", 1000, False)]
    assert [(r["audio_duration_ms"], r["reference_segment_count"], r["reference_interval_count"], r["missed_reference_interval_count"], r["extra_detected_interval_count"]) for r in got] == [(2500, 2, 2, 0, 1), (2500, 2, 2, 1, 0)]
    late = home("late.json", '{"case_id": "c1", "start_ms": 0, "end_ms": 2501}\n')
    assert main(["vad-compare-coverage", index, late], spark) == 1 and main(["vad-coverage-cases", index, "--intervals", late], spark) == 1
    capsys.readouterr()
    assert main(["vad-coverage", audio, f"{tmp_path}/c1.srt"], spark) == 0  # by energy: the whole file speaks
    assert rows()[0]["missed_reference_duration_ms"] == 0


def test_review_queues_and_packs(spark, home, tmp_path, capsys):
    home("a.wav", wav.encode(np.zeros((3000, 2), np.int16), 1000))
    home("r.srt", REF)
    manifests = []
    for k, text in enumerate((REF.replace("きて", "まって"), REF.replace("ねえ", "うん").replace("きて", "まって"))):
        home(f"c{k}.srt", text)
        manifests.append(home(f"m{k}.json", json.dumps({"format": "x", "cases": [{"id": "a", "reference": "r.srt", "candidate": f"c{k}.srt"}]})))
    queues = [str(tmp_path / f"q{k}.json") for k in range(2)]
    for m, q in zip(manifests, queues, strict=True):
        assert main(["review-effort", m, "--document", q, "--source-case-index", "i.json"], spark) == 0
    rows = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    rows()
    both = str(tmp_path / "both.json")
    assert main(["merge-review-effort", *queues, "--document", both], spark) == 0
    assert [(r["reference_id"], r["merged_input_count"], len(r["source_reports"])) for r in rows()] == [("seg_000001", 1, 1), ("seg_000002", 2, 2)]
    made = json.loads(open(both).read())
    assert (made["item_count"], made["source_case_index"], made["reason_counts"]) == (2, "i.json", {"text": 2})
    assert main(["merge-review-effort", queues[0], home("no.json", json.dumps({"format": "x", "items": [{"reasons": []}]}))], spark) == 1
    capsys.readouterr()
    assert main(["compare-review-effort", *manifests], spark) == 0
    assert [(r["reference_id"], r["failed_count"], r["passed_count"], r["reason_counts"]) for r in rows()] == [("seg_000002", 2, 0, {"text": 2}), ("seg_000001", 1, 1, {"text": 1})]
    assert main(["compare-review-effort", *manifests, "--totals"], spark) == 0
    assert [(r["label"], r["reference_failures"], r["text"]) for r in rows()] == [("m0", 1, 1), ("m1", 2, 2)]
    amap, clips = home("map.json", json.dumps({"a": "a.wav"})), str(tmp_path / "clips")
    assert main(["review-pack", both, "--audio-map", amap, "--clips", clips], spark) == 0
    assert {(r["reference_id"], r["clip_start_ms"], r["clip_end_ms"]) for r in rows()} == {("seg_000001", 0, 1500), ("seg_000002", 1000, 3000)}
    assert sorted(wav.info(bytes(r.content))["duration_ms"] for r in spark.read.parquet(clips).collect()) == [1500, 2000]
    assert main(["review-pack", both, "--audio", f"{tmp_path}/a.wav"], spark) == 0
    assert main(["review-pack", both], spark) == 1 and main(["review-pack", both, "--audio-map", home("z.json", json.dumps({"z": "a.wav"}))], spark) == 1


def test_prepared_cases_and_readiness(spark, home, tmp_path, capsys):
    home("a.wav", wav.encode(np.arange(6000, dtype=np.int16).reshape(3000, 2), 1000))
    home("r.srt", REF)
    plan = home("plan.json", json.dumps({"format": "x", "reference_type": "human-reviewed", "cases": [{"id": f"p{k}", "audio": "a.wav", "reference": "r.srt", "start_ms": s, "end_ms": s + 1200} for k, s in enumerate((0, 1400))]}))
    out = tmp_path / "set"
    assert main(["prepare-review-cases", plan, "-o", str(out)], spark) == 0
    assert main(["review-case-status", f"{out}/index.json"], spark) == 0
    assert [json.loads(x)["issues"] for x in capsys.readouterr().out.splitlines()] == [[], []]
    assert [wav.info((out / f"p{k}.wav").read_bytes())["duration_ms"] for k in range(2)] == [1200, 1200]
    assert [(s["start_ms"], s["end_ms"], s["text"]) for s in json.loads((out / "p1.master.json").read_text())["segments"]] == [(100, 1100, "きて")]
    audited, compared = str(tmp_path / "audit"), str(tmp_path / "evals")
    assert main(["audit-review-case-references", f"{out}/index.json", "-o", audited], spark) == 0
    manifest = home("m.json", json.dumps({"format": "x", "cases": [{"id": "a", "reference": "r.srt", "candidate": "r.srt"}]}))
    assert main(["compare-evals", manifest, "-o", compared], spark) == 0
    capsys.readouterr()
    ready = ["pipeline-readiness", "--reference-audit", audited, "--eval-comparison", compared]
    assert main(ready, spark) == 0
    assert [(r["stage"], r["status"]) for r in map(json.loads, capsys.readouterr().out.splitlines())] == [("reference", "pass"), ("vad_chunking", "unknown"), ("alignment", "pass"), ("channel_attribution", "pass"), ("text_asr", "pass")]
    assert main([*ready, "--summary", "--fail-unless-asr-only-ready"], spark) == 1
    got = capsys.readouterr()
    assert json.loads(got.out)["unknown_stages"] == ["vad_chunking"] and "vad_chunking" in got.err


def test_reference_types_and_invalid_references(spark, home, tmp_path, capsys):
    home("r.srt", REF)
    cases = [{"id": f"c{k}", "reference": "r.srt", "candidate": "r.srt", "reference_type": t} for k, t in enumerate(("machine", "human-reviewed", "machine"))]
    manifest = home("m.json", json.dumps({"format": "x", "cases": cases}))
    assert main(["eval-manifest", manifest, "--require-reference-type", "human-reviewed"], spark) == 1
    assert json.loads(capsys.readouterr().out)["gate_failures"] == ["case c0 has reference type machine, and 1 more have another than human-reviewed"]
    assert main(["eval-manifest", manifest, "--require-reference-type", "human-reviewed", "--by-case"], spark) == 1
    assert {r["case_id"]: r["gate_passed"] for r in map(json.loads, capsys.readouterr().out.splitlines())} == {"c0": False, "c1": True, "c2": False}
    home("a.wav", wav.encode(np.zeros((3000, 2), np.int16), 1000))
    home("back.srt", "1\n00:00:05,000 --> 00:00:02,000\n[L]x\n")
    index = home("index.json", json.dumps({"format": "x", "items": [{"id": "c", "audio": "a.wav", "reference": "back.srt"}]}))
    assert main(["audit-review-case-references", index], spark) == 1
    assert "end" in capsys.readouterr().err
