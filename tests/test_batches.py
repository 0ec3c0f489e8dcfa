"""Batch alignment and transcription with fakes in place of models."""

import json
import os
import stat
import sys

import numpy as np
import pytest

from lumenspan.cli import main
from lumenspan.plans import batches
from lumenspan.plans.workflow import Model
from lumenspan.sources import wav

SEG = "case_id string, ord long, id string, start_ms long, end_ms long, channel string, kind string, text string, needs_review boolean"


def segments(spark, cases="abc", n=3):
    return spark.createDataFrame([(c, k, f"s{k}", k * 1000, k * 1000 + 800, "L", "speech", f"{c}{k}", True) for c in cases for k in range(n)], SEG)


def audio(spark, cases="abc"):
    return spark.createDataFrame([(c, f"/{c}.wav") for c in cases], "case_id string, audio string")


def test_alignment_of_several_cases(spark):
    def fake(path, rows):  # later by the case's place, and told in another order
        by = "abc".index(path[1]) * 100
        return [{"id": r["id"], "start_ms": r["start_ms"] + by, "end_ms": r["end_ms"] + by} for r in reversed(rows)]

    before = segments(spark)
    after, told = batches.aligned_cases(before, audio(spark), fake)
    assert after.columns == before.columns and {r.needs_review for r in after.collect()} == {True}  # flags stay
    assert sorted((r.case_id, r.id, r.start_ms) for r in after.collect()) == sorted((c, f"s{k}", k * 1000 + p * 100) for p, c in enumerate("abc") for k in range(3))
    assert {r.case_id: (r.segments, r.changed, r.mean_delta_ms, r.review_flag_changes, r.review_count) for r in told.collect()} == {"a": (3, 0, 0.0, 0, 3), "b": (3, 3, 100.0, 0, 3), "c": (3, 3, 200.0, 0, 3)}


@pytest.mark.parametrize(("told", "rule"), [(lambda rows: rows[1:], "missing"), (lambda rows: [*rows, rows[0]], "repeated"), (lambda rows: [*rows, {**rows[0], "id": "new"}], "unknown"), (lambda rows: [{**r, "start_ms": 1.5} for r in rows], "whole times"), (lambda rows: [{**r, "id": ""} for r in rows], "needs an id"), (lambda rows: {}, "list")])
def test_alignment_must_be_one_to_one(spark, told, rule):
    only_b = lambda path, rows: told(rows) if path == "/b.wav" else rows
    with pytest.raises(Exception, match=f"(?s)case b.*{rule}"):
        batches.aligned_cases(segments(spark), audio(spark), only_b)


def test_alignment_needs_audio(spark):
    with pytest.raises(ValueError, match="case c: the case has no audio"):
        batches.aligned_cases(segments(spark), audio(spark, "ab"), lambda path, rows: rows)


def test_alignment_commands(spark, tmp_path, capsys):
    program = tmp_path / "aligner.py"
    program.write_text(f"#!{sys.executable}\nimport json, sys\nx = json.load(sys.stdin)\nassert x['audio_file'].endswith('.wav')\nprint(json.dumps({{'segments': [{{'id': s['id'], 'start_ms': s['start_ms'] + 50, 'end_ms': s['end_ms'] + 50}} for s in x['master']['segments']]}}))\n")
    os.chmod(program, program.stat().st_mode | stat.S_IXUSR)
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nx\n")
    (tmp_path / "a.wav").write_bytes(wav.encode(np.zeros((3000, 2), np.int16), 1000))
    out = str(tmp_path / "out.json")
    assert main(["align-transcript", str(tmp_path / "a.srt"), str(tmp_path / "a.wav"), "--command", str(program), "-o", out], spark) == 0
    assert [(s["start_ms"], s["end_ms"]) for s in json.loads(open(out).read())["segments"]] == [(50, 1050)]
    assert main(["align-transcript", str(tmp_path / "a.srt"), str(tmp_path / "a.wav"), "--command", f"{sys.executable} -c 1", "-o", out], spark) == 1
    (tmp_path / "index.json").write_text(json.dumps({"format": "x", "items": [{"id": c, "audio": "a.wav", "reference": "a.srt", "candidate": "a.srt"} for c in ("p", "q")]}))
    made = tmp_path / "set"
    capsys.readouterr()
    assert main(["align-review-case-candidates", str(tmp_path / "index.json"), "--command", str(program), "-o", str(made)], spark) == 0
    plan = json.loads((made / "attach-plan.json").read_text())
    assert [(c["case_id"], c["candidate_id"]) for c in plan["candidates"]] == [("p", "a-aligned"), ("q", "a-aligned")]
    assert json.loads((made / "q.master.json").read_text())["segments"][0]["start_ms"] == 50
    assert main(["build-eval-manifest", str(tmp_path / "index.json"), "-o", str(tmp_path / "m.json")], spark) == 0


def test_transcription_goes_on_where_it_stopped(spark, tmp_path):
    rng, cases = np.random.default_rng(1), []
    for c in ("a", "b", "quiet"):
        frames = rng.integers(-8000, 8000, (2600, 2)).astype(np.int16)
        if c == "quiet":
            frames[:] = 0
        (tmp_path / f"{c}.wav").write_bytes(wav.encode(frames, 1000))
        cases.append((c, str(tmp_path / f"{c}.wav")))
    index, folder, log = spark.createDataFrame(cases, "case_id string, audio string"), str(tmp_path / "out"), str(tmp_path / "log")

    def hook(content, channel):
        frames, _ = wav.decode(content)
        with open(log, "a") as f:
            f.write(f"{len(frames)} {channel}\n")
        if not frames.any():
            return []
        if os.path.exists(log + ".fail"):
            raise RuntimeError("stopped")
        return [{"start_ms": 0, "end_ms": len(frames), "text": f"said {len(frames)}"}]

    model = Model(hook, max_chunk_ms=1000)
    first = batches.transcribed_cases(index.where("case_id in ('a', 'quiet')"), model, folder)
    assert {r.case_id: (r.segments, r.review_count) for r in first.collect()} == {"a": (6, 6), "quiet": (0, 0)}
    calls = len(open(log).readlines())
    open(log + ".fail", "w").close()
    with pytest.raises(Exception, match="stopped"):
        batches.transcribed_cases(index, model, folder)
    os.unlink(log + ".fail")
    before = len(open(log).readlines())
    every = batches.transcribed_cases(index, model, folder)
    assert {r.case_id: r.segments for r in every.collect()} == {"a": 6, "b": 6, "quiet": 0}
    assert calls == 12 and len(open(log).readlines()) - before == 6  # of the case that was left, alone
    got = sorted((r.case_id, r.start_ms, r.end_ms, r.channel, r.text) for r in batches.candidate_segments(spark, folder).collect())
    assert got == sorted((c, s, min(2600, s + 1000), side, f"said {min(2600, s + 1000) - s}") for c in "ab" for s in (0, 1000, 2000) for side in "LR")
    again = len(open(log).readlines())
    assert batches.transcribed_cases(index, model, folder).count() == 3 and len(open(log).readlines()) == again


def test_transcription_of_the_mix_takes_sides(spark, tmp_path):
    frames = np.zeros((3000, 2), np.int16)
    frames[:1000, 0], frames[2000:, 1] = 8000, 8000
    (tmp_path / "a.wav").write_bytes(wav.encode(frames, 1000))
    hook = lambda content, channel: [{"start_ms": 0, "end_ms": 900, "text": channel}]
    index = spark.createDataFrame([("a", str(tmp_path / "a.wav"))], "case_id string, audio string")
    batches.transcribed_cases(index, Model(hook, mix_first=True), str(tmp_path / "out"))
    assert [(r.channel, r.text) for r in batches.candidate_segments(spark, str(tmp_path / "out")).orderBy("start_ms").collect()] == [("L", "MIX"), ("R", "MIX")]


def test_digest_reads_files_in_chunks(spark, tmp_path):
    import hashlib

    from lumenspan.sources.documents import snapshot_digest

    folder = tmp_path / "model"
    (folder / "sub dir").mkdir(parents=True)
    big = folder / "big.bin"
    with open(big, "wb") as f:
        f.truncate(2_200_000_000)  # sparse, over what one value can hold
    (folder / "sub dir" / "b.txt").write_bytes(b"x" * 1001)
    each, root = snapshot_digest(spark, str(folder), 1 << 24)
    zero = hashlib.sha256()
    for _ in range(22):
        zero.update(bytes(100_000_000))
    got = {r.path: (r.sha256, r.size_bytes) for r in each.collect()}
    assert got["big.bin"] == (zero.hexdigest(), 2_200_000_000)
    assert sorted(v for k, v in got.items() if k != "big.bin") == [(hashlib.sha256(b"x" * 1001).hexdigest(), 1001)]
    assert root.first().files == 2
