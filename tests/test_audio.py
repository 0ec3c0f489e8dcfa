"""Audio by range reads, detected intervals, and the channel sweep."""

import json
import math
import struct

import numpy as np
import pytest

from lumenspan.operators import channels
from lumenspan.plans import report
from lumenspan.sources import audio, detections, documents, wav

RATE = 8000


@pytest.fixture
def files(spark, tmp_path):
    """Cases of stereo noise (2.3 s), of mono, and of a file with other chunks around its samples."""
    frames = np.random.default_rng(0).integers(-9000, 9000, (18_404, 2)).astype(np.int16)
    plain = wav.encode(frames, RATE)
    (tmp_path / "a.wav").write_bytes(plain)
    (tmp_path / "m.wav").write_bytes(wav.encode(frames[:, :1], RATE))
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + chunk(b"JUNK", b"odd") + plain[12:36] + chunk(b"LIST", b"more") + chunk(b"data", frames.tobytes()) + chunk(b"tail", b"x")
    (tmp_path / "c.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    df = spark.createDataFrame([(c, f"{pre}{tmp_path}/{c}.wav") for c, pre in (("a", ""), ("m", "file:"), ("c", "file://"))], "case_id string, audio string")
    return df, frames


def test_headers_and_sums_of_exact_frames(spark, files):
    df, frames = files
    heads = audio.headers(df).cache()
    assert {r.case_id: (r.frame_count, r.channels, r.sample_rate, r.duration_ms) for r in heads.collect()} == {"a": (18_404, 2, RATE, 2300), "c": (18_404, 2, RATE, 2300), "m": (18_404, 1, RATE, 2300)}
    assert [(r.case_id, r.rule) for r in audio.problems(heads).collect()] == [("m", "stereo audio is needed")]
    spans = [(0, 2300), (3, 1007), (511, 513), (1999, 9999), (5000, 6000), (7, 7), (1, 2)]  # off the grid of 10 ms, over the end, empty
    ranges = spark.createDataFrame([(c, a, b) for c in "acmz" for a, b in spans], "case_id string, start_ms long, end_ms long")
    for block in (1 << 20, 1000, 7):
        got = {(r.case_id, r.start_ms, r.end_ms): (r.left_sq, r.right_sq, r.n) for r in audio.range_sums(ranges, heads, block).collect()}
        assert len(got) == 3 * len(spans)
        for (case, a, b), sums in got.items():
            lo, hi = (min(len(frames), round(RATE * x / 1000)) for x in (a, b))
            part = frames[lo:hi].astype(np.int64) ** 2
            assert sums == (part[:, 0].sum(), part[:, 0 if case == "m" else 1].sum(), max(0, hi - lo))


def test_a_task_reads_blocks_only(spark, tmp_path, monkeypatch):
    """A sparse file of 3 GB of silence: only the blocks of the ranges are read, each under the bound."""
    path, frames = tmp_path / "long.wav", 800_000_000
    head = b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48_000, 192_000, 4, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + frames * 4)
        f.seek(len(head) + 48_000 * 4 * 10_000)
        f.write(struct.pack("<hh", 3, 4) * 48)
    heads = audio.headers(spark.createDataFrame([("x", str(path))], "case_id string, audio string"))
    assert heads.first().frame_count == frames
    got = audio.range_sums(spark.createDataFrame([("x", 9_999_999, 10_000_002), ("x", 16_000_000, 16_000_100)], "case_id string, start_ms long, end_ms long"), heads).orderBy("start_ms").collect()
    assert [(r.left_sq, r.right_sq, r.n) for r in got] == [(9 * 48, 16 * 48, 144), (0, 0, 4800)]


def test_levels_and_clips_equal_those_of_whole_files(spark, files):
    df, frames = files
    heads = audio.headers(df)
    seg = spark.createDataFrame([("a", "s1", 11, 987, "speech"), ("c", "s2", 100, 2300, "speech"), ("a", "s3", 2301, 2400, "speech"), ("z", "s4", 0, 9, "speech")], "case_id string, id string, start_ms long, end_ms long, kind string")
    got = {r.id: r for r in audio.segment_levels(seg, heads, 500).collect()}
    for i, (a, b) in {"s1": (11, 987), "s2": (100, 2300)}.items():
        part = frames[round(RATE * a / 1000) : round(RATE * b / 1000)].astype(float)
        assert (got[i].left_dbfs, got[i].right_dbfs) == pytest.approx(tuple(20 * np.log10(np.sqrt((part**2).mean(axis=0)) / 32767)))
    assert got["s3"].left_dbfs is None and got["s4"].left_dbfs is None
    assert {r.id for r in audio.silent_ranges(audio.segment_levels(seg, heads)).collect()} == {"s3", "s4"}
    clip = audio.clips(seg.where("id in ('s1', 's2')"), heads).collect()
    source = wav.encode(frames, RATE)
    assert all(bytes(r.content) == wav.cut(source, r.start_ms, r.end_ms) for r in clip) and len(clip) == 2
    with pytest.raises(Exception, match="no audio"):
        audio.clips(seg.where("id = 's3'"), heads).collect()


def test_files_that_are_not_wav(spark, tmp_path):
    for k, data in enumerate((b"", b"RIFF    WAVE", b"no wave at all", b"RIFF0000WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 2, 8000, 64000, 8, 32) + b"data" + struct.pack("<I", 0))):
        path = tmp_path / f"{k}.wav"
        path.write_bytes(data)
        with pytest.raises(Exception, match="WAV|samples|PCM"):
            audio.headers(spark.createDataFrame([("x", str(path))], "case_id string, audio string")).collect()


def test_evidence_is_of_exact_frames(spark, tmp_path):
    """The strongest second begins off the 10 ms grid."""
    frames = np.zeros((9 * 1000, 2), np.int16)
    frames[4003:5003, 0] = 5000
    (tmp_path / "e.wav").write_bytes(wav.encode(frames, 1000))
    heads = audio.headers(spark.createDataFrame([("e", str(tmp_path / "e.wav"))], "case_id string, audio string"))
    seg = spark.createDataFrame([("e", "s", 3, 8503, "L"), ("e", "short", 0, 900, "L")], "case_id string, id string, start_ms long, end_ms long, energy_channel string")
    got = {r.id: (r.clip_start_ms, r.clip_end_ms) for r in channels.evidence_clips(seg, audio.range_sums(channels.probes(seg), heads)).collect()}
    assert got == {"s": (2003, 7003), "short": (0, 900)}  # around 4003 to 5003


def test_detections(spark, tmp_path):
    heads = spark.createDataFrame([("a", 1000), ("b", 500)], "case_id string, duration_ms long")

    def rules(name, text):
        (tmp_path / name).write_text(text)
        return {(r.case_id, r.rule) for r in detections.problems(detections.read(spark, str(tmp_path / name), "a"), heads).collect()}

    line = lambda c, a, b: json.dumps({"case_id": c, "start_ms": a, "end_ms": b}) + "\n"
    assert rules("ok.json", json.dumps({"intervals": [{"start_ms": 0, "end_ms": 5}, {"start_ms": 5, "end_ms": 1000}]})) == set()
    assert rules("ok.jsonl", line("a", 0, 9) + line("b", 0, 9) + line("a", 9, 1000)) == set()
    bad = "interval is empty, unsorted or overlaps"
    assert rules("order.json", json.dumps({"intervals": [{"start_ms": 6, "end_ms": 9}, {"start_ms": 0, "end_ms": 5}]})) == {("a", bad)}
    assert rules("empty.jsonl", line("b", 4, 4)) == rules("over.jsonl", line("b", 0, 9) + line("b", 8, 10)) == {("b", bad)}
    assert rules("late.jsonl", line("b", 0, 501)) == {("b", "an interval ends after the audio")}
    assert rules("float.jsonl", line("a", 0.5, 3)) == rules("text.jsonl", line("a", "0", 3)) == {("a", "an interval needs a case and whole times")}
    assert ("z", "no audio for the intervals' case") in rules("other.jsonl", line("z", 0, 3))


def test_energy_of_long_files_equals_that_of_windows(spark, files):
    df, frames = files
    heads = audio.headers(df.where("case_id in ('a', 'c')"))
    for block in (1 << 20, 1700):
        got = sorted((r.case_id, r.start_ms, r.end_ms, r.all_sq, r.n) for r in detections.windows(heads, 100, block).collect())
        squares = (frames.astype(np.int64) ** 2).sum(axis=1)
        want = [(c, round(k / RATE * 1000), round(min(k + 800, len(frames)) / RATE * 1000), squares[k : k + 800].sum(), 2 * len(squares[k : k + 800])) for c in "ac" for k in range(0, len(frames), 800)]
        assert got == want
    whole = [(r.case_id, r.start_ms, r.end_ms) for r in detections.by_energy(heads, 0.0).collect()]
    assert sorted(whole) == [("a", 0, 2300), ("c", 0, 2300)]  # nothing is that loud
    assert math.isclose(detections.amplitude(-20.0), 3276.7)


def test_audio_maps(spark, tmp_path):
    def rows(x):
        (tmp_path / "map.json").write_text(json.dumps(x))
        return sorted((r.case_id, r.audio.removeprefix("file:").replace("//", "/")) for r in documents.audio_map(spark, str(tmp_path / "map.json")).collect())

    want = [("a", f"{tmp_path}/a.wav"), ("b", "/x/b.wav")]
    assert rows({"a": "a.wav", "b": "/x/b.wav"}) == want
    assert rows({"format": "f", "items": [{"case_id": "a", "audio": "a.wav"}, {"case_id": "b", "audio": "/x/b.wav"}]}) == want
    assert rows({"format": "f", "items": [{"id": "a", "audio": "a.wav", "reference": "r"}, {"id": "b", "audio": "/x/b.wav"}]}) == want
    for bad in ([1], {"items": [{"case_id": "a"}]}, {"items": [{"case_id": "a", "audio": "x"}] * 2}, {"a": ""}):
        with pytest.raises(ValueError, match="audio map"):
            rows(bad)


def test_sweep_equals_each_setting_evaluated_alone(spark):
    seg = "case_id string, ord long, id string, start_ms long, end_ms long, channel string, kind string, text string, needs_review boolean"
    ref = spark.createDataFrame([("c", 1, "r1", 0, 900, "L", "speech", "あ", False), ("c", 2, "r2", 1000, 2000, "R", "speech", "い", False), ("d", 1, "r1", 0, 900, "R", "speech", "う", False)], seg)
    rows = [("c", 1, "c1", 0, 900, "MIX", "speech", "あ", False, -10.0, -60.0), ("c", 2, "c2", 1000, 2700, "L", "speech", "え", True, -60.0, -30.0), ("d", 1, "c1", 0, 900, "MIX", "speech", "う", False, -20.0, -15.0), ("d", 2, "c2", 5000, 5100, "MIX", "sfx", "", False, None, None)]
    cand = spark.createDataFrame(rows, seg + ", left_dbfs double, right_dbfs double")
    for reset in (False, True):
        got = {r.setting: r for r in report.channel_sweep(ref, cand, [4.0, 8.0], [-40.0, None], reset).collect()}
        assert sorted(r.rank for r in got.values()) == [1, 2, 3, 4]
        for t in (4.0, 8.0):
            for q in (-40.0, None):
                before = cand.replace(["L", "R"], ["MIX", "MIX"], ["channel"]) if reset else cand
                alone = channels.attributed(before, t, q)
                want, r = report.suite(ref, alone.select(*ref.columns)).first(), got[channels.setting_id(t, q)]
                for c in ("case_count", "practical_cer", "aligned_channel_accuracy", "aligned_channel_candidate_mix_ratio", "aligned_within_500ms_ratio", "channel_edit_segments", "text_edit_segments", "segments_needing_edit_ratio", "candidate_review_ratio", "dominant_reason"):
                    assert r[c] == want[c], c
                assert (r.total_segments, r.changed_segments) == (4, channels.diagnostics(alone).first().changed_segments)
    for thresholds, quiets in (([], [None]), ([8.0], []), ([-1.0], [None])):
        with pytest.raises(ValueError, match="threshold"):
            report.channel_sweep(ref, cand, thresholds, quiets)


def test_suite_row_of_both_equals_the_suite(spark):
    from lumenspan.sources.carrier import carrier

    ref, cand = carrier(spark, "/root/testdata/sf0.001")
    rows = report.both(ref, cand).collect()
    whole = next(r for r in rows if r.is_suite).asDict()
    suite = report.suite(ref, cand).first().asDict()
    assert {k: whole[k] for k in suite} == suite
    cases = {r.case_id: r for r in report.evaluated(ref, cand).collect()}
    assert len(rows) == len(cases) + 1 and all(r.practical_cer == cases[r.case_id].practical_cer and r.candidate_review_ratio == cases[r.case_id].candidate_review_ratio for r in rows if not r.is_suite)
