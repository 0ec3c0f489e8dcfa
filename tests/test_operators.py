"""Golden values and random comparisons with plain loops."""

import io
import math
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import hooks
from lumenspan.functions import text as T
from lumenspan.operators import audit, channels, coverage, effort, evaluate, intervals, matching
from lumenspan.plans import workflow
from lumenspan.schemas import violations
from lumenspan.sources import documents, srt, wav

SEG = "case_id string, ord long, id string, start_ms long, end_ms long, channel string, kind string, text string, needs_review boolean"


def segs(spark, rows, case="a"):
    return spark.createDataFrame([(case, n, f"seg_{n + 1:06d}", s, e, c, "speech", t, False) for n, (s, e, c, t) in enumerate(rows)], SEG)


def ivs(spark, rows, case="a"):
    return spark.createDataFrame([(case, s, e) for s, e in rows], "case_id string, start_ms long, end_ms long")


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_coverage_golden(spark):
    ref, det = segs(spark, [(100, 300, "L", "x"), (400, 700, "L", "x"), (400, 500, "R", "y"), (900, 1000, "L", "z")]), ivs(spark, [(0, 400), (600, 900)])
    r = coverage.coverage(ref, det).first()
    assert (r.reference_speech_duration_ms, r.detected_speech_duration_ms, r.overlap_duration_ms) == (600, 700, 300)
    ref = segs(spark, [(100, 400, "L", "x"), (400, 700, "L", "x")])
    r = coverage.coverage(ref, det).first()
    assert (r.reference_speech_duration_ms, r.detected_speech_duration_ms, r.overlap_duration_ms, r.missed_reference_duration_ms, r.extra_detected_duration_ms) == (600, 700, 400, 200, 300)
    assert pairs(coverage.fragments(ref, det), "kind", "start_ms", "end_ms") == [("extra", 0, 100), ("extra", 700, 900), ("missed", 400, 600)]


def test_energy_golden(spark):
    """Sound, silence, sound of a second each at windows of 100 ms."""
    windows = spark.createDataFrame([("a", k * 100, k * 100 + 100, 1.0 if k < 10 or k >= 20 else 0.0) for k in range(30)], "case_id string, start_ms long, end_ms long, level double")
    durations = spark.createDataFrame([("a", 3000), ("b", 500)], "case_id string, duration_ms long")
    got = pairs(channels.energy_intervals(windows, durations, 0.5, 300, 200, 100), "case_id", "index", "start_ms", "end_ms")
    assert got == [("a", 0, 0, 1100), ("a", 1, 1900, 3000), ("b", 0, 0, 500)]


def test_fixed_chunks(spark):
    got = pairs(intervals.fixed_chunks(spark.createDataFrame([("a", 450), ("z", 0)], "case_id string, duration_ms long"), 200), "case_id", "index", "start_ms", "end_ms")
    assert got == [("a", 0, 0, 200), ("a", 1, 200, 400), ("a", 2, 400, 450)]


def loop_hysteresis(ps, frame_ms, on, off, min_speech, min_silence, pad):
    need_speech, need_silence = max(1, math.ceil(min_speech / frame_ms)), max(1, math.ceil(min_silence / frame_ms))
    out, start, silence = [], None, None
    for i, p in enumerate(ps):
        if start is None:
            if p >= on:
                start, silence = i, None
        elif p < off:
            silence = i if silence is None else silence
            if i - silence + 1 >= need_silence:
                if silence - start >= need_speech:
                    out.append((start, silence))
                start = silence = None
        elif p >= on:
            silence = None
    if start is not None and len(ps) - start >= need_speech:
        out.append((start, len(ps)))
    done = []
    for a, b in out:
        a, b = max(0, a * frame_ms - pad), min(len(ps) * frame_ms, b * frame_ms + pad)
        if done and a <= done[-1][1]:
            done[-1][1] = max(done[-1][1], b)
        elif b > a:
            done.append([a, b])
    return [tuple(x) for x in done]


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_equals_loop(spark, seed):
    rng = random.Random(seed)
    cases = {f"c{k}": [rng.choice([0.1, 0.3, 0.4, 0.6, 0.9]) for _ in range(rng.randrange(1, 60))] for k in range(25)}
    frames = spark.createDataFrame([(c, i, p) for c, ps in cases.items() for i, p in enumerate(ps)], "case_id string, at long, p double")
    got = pairs(channels.hysteresis(frames, 20, 0.5, None, 40, 40, 10), "case_id", "start_ms", "end_ms")
    want = sorted((c, a, b) for c, ps in cases.items() for a, b in loop_hysteresis(ps, 20, 0.5, 0.35, 40, 40, 10))
    assert got == want


def test_best_overlap_ties_and_buckets(spark):
    rng = random.Random(5)
    mk = lambda n: [(s := rng.randrange(0, 300_000), s + rng.choice([500, 1000, 90_000]), rng.choice("LR"), "x") for _ in range(n)]
    r, c = mk(60), mk(60)
    got = pairs(matching.best_overlap(segs(spark, r), segs(spark, c)), "ref_ord", "cand_ord", "overlap_ms")
    want = []
    for i, (s, e, *_) in enumerate(r):
        best = max(((min(e, y) - max(s, x), -j) for j, (x, y, *_) in enumerate(c)), default=(0, 0))
        if best[0] > 0:
            want.append((i, -best[1], best[0]))
    assert got == sorted(want)


def test_union_touching_and_difference(spark):
    assert pairs(intervals.union(ivs(spark, [(0, 10), (10, 20), (30, 40), (35, 36), (50, 50)])), "start_ms", "end_ms") == [(0, 20), (30, 40)]
    rng = random.Random(1)
    mk = lambda: [(s := rng.randrange(200), s + rng.randrange(0, 30)) for _ in range(20)]
    a, b = mk(), mk()
    have = lambda xs: {t for s, e in xs for t in range(s, e)}
    assert have(pairs(intervals.difference(ivs(spark, a), ivs(spark, b)), "start_ms", "end_ms")) == have(a) - have(b)
    assert have(pairs(intervals.intersection(ivs(spark, a), ivs(spark, b)), "start_ms", "end_ms")) == have(a) & have(b)


def test_empty_tables(spark):
    none = segs(spark, [(0, 1, "L", "x")]).limit(0)
    some = segs(spark, [(0, 1000, "L", "x")])
    assert matching.best_overlap(none, some).count() == 0
    assert effort.items(none, some).count() == 1
    assert evaluate.timing(matching.best_overlap(none, none)).first().mean_start_error_ms is None
    assert audit.queue(none).count() == 0
    assert coverage.coverage(none, ivs(spark, [])).count() == 0


def test_effort_golden(spark):
    ref = segs(spark, [(0, 1000, "L", "ね"), (2000, 3000, "R", "まじょ"), (9000, 9500, "L", "x")])
    cand = segs(spark, [(60, 1100, "L", "ねえ"), (2000, 2900, "L", "まじょ"), (20000, 20500, "R", "y")])
    got = {(r.reference_id, r.candidate_id): list(r.reasons) for r in effort.items(ref, cand).collect()}
    assert got == {("seg_000001", "seg_000001"): ["text"], ("seg_000002", "seg_000002"): ["channel"], ("seg_000003", None): ["missing_reference"], (None, "seg_000003"): ["extra_candidate"]}
    assert [r.reasons[0] for r in effort.ranked(effort.items(ref, cand)).orderBy("priority_rank").collect()] == ["missing_reference", "extra_candidate", "text", "channel"]
    r = effort.rollup(effort.edits(ref, cand)).first()
    assert (r.segments_needing_edit, r.segments_needing_edit_ratio) == (4, 1.0)


def test_text_forms(spark):
    df = spark.createDataFrame([("ね、 魔女ちゃん！？",), ("ABC１２３",), ("らーめん〜",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.practical("t"), T.relaxed("t")).collect()]
    assert got == [("ね魔女ちゃん", "ね魔女ちゃん"), ("ABC123", "ABC123"), ("らーめん", "らめん"), (None, None)]


def test_edit_distance_equals_builtin(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("abcé你", k=rng.randrange(0, 80))), "".join(rng.choices("abcé你", k=rng.randrange(0, 80)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(T.long_distance("a", "b") != F.levenshtein("a", "b")).count() == 0


def test_artifacts(spark):
    cand = segs(spark, [(0, 1000, "L", "hello"), (0, 100, "L", "あいうえおかきく"), (0, 9000, "L", "はいはいはいはいはいはい"), (0, 2000, "L", "ふつう")])
    flags = evaluate.artifacts(cand)
    assert [(r.non_japanese_text, r.high_text_density, r.repeated_text) for r in flags.orderBy("id").collect()] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]
    assert evaluate.artifact_rollup(flags).first().artifact_segment_ratio == 0.75


def test_tagged_tokens(spark):
    df = spark.createDataFrame([("a [T:25] b [T:70] _ [T:110] c [T:160]", 9999), ("x [T:990] y [T:20]", 99999), ("none", 5)], "t string, d long")
    got = [[(x.text, x.end_ms) for x in r[0]] for r in df.select(T.tagged_tokens(F.col("t"), F.col("d"))).collect()]
    assert got == [[("a", 250), ("b", 700), ("_", 1100), ("c", 1600)], [("x", 9900), ("y", 10200)], []]


def test_cleaned(spark):
    df = spark.createDataFrame([("```\nTranscription: こん にちは\n```",), ("hello",), ("**ね え 、 は**",)], "t string")
    assert [r[0] for r in df.select(T.cleaned(F.col("t"))).collect()] == ["こんにちは", "", "ねえ、は"]


def test_srt(spark):
    content = "1\r\n00:00:01,000 --> 00:00:02.500\r\n[L] [x:SPEAKER_00] やあ\r\nline two\r\n\r\n00:00:03,000 --> 00:00:04,000\n[LR] b\n\n3\n01:00:05,000 --> 01:00:06,000\n[L][R] c\n\nbad"
    rows = srt.parse(spark.createDataFrame([("a", content), ("n", None)], "case_id string, content string")).orderBy("ord").collect()
    assert rows[0].problem is None
    assert [r.problem is None for r in rows] == [True, True, True, False]


def test_srt_labels(spark):
    content = "00:00:01,000 --> 00:00:02,000\n[L] a\n\n00:00:03,000 --> 00:00:04,000\n[LR] b\n\n00:00:05,000 --> 00:00:06,000\n[L] [MIX] [R] [SPEAKER_01] c\n\n00:00:07,000 --> 00:00:08,000\n[note] d"
    rows = srt.parse(spark.createDataFrame([("a", content)], "case_id string, content string")).orderBy("ord").collect()
    assert [(r.channel, r.text) for r in rows] == [("L", "a"), ("MIX", "b"), ("R", "c"), ("MIX", "[note] d")]


def test_srt_labels_of_the_first_line_only(spark):
    content = "00:00:01,000 --> 00:00:02,000\n[L]\n[R] hi\n\n00:00:03,000 --> 00:00:04,000\nhello\n[R] there"
    rows = srt.parse(spark.createDataFrame([("a", content)], "case_id string, content string")).orderBy("ord").collect()
    assert [(r.channel, r.text) for r in rows] == [("L", "[R] hi"), ("MIX", "hello\n[R] there")]


@pytest.mark.parametrize("line", ["00:75:59,000 --> 01:00:00,000", "00:00:75,000 --> 01:00:00,000", "00:00:00,000 --> 00:60:00,000", "00:00:00,000 --> 00:00:60,000"])
def test_srt_of_impossible_times_is_a_problem(spark, line):
    (row,) = srt.parse(spark.createDataFrame([("a", line + "\nx")], "case_id string, content string")).collect()
    assert row.problem == "the timing line isn't valid" and row.start_ms is None and row.end_ms is None


@pytest.mark.parametrize("line", ["00:00:05,000 --> 00:00:02,000", "00:00:05,000 --> 00:00:05,000"])
def test_srt_cues_must_end_after_they_start(spark, line):
    (row,) = srt.parse(spark.createDataFrame([("a", line + "\nx")], "case_id string, content string")).collect()
    assert row.problem == "a cue must end after it starts" and row.start_ms is None and row.end_ms is None


def test_masters(spark, tmp_path):
    (tmp_path / "a.master.json").write_text('{"format": "timed-master-v1", "segments": [{"id": "seg_000001", "start_ms": 0, "end_ms": 5, "channel": "L", "kind": "speech", "text": "x", "needs_review": true}]}')
    assert [tuple(r) for r in documents.read_masters(spark, str(tmp_path)).collect()] == [("a", 0, "seg_000001", 0, 5, "L", "speech", "x", True)]
    (tmp_path / "b.json").write_text('{"format": "timed-master-v1", "segments": [{"id": "s", "start_ms": true, "end_ms": 5, "channel": "L", "kind": "speech", "text": "x"}]}')
    with pytest.raises(Exception, match="integer"):
        documents.read_masters(spark, str(tmp_path)).collect()


def test_master_round_trip(spark, tmp_path):
    seg = segs(spark, [(0, 5, "L", "é \"q\""), (5, 9, "R", "y")], "c")
    headers = spark.createDataFrame([("c", "ja", 9)], "case_id string, source_language string, duration_ms long")
    (tmp_path / "c.master.json").write_text(documents.master_json(seg, headers, "timed-master-v1").first().json)
    assert sorted(map(tuple, documents.read_masters(spark, str(tmp_path)).collect())) == sorted(map(tuple, seg.collect()))


def test_violations(spark):
    bad = spark.createDataFrame([("a", 0, "x", 5, 5, "Q", "speech", "t", False), ("a", 1, "x", 0, 5, "L", "talk", None, False)], SEG)
    rules = {r.rule for r in violations(bad).collect()}
    assert rules == {"end_ms is not after start_ms", "channel is unknown", "kind is unknown", "text is missing", "id is repeated"}


def test_audit_golden(spark):
    seg = segs(spark, [(0, 1000, "L", "a"), (0, 1000, "L", "b"), (500, 1500, "R", "c"), (1450, 1560, "R", "d"), (5000, 36000, "L", "e")])
    r = audit.audit(seg, spark.createDataFrame([("a", 40000)], "case_id string, duration_ms long")).first()
    assert (r.overlap_pair_count, r.same_channel_overlap_pair_count, r.cross_channel_overlap_pair_count, r.exact_boundary_overlap_pair_count, r.long_segment_count) == (3, 1, 2, 1, 1)
    assert r.speech_union_duration_ms == 1560 + 31000


def test_slice(spark):
    got = pairs(intervals.time_slice(segs(spark, [(0, 100, "L", "a"), (150, 300, "R", "b"), (400, 500, "L", "c")]), 50, 250), "id", "start_ms", "end_ms", "needs_review")
    assert got == [("seg_000001", 0, 50, True), ("seg_000002", 100, 200, True)]


def test_attribution(spark):
    rows = [("a", "MIX", -20.0, -50.0), ("b", "MIX", -20.0, -30.0), ("c", "R", -20.0, -50.0), ("d", "MIX", -60.0, -41.0)]
    df = spark.createDataFrame([("x", i, c, "speech", left, right) for i, c, left, right in rows], "case_id string, id string, channel string, kind string, left_dbfs double, right_dbfs double")
    assert pairs(channels.attributed(df), "id", "channel", "reason") == [("a", "L", "left_dominant"), ("b", "MIX", "quieter_side_active"), ("c", "R", "skipped_existing_channel"), ("d", "R", "right_dominant")]
    assert channels.setting_id(8.0, -40.0) == "th8_quietm40" and channels.setting_id(2.5, None) == "th2p5_quietnone"


def stereo(left, right, rate=1000):
    return wav.encode(np.stack([np.array(left), np.array(right)], axis=1), rate)


def test_wav(spark):
    data = stereo([1000] * 1000 + [0] * 1000, [10] * 1000 + [2000] * 1000)
    assert wav.info(data)["duration_ms"] == 2000
    assert wav.decode(wav.split(stereo([1, 2], [2, 3]))["MIX"])[0].ravel().tolist() == [2, 2]  # halves to even
    assert wav.info(wav.cut(data, 500, 700))["frame_count"] == 200
    with pytest.raises(ValueError, match="no audio"):
        wav.cut(data, 5000, 6000)
    audio = spark.createDataFrame([("a", data)], "case_id string, content binary")
    seg = segs(spark, [(0, 1000, "MIX", "x"), (1000, 2000, "MIX", "y")])
    levels = {r.id: (r.left_dbfs, r.right_dbfs) for r in wav.segment_levels(seg, audio).collect()}
    assert levels["seg_000001"][0] == pytest.approx(20 * math.log10(1000 / 32767))
    assert levels["seg_000002"] == pytest.approx((20 * math.log10(1 / 32767), 20 * math.log10(2000 / 32767)))


def test_levels_of_exact_ranges(spark):
    """Bounds off any grid, short and overlapping segments, a segment past the end: each as a loop over its frames."""
    rng = np.random.default_rng(2)
    left, right = rng.integers(-9000, 9000, 3000), rng.integers(-500, 500, 3000)
    audio = spark.createDataFrame([("a", stereo(left, right))], "case_id string, content binary")
    spans = [(3, 4), (17, 1033), (900, 905), (901, 2999), (0, 3000), (2990, 5000), (4000, 5000)]
    got = {r.ord: (r.left_dbfs, r.right_dbfs) for r in wav.segment_levels(segs(spark, [(*s, "MIX", "x") for s in spans]), audio).collect()}
    want = lambda x, s: 20 * math.log10(max(1.0, math.sqrt(float(np.mean(x[s[0] : s[1]].astype(float) ** 2)))) / 32767)
    for n, (levels, s) in enumerate(zip((got[k] for k in sorted(got)), spans, strict=True)):
        assert levels == ((None, None) if n == 6 else pytest.approx((want(left, s), want(right, s))))


def test_audio_of_other_widths_is_speech_throughout(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(1000)
        f.writeframes(bytes(range(200)) * 10)
    audio = spark.createDataFrame([("a", "MIX", out.getvalue())], "case_id string, channel string, content binary")
    assert pairs(workflow.speech_chunks(audio, workflow.Energy()), "start_ms", "end_ms") == [(0, 2000)]


def test_hooks(spark):
    audio = spark.createDataFrame([("a", b"xx")], "case_id string, content binary")
    assert pairs(hooks.detect(audio, lambda b: [(0, 10 * len(b)), (30, 40)]), "index", "start_ms", "end_ms") == [(0, 0, 20), (1, 30, 40)]
    clips = spark.createDataFrame([("a", "L", 1000, b"x"), ("a", "R", 0, b"y")], "case_id string, channel string, offset_ms long, content binary")
    got = pairs(hooks.transcribe(clips, lambda b, c: [{"start_ms": 5, "end_ms": 9, "text": c}, {"start_ms": 0, "end_ms": 1, "text": " "}]), "id", "start_ms", "channel", "text")
    assert got == [("seg_000001", 5, "R", "R"), ("seg_000002", 1005, "L", "L")]


def test_snapshot_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes(b"1")
    (tmp_path / "sub/a.txt").write_bytes(b"22")
    each, root = documents.snapshot_digest(spark, str(tmp_path))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert pairs(each, "path", "size_bytes") == [("b.txt", 1), ("sub/a.txt", 2)]
    assert root.first().root_sha256 == sha(f"b.txt\0{sha(b'1')}\0sub/a.txt\0{sha(b'22')}\0".encode())


def test_forms_of_all_letters_equal_unicode(spark):
    """Every code point, alone and beside others, and both forms of a text from one call of Python."""
    import unicodedata

    held = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    made = ["a" + "".join(held[k : k + 64]) for k in range(0, len(held), 64)] + ["", "e\u0301 ｶﾞー〜～"]
    want = {t: "".join(c for c in unicodedata.normalize("NFKC", t) if not c.isspace() and unicodedata.category(c)[0] not in "PS") for t in made}
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", T.practical("t").alias("p"), T.relaxed("t").alias("r"))
    for i, p, r in df.collect():
        assert p == want[made[i]] and r == p.replace("ー", "")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and len(set(re.findall(r"pythonUDF\d+", plan))) == 1


def test_texts_leave_arrow_one_by_one():
    """Neither a batch of texts nor one of pairs of documents stands in memory as Python strings."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{k} ー" + "そうですか、 " * 500 for k in range(3000)])
    for call in (lambda: T.practical.func(texts), lambda: T.long_distance.func(texts, texts)):
        call()
        tracemalloc.start()
        call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5e6  # all of them take 21 MB


def test_distance_of_long_texts_with_parts_left_out():
    """Linear where a text has the other's characters in order, but for few."""
    import time

    rng = random.Random(2)
    turns = ["".join(rng.choices("abcdefghij klmnop", k=500)) for _ in range(800)]
    ref, cand = "".join(turns), "".join(t[2:] if k % 4 == 0 else t for k, t in enumerate(turns) if k % 7)
    begun = time.process_time()
    assert T.edit_distance(ref, cand) == T.edit_distance(cand, ref) == len(ref) - len(cand)
    assert len(ref) - len(cand) < T.edit_distance(ref, cand + "#noise") <= len(ref) - len(cand) + 6
    assert time.process_time() - begun < 10  # 400 000 by 340 000 characters, bit by bit, take a minute or more


def test_distance_equals_brute_force():

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choices("abcd", k=rng.randrange(14)))
        b = "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choices("abcde", k=rng.randrange(4)))
        assert T.edit_distance(a, b) == brute(a, b)
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        over = brute(a, b) - (len(long) - len(short))
        for most in (0, 1, 3, 30):
            assert T._excess(long, short, most) == (over if over <= most else None)


def test_text_distance_of_contained_texts(spark):
    """Cut texts take the difference of lengths, without a table of the distances; others are as Spark has them."""
    rows = [("abcdef", "cdef"), ("cd", "abcdef"), ("abc", "abd"), ("a😀b", "😀"), ("", "ab"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string").select(effort._distance("a", "b").alias("got"), F.levenshtein("a", "b").alias("want"))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
