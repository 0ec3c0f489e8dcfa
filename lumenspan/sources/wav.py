"""PCM16 WAV audio: header scan, channel split, range cut, window energies. Decoding is stdlib ``wave`` and numpy in
``mapInArrow``; only small rows of energies leave it."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Frames × channels of PCM16, and the rate. Other encodings raise."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM can be decoded")
        return np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()), f.getframerate()


def encode(frames: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(frames.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(frames.astype("<i2").tobytes())
    return out.getvalue()


def info(data: bytes) -> dict:
    with wave.open(io.BytesIO(data)) as f:
        n, rate = f.getnframes(), f.getframerate()
        return {"duration_ms": round(n / rate * 1000), "channels": f.getnchannels(), "sample_rate": rate, "sample_width": f.getsampwidth(), "frame_count": n}


def split(data: bytes) -> dict[str, bytes]:
    """L, R and MIX (the mean, halves to even) of stereo; MIX of mono."""
    frames, rate = decode(data)
    if frames.shape[1] == 1:
        return {"MIX": data}
    left, right = frames[:, :1], frames[:, 1:2]
    mix = np.rint((left.astype(np.int32) + right) / 2)
    return {"L": encode(left, rate), "R": encode(right, rate), "MIX": encode(mix, rate)}


def cut(data: bytes, start_ms: int, end_ms: int) -> bytes:
    """A range; frame bounds round halves to even, within the audio. An empty range raises."""
    frames, rate = decode(data)
    lo, hi = (max(0, min(len(frames), round(rate * ms / 1000))) for ms in (start_ms, end_ms))
    if hi <= lo:
        raise ValueError("the range has no audio")
    return encode(frames[lo:hi], rate)


def gain(data: bytes, target_dbfs: float = -24.0, peak_dbfs: float = -3.0, most: float = 4.0) -> bytes:
    """Louder by up to ``most``, to the target level, below the peak; left alone for a hundredth."""
    frames, rate = decode(data)
    rms, peak = float(np.sqrt(np.mean(frames.astype(np.float64) ** 2))) if frames.size else 0.0, int(np.abs(frames.astype(np.int32)).max(initial=0))
    if not rms or not peak:
        return data
    by = min(most, 32767 * 10 ** (target_dbfs / 20) / rms, 32767 * 10 ** (peak_dbfs / 20) / peak)
    return data if by <= 1.01 else encode(np.clip(np.rint(frames * by), -32768, 32767), rate)


def window_energies(audio: DataFrame, window_ms: int = 100) -> DataFrame:
    """``case_id, content`` → ``case_id, at, start_ms, end_ms, left_sq, right_sq, all_sq, n``, a row a window.

    Sums of squares add up, so any range's level is an aggregate over rows; audio itself is never shuffled. Audio that
    isn't 16-bit PCM is one window of the whole file without sums (``n`` 0), which energy can't tell from speech.
    """
    spec = "case_id string, at long, start_ms long, end_ms long, left_sq double, right_sq double, all_sq double, n long"
    names = [x.split()[0] for x in spec.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, content in zip(batch.column("case_id"), batch.column("content"), strict=True):
                head = info(content.as_py())
                if head["sample_width"] != 2:
                    if head["duration_ms"]:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((case_id.as_py(), 0, 0, head["duration_ms"], None, None, None, 0), (pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 3, pa.int64()), strict=True)], names)
                    continue
                frames, rate = decode(content.as_py())
                step = max(1, round(rate * window_ms / 1000))
                starts = np.arange(0, len(frames), step)
                if not starts.size:
                    continue
                squares = np.add.reduceat(frames.astype(np.float64) ** 2, starts, axis=0)
                ends = np.minimum(starts + step, len(frames))
                ms = lambda x, rate=rate: np.rint(x / rate * 1000).astype(np.int64)
                columns = [pa.array([case_id.as_py()] * starts.size), pa.array(np.arange(starts.size)), pa.array(ms(starts)), pa.array(ms(ends)), pa.array(squares[:, 0]), pa.array(squares[:, -1]), pa.array(squares.sum(axis=1)), pa.array((ends - starts).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return audio.select(F.col("case_id").cast("string"), "content").mapInArrow(run, spec)


def segment_levels(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """Segments with ``left_dbfs, right_dbfs`` of exactly their frames in ``audio`` (``case_id, content``).

    Each audio is decoded once with all bounds of its case; squares are summed a million frames at a time. Ranges without
    frames, and cases without audio, have no levels. Long files on storage are measured by :mod:`lumenspan.sources.audio`.
    """
    from lumenspan.operators.channels import level_of

    spec = "case_id string, id string, left_sq double, right_sq double, n long"
    names = [x.split()[0] for x in spec.split(", ")]
    bounds = segments.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.collect_list(F.struct("id", "start_ms", "end_ms")).alias("bounds"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, content, wanted in zip(*(batch.column(k) for k in ("case_id", "content", "bounds")), strict=True):
                frames, rate = decode(content.as_py())
                rows = wanted.as_py()
                lo, hi = (np.array([max(0, min(len(frames), round(rate * r[k] / 1000))) for r in rows]) for k in ("start_ms", "end_ms"))
                squared = lambda a, b, frames=frames: sum((np.square(frames[k : min(b, k + (1 << 20))], dtype=np.int64).sum(axis=0) for k in range(a, b, 1 << 20)), np.zeros(frames.shape[1], np.int64))
                sums, n = np.array([squared(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.float64).reshape(len(rows), -1), hi - lo
                some = np.flatnonzero(n > 0)
                columns = [[case_id.as_py()] * some.size, [rows[k]["id"] for k in some], sums[some, 0], sums[some, -1], n[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names)

    held = audio.select(F.col("case_id").cast("string").alias("case_id"), "content").join(bounds, "case_id").mapInArrow(run, spec)
    levels = held.select(F.col("case_id").alias("_case"), F.col("id").alias("_id"), level_of(F.col("left_sq"), F.col("n")).alias("left_dbfs"), level_of(F.col("right_sq"), F.col("n")).alias("right_dbfs"))
    return segments.join(levels, (segments["case_id"].cast("string") == F.col("_case")) & (segments["id"] == F.col("_id")), "left").drop("_case", "_id")


def analysed(audio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``case_id, content`` → headers (``case_id, duration_ms, channels, sample_rate, sample_width, frame_count``) and
    channels (``case_id, channel, content``). What isn't WAV raises."""

    def headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"case_id": c.as_py(), **info(a.as_py())} for c, a in zip(batch.column("case_id"), batch.column("content"), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    def channels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, content in zip(batch.column("case_id"), batch.column("content"), strict=True):
                for name, part in split(content.as_py()).items():
                    yield pa.RecordBatch.from_arrays([pa.array([case_id.as_py()]), pa.array([name]), pa.array([part], pa.binary())], ["case_id", "channel", "content"])

    held = audio.select(F.col("case_id").cast("string"), "content")
    return held.mapInArrow(headers, "case_id string, duration_ms long, channels long, sample_rate long, sample_width long, frame_count long"), held.mapInArrow(channels, "case_id string, channel string, content binary")


def cut_clips(audio: DataFrame, intervals: DataFrame) -> DataFrame:
    """``case_id, channel, content`` and ``case_id, channel, start_ms, end_ms`` → clips ``case_id, channel, offset_ms,
    content``, each audio decoded once. With a column ``key`` in the intervals, the clips have it as their case."""
    key = F.col("key") if "key" in intervals.columns else F.col("case_id").cast("string")
    bounds = intervals.groupBy("case_id", "channel").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", key.alias("key")))).alias("bounds"))
    joined = audio.join(bounds, ["case_id", "channel"]).select("channel", "content", "bounds")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, content, wants in zip(*batch.columns, strict=True):
                source = content.as_py()
                for b in wants.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([b["key"]]), pa.array([channel.as_py()]), pa.array([b["start_ms"]], pa.int64()), pa.array([cut(source, b["start_ms"], b["end_ms"])], pa.binary())], ["case_id", "channel", "offset_ms", "content"])

    return joined.mapInArrow(run, "case_id string, channel string, offset_ms long, content binary")


def peaks(audio: DataFrame, buckets: int) -> DataFrame:
    """``case_id, bucket, peak``: the largest absolute sample of each of ``buckets`` even stretches, 0 to 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case_id, content in zip(batch.column("case_id"), batch.column("content"), strict=True):
                frames, _ = decode(content.as_py())
                if not len(frames):
                    continue
                loud = np.abs(frames.astype(np.int32)).max(axis=1)
                n = min(buckets, len(loud))
                tops = np.maximum.reduceat(loud, np.arange(n) * len(loud) // n) / 32768.0
                yield pa.RecordBatch.from_arrays([pa.array([case_id.as_py()] * n), pa.array(np.arange(n, dtype=np.int64)), pa.array(tops)], ["case_id", "bucket", "peak"])

    return audio.select(F.col("case_id").cast("string"), "content").mapInArrow(run, "case_id string, bucket long, peak double")
