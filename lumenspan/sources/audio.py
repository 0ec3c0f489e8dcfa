"""Audio files by range reads: headers, exact levels of ranges, and clips, without reading a file whole.

A header takes a few small reads. Ranges are dealt by blocks of ``BLOCK`` frames: a block that some range touches is read
by its byte range in one task, and running sums of squares within it give each range's part; parts add up by range. So a
task holds one block however long a file is, blocks of one file are read side by side, and what no range touches isn't
read. Paths are those that pyarrow's file systems open (local, ``file:``, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lumenspan.sources.wav import encode

#: Frames of a block: 4 MB of 16-bit stereo, and 16 MB of sums.
BLOCK = 1 << 20

HEADER = "case_id string, audio string, data_at long, frame_count long, channels long, sample_rate long, sample_width long, duration_ms long"


@lru_cache(maxsize=8)
def _filesystem(scheme: str, host: str) -> pafs.FileSystem:
    return pafs.LocalFileSystem() if scheme == "file" else pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def opened(uri: str) -> pa.NativeFile:
    """A file for random reads."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return _filesystem("file", "").open_input_file(os.path.abspath(uri))
    if scheme == "file":
        return _filesystem("file", "").open_input_file("/" + rest.lstrip("/"))
    host, _, path = rest.lstrip("/").partition("/")
    return _filesystem(scheme, host).open_input_file(path if scheme in ("hdfs", "viewfs") else f"{host}/{path}")


def header(f: pa.NativeFile) -> dict:
    """Where a WAV file's samples are and what they are, by its chunks; data cut short ends with the file. What isn't PCM raises."""
    size = f.size()
    if size < 12 or f.read_at(4, 0) != b"RIFF" or f.read_at(4, 8) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
            if kind not in (1, 0xFFFE) or not channels or not rate:
                raise ValueError("only PCM can be read")
            form = channels, rate, (bits + 7) // 8
        elif name == b"data":
            if form is None:
                raise ValueError("the samples come before their format")
            channels, rate, width = form
            frames = min(length, size - at - 8) // (channels * width)
            return {"data_at": at + 8, "frame_count": frames, "channels": channels, "sample_rate": rate, "sample_width": width, "duration_ms": round(frames / rate * 1000)}
        at += 8 + length + (length & 1)
    raise ValueError("the file has no samples")


def headers(files: DataFrame) -> DataFrame:
    """``case_id, audio`` (a path) → the columns of :data:`HEADER`. Null paths are left out; what isn't WAV raises."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case_id, path in zip(batch.column("case_id").to_pylist(), batch.column("audio").to_pylist(), strict=True):
                with opened(path) as f:
                    try:
                        rows.append({"case_id": case_id, "audio": path, **header(f)})
                    except (ValueError, struct.error) as e:
                        raise ValueError(f"{path}: {e}") from None
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return files.where("audio is not null").select(F.col("case_id").cast("string"), "audio").mapInArrow(run, HEADER)


def problems(heads: DataFrame, channels: int = 2) -> DataFrame:
    """``case_id, rule``: files that aren't 16-bit, or have fewer channels than are asked for."""
    few = F.lit("stereo audio is needed") if channels == 2 else F.lit(f"{channels} channels are needed")
    rule = F.when(F.col("sample_width") != 2, F.lit("only 16-bit samples can be measured")).when(F.col("channels") < channels, few)
    return heads.select("case_id", rule.alias("rule")).where("rule is not null")


def _frame(ms: Column, rate: Column, frames: Column) -> Column:
    """A time's frame: halves round to even, within the audio."""
    return F.greatest(F.lit(0), F.least(frames, F.rint(rate.cast("double") * ms / 1000).cast("long")))


def range_sums(ranges: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """``case_id, start_ms, end_ms`` → the distinct ranges with ``left_sq, right_sq`` (sums of squares of exactly their
    frames; of the first and the last channel) and ``n`` frames.

    Ranges of cases without audio are left out; those without a frame have ``n`` 0. Sums are whole numbers, so they are
    the same however blocks are cut. 16-bit samples only; :func:`problems` tells which files have others.
    """
    key = ["case_id", "start_ms", "end_ms"]
    wanted = ranges.select(F.col("case_id").cast("string").alias("case_id"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long")).distinct().join(heads, "case_id")
    lo, hi = (_frame(F.col(c), F.col("sample_rate"), F.col("frame_count")) for c in ("start_ms", "end_ms"))
    wanted = wanted.select(*key, "audio", "data_at", "channels", lo.alias("lo"), F.greatest(lo, hi).alias("hi"))
    touched = F.sequence(F.floor(F.col("lo") / block), F.floor((F.greatest(F.col("hi"), F.col("lo") + 1) - 1) / block))
    parts = wanted.where("hi > lo").withColumn("block", F.explode(touched))
    parts = parts.repartition("audio", "block").sortWithinPartitions("audio", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, upto = None, None
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for r in rows:
                here = r["audio"], r["block"]
                if here != held:
                    first, width = r["block"] * block, 2 * r["channels"]
                    with opened(r["audio"]) as f:
                        data = f.read_at(block * width, r["data_at"] + first * width)
                    frames = np.frombuffer(data[: len(data) // width * width], "<i2").reshape(-1, r["channels"])[:, [0, -1]].astype(np.int64)
                    upto = np.zeros((len(frames) + 1, 2), np.int64)
                    np.cumsum(frames**2, axis=0, out=upto[1:])
                    held = here
                a, b = (max(0, min(len(upto) - 1, r[k] - r["block"] * block)) for k in ("lo", "hi"))
                left, right = (upto[b] - upto[a]).tolist()
                out.append({**{k: r[k] for k in key}, "left_sq": left, "right_sq": right, "n": b - a})
            if out:
                yield pa.RecordBatch.from_pylist(out)

    sums = parts.select(*key, "audio", "data_at", "channels", "lo", "hi", "block").mapInArrow(run, "case_id string, start_ms long, end_ms long, left_sq long, right_sq long, n long")
    none = wanted.where("hi = lo").select(*key, *[F.lit(0).cast("long").alias(c) for c in ("left_sq", "right_sq", "n")])
    return sums.unionByName(none).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("left_sq", "right_sq", "n")])


def segment_levels(segments: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """Segments with ``left_dbfs, right_dbfs`` of exactly their frames; null for a range without frames and a case
    without audio."""
    from lumenspan.operators.channels import level_of

    sums = range_sums(segments, heads, block).where("n > 0")
    levels = sums.select(F.col("case_id").alias("_case"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"), level_of(F.col("left_sq"), F.col("n")).alias("left_dbfs"), level_of(F.col("right_sq"), F.col("n")).alias("right_dbfs"))
    same = (F.col("case_id").cast("string") == F.col("_case")) & (F.col("start_ms") == F.col("_from")) & (F.col("end_ms") == F.col("_to"))
    return segments.join(levels, same, "left").drop("_case", "_from", "_to")


def silent_ranges(segments: DataFrame) -> DataFrame:
    """``case_id, id, rule``: spoken segments that no frame lies in."""
    return segments.where("kind = 'speech' and left_dbfs is null").select("case_id", "id", F.lit("the range has no audio").alias("rule"))


def clips(ranges: DataFrame, heads: DataFrame) -> DataFrame:
    """``ranges`` (``case_id, start_ms, end_ms`` and more) with ``content``: the range as a WAV file, read by its bytes.

    A clip is one value; ranges are dealt evenly, whatever file they are of. An empty range raises. A column of that
    name is replaced.
    """
    ranges = ranges.drop("content")
    names = ranges.columns
    named = heads.select(F.col("case_id").alias("_case"), F.struct("audio", "data_at", "channels", "sample_rate", "sample_width", "frame_count").alias("_head"))
    joined = ranges.join(named, F.col("case_id").cast("string") == F.col("_case")).drop("_case")
    lo, hi = (_frame(F.col(c), F.col("_head.sample_rate"), F.col("_head.frame_count")) for c in ("start_ms", "end_ms"))
    joined = joined.withColumn("_lo", lo).withColumn("_hi", hi).repartition("case_id", "start_ms", "end_ms")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a clip at a time
                row = batch.slice(at, 1)
                head, lo, hi = (row.column(c)[0].as_py() for c in ("_head", "_lo", "_hi"))
                if hi <= lo:
                    raise ValueError(f"case {row.column('case_id')[0].as_py()}: the range has no audio")
                if head["sample_width"] != 2:
                    raise ValueError(f"{head['audio']}: only 16-bit samples can be cut")
                width = 2 * head["channels"]
                with opened(head["audio"]) as f:
                    data = f.read_at((hi - lo) * width, head["data_at"] + lo * width)
                content = encode(np.frombuffer(data, "<i2").reshape(-1, head["channels"]), head["sample_rate"])
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), pa.array([content], pa.binary())], [*names, "content"])

    return joined.mapInArrow(run, StructType([*ranges.schema, StructField("content", BinaryType())]))
