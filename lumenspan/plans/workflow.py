"""From audio to segments: which channels and chunks a model hears, transcription, attribution, and one segment anew."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import hooks
from lumenspan.operators import channels as sides
from lumenspan.operators.intervals import replace_segment, review_flags, split_long
from lumenspan.sources import wav


@dataclass(frozen=True)
class Energy:
    """Speech detection by energy, as local models use it."""

    threshold_dbfs: float = -48.0
    window_ms: int = 100
    min_silence_ms: int = 500
    min_speech_ms: int = 200
    pad_ms: int = 200
    max_chunk_ms: int | None = None

    def __post_init__(self) -> None:
        if self.window_ms <= 0 or (self.max_chunk_ms is not None and self.max_chunk_ms <= 0):
            raise ValueError("window_ms and max_chunk_ms must be positive")


@dataclass(frozen=True)
class Model:
    """A speech model: its hook, whether it hears the mix and chunks by energy, and the longest chunk that it takes."""

    hook: Callable[[bytes, str], list[dict]]
    mix_first: bool = False
    max_chunk_ms: int | None = None
    energy: Energy = Energy()


def program(argv: list[str]) -> Callable[[bytes, str], list[dict]]:
    """A hook that is a program: it takes the channel as its last argument and a clip as WAV, and writes
    ``{"segments": [{"start_ms", "end_ms", "text"}]}`` in the clip's own time. Failures and other output raise."""
    if not argv:
        raise ValueError("a transcription command is needed")

    def hook(content: bytes, channel: str) -> list[dict]:
        done = subprocess.run([*argv, channel], input=content, capture_output=True, check=False)  # noqa: S603 - the user's own program
        if done.returncode:
            raise ValueError(f"the transcription command failed: {done.stderr.decode(errors='replace').strip() or 'no message'}")
        try:
            said = json.loads(done.stdout)["segments"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"the transcription command's output can't be read: {e}") from None
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if not isinstance(said, list) or not all(isinstance(x, dict) and whole(x.get("start_ms")) and whole(x.get("end_ms")) and isinstance(x.get("text"), str) for x in said):
            raise ValueError("the transcription command must write segments of whole times and a text")
        return said

    return hook


def heard(audio: DataFrame, mix_first: bool) -> DataFrame:
    """Of ``case_id, channel, content``: the mix for models that take it first, else both sides, else the mix."""
    has = audio.groupBy("case_id").agg(F.collect_set("channel").alias("has"))
    both, mixed = F.array_contains("has", "L") & F.array_contains("has", "R"), F.array_contains("has", "MIX")
    mix = F.array(F.lit("MIX"))
    chosen = F.when(mixed & (F.lit(mix_first) | ~both), mix).when(both, F.array(F.lit("L"), F.lit("R"))).otherwise(F.array().cast("array<string>"))
    return audio.join(has.select("case_id", F.explode(chosen).alias("channel")), ["case_id", "channel"])


def speech_chunks(audio: DataFrame, energy: Energy) -> DataFrame:
    """``case_id, channel, start_ms, end_ms`` of speech by energy, for each channel apart."""
    key = F.concat_ws("\0", "case_id", "channel")
    windows = wav.window_energies(audio.select(key.alias("case_id"), "content"), energy.window_ms)
    levels = windows.select("case_id", "start_ms", "end_ms", sides.level_of(F.col("all_sq"), F.col("n")).alias("level"))
    durations = windows.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms"))
    found = sides.energy_intervals(levels, durations, energy.threshold_dbfs, energy.min_silence_ms, energy.min_speech_ms, energy.pad_ms)
    if energy.max_chunk_ms is not None:
        found = split_long(found, energy.max_chunk_ms)
    part = lambda k: F.element_at(F.split("case_id", "\0"), k)
    return found.select(part(1).alias("_case"), part(2).alias("channel"), "start_ms", "end_ms").withColumnRenamed("_case", "case_id")


def chunks_for(audio: DataFrame, chunks: DataFrame, model: Model) -> DataFrame:
    """What a model hears of each channel: speech by energy if it takes the mix first, else the analysed chunks
    (``case_id, start_ms, end_ms``); cut to the longest chunk that it takes."""
    if model.mix_first:
        out = speech_chunks(audio, model.energy)
    else:
        out = audio.select("case_id", "channel").join(chunks.select("case_id", "start_ms", "end_ms"), "case_id")
    return out if model.max_chunk_ms is None else split_long(out, model.max_chunk_ms)


def transcribed(audio: DataFrame, chunks: DataFrame, model: Model) -> DataFrame:
    """``case_id, channel, content`` of analysed audio → segments with review flags.

    Models that hear the mix get sides by energy where the case has both. Attribution comes before ids are given.
    """
    chosen = heard(audio, model.mix_first)
    said = hooks.transcribe(wav.cut_clips(chosen, chunks_for(chosen, chunks, model)), model.hook)
    if model.mix_first:
        said = attributed(said, audio)
    return review_flags(said)


def attributed(segments: DataFrame, audio: DataFrame, threshold_db: float = sides.THRESHOLD_DB) -> DataFrame:
    """Spoken MIX segments take the louder side, without a limit on the other; cases without both sides stay."""
    level = {}
    for side in ("L", "R"):
        level[side] = wav.segment_levels(segments, audio.where(F.col("channel") == side)).select("case_id", "id", F.col("left_dbfs").alias(side))
    held = segments.join(level["L"], ["case_id", "id"], "left").join(level["R"], ["case_id", "id"], "left")
    side, _ = sides.decision(F.col("L"), F.col("R"), F.lit(threshold_db), F.lit(None).cast("double"))
    known = (F.col("kind") == "speech") & (F.col("channel") == "MIX") & F.col("L").isNotNull() & F.col("R").isNotNull()
    return held.withColumn("channel", F.when(known, side).otherwise(F.col("channel"))).select(*segments.columns)


def retranscribed(segments: DataFrame, audio: DataFrame, wanted: DataFrame, model: Model) -> DataFrame:
    """Segments with those that ``wanted`` (``case_id, id``) names heard again, on their own channel or, where the case
    lacks it, the mix, and replaced by what was said, which takes their channel.

    Ids of such cases are new by time. A segment of which nothing is said stays.
    """
    named = segments.join(wanted.select("case_id", "id"), ["case_id", "id"], "left_semi")
    own = audio.select("case_id", "channel").withColumn("_own", F.lit(True))
    ranges = named.select("case_id", "id", "channel", "start_ms", "end_ms").join(own, ["case_id", "channel"], "left")
    key = F.concat_ws("\0", "case_id", "id", "channel")
    ranges = ranges.select("case_id", key.alias("key"), F.when(F.col("_own"), F.col("channel")).otherwise(F.lit("MIX")).alias("channel"), "start_ms", "end_ms")
    if model.max_chunk_ms is not None:
        ranges = split_long(ranges, model.max_chunk_ms)
    said = hooks.transcribe(wav.cut_clips(audio, ranges), model.hook)
    part = lambda k: F.element_at(F.split("case_id", "\0"), k)
    rows = said.select(part(1).alias("_case"), part(2).alias("replaces"), part(3).alias("_channel"), "*").drop("case_id", "channel").withColumnsRenamed({"_case": "case_id", "_channel": "channel"})
    return review_flags(replace_segment(segments, rows.select(*segments.columns, "replaces")))
