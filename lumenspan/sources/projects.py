"""A store of projects: a log of each project's changes, and versions of its rows.

``projects`` is the log: an entry tells what a change sets, a file of its own that appears whole or not at all. Rows
(``segments``, ``audio``, ``chunks``) are written by Spark into a folder of a new version, and become the project's by
the entry that names it; a save that fails before leaves a folder that nothing reads. So a project may be saved from its
own segments, a reader never meets half a save, and changes of different tables don't undo each other.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.intervals import fixed_chunks
from lumenspan.schemas import assert_valid, violations
from lumenspan.scratch import checkpointed
from lumenspan.sources.wav import analysed

# Fixed value: what a project's id looks like.
PROJECT_ID = re.compile(r"[0-9a-f]{32}")
ABOUT = {"source_file": "string", "source_language": "string", "mime_type": "string", "has_audio": "boolean", "duration_ms": "long"}
TABLES = {
    "segments": "ord long, id string, start_ms long, end_ms long, channel string, kind string, text string, needs_review boolean",
    "audio": "name string, content binary",
    "chunks": "index long, start_ms long, end_ms long",
}
#: What an entry of the log may set; what it leaves null stays as it was.
SET = ABOUT | dict.fromkeys(TABLES, "string")
LOG = "number long, " + ", ".join(f"{k} {t}" for k, t in SET.items())


def safe_extension(file_name: str) -> str:
    """A file's ending in lower case, ``.bin`` if it is none of up to 11 letters and digits."""
    found = re.search(r"[^/.][^/]*?(\.[a-z0-9]{1,11})$", file_name.lower())
    return found.group(1) if found else ".bin"


class Projects:
    """Projects under a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        """Parquet under the root; empty before the first save."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @staticmethod
    def _state(log: DataFrame) -> DataFrame:
        """A row a project: of each field the last value that an entry sets (entries of one number: by name)."""
        last = F.struct("number", "entry")
        return log.groupBy("project_id").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), last)).alias(k) for k in SET], F.max("number").alias("number"))

    def _projects(self) -> DataFrame:
        return self._state(self._read("projects", f"{LOG}, project_id string, entry string"))

    def _log_of(self, project_id: str) -> DataFrame:
        if not PROJECT_ID.fullmatch(project_id):
            raise ValueError("a project id has 32 hexadecimal digits")
        return self._read(f"projects/project_id={project_id}", f"{LOG}, entry string").withColumn("project_id", F.lit(project_id))

    def table(self, name: str) -> DataFrame:
        """The rows of all projects as they are now, with ``project_id``."""
        held = self._read(name, f"{TABLES[name]}, project_id string, version string")
        return held.join(self._projects().select("project_id", F.col(name).alias("version")), ["project_id", "version"], "left_semi").drop("version")

    def _known(self, project_id: str) -> dict:
        row = self._state(self._log_of(project_id)).first()
        if row is None:
            raise ValueError("there is no such project")
        return row.asDict()

    def project(self, project_id: str) -> dict:
        """A project's metadata; an unknown one raises."""
        known = self._known(project_id)
        return {k: known[k] for k in ABOUT} | {"project_id": project_id}

    def _put(self, name: str, project_id: str, rows: DataFrame) -> str:
        """Write rows as a new version, which counts once an entry names it."""
        version = uuid.uuid4().hex
        rows.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{self.root}/{name}/project_id={project_id}/version={version}")
        return version

    def _note(self, project_id: str, number: int, **values) -> None:
        """Append an entry; then the versions that it or a later one follows by two steps or more are deleted."""
        row = self.spark.createDataFrame([(number, *(values.get(k) for k in SET))], LOG)
        row.coalesce(1).write.parquet(f"{self.root}/projects/project_id={project_id}/entry={uuid.uuid4().hex}")
        for name in TABLES.keys() & values.keys():
            kept = 2  # the one now, and the one before for readers that have begun
            old = self._log_of(project_id).where(F.col(name).isNotNull()).orderBy(F.desc("number"), F.desc("entry")).offset(kept).limit(kept).select(name)
            for r in old.collect():
                self._delete(f"{name}/project_id={project_id}/version={r[0]}")

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _of(self, name: str, project_id: str) -> DataFrame:
        """A project's rows of a table as they are now, read from their version alone."""
        version = self._known(project_id)[name]
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/project_id={project_id}/version={version}")

    def create_from_segments(self, segments: DataFrame, source_language: str, source_file: str | None = None, duration_ms: int | None = None) -> str:
        project_id = uuid.uuid4().hex
        version = self._put("segments", project_id, self._valid(project_id, segments))
        self._note(project_id, 0, source_file=source_file, source_language=source_language, has_audio=False, duration_ms=duration_ms, segments=version)
        return project_id

    def create_from_audio(self, file_name: str, mime_type: str, content: bytes) -> str:
        for name, value in (("file_name", file_name), ("mime_type", mime_type), ("content", content)):
            if not value:
                raise ValueError(f"{name} must not be empty")
        project_id = uuid.uuid4().hex
        version = self._put("audio", project_id, self.spark.createDataFrame([(f"original{safe_extension(file_name)}", bytearray(content))], TABLES["audio"]))
        self._note(project_id, 0, source_file=file_name, mime_type=mime_type, has_audio=True, audio=version)
        return project_id

    @staticmethod
    def _valid(project_id: str, segments: DataFrame) -> DataFrame:
        held = segments if "case_id" in segments.columns else segments.withColumn("case_id", F.lit(project_id))
        assert_valid(violations(held))
        return held

    def save_segments(self, project_id: str, segments: DataFrame) -> None:
        """Replace a project's segments; invalid ones raise before anything is written. No segments: none stay.

        Nothing of them comes to the driver. Of two saves at once, all rows of one stay.
        """
        number = self._known(project_id)["number"]
        self._note(project_id, number + 1, segments=self._put("segments", project_id, self._valid(project_id, segments)))

    def segments(self, project_id: str) -> DataFrame:
        """A project's segments, the project as their case."""
        return self._of("segments", project_id).withColumn("case_id", F.lit(project_id))

    def chunks(self, project_id: str) -> DataFrame:
        """The chunks of a project's analysed audio, the project as their case."""
        return self._of("chunks", project_id).withColumn("case_id", F.lit(project_id))

    def channels(self, project_id: str) -> DataFrame:
        """``case_id, channel, content`` of a project's analysed audio; one that wasn't analysed raises."""
        held = self._of("audio", project_id).where("name in ('L', 'R', 'MIX')")
        if held.isEmpty():
            raise ValueError("the project has no analysed audio")
        return held.select(F.lit(project_id).alias("case_id"), F.col("name").alias("channel"), "content")

    def audio(self, project_id: str, name: str | None = None) -> bytes:
        """The original audio, or a channel's (``L``, ``R``, ``MIX``)."""
        wanted = F.col("name").startswith("original.") if name is None else F.col("name") == name
        row = self._of("audio", project_id).where(wanted).first()
        if row is None:
            raise ValueError("the project has no such audio")
        return bytes(row["content"])

    def analyse(self, project_id: str, max_chunk_ms: int = 180_000) -> dict:
        """Split a project's audio by channel and cut it into chunks, as one change; returns the metadata."""
        number = self._known(project_id)["number"]
        original = self._of("audio", project_id).where(F.col("name").startswith("original."))
        info, channels = analysed(original.select(F.lit(project_id).alias("case_id"), "content"))
        info = checkpointed(info.select("case_id", "duration_ms"))
        first = info.first()
        if first is None:
            raise ValueError("the project has no audio")
        audio = self._put("audio", project_id, original.unionByName(channels.select(F.col("channel").alias("name"), "content")))
        chunks = self._put("chunks", project_id, fixed_chunks(info, max_chunk_ms))
        self._note(project_id, number + 1, duration_ms=first["duration_ms"], audio=audio, chunks=chunks)
        return self.project(project_id)

    def summary(self) -> DataFrame:
        """A row a project: segments and flagged ones."""
        held = self.table("segments").groupBy("project_id").agg(F.count("*").alias("segments"), F.sum(F.col("needs_review").cast("long")).alias("review_count"))
        return self._projects().select("project_id", *ABOUT).join(held, "project_id", "left").na.fill(0, ["segments", "review_count"])
