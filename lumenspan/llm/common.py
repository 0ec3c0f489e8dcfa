"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII white space that separates words, as a Java or RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"

_FOLDERS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder of our own is made on a ``local`` master, as in tests; a cluster without a shared
    folder is an error, since executors would write where nobody else can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = known.rsplit("/", 1)[0] if known else f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{root.rstrip('/')}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared root; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_root(spark)}/lumenspan-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex[:8]}"


def release(spark: SparkSession) -> None:
    """Delete what :func:`shared_folder` gave out in this application."""
    try:
        folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
        if folder:
            remove(spark, folder)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; then the cluster's own clean-up has the folder
        return


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write as Parquet in the shared folder and read back; also the folder, for :func:`remove`."""
    spark = df.sparkSession
    uri = shared_folder(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`saved` until the application ends."""
    return saved(df, name)[0]


class Scratch:
    """Intermediate tables that are deleted together once what was made of them is saved."""

    def __init__(self, spark: SparkSession):
        self.spark, self.uris = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, uri = saved(df, name)
        self.uris.append(uri)
        return out

    def done(self) -> None:
        while self.uris:
            remove(self.spark, self.uris.pop())


def work_partitions(spark: SparkSession) -> int:
    """A fixed number of partitions for small rows that stand for much work, which must not be merged by their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes (a larger row alone), never empty.

    Spark bounds the bytes of a batch that it sends; what a batch is made into can be many times as large, and this
    bounds that without touching the session's settings.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(rows, batch.num_rows - at)
            while step > 1 and batch.slice(at, step).nbytes > size:
                step = (step + 1) // 2
            yield batch.slice(at, step)
            at += step


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], rows: int = 1000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that handles a batch of at most ``rows`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield fn(batch)

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty; one value at a time, so that a batch isn't held twice."""
    column = batch.column(name).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def count_words(text: str | Column = "text") -> Column:
    """Number of words of a column, natively; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def typed(docs: DataFrame, name: str = "doc_id") -> str:
    """A column's type, for a schema string."""
    return docs.schema[name].dataType.simpleString()


def unused(name: str, *frames: DataFrame) -> str:
    """A column name, made from ``name``, that none of the frames has."""
    have = {c.lower() for df in frames for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def range_bounds(docs: DataFrame, ranges: int, name: str = "doc_id") -> list:
    """Values of a column that part its rows into about ``ranges`` equal ranges: one value a range comes to the driver.

    For text, which has no approximate percentiles, 50 values a range come, those with the smallest hashes.
    """
    if isinstance(docs.schema[name].dataType, StringType):
        some = sorted(r[0] for r in docs.select(name).where(F.col(name).isNotNull()).orderBy(F.xxhash64(name), name).limit(50 * ranges).collect())
        return sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []
    steps = [k / ranges for k in range(1, ranges)]
    return sorted(set(docs.select(name).agg(F.percentile_approx(name, steps, max(10_000, 100 * ranges))).first()[0] or []))


def range_of(docs: DataFrame, bounds: list, name: str = "doc_id") -> Column:
    """Number of a row's range: how many bounds are under its value; null: as many as there are bounds.

    Found in two steps, among the last bounds of chunks and then within a chunk, so that a row takes about twice the
    root of the number of bounds in comparisons.
    """
    if not bounds:
        return F.lit(0)
    value, kind, width = F.col(name), typed(docs, name), max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    array = lambda xs: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    under = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    chunk = under(array([c[-1] for c in chunks]))  # whole chunks under the value
    within = F.coalesce(under(F.get(F.array(*map(array, chunks)), chunk)), F.lit(0))
    return F.when(value.isNull(), F.lit(len(bounds))).otherwise(F.least(chunk * width + F.greatest(within, F.lit(0)), F.lit(len(bounds)))).cast("int")
