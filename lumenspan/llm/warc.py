"""WARC archives with an index first.

Writing gives an index row for each record (file, offset, length, URL, digest); it is saved as a table before anything
is read. Reading takes rows of the index, sorts them by place, joins neighbouring byte ranges into larger reads and
parses the records. Each record is a gzip member of its own, so a byte range is a readable archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenspan.llm.common import shared_folder, slices, work_partitions, written
from lumenspan.llm.files import Writer, opened

INDEX = "file string, offset long, length long, url string, digest string, page_id {id}"
RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}"
ID = "urn:lumenspan:page:"
#: Payloads under this are never replaced by a revisit.
LEAST_BYTES = 1000


def information(date: str = "2000-01-01T00:00:00Z", name: str = "") -> bytes:
    """The record that a file begins with; the index leaves it out."""
    body = b"software: lumenspan\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:lumenspan:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _named(page_id: int | str | None, digest: str) -> str:
    """A record's name; a null id is ``!``, which no quoted id is."""
    return f"<{ID}{'!' if page_id is None else quote(str(page_id), safe='')}:{digest}>"


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response record, or (``refers_to`` given) a revisit record without the payload.

    A record is named by its page and payload, so rows that repeat an id share a name only if they are the same capture.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes, number: bool = True) -> dict:
    """A record's fields, its ids as numbers or text; a response's payload digest is computed anew and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(name: str | None) -> int | str | None:
        found = (name or f"<{ID}!:>").removeprefix(f"<{ID}").split(":")[0]
        return None if found == "!" else int(found) if number else unquote(found)

    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": declared, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To"))}


def _by_text(df: DataFrame) -> bool:
    return isinstance(df.schema["page_id"].dataType, StringType)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: among equal payloads of 1000 bytes or more all but the largest page_id
    (ties: all that have it) refer to it.

    Digests alone are grouped; only those that occur twice meet the pages again. Text ids stay text and are compared by
    code point; others are whole numbers.
    """
    page_id = F.col("page_id") if _by_text(pages) else F.col("page_id").cast("long")
    shaped = pages.select(page_id.alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    shaped = shaped.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = shaped.where(F.octet_length("html") >= LEAST_BYTES)
    twice = written(large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").select(F.col("digest").alias("_digest"), "target"), "twice")
    joined = shaped.join(twice, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("target")), F.lit(None)).otherwise(F.col("target")).alias("refers_to"))


def member(data: bytes, level: int) -> bytes:
    """A gzip member of its own."""
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write a record for each of :func:`with_revisits`'s rows into ``folder``; the saved index.

    Files of a task that is run again are left out: the index names only those of the attempt that counted.
    """
    spec = INDEX.format(id="string" if _by_text(pages) else "long")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string() if _by_text(pages) else pa.int64())
    names = [x.split()[0] for x in spec.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Writer | None = None
        for batch in slices(batches, 200):
            rows: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                payload = html.as_py().encode()
                data = member(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py()), level)
                if out is not None and out.at + len(data) > file_bytes:
                    out.close()
                    out = None
                if out is None:
                    out = Writer(folder, ".warc.gz")
                    out.append(member(information(name=out.name), level))
                rows.append((out.name, out.append(data), len(data), url.as_py(), digest.as_py(), page_id.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return written(pages.mapInArrow(run, spec), "warc-index")


def ranges(rows: Iterable[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted ``(file, offset, length)`` → ``(file, start, end, records)``: neighbours no more than ``gap`` bytes apart
    are read together, up to ``most`` bytes (a larger record alone)."""
    file, start, end, held = "", 0, 0, []
    for name, at, size in rows:
        if held and (name != file or at - end > gap or max(end, at + size) - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, at, at
        held.append((at, size))
        end = max(end, at + size)
    if held:
        yield file, start, end, held


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20, payload: bool = False) -> DataFrame:
    """The records of the index rows given: a row for each, in coalesced reads; ``payload=True`` adds it as binary.

    An index row given twice gives its record twice; no index rows give an empty table.
    """
    number = not _by_text(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name, source = None, None
        rows: list[dict] = []
        places = ((f.as_py(), o.as_py(), n.as_py()) for b in batches for f, o, n in zip(b.column("file"), b.column("offset"), b.column("length"), strict=True))
        for file, start, end, held in ranges(places, gap, most):
            if file != name:
                name, source = file, system.open_input_file(f"{path}/{file}")
            data = source.read_at(end - start, start)
            for at, size in held:
                rows.append(parse(zlib.decompress(data[at - start : at - start + size], 31), number))
            if len(rows) >= 200:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    spec = RECORDS.format(id="long" if number else "string") + ", payload binary" * payload
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in spec.split(", "))])
    dealt = index.select("file", "offset", "length").repartition(work_partitions(index.sparkSession), "file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, spec)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives of all ``pages`` (``page_id, url, html``; other columns are ignored) and read them back.

    Null html is an empty payload, null URLs have no target header, a null page_id names none (it never is a revisit's
    target). Repeated rows get a record each. An empty table gives an empty table.
    """
    folder = shared_folder(spark, "warc")
    return read_archives(write_archives(with_revisits(pages), folder), folder)
