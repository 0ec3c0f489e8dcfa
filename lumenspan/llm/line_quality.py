"""Quality rules: text statistics, and lines that many documents of a host share.

Lines are normalised (outer white space off, A-Z lower-cased) and hashed; a host's line is over the limit if more
distinct documents have it than ``max(min_docs, share * documents of the host)``. Lines over the limit are removed; a
document that keeps less than ``min_left`` of its words is depleted and rejected.

Distinct documents are distinct texts: exact copies count once, or a text copied often would be its own boilerplate.
Nothing coarser is one document: near copies, and pages that share other lines, count each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import per_batch, texts, unused, written

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, its first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    ends = np.zeros(len(words) + 1, np.int64)
    again = np.fromiter((k for k, w in enumerate(windows) if counts[w] > 1), np.int64)
    np.add.at(ends, again, 1)
    np.add.at(ends, again + WINDOW, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def statistics(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """The five counts, hashes and word counts of the distinct lines."""
    words = data.split()
    chars = len(data.decode("utf-8", "replace")) - sum(data.count(c) for c in SPACE)
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    sizes: dict[int, int] = {}
    for x in lines:
        h = xxhash.xxh64_intdigest(x.strip(SPACE).lower(), 42)
        sizes[h] = sizes.get(h, 0) + len(x.split())
    counts = [len(words), chars, sum(data.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)]
    return counts, list(sizes), list(sizes.values())


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text`` → those without the text, its hash ``text_hash``, counts and ``lines``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("h", pa.int64()), ("w", pa.int32())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, sizes, ids, ends = [], [], [], [], [0]
        for t in texts(batch):
            c, h, s = statistics(t)
            counts.append(c)
            hashes += h
            sizes += s
            ids.append(xxhash.xxh64_intdigest(t, 42))
            ends.append(len(hashes))
        flat = pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())], fields=list(struct))
        lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        signed = pa.array(np.array(ids, np.uint64).view(np.int64))
        cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), signed, *cols, lines], ["doc_id", "source", "text_hash", *STATS, "lines"])

    fields = ", ".join(f"{x} long" for x in STATS)
    return docs.select("doc_id", F.col("source").cast("string"), "text").mapInArrow(per_batch(run), f"doc_id {id_type}, source string, text_hash long, {fields}, lines array<struct<h: long, w: int>>")


def frequent_lines(slim: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``source, h`` of the lines over the limit.

    First a plain count of rows by line, combined before the shuffle; that is an upper bound, so only lines over the
    limit by it are looked at again, to count distinct texts exactly: pairs of line and text are made distinct, spread
    by both, and then counted by line with a combination before the shuffle. A line of a third of all rows is no
    larger a task than others.
    """
    limits = slim.groupBy("source").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(float(share))).alias("limit"))
    limits = limits.select(F.col("source").alias("s"), (F.col("limit") + 1e-9).alias("limit"))
    each = slim.select("source", F.explode("lines.h").alias("h"))
    many = each.groupBy("source", "h").agg(F.count("*").alias("n"))
    many = many.join(limits, F.col("source").eqNullSafe(F.col("s"))).where("n > limit")
    many = written(many.select(F.col("source").alias("s"), F.col("h").alias("g"), "limit"), "many")
    pairs = slim.select("source", "text_hash", F.explode("lines.h").alias("h"))
    pairs = pairs.join(many, (F.col("h") == F.col("g")) & F.col("source").eqNullSafe(F.col("s"))).select("source", "h", "limit", "text_hash").distinct()
    return pairs.groupBy("source", "h", "limit").agg(F.count("*").alias("n")).where("n > limit").select("source", "h")


def line_quality(docs: DataFrame, min_docs: int = 50, share: float = 0.005, min_left: float = 0.3) -> DataFrame:
    """Statistics and verdict of each row: ``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed, left_words, kept``.

    Takes ``doc_id, source, text``; other columns are ignored. ``removed`` has the hashes of the lines over the limit.
    ``base_failed``: under 10 words, or more than a fifth of them repeated. ``kept``: not ``base_failed``, and at
    least ``min_left`` of the words stand in other lines. Null texts are empty and fail; null sources are one host.
    Repeated rows get a row each, with equal verdicts. An empty table gives an empty table.
    """
    slim = written(document_lines(docs), "lines")
    frequent = written(frequent_lines(slim, min_docs, share), "frequent")
    each = slim.select("doc_id", "text_hash", "source", F.explode("lines.h").alias("h"))
    hit = each.join(frequent.select(F.col("source").alias("s"), F.col("h").alias("g")), (F.col("h") == F.col("g")) & F.col("source").eqNullSafe(F.col("s")))
    hit = hit.groupBy("doc_id", "text_hash", "source").agg(F.collect_set("h").alias("removed"))
    hit = hit.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "source")], "removed")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "text_hash", "source")]
    out = slim.join(hit, same[0] & same[1] & same[2], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains(F.col("removed"), x.h)), F.lit(0).cast("long"), lambda a, x: a + x.w)
    out = out.withColumn("left_words", F.col("n_words") - gone)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("left_words") >= min_left * F.col("n_words") - 1e-9)
    return out.select("doc_id", "text_hash", "source", *STATS, "base_failed", "removed", "left_words", kept.alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """A text without the lines whose normalised hashes are in ``removed``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(F.translate(F.btrim(x, F.lit(" \t\x0b\x0c\r")), upper, lower)))), "\n")


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`line_quality` keeps, all columns, each as often as it stands there.

    Lines over the limit go from the texts (and ``n_chars``, if there, is counted anew). Null texts go, being empty;
    null ids and sources are equal to each other. An empty table gives an empty table.
    """
    names = [unused(f"_{c}", docs) for c in ("id", "hash", "source", "removed")]
    verdict = line_quality(docs, **limits).where("kept").select("doc_id", "text_hash", "source", "removed").dropDuplicates(["doc_id", "text_hash", "source"]).toDF(*names)
    own = [docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))), docs["source"].cast("string")]
    same = [c.eqNullSafe(F.col(n)) for c, n in zip(own, names[:3], strict=True)]
    out = docs.join(verdict, same[0] & same[1] & same[2])
    removed = F.col(names[3])
    text = F.when(F.size(removed) > 0, without_lines(docs["text"], removed)).otherwise(docs["text"])
    return out.select(*[text.alias("text") if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])
