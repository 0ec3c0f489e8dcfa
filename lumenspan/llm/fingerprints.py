"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

Terms are lower-cased words and neighbouring word pairs; a term votes on each bit with its hash's sign and the weight
``16 + 16 * log2(frequency)``, so frequent words don't drown the rest. Fingerprints within a Hamming radius are found
by tables keyed on blocks of bits: with ``radius + 2`` blocks any two such fingerprints agree on two blocks at least,
so a table for each two blocks (the bits permuted so that they lead) finds every one of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from lumenspan.llm.common import range_bounds, range_of, slices, typed, work_partitions, written

OUT = "n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def fingerprint(text: str) -> int:
    """64-bit weighted SimHash of a text; without words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    terms = Counter(words)
    terms.update(pairwise(words))
    digest = xxhash.xxh64_intdigest
    counts = np.fromiter(terms.values(), np.int64, len(terms))
    weights = np.rint(16 + 16 * np.log2(counts)).astype(np.int64)
    votes = np.zeros(64, np.int64)
    keys = [x if type(x) is bytes else b" ".join(x) for x in terms]
    for at in range(0, len(keys), 1 << 15):
        h = np.array([digest(x) for x in keys[at : at + (1 << 15)]], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[at : at + (1 << 15)] @ (2 * bits.astype(np.int64) - 1)
    return int(np.packbits(votes > 0, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits, 0 to 1."""
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _along(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted within buckets → a row for each that isn't a follower, with the row after it."""
    last: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(k) for k in ("bucket", "follower", "doc_id", "text")]
        for bucket, follower, doc_id, value in zip(*columns, strict=True):
            here = bucket.as_py()
            if follower.as_py() and (last is None or last[0] != here):
                continue  # another follower: the first has served
            text = value.as_py() or ""
            fp = fingerprint(text)
            if last is not None and last[0] == here:
                _, was, before, was_fp = last
                new = edited(before, text)
                new_fp = was_fp if new == before else fingerprint(new)
                rows.append((was, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _signed(was_fp), _signed(new_fp), likeness(was_fp, new_fp), likeness(was_fp, fp)))
            last = None if follower.as_py() else (here, doc_id.as_py(), text, fp)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, in one pass over range-dealt rows.

    Takes ``doc_id`` (a number, or text) and ``text``; other columns are ignored. Gives ``doc_id, n_chars, edited_sha256, fp,
    edited_fp, near_edited, near_next``, a row for each row. The order is by doc_id, nulls last, ties by text; the row
    after the last is the first, so a single row is its own next. Null texts are empty; empty texts have fingerprint
    0. An empty table gives an empty table.

    Texts are shuffled once, into ranges of doc_id. The first rows of each range also go to the range before, so no
    range needs another one's output. Only range bounds come to the driver: one id a range.
    """
    id_type = typed(docs)
    ranges = max(2, work_partitions(docs.sparkSession))
    ids = docs.select("doc_id")
    bounds = range_bounds(docs, ranges)
    bucket = range_of(docs, bounds)
    firsts = [tuple(r) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()]
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    also: Column = F.lit(None).cast("int")
    if known := [x for x in before if x is not None]:
        also = F.element_at(F.map_from_arrays(F.array(*map(F.lit, known)).cast(f"array<{id_type}>"), F.array(*[F.lit(before[x]) for x in known])), F.col("doc_id"))
    if None in before:
        also = F.when(F.col("doc_id").isNull(), F.lit(before[None])).otherwise(also)
    at = lambda b, follower: F.struct(b.cast("int").alias("bucket"), F.lit(follower).alias("follower"))
    dealt = docs.select("doc_id", "text", bucket.alias("own"), also.alias("also"))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(at(F.col("own"), False))).otherwise(F.array(at(F.col("own"), False), at(F.col("also"), True)))).alias("x")).select("x.*", "doc_id", "text")
    out_schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    order = [F.col("bucket"), F.col("follower"), F.col("doc_id").asc_nulls_last(), F.col("text")]
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(*order).mapInArrow(lambda b: _along(slices(b), out_schema), f"doc_id {id_type}, {OUT}")


def within_radius(queries: DataFrame, rows: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct ``fp`` of ``queries``, the number ``n_near`` of ``rows`` (by ``fp``) within ``radius`` bits.

    Equal fingerprints are counted before the search, so copies aren't expanded; each pair counts in the first table
    that has it. Null fingerprints are no query and no row. All rows within the radius count, none is preferred, so ties
    don't arise; repeated queries give one row.
    """
    blocks = radius + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    tables = list(combinations(range(blocks), 2))

    def block(fp: Column, k: int) -> Column:
        return F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    def keyed(df: DataFrame, *keep: str) -> DataFrame:
        key = [F.struct(F.lit(t).alias("t"), F.shiftleft(block(F.col("fp"), i), 32).bitwiseOR(block(F.col("fp"), j)).alias("key")) for t, (i, j) in enumerate(tables)]
        return df.select("fp", *keep, F.explode(F.array(*key)).alias("x")).select("fp", *keep, "x.*")

    left = keyed(queries.select("fp").where("fp is not null").distinct()).alias("q")
    right = keyed(rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")), "n").alias("r")
    a, b = F.col("q.fp"), F.col("r.fp")
    first = F.coalesce(*[F.when((block(a, i) == block(b, i)) & (block(a, j) == block(b, j)), F.lit(t)) for t, (i, j) in enumerate(tables)])
    near = (F.col("q.t") == F.col("r.t")) & (F.col("q.key") == F.col("r.key")) & (F.bit_count(a.bitwiseXOR(b)) <= radius) & (first == F.col("q.t"))
    return left.join(right, near).groupBy(a.alias("fp")).agg(F.sum("r.n").alias("n_near"))


def hex_of(fp: str) -> Column:
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def searched(docs: DataFrame, radius: int = 3) -> DataFrame:
    """:func:`document_fingerprints`, and for rows whose id is divisible by 50 the ``n_near`` rows within ``radius``.

    A row counts itself and its copies. Text ids are read as whole numbers; ids that are none, and null ones, ask
    nothing (null ``n_near``), and are found like any other row. An empty table gives an empty table.
    """
    done = written(document_fingerprints(docs), "fingerprints")
    asks = F.coalesce(F.col("doc_id").try_cast("decimal(38,0)") % 50 == 0, F.lit(False))
    if isinstance(docs.schema["doc_id"].dataType, StringType):
        asks = F.col("doc_id").rlike(r"^-?[0-9]+$") & asks
    near = within_radius(done.where(asks), done, radius)
    asked = F.when(asks, F.col("n_near"))
    return done.join(near, "fp", "left").select("doc_id", "n_chars", "edited_sha256", hex_of("fp").alias("fingerprint"), hex_of("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", asked.alias("n_near"))
