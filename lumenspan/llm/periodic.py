"""Periodic runs of words, by Main and Lorentz's divide and conquer.

A run is a stretch of words in which words ``period`` apart are equal, at least ``max(MIN_WORDS, 3 * period)`` long and
not extendable with that period. Words are interned as numbers. A stretch is halved again and again; of each half's
midpoint, Z-functions of the right half and of the reversed left half tell how far each period reaches to both sides, so
every run that crosses the midpoint is found in time linear in the stretch. Runs that reach over an end of the stretch
cross an earlier midpoint and were found there whole. One interval keeps its smallest period.

Each window of 8 words within a run stands in it again one period before or after, since a run is at least 8 words
longer than twice its period. So only stretches whose 8-word windows all repeat in the text are divided; a text without
a repeated window has no run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lumenspan.llm.common import per_batch, texts

MIN_WORDS, TIMES, WINDOW = 24, 3, 8

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ADDED = {"n_words": LongType(), "runs": ArrayType(RUN), "collapsed": StringType()}
RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def interned(words: list[bytes]) -> list[int]:
    """Equal words as equal numbers."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def z_function(x: list[int], count: int) -> list[int]:
    """For each of the first ``count`` places, how many items from there on equal those from the beginning on."""
    n, z = len(x), [0] * count
    left = right = 0
    for i in range(1, count):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _reaches(near: list[int], far: list[int], most: int) -> tuple[list[int], list[int]]:
    """For each period up to ``most``: how far ``near`` equals itself that much further in, and how far it equals what
    begins that many items before it, where ``far`` ends."""
    text = [*near, -1, *far[len(far) - most :], *near]
    z = z_function(text, len(near) + 1 + most)
    inner = z[1 : most + 1] if most < len(near) else z[1 : len(near)] + [0] * (most + 1 - len(near))
    return inner, z[: len(near) : -1]


def crossing(x: list[int], low: int, high: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs within ``x[low:high]`` that cross or touch its midpoint."""
    mid, most = (low + high) // 2, (high - low) // TIMES
    left, right = x[low:mid], x[mid:high]
    ahead, ahead_before = _reaches(right, left, most)  # of (mid, mid + q) and of (mid - q, mid), forwards
    behind, behind_after = _reaches(left[::-1], right[::-1], most)  # of (mid - q, mid) and of (mid, mid + q), backwards
    for q in range(1, most + 1):
        for first, back, on in ((mid, behind_after[q - 1], ahead[q - 1]), (mid - q, behind[q - 1], ahead_before[q - 1])):
            if back + on < (TIMES - 1) * q or back + on + q < MIN_WORDS:
                continue
            start, end = first - back, first + on + q
            if (start == low > 0 and x[start - 1] == x[start - 1 + q]) or (end == high < len(x) and x[end] == x[end - q]):
                continue  # goes on over an end: found whole at that midpoint
            found[start, end] = min(q, found.get((start, end), q))


def divided(x: list[int]) -> dict[tuple[int, int], int]:
    """``(start, end)`` of every run and its smallest period."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low >= MIN_WORDS:
            crossing(x, low, high, found)
            mid = (low + high) // 2
            todo += [(low, mid), (mid, high)]
    return found


def repeated_stretches(ids: list[int]) -> list[tuple[int, int]]:
    """Stretches in which every window of 8 words stands twice or more in the text. Equal windows have equal hashes, so
    a collision can only add a stretch."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return []
    h = np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for step, odd in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
        h = h[:-step] * np.uint64(odd) + h[step:]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.isin(h, twice).astype(np.int8), [0]))))
    return [(int(a), int(b) + WINDOW - 1) for a, b in edges.reshape(-1, 2) if b - a + WINDOW - 1 >= MIN_WORDS]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    ids, out = interned(words), []
    for low, high in repeated_stretches(ids):
        out += [(low + s, e - s, q) for (s, e), q in divided(ids[low:high]).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edges)[:-1].tolist(), strict=True) if not inside]


def periodic(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) with ``n_words``, all ``runs`` of the whole text and the text
    ``collapsed`` to its words outside of repetitions, joined by a space; columns of those names are replaced.

    Null, empty and short texts have no run. Runs may overlap. Repeated rows keep a row each; an empty table gives an
    empty one. A text is read by one task; nothing is shuffled.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found, left = [], [], []
        for text in texts(batch):
            words = text.split()  # at the six ASCII white spaces
            runs = runs_of(words)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            left.append(b" ".join(collapsed(words, runs)))
        added = [pa.array(counts, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], [*keep, *ADDED])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, kind) for c, kind in ADDED.items())])
    return docs.mapInArrow(per_batch(run, 200), schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period; ties go to the smallest start, then period. Null without a run."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs are by start, then period: the first of equals stays
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a tenth of the texts made to repeat: of the n words, with ``h = crc32(doc_id)`` and
    ``g = h // 10``, where ``h % 10 = 0`` each word i from ``a = g % n`` on is word ``a + (i - a) % p``,
    ``p = 1 + (n - a) // (3 + g % 8)``. Null ids and texts without words stay."""
    held = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    held = held.withColumn("_w", words).withColumn("_n", F.when(F.col("_w").isNotNull(), F.size("_w")))
    g = F.floor(F.col("_h") / 10)
    held = held.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")).cast("int"))
    held = held.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times))
    made = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n"))
    return held.select("doc_id", F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
