"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words of letters and their four- and five-letter beginnings, hashed to 2**18 places. A machine
of first-order weights and ``factors`` dimensions of pairwise interaction is fitted by one task to a bounded sample
of labelled rows (``max_rows``), and only the machine comes to the driver; its places are those that tell the labels
apart best in that sample, alone or with another term. Scoring is one pass over whole texts, with a model of a few hundred KB.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenspan.llm.common import slices, texts, typed, written

PLACES = 1 << 18
LETTERS = re.compile(r"[^\W\d_]+")


def places(word: str) -> tuple[int, ...]:
    """Hash places of a word's terms."""
    terms = [f"w {word}"] + [f"{k} {word[:k]}" for k in (4, 5) if len(word) >= k]
    return tuple(xxhash.xxh32_intdigest(t) % PLACES for t in terms)


def distinct_words(data: bytes) -> set[str]:
    """Distinct words of a whole text."""
    return set(LETTERS.findall(data.decode("utf-8", "replace").lower()))


@dataclass
class Machine:
    """``at`` maps hash places to rows of ``w`` and ``v``; ``n_rows`` is the number of rows that it was fitted to."""

    bias: float
    at: dict[int, int]
    w: np.ndarray
    v: np.ndarray
    n_rows: int

    def score(self, rows: list[int]) -> float:
        if not rows:
            return 1 / (1 + math.exp(-self.bias))
        v = self.v[rows]
        z = self.bias + self.w[rows].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))

    def packed(self) -> dict:
        """One row of :data:`MODEL`."""
        return {"bias": self.bias, "n_rows": self.n_rows, "at": np.array(list(self.at), "<i4").tobytes(), "w": self.w.astype("<f4").tobytes(), "v": self.v.astype("<f4").tobytes()}

    @staticmethod
    def unpacked(row) -> Machine:
        at, w = np.frombuffer(bytes(row["at"]), "<i4"), np.frombuffer(bytes(row["w"]), "<f4")
        v = np.frombuffer(bytes(row["v"]), "<f4").reshape(w.size, -1) if w.size else np.zeros((0, 0), np.float32)
        return Machine(row["bias"], {int(p): k for k, p in enumerate(at)}, w, v, row["n_rows"])


#: A machine as a row.
MODEL = pa.schema([("bias", pa.float64()), ("n_rows", pa.int64()), ("at", pa.binary()), ("w", pa.binary()), ("v", pa.binary())])


def _ratio(k1: np.ndarray, k0: np.ndarray, pos: float, n: float) -> np.ndarray:
    """Log-likelihood ratio between presence and label, from the rows with a place by label; 0 where under 3 have it."""
    seen, g = k1 + k0, np.zeros(k1.size)
    for cell, row, col in ((k1, seen, pos), (pos - k1, n - seen, pos), (k0, seen, n - pos), (n - pos - k0, n - seen, n - pos)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(cell > 0, 2 * cell * np.log(cell * n / (row * col)), 0)
    g[seen < 3] = 0
    return g


def select_places(rows: list[np.ndarray], y: np.ndarray, count: int, anchors: int = 32) -> np.ndarray:
    """At most ``count`` places that tell the labels apart best alone, and a 32nd of that with another place.

    Alone, by the ratio over all rows; then, of the others, by the ratio over the rows that also have one of the
    ``anchors`` best places: so a term that matters in pairs only is kept for the machine to weigh.
    """

    def counts(some: np.ndarray) -> np.ndarray:
        out = np.zeros(PLACES, np.int64)
        for at in range(0, len(some), 500):  # so that the sample isn't held twice
            out += np.bincount(np.concatenate([rows[k] for k in some[at : at + 500]]), minlength=PLACES)
        return out

    bad, good = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    alone, paired = _ratio(counts(bad), counts(good), float(bad.size), float(len(y))), np.zeros(PLACES)
    leading = np.argsort(-alone, kind="stable")[:anchors]
    having: dict[int, list[int]] = {int(p): [] for p in leading}
    for k, r in enumerate(rows):
        for p in r[np.isin(r, leading, assume_unique=True)].tolist():
            having[p].append(k)
    for some in having.values():
        label = y[some] > 0
        if label.any() and not label.all():
            some = np.array(some)
            paired = np.maximum(paired, _ratio(counts(some[label]), counts(some[~label]), float(label.sum()), float(some.size)))
    order = np.argsort(-alone, kind="stable")[:count]
    order = order[alone[order] > 10.8]  # p < 0.001 for one degree of freedom
    paired[order] = 0
    more = np.argsort(-paired, kind="stable")[: count // 32]
    return np.sort(np.concatenate((order, more[paired[more] > 40])))  # so many trials


def train(rows: list[np.ndarray], y: np.ndarray, count: int = 4096, factors: int = 4, epochs: int = 60, seed: int = 7) -> Machine:
    """Fit by Adam on the log loss, with an L2 penalty; the same rows in the same order give the same machine.

    Without rows of both labels the machine knows only their share (none at all: score near 0).
    """
    pos, n = float(y.sum()), len(y)
    bias = math.log((pos + 0.5) / (n - pos + 0.5)) if n else -10.0
    keep = select_places(rows, y.astype(float), count) if 0 < pos < n else np.zeros(0, np.int64)
    at = {int(p): k for k, p in enumerate(keep)}
    m = len(at)
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.02, (m, factors))], axis=1)
    if not m:
        return Machine(bias, at, theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32), n)
    local = [np.array([at[p] for p in r.tolist() if p in at], np.int64) for r in rows]
    first, second, step, b1, b2 = np.zeros_like(theta), np.zeros_like(theta), 0, 0.9, 0.99
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 1024):
            some = order[k : k + 1024]
            lens = np.array([local[i].size for i in some])
            flat = np.concatenate([local[i] for i in some])
            doc = np.repeat(np.arange(some.size), lens)
            x = theta[flat]
            sums = np.stack([np.bincount(doc, x[:, f], some.size) for f in range(factors + 1)], axis=1)
            squares = np.bincount(doc, (x[:, 1:] ** 2).sum(axis=1), some.size)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[some]) / some.size
            each = err[doc][:, None] * np.concatenate([np.ones((flat.size, 1)), sums[doc, 1:] - x[:, 1:]], axis=1)
            grad = np.stack([np.bincount(flat, each[:, f], m) for f in range(factors + 1)], axis=1) + 1e-5 * theta
            step += 1
            bias -= 0.02 * float(err.sum()) * 4
            first, second = b1 * first + (1 - b1) * grad, b2 * second + (1 - b2) * grad**2
            theta -= 0.05 * (first / (1 - b1**step)) / (np.sqrt(second / (1 - b2**step)) + 1e-8)
    return Machine(bias, at, theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32), n)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from learning: crc32 of its id's text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Machine:
    """Fit to at most ``max_rows`` labelled rows that aren't held out, those with the smallest id hashes.

    Only ``doc_id`` (to join), ``text`` and ``toxic`` are read; null labels are left out. The sample is found on the
    labels alone; its texts' hash places go to the one task that fits.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    sample = sample.select("doc_id", "text", "toxic")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(np.array([p for w in distinct_words(t) for p in places(w)], "<i4")).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "toxic", "places"])

    found = written(sample.mapInArrow(run, "doc_id string, toxic int, places binary"), "sample")
    if found.count() > max_rows:  # rows that share an id are all of one sample id: the bound holds for rows too
        found = written(found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("places")).limit(max_rows), "sample")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, p, t) for batch in batches for i, p, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "places", "toxic")), strict=True))
        made = train([np.frombuffer(p, "<i4") for _, p, _ in got], np.array([t > 0 for *_, t in got], bool).astype(float))
        yield pa.RecordBatch.from_pylist([made.packed()], MODEL)

    # one task for max_rows rows at most; a lost executor's task is run again and gives the same machine
    made = found.coalesce(1).mapInArrow(learn, "bias double, n_rows long, at binary, w binary, v binary").first()
    return Machine.unpacked(made) if made else train([], np.zeros(0))


def scores(docs: DataFrame, machine: Machine, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``tox_score`` (0 to 1; a column of that name is replaced) of the whole text; null and empty texts score the bias alone.

    ``keep_text=False`` leaves ``text`` out of the result. Repeated rows keep a row each; an empty table gives one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(machine)  # at most 4096 places
    docs = docs.drop("tox_score")
    keep = [c for c in docs.columns if keep_text or c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in slices(batches):
            out = []
            for t in texts(batch):
                found: set[int] = set()
                for w in distinct_words(t):
                    rows = known.get(w)
                    if rows is None:
                        if len(known) >= 500_000:
                            known.clear()
                        rows = known[w] = tuple(model.at[p] for p in places(w) if p in model.at)
                    if rows:
                        found.update(rows)
                out.append(model.score(sorted(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "tox_score"])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("tox_score", DoubleType())]))


def crc_held_out(doc_id: int) -> bool:
    """:func:`held_out` of one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
