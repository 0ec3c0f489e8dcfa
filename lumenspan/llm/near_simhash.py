"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits, or 8 positional bytes. Two fingerprints that differ in at most ``radius`` bits
differ in at most ``radius`` bytes, so they share at least ``8 - radius`` positional bytes: the guaranteed minimum.
Postings of single bytes would pair a fixed share (1 in 32) of all fingerprints, which is quadratic; so postings are
kept for small sets of positions, chosen so that any guaranteed number of shared positions contains one of them (for
4 of 8: 20 sets of three positions, 24 bits a key). Within a posting the shared bytes of a pair are tallied, pairs
under the minimum go, and the rest are verified bit by bit.

Only distinct fingerprints are indexed, so exact copies cost nothing. A posting gives its spanning links, not its
pairs: a breadth-first walk compares each newly reached fingerprint with those not reached yet, so a posting of m
mutual near copies costs about m comparisons and gives m - 1 links, with the same components as all its pairs.
Postings come as a sorted stream, 8 bytes a member, whatever their size.

Copies that were shortened or extended lie beyond the radius. :func:`similar_documents` finds those by an exact index of
shingles; with a ``radius`` it takes the links of fingerprints too and looks only at what those leave apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.common import Scratch, per_batch, slices, texts, typed, unused, written
from lumenspan.llm.components import components

BYTES = 8


def position_sets(minimum: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``minimum`` of the 8 positions contain one of them.

    For a minimum of 4, sets of three from three groups of positions: three of one group, or two of a group and one
    of the next. For other minima, all sets of that many positions.
    """
    if minimum != 4:
        return list(combinations(range(BYTES), minimum))
    group = {p: p % 3 for p in range(BYTES)}
    out = []
    for s in combinations(range(BYTES), 3):
        n = [sum(group[p] == g for p in s) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(s)
    return out


def simhash(data: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the lower-cased word shingles of a text's bytes, repeats included; no words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, votes = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, text`` → ``doc_id, fp`` (signed long). Null and empty texts: 0."""
    id_type = typed(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((simhash(t, shingle) for t in texts(batch)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(per_batch(run), f"doc_id {id_type}, fp long")


def spanning_links(fps: np.ndarray, radius: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of distinct fingerprints at ``radius`` or fewer bits."""
    left, us, vs = np.sort(fps), [], []
    minimum = BYTES - radius
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at, queue = queue[-1], queue[:-1]
            near = np.concatenate([_near(left[k : k + block], at, radius, minimum) for k in range(0, left.size, block)])
            if near.any():
                got, left = left[near], left[~near]
                us.append(got)
                vs.append(np.full(got.size, at, np.uint64))
                queue.extend(got)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _near(some: np.ndarray, one: np.uint64, radius: int, minimum: int) -> np.ndarray:
    differ = some ^ one
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = shared >= minimum
    near[near] = np.bitwise_count(differ[near]) <= radius
    return near


def _posting_links(radius: int):
    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [keys.size]))
        pairs = starts[ends - starts == 2]
        a, b = fps[pairs], fps[pairs + 1]
        near = (np.bitwise_count(a ^ b) <= radius) & (((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - radius)
        us, vs = [a[near]], [b[near]]
        for s, e in zip(starts, ends, strict=True):
            if e - s > 2:
                u, v = spanning_links(fps[s:e], radius)
                us.append(u)
                vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        for at in range(0, u.size, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].view(np.int64)) for x in (u, v)], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table in whole_groups(batches):
            yield from links(keys, table.column("fp").to_numpy().view(np.uint64))

    return run


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Batches sorted by their first column, ``key``, in pieces that hold each key's rows together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(0)[0].as_py() != keys[-1]):
            ready = pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema)
            held = []
            if ready.num_rows:
                yield ready.column(0).to_numpy(), ready
        held.append(batch.slice(last))
    if held:
        ready = pa.Table.from_batches(held)
        yield ready.column(0).to_numpy(), ready


def posting_keys(radius: int) -> Column:
    """Array of a fingerprint's posting keys: the number of a set of positions, and the bytes there."""
    if not 0 <= radius < BYTES:
        raise ValueError("the radius must leave a guaranteed shared byte: 0 to 7 bits")
    keys = []
    for n, some in enumerate(position_sets(BYTES - radius)):
        parts = [F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)) for p in some]
        if len(some) <= 6:
            key = F.lit(n)
            for part in parts:
                key = F.shiftleft(key.cast("long"), 8).bitwiseOR(part)
        else:
            key = F.xxhash64(F.lit(n), *parts)  # a clash only adds comparisons
        keys.append(key.cast("long"))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fp`` → ``(u, v)`` links between distinct fingerprints, with the components of all links within ``radius``.

    Repeated fingerprints are one; a null one has no links. An empty table gives an empty table.
    """
    keys = posting_keys(radius)
    postings = fps.select("fp").distinct().select(F.explode(keys).alias("key"), "fp")
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(_posting_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, fp, fingerprint, component_id``, a row for each row of ``docs``.

    Takes ``doc_id`` (integer) and ``text``; other columns are ignored. ``component_id`` is the smallest ``doc_id``
    reachable by links of ``radius`` or fewer bits, itself included. Null, empty and word-less texts have fingerprint
    zero and are linked like any other; a null ``doc_id`` keeps its row and names no class unless all are null (then
    the class is null). Repeated rows keep one row each. An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, shingle), "fps")
    scratch = Scratch(docs.sparkSession)
    roots = components(near_links(fps, radius), scratch)
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(joined, "classes")
    scratch.done()
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(data: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased word shingles; a text of fewer words is one shingle; no words: empty."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 1)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[s:e], 1) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64))


def set_name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of a set's n hashes, rare ones first.

    Sets of ``similarity`` share at least that part of either, so their prefixes in any one order share a hash. The
    order is by how common a hash is among those known as common (the rest come first), then by value.
    """
    if not hashes.size:
        return hashes
    keep = hashes.size - int(np.ceil(similarity * hashes.size - 1e-9)) + 1
    if common.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        level = np.where(common[at] == hashes, counts[at], 0)
        if level.any():
            return hashes[np.lexsort((hashes, level))[:keep]]
    return hashes[:keep]


def parities(hashes: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each bit, of two to four bits a hash (a power of two; 1024 at least).

    Two sets' parities differ in no more bits than the sets in hashes. Bits are taken by the low end of a hash, so
    :func:`folded` gives the parities at a smaller size.
    """
    size = max(1024, 1 << (2 * hashes.size - 1).bit_length()) if hashes.size else 1024
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, length: int) -> bytes:
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, length // 8), axis=0).tobytes()


def can_be_alike(a: bytes, b: bytes, size: int, similarity: float) -> bool:
    """Whether sets with these parities, of ``size`` hashes together, can be alike: no such pair is denied."""
    a, b = (folded(x, min(len(a), len(b))) for x in (a, b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= size * (1 - similarity) / (1 + similarity) + 1e-9


NEXT = 4
#: Postings of so many texts are complete with each one's pairs with the first and the next four.
SMALL = NEXT + 2
#: Larger postings are compared block against block, each two blocks in a task of their own.
BLOCK = 4096


def _first_pairs(similarity: float, most: int = 1_000_000):
    """Sorted ``key, name, n`` → pairs to verify ``(null, u, v)``, and members ``(key, u, null)`` of postings over ``SMALL``.

    Each member is paired with the posting's first and the next four: all pairs of a small posting; in a large one
    those join a group of copies, and :func:`_other_pairs` takes all that they leave apart. Postings are a stream: of
    one that goes on from batch to batch only its first and last few members are held. Pairs that several keys give
    are made one, up to ``most`` at a time.
    """
    kinds = {"key": pa.int64(), "u": pa.int64(), "v": pa.int64()}

    def batch_of(key, u, v) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(u), 100_000):
            some = [None if x is None else x[at : at + 100_000] for x in (key, u, v)]
            size = some[1].size
            yield pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip(some, kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        # of the posting that goes on: its last members with those before, its first, and how many there are
        tail = np.zeros((0, 3), np.int64)
        first, seen = np.zeros(3, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            over = np.concatenate((tail[-1:], rows))
            fresh = (over[1:, :2] != over[:-1, :2]).any(axis=1)
            rows = rows[fresh if len(tail) else np.concatenate(([True], fresh))]
            if not len(rows):
                continue
            old = len(tail)
            x = np.concatenate((tail, rows))
            key = x[:, 0]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begun = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            place = np.arange(len(x)) - begun  # in its posting
            heads = x[begun, 1:]
            same = begun == 0
            if old:
                place[same] += seen - old
                heads[same] = first[1:]
            us, vs = [], []
            for step in range(1, NEXT + 1):
                v = np.arange(max(step, old), len(x))
                v = v[place[v] >= step]
                us.append(x[v - step, 1:])
                vs.append(x[v, 1:])
            v = np.arange(old, len(x))
            v = v[place[v] > NEXT]
            us.append(heads[v])
            vs.append(x[v, 1:])
            u, v = np.concatenate(us), np.concatenate(vs)
            fit = np.minimum(u[:, 1], v[:, 1]) >= similarity * np.maximum(u[:, 1], v[:, 1]) - 1e-9
            u, v = u[fit, 0], v[fit, 0]
            held.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
            count += u.size
            if count > most:
                held = [np.unique(np.concatenate(held), axis=0)]
                if held[0].shape[0] > most // 2:
                    yield from batch_of(None, held[0][:, 0], held[0][:, 1])
                    held = []
                count = sum(h.shape[0] for h in held)
            # members: from the seventh on each names itself, the seventh also the six before
            late = np.flatnonzero((place >= SMALL) & (np.arange(len(x)) >= old))
            turn = late[place[late] == SMALL]
            before = (turn[:, None] - np.arange(1, SMALL + 1)).ravel()
            m = np.concatenate((late, before))
            yield from batch_of(x[m, 0], x[m, 1], None)
            last = begun[-1]
            first, seen = (first, int(place[-1]) + 1) if last == 0 and old else (x[last].copy(), int(place[-1]) + 1)
            tail = x[max(last, len(x) - SMALL) :].copy()
        if held:
            pairs = np.unique(np.concatenate(held), axis=0)
            yield from batch_of(None, pairs[:, 0], pairs[:, 1])

    return run


def _other_pairs(similarity: float):
    """Sorted ``key, i, j, name, block, n, root, bits`` → the pairs of two blocks (or of one, ``i = j``) of a posting
    with different roots that can be alike.

    Both bounds, of sizes and of :func:`parities`, hold for every pair of ``similarity``, so no pair is lost.
    """
    apart = (1 - similarity) / (1 + similarity)

    def pairs(names, sizes, roots, blocks, bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(x) for x in bits])
        cross = blocks.min() != blocks.max()
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            upper = np.flatnonzero((lengths > length) & (sizes <= sizes[own].max() / similarity + 1e-9))
            own, upper = own[np.argsort(sizes[own], kind="stable")], upper[np.argsort(sizes[upper], kind="stable")]
            order = np.concatenate((own, upper))
            n, r, name, block = sizes[order], roots[order], names[order], blocks[order]
            b = np.frombuffer(b"".join([*(bits[k] for k in own), *(folded(bits[k], length) for k in upper)]), np.uint64).reshape(order.size, -1)
            ends = np.searchsorted(n[: own.size], n[: own.size] / similarity + 1e-9, side="right")
            ends_upper = own.size + np.searchsorted(n[own.size :], n[: own.size] / similarity + 1e-9, side="right")
            for i in range(own.size):
                j = np.concatenate((np.arange(i + 1, ends[i]), np.arange(own.size, ends_upper[i])))
                j = j[(r[j] != r[i]) & ((block[j] != block[i]) | (not cross))]
                j = j[np.bitwise_count(b[j] ^ b[i]).sum(axis=1) <= (n[j] + n[i]) * apart + 1e-9]
                if j.size:
                    yield np.full(j.size, name[i]), name[j]

    def batch_of(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for keys, table in whole_groups(batches):
            i, j, names, blocks, sizes, roots = (table.column(c).to_numpy() for c in ("i", "j", "name", "block", "n", "root"))
            bits = table.column("bits").to_pylist()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1, [keys.size]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for u, v in pairs(names[lo:hi], sizes[lo:hi], roots[lo:hi], blocks[lo:hi], bits[lo:hi]):
                    us.append(u)
                    vs.append(v)
                    held += u.size
                    if held > 100_000:
                        yield batch_of(us, vs)
                        us, vs, held = [], [], 0
        if held:
            yield batch_of(us, vs)

    return run


def _in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``key, name, root`` and ``key, m`` → each member once for each two blocks ``i <= j`` that its own is one of.

    ``key`` is made of the key and the blocks, so that each two blocks are dealt on their own.
    """
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    at = members.join(sizes, "key").select("key", "name", "root", blocks.alias("blocks"), F.pmod(F.xxhash64(F.col("name")), blocks).alias("block"))
    at = at.select("key", "name", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return at.select(F.when((i == 0) & (j == 0), F.col("key")).otherwise(F.xxhash64("key", i, j)).alias("key"), i.alias("i"), j.alias("j"), "name", "block", "root")


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` that the parities allow."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [can_be_alike(a, b, n, similarity) for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n")), strict=True)]
        return batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("name").alias("u"), F.col("bits").alias("a"), F.col("n").alias("n1"))
    right = sets.select(F.col("name").alias("v"), F.col("bits").alias("b"), F.col("n").alias("n2"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", (F.col("n1") + F.col("n2")).alias("n")).mapInArrow(per_batch(run), "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` of sets whose exact Jaccard similarity is ``similarity`` or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(shared >= similarity * (x.size + y.size - shared) - 1e-9)
        return batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("name").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("name").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(per_batch(run), "u long, v long")


def _sketched(docs: DataFrame, shingle: int, with_fp: bool) -> DataFrame:
    """``doc_id, text`` → ``doc_id, text_hash, fp, name, n, bits, common``: a text's :func:`simhash` (null without
    ``with_fp``), name and size of its set, its :func:`parities`, and (on one row of a batch) the hashes that four or
    more of the batch's sets have."""
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, fps, names, sets, bits = [], [], [], [], []
        for t in texts(batch):
            some = shingle_set(t, shingle)
            fps.append(simhash(t) if with_fp else 0)
            bits.append(parities(some))
            hashes.append(xxhash.xxh64_intdigest(t, 42))
            names.append(set_name(some))
            sets.append(some)
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= 4
        common = [[{"h": h, "c": c} for h, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]] + [None] * (batch.num_rows - 1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(hashes), signed(fps) if with_fp else pa.nulls(batch.num_rows, pa.int64()), signed(names), pa.array([x.size for x in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array(common, kind)], ["doc_id", "text_hash", "fp", "name", "n", "bits", "common"])

    return docs.select("doc_id", "text").mapInArrow(per_batch(run), f"doc_id {typed(docs)}, text_hash long, fp long, name long, n int, bits binary, common array<struct<h: long, c: long>>")


def _links_of_names(sketches: DataFrame, radius: int) -> DataFrame:
    """``fp, name`` → links ``u, v`` of names: those of one fingerprint, and of fingerprints by :func:`near_links`."""
    each = sketches.select("fp", "name").distinct()
    one = each.groupBy("fp").agg(F.min("name").alias("first"))
    same = each.join(one, "fp").where("name <> first").select(F.col("name").alias("u"), F.col("first").alias("v"))
    end = lambda c: one.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = near_links(sketches, radius).join(end("u"), "u").join(end("v"), "v").where("first_u <> first_v")
    return same.unionByName(near.select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))).distinct()


def _prefix_keys(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``text`` → ``key, name, n``: the :func:`prefix` of each text's set; of equal sets in a task once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            parts, names, sizes, lengths = [np.zeros(0, np.uint64)], [], [], []
            for t in texts(batch):
                some = shingle_set(t, shingle)
                name = set_name(some)
                if name in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(name)
                parts.append(prefix(some, similarity, common, counts))
                names.append(name)
                sizes.append(some.size)
                lengths.append(parts[-1].size)
            flat = np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(names, np.uint64).view(np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], ["key", "name", "n"])

    return docs.select("text").mapInArrow(run, "key long, name long, n int")


def _sets_of(docs: DataFrame, hashes: DataFrame, shingle: int) -> DataFrame:
    """``name, hashes``: the whole sets of the texts whose ``text_hash`` is in ``hashes``, each once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, shingle) for t in texts(batch)]
        names = np.array([set_name(x) for x in found], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in found], pa.binary())], ["name", "hashes"])

    some = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").join(hashes, "text_hash", "left_semi")
    return some.dropDuplicates(["text_hash"]).select("text").mapInArrow(per_batch(run), "name long, hashes binary")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """Classes of documents whose ``shingle``-word shingles are alike: ``doc_id, text_hash, component_id, class``.

    Links are all pairs of texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Candidates
    come from an index of the sets' prefixes, which every such pair shares a key of; bounds that hold for every such
    pair deny most others, and the rest are verified on the whole sets, but for pairs that links already join. Which
    hashes count as common only orders the prefixes, so it changes work and not links. With a ``radius``, texts whose
:func:`simhash` differ in so many bits or fewer are linked too; these links come from the byte-position index, and
of the other pairs only those that they leave apart are compared. A row for each row of ``docs``;
    null texts are empty; texts without words are one class; ``component_id`` is the smallest ``doc_id`` of the class
    (null if it has none), ``class`` a hash that names it. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(_sketched(docs, shingle, radius is not None), "sketches")
    # 50 000 hashes at most; those left out only cost work
    often = rows.select(F.explode("common").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c")).orderBy(F.desc("c"), "h").limit(50_000).collect()
    known = sorted((r.h % 2**64, r.c) for r in often)
    common, counts = np.array([h for h, _ in known], np.uint64), np.array([c for _, c in known], np.int64)
    one = scratch.written(rows.groupBy("name").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("bits").alias("bits")), "distinct")

    def sets_of(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct()
        hashes = one.select("name", "text_hash").join(involved, "name", "left_semi").select("text_hash")
        return scratch.written(_sets_of(docs, scratch.written(hashes, "involved"), shingle), "sets")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs that no links join yet."""
        for end in ("u", "v"):
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return pairs.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Roots of the components of the known links and all that the pairs give: first one pair of each text, then what
        those and the known ones leave apart. A component's links go on as links to its root, which need few rounds."""
        sets = sets_of(pairs)
        roots = components(known.unionByName(scratch.written(_verified(pairs.groupBy("v").agg(F.min("u").alias("u")), sets, similarity), "verified")), scratch)
        rest = scratch.written(_verified(apart(pairs, roots), sets, similarity), "verified")
        return components(roots.toDF("u", "v").unionByName(rest), scratch)

    postings = _prefix_keys(docs, shingle, similarity, common, counts)
    met = scratch.written(postings.repartition("key").sortWithinPartitions("key", "name").mapInArrow(_first_pairs(similarity), "key long, u long, v long"), "met")
    first = met.where("v is not null").select("u", "v").distinct()
    near = docs.sparkSession.createDataFrame([], "u long, v long")
    if radius is not None:
        near = scratch.written(_links_of_names(rows, radius), "near")
    roots = linked(scratch.written(_possible(first, one, similarity), "possible"), near)
    members = met.where("v is null").select("key", F.col("u").alias("name")).join(roots, F.col("name") == F.col("node"), "left")
    members = scratch.written(members.select("key", "name", F.coalesce("root", "name").alias("root")), "members")
    mixed = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b").select("key", "m")
    members = _in_blocks(members, mixed).join(one.select("name", "n", "bits"), "name")
    others = members.repartition("key").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "name", "block", "n", "root", "bits").mapInArrow(_other_pairs(similarity), "u long, v long")
    others = scratch.written(others.distinct(), "others")
    if not others.isEmpty():
        roots = linked(others, roots.toDF("u", "v"))
    named = one.join(roots, F.col("name") == F.col("node"), "left")
    named = scratch.written(named.select("name", "least", F.coalesce("root", "name").alias("root")), "named")
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_name = named.join(by_root, "root").select("name", "component_id", F.col("root").alias("class"))
    out = written(rows.select("doc_id", "text_hash", "name").join(by_name, "name").select("doc_id", "text_hash", "component_id", "class"), "similar")
    scratch.done()
    return out


def representatives(docs: DataFrame, radius: int | None = 4, **settings) -> DataFrame:
    """One row of ``docs`` for each class of :func:`similar_documents`, with the links of SimHashes within ``radius``, all
    columns: that with the smallest ``doc_id``, null last; of several with that id that with the smallest text hash, and
    of equal rows one.

    Texts are shuffled once, by id and text hash; the window after the join needs no other dealing.
    """
    id_, hash_, at_ = (unused(f"_{c}", docs) for c in ("id", "hash", "at"))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("x")
    stay = similar_documents(docs, radius=radius, **settings).groupBy("class").agg(order).select(F.col("x.doc_id").alias(id_), F.col("x.text_hash").alias(hash_))
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_)))
    turn = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(hash_))
    return kept.withColumn(at_, turn).where(F.col(at_) == 1).select(*docs.columns)
