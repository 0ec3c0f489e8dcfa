"""Token-id files compressed by Re-Pair grammars.

Ids are cut into shards of about ``shard_ids``. In each, rounds replace the most frequent neighbouring pairs by new
symbols (many pairs a round, from left to right where they overlap) until no pair is frequent or a round gains little. A file has shards one
after another; a shard has its rules, their expansion lengths and the remaining symbols, so any range of ids can be
decoded by expanding only the symbols that cover it.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.common import range_bounds, range_of, shared_folder, slices, typed, work_partitions, written
from lumenspan.llm.files import Writer, opened

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIQ")  # magic, first nonterminal, rules, symbols, ids


def repair(ids: np.ndarray, vocabulary: int, pairs: int = 4096, least_count: int = 8, gain: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Rules (rows of two symbols; row k defines symbol ``vocabulary + k``) and the remaining symbols.

    A round takes up to ``pairs`` pairs that stand there ``least_count`` times or more, and rounds go on until there are
    none or a round shortens the ids by less than ``gain`` (running on gains under a thousandth on ordinary text; a
    shard of copies halves round by round and goes on). A round counts pairs by a 20-bit hash first; only members of
    the most frequent hashes are counted exactly.
    """
    s, rules = ids.astype(np.uint32), []
    known = vocabulary
    while s.size > 2 * least_count:
        a, b = s[:-1], s[1:]
        bucket = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)
        counts = np.bincount(bucket, minlength=1 << 20)
        held = np.cumsum(np.bincount(np.minimum(counts, 4095), minlength=4096)[::-1])  # buckets with at least each count
        least = max(least_count, 4095 - int(np.searchsorted(held, pairs)))
        some = np.flatnonzero((counts >= least)[bucket])
        found, n = np.unique((a[some].astype(np.uint64) << np.uint64(32)) | b[some], return_counts=True)
        best = np.argsort(-n, kind="stable")[:pairs]
        best = np.sort(best[n[best] >= least_count])
        if not best.size:
            break
        left, right = (found[best] >> np.uint64(32)).astype(np.uint32), found[best].astype(np.uint32)
        rule = np.full(1 << 20, best.size, np.int32)  # of two chosen pairs with one hash, one waits for a later round
        rule[(left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(12)] = np.arange(best.size, dtype=np.int32)
        which = rule[bucket[some]]
        left, right = np.append(left, np.uint32(0xFFFFFFFF)), np.append(right, np.uint32(0xFFFFFFFF))
        hit = (left[which] == a[some]) & (right[which] == b[some])
        where, which = some[hit], which[hit]
        first = np.concatenate(([True], np.diff(where) != 1))  # runs of overlapping pairs: every other one
        even = np.ones(where.size, bool)
        if not first.all():
            begun = np.maximum.accumulate(np.where(first, np.arange(where.size), 0))
            even = (np.arange(where.size) - begun) % 2 == 0
        where, which = where[even], which[even]
        saved = where.size / s.size
        s[where] = known + which
        keep = np.ones(s.size, bool)
        keep[where + 1] = False
        s = s[keep]
        rules.append(np.stack([left[:-1], right[:-1]], axis=1))
        known += best.size
        if saved < gain:
            break
    return np.concatenate([np.zeros((0, 2), np.uint32), *rules]), s


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expansion lengths of the rules, each from earlier ones."""
    out = np.ones(rules.shape[0], np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (1 if a < vocabulary else int(out[a - vocabulary])) + (1 if b < vocabulary else int(out[b - vocabulary]))
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """All ids that symbols stand for."""
    s = symbols.astype(np.uint32)
    while (big := s >= vocabulary).any():
        ends = np.cumsum(1 + big)
        out = np.empty(int(ends[-1]), np.uint32)
        out[ends[~big] - 1] = s[~big]
        pair = rules[s[big] - vocabulary]
        out[ends[big] - 2], out[ends[big] - 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def packed(x: np.ndarray) -> bytes:
    """24 bits a symbol."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def write_shard(ids: np.ndarray, vocabulary: int) -> bytes:
    rules, symbols = repair(ids, vocabulary)
    if vocabulary + len(rules) >= 1 << 24:
        raise ValueError("a symbol doesn't fit 24 bits")
    return HEAD.pack(MAGIC, vocabulary, len(rules), symbols.size, ids.size) + packed(rules.ravel()) + lengths_of(rules, vocabulary).astype("<u4").tobytes() + packed(symbols)


class Shard:
    """Reads a shard's bytes; ids are expanded when asked for."""

    def __init__(self, data: bytes):
        magic, self.vocabulary, rules, symbols, self.size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size
        self.rules = unpacked(data[at : at + 6 * rules]).reshape(-1, 2)
        at += 6 * rules
        self.lengths = np.frombuffer(data, "<u4", rules, at)
        self.symbols = unpacked(data[at + 4 * rules : at + 4 * rules + 3 * symbols])
        self._ends: np.ndarray | None = None

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.vocabulary)

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``, by expanding only the symbols that cover them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        if self._ends is None:
            each = np.ones(self.symbols.size, np.int64)
            big = self.symbols >= self.vocabulary
            each[big] = self.lengths[self.symbols[big] - self.vocabulary]
            self._ends = np.cumsum(each)
        lo, hi = int(np.searchsorted(self._ends, start, "right")), int(np.searchsorted(self._ends, end, "left"))
        skip = start - (int(self._ends[lo - 1]) if lo else 0)
        return expand(self.symbols[lo : hi + 1], self.rules, self.vocabulary)[skip : skip + end - start]


# ASCII punctuation but the apostrophe, which the model's splitter may join to letters, and letters
# (a-z and those from U+00DF to U+024F) as the model's splitter knows them.
MARKS = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
LETTER = "[a-z\u00df-\u00f6\u00f8-\u024f]"


# The normaliser and splitter of the tokenizers whose texts may be encoded word by word.
WORD_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]


class WordCache:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    Only a tokenizer with the steps above and word ends ``</w>`` is used so (``by_words``); with any other, whole
    texts are encoded. The model lower-cases, drops white space and splits letters from the marks that follow them, and no token spans
    such a split. So texts are lower-cased (A-Z), parted there by a space and split at white space; the distinct
    words of a batch are encoded (in long joined texts: a token that ends a word ends a part) and their ids dealt
    back. Texts that hold a special token's string are encoded as they are, and words whose ends don't add up one by
    one. The cache is bounded.
    """

    def __init__(self, path: str, dtype: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most = Tokenizer.from_file(path), dtype, most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)"
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = [steps["normalizer"], steps["pre_tokenizer"]] == WORD_STEPS and steps["model"].get("end_of_word_suffix") == "</w>"
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """A word of letters, or of marks, is one part; others may be several.

        A word of a-z goes through the normaliser, splitter and byte map as it is, so the library's model takes it
        directly.
        """
        model, ascii_words = self.tokenizer.model, [w for w in words if w.isascii() and w.isalpha()]
        self.known.update((w, np.array([t.id for t in model.tokenize(w)], self.dtype).tobytes()) for w in ascii_words)
        words = [w for w in words if not (w.isascii() and w.isalpha())]
        plain = [w for w in words if w.isalpha() or re.fullmatch(f"{MARKS}+", w)]
        other = [w for w in words if not (w.isalpha() or re.fullmatch(f"{MARKS}+", w))]
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if cuts.size == len(group):
                data, size = ids.tobytes(), ids.itemsize
                for w, lo, hi in zip(group, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                    self.known[w] = data[lo * size : hi * size]
            else:
                other += group
        self.known.update(zip(other, (x.tobytes() for x in self._ids(other)), strict=True) if other else ())

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and how many each text has."""
        column = pc.if_else(pc.is_valid(column), column, "").cast(pa.large_string())  # anew: ascii_lower goes wrong on a slice
        whole = pc.match_substring_regex(column, self.special).to_numpy(zero_copy_only=False)
        if not self.by_words or whole.any():
            return self._one_by_one(column)
        parted = pc.replace_substring_regex(pc.ascii_lower(column), f"({LETTER})({MARKS})", r"\1 \2")
        for space in "\t\n\x0b\x0c\r":
            parted = pc.replace_substring(parted, space, " ")
        split = pc.split_pattern(parted, " ")
        words = split.flatten().dictionary_encode()
        names, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        known = self.known
        if len(known) > self.most:
            known.clear()
            known[""] = b""
        fresh = [w for w in names if w not in known]
        if fresh:
            self._learn(fresh)
        held = [known[w] for w in names]
        flat = np.frombuffer(b"".join(held), self.dtype)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(self.dtype).itemsize
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(held) else sizes
        each = sizes[at]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(starts[at] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(upto[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def _one_by_one(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(column.to_pylist())
        return np.concatenate(ids), np.array([x.size for x in ids], np.int64)


@lru_cache(maxsize=1)
def word_cache(path: str, dtype: str) -> WordCache:
    """Kept in a worker from task to task."""
    return WordCache(path, dtype)


def encoded(docs: DataFrame, path: str, end_id: int, dtype: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian ``dtype``), the end id appended."""
    id_type = typed(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(path, dtype)
        for batch in slices(batches, 8000):  # of as many rows few words are new
            ids, sizes = words.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            ends = np.concatenate(([0], np.cumsum(sizes + 1))) * ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary")


INDEX = "bucket int, file string, at long, length long, first long, n_tokens long, before long"


def write_files(ids: DataFrame, bounds: list, folder: str, vocabulary: int, dtype: str, shard_ids: int = 1 << 20) -> DataFrame:
    """Write ``doc_id, ids`` rows in ascending order, a bucket between two bounds after another; the saved index.

    Index: ``doc_id``, file, place and length of the shard, first id in it, number of ids, ids before it in the bucket.
    """
    id_type = typed(ids)
    dealt = ids.select(range_of(ids, bounds).alias("bucket"), "doc_id", "ids").repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Writer | None = None
        held, rows, size, now, before = [], [], 0, None, 0

        def shut() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, size
            if rows:
                data = write_shard(np.concatenate(held), vocabulary)
                at = out.append(data)
                doc, first, n, bef = zip(*rows, strict=True)
                cols = [pa.array(doc), pa.array([now] * len(doc), pa.int32()), pa.array([out.name] * len(doc)), pa.array([at] * len(doc), pa.int64()), pa.array([len(data)] * len(doc), pa.int64()), *(pa.array(x, pa.int64()) for x in (first, n, bef))]
                cols[0] = cols[0].cast(kind)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(x.split()[0] for x in INDEX.split(", "))])
            held, rows, size = [], [], 0

        for batch in batches:
            kind = batch.column("doc_id").type
            for b, doc_id, value in zip(batch.column("bucket"), batch.column("doc_id"), batch.column("ids"), strict=True):
                if b.as_py() != now or size >= shard_ids:
                    yield from shut()
                    if b.as_py() != now:
                        now, before = b.as_py(), 0
                        if out is not None:
                            out.close()
                        out = Writer(folder, ".rpg")
                x = np.frombuffer(value.as_py(), dtype)
                rows.append((doc_id.as_py(), size, x.size, before))
                held.append(x)
                size += x.size
                before += x.size
        if rows:
            yield from shut()
        if out is not None:
            out.close()

    return written(dealt.mapInArrow(run, f"doc_id {id_type}, {INDEX}"), "token-index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, bucket, before, n_tokens, ids_crc32``, with ids decoded from the files."""
    id_type = typed(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        place, shard, ids, source, name = None, None, None, None, None
        for batch in batches:
            crcs, sizes = [], []
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("file", "at", "length", "first", "n_tokens")), strict=True))
            asked = Counter()
            for file, at, _, _, n in rows:
                asked[file, at] += n
            for file, at, length, first, n in rows:
                if (file, at) != place:
                    place = file, at
                    if name != file:
                        name, source = file, system.open_input_file(f"{path}/{file}")
                    shard, ids = Shard(source.read_at(length, at)), None
                if ids is None and 2 * asked[place] >= shard.size:
                    ids = shard.all()
                # of a shard of which little is asked for, only the symbols that cover that are expanded
                got = (shard.range(first, first + n) if ids is None else ids[first : first + n]).astype("<u4")
                crcs.append(zlib.crc32(got.tobytes()))
                sizes.append(got.size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bucket"), batch.column("before"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "bucket", "before", "n_tokens", "ids_crc32"])

    parts = 1 + (index.agg(F.max("bucket")).first()[0] or 0)
    dealt = index.repartitionById(parts, F.col("bucket")).sortWithinPartitions("file", "at", "first")
    return dealt.select("doc_id", "bucket", "before", "file", "at", "length", "first", "n_tokens").mapInArrow(run, f"doc_id {id_type}, bucket int, before long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1, vocabulary: int | None = None) -> DataFrame:
    """Encode, write and read back: ``doc_id, start, n_tokens, ids_crc32``, a row for each row.

    Takes ``doc_id`` (a number) and ``text``. Order: doc_id, nulls last, ties by ids. Null and empty texts have the end
    id alone. ``start``: ids of all rows before. An empty table gives an empty table. Only bucket bounds (one id a
    bucket) come to the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = vocabulary or max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    bounds = range_bounds(docs, max(2, work_partitions(spark)))
    folder = shared_folder(spark, "tokens")
    index = write_files(encoded(docs, path, end_id, dtype), bounds, folder, vocabulary, dtype)
    totals = index.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    back = read_files(index, folder)
    return back.join(base, back["bucket"] == base["b"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
