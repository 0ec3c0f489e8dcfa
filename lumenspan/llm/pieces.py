"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces, scores, types, model kind, normaliser) and a tokenizers pipeline is built
from it: the normaliser's character map, the metaspace marker, unigram scores or BPE merges, and byte fallback. The
ids returned are always those of the tokenizers library; the sentencepiece library only verifies them (``parity``).

A BPE merge makes a piece of the model, so where no piece of the model has two neighbouring characters in it, no merge
ever crosses between them: the text's ids are those of the parts that such places cut it into. That is looked up in
the model's pieces (markers after another character, line feeds, and punctuation after a word), and lets each distinct
part be encoded and verified once, in multithreaded batches. Unigram models, and BPE models without such cuts, are
encoded and verified text by text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from lumenspan.llm.common import slices, texts

MARK = "▁"
RUN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protobuf message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True


def parse_model(data: bytes) -> Model:
    """A model from its file's bytes."""
    out = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra = bool(v)
    return out


def merges_of(model: Model) -> list[tuple[str, str]]:
    """BPE merges: every way to make a piece of two others, best score first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    ranked = sorted(((-s, n, p) for n, (p, s, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1))
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in score and p[k:] in score]


def build(model: Model, normalise: bool = True):
    """A tokenizers pipeline; ``normalise=False``: for text that is normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        at = next((n for n, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
        out = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], at, model.byte_fallback))
    elif model.kind == BPE:
        out = Tokenizer(models.BPE({p: n for n, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.remove_extra:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]  # spaces only
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    else:
        out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return out


#: Most distinct runs, and most parts of runs, that an encoder holds from batch to batch.
MOST = 250_000
# ASCII punctuation that may follow a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Encodes and decodes texts; holds a bounded number of distinct runs and parts of runs.

    A run is a marker and what follows it; a run of a word and punctuation is two parts if no piece has the two
    characters that meet between them.
    """

    def __init__(self, path: str, verify: bool = True, most: int = MOST):
        with open(path, "rb") as f:
            self._set_up(f.read(), verify, most)

    @classmethod
    def of(cls, data: bytes, verify: bool = True, most: int = MOST) -> Encoder:
        """From a model file's bytes."""
        out = cls.__new__(cls)
        out._set_up(data, verify, most)
        return out

    def _set_up(self, data: bytes, verify: bool, most: int) -> None:
        self.model, self.most, self.verify = parse_model(data), most, verify
        self.whole, self.run = build(self.model), build(self.model, normalise=False)
        normal = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER)]
        self.feed = self.run.encode("\n", add_special_tokens=False).ids
        self.by_runs = self.model.kind == BPE and len(self.feed) == 1 and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in normal)
        self.meet = {pair for p in normal for pair in pairwise(p)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.bad: set[str] = set()  # runs and parts without parity
        self.unknown = next((n for n, (_, _, kind) in enumerate(self.model.pieces) if kind == UNKNOWN), -1)
        self.table = pa.array([self._bytes_of(p, kind) for p, _, kind in self.model.pieces], pa.large_binary())
        import sentencepiece

        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        """What a piece stands for: nothing (control), a byte, or its text with spaces for markers."""
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()

    def _encode_parts(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of parts by both libraries: in long texts with line feeds between, where these stand alone."""
        groups = [parts[k : k + 64] for k in range(0, len(parts), 64)]
        joined = ["\n" + "\n".join(g) for g in groups]
        got = self._cut([e.ids for e in self.run.encode_batch(joined, add_special_tokens=False)], 1)
        if not self.verify:
            return got, got
        lead = len(self.check.encode("\n"))
        return got, self._cut(self.check.encode([j.replace(MARK, " ") for j in joined]), lead)

    def _cut(self, ids: list[list[int]], lead: int) -> list[list[int]]:
        out, feed = [], self.feed[0]
        for each in ids:
            now: list[int] = []
            for i in each[lead:]:
                if i == feed:
                    out.append(now)
                    now = []
                else:
                    now.append(i)
            out.append(now)
        return out

    def _split(self, run: str) -> tuple[str, ...]:
        head = run.rstrip(PUNCTUATION)
        if not head or len(head) == len(run) or (head[-1], run[len(head)]) in self.meet:
            return (run,)
        return head, run[len(head) :]

    def _alike(self, ids: list[list[int]]) -> list[bool]:
        """Whether the library decodes parts to the bytes that the table has for them; unknown pieces aren't compared."""
        if not self.verify:
            return [True] * len(ids)
        said = self.run.decode_batch(ids, skip_special_tokens=False)
        own = self._joined([np.array(x, "<i4") for x in ids])
        return [self.unknown in x or t.replace(MARK, " ").encode() == b for x, t, b in zip(ids, said, own, strict=True)]

    def _learn(self, runs: list[str]) -> None:
        split = {r: self._split(r) for r in runs if r != "\n"}
        fresh = list({p for parts in split.values() for p in parts if p not in self.parts})
        if fresh:
            got, want = self._encode_parts(fresh)
            for p, e, w, same in zip(fresh, got, want, self._alike(got), strict=True):
                self.parts[p] = np.array(e, "<i4").tobytes()
                if e != w or not same:
                    self.bad.add(p)
        for r, parts in split.items():
            self.known[r] = b"".join([self.parts[p] for p in parts])
            if not self.bad.isdisjoint(parts):
                self.bad.add(r)
        self.known["\n"] = np.array(self.feed, "<i4").tobytes()

    def encode(self, data: list[str]) -> list[tuple[np.ndarray, bool]]:
        """For each text: the tokenizers library's ids, and whether sentencepiece has the same."""
        if not self.by_runs:
            got = [e.ids for e in self.whole.encode_batch(data, add_special_tokens=False)]
            want = self.check.encode(data) if self.verify else got
            return [(np.array(e, "<i4"), e == w) for e, w in zip(got, want, strict=True)]
        runs = [RUN.findall(self.whole.normalizer.normalize_str(t)) if t else [] for t in data]
        known = self.known
        fresh = list({r for each in runs for r in each if r not in known})
        if fresh:
            self._learn(fresh)
        out = [(np.frombuffer(b"".join([known[r] for r in each]), "<i4"), not self.bad or self.bad.isdisjoint(each)) for each in runs]
        self._forget(self.known)
        self._forget(self.parts)
        return out

    def _forget(self, held: dict[str, bytes]) -> None:
        """The older half of what is held goes if that is too much; bad ones stay bad, as long as either has them."""
        if len(held) > self.most:
            for x in list(islice(held, len(held) - self.most // 2)):
                del held[x]
            self.bad = {x for x in self.bad if x in self.known or x in self.parts}

    def forget(self) -> None:
        """Nothing that texts brought is held any longer; the model stays."""
        self.known, self.parts, self.bad = {}, {}, set()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of the texts of ids, each whole: by the tokenizers library; where texts are parts that no merge can
        cross, the parts' bytes, which the library's decoding of each distinct part was held against (``parity``)."""
        back = self._joined(ids)
        if self.model.dummy_prefix:
            back = [t.removeprefix(b" ") for t in back]
        if self.by_runs:
            return back
        said = self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [b if self.unknown in x else t.encode() for x, t, b in zip(ids, said, back, strict=True)]

    def _joined(self, ids: list[np.ndarray]) -> list[bytes]:
        """The pieces' bytes, one after another."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        got = self.table.take(pa.array(np.concatenate([np.zeros(0, "<i4"), *ids])))
        at = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[np.concatenate(([0], np.cumsum(sizes)))]
        data = got.buffers()[2].to_pybytes() if len(got) else b""
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """Kept in a worker from task to task, without what the tasks' texts brought."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``n_tokens, ids_crc32, parity, round_trip`` (and ``ids``) of each whole text.

    ``parity``: sentencepiece gives the same ids, and the library decodes parts as the table does; ``round_trip``: the ids, decoded, give the whole text back (a text
    with the marker itself, or one that the normaliser changes, doesn't come back). Null and empty texts have no ids,
    parity and a round trip. Repeated rows get a row each; an empty table gives an empty table. Columns of the new
    names in ``docs`` are left out, also where ``keep`` names them.
    """

    keep = tuple(c for c in dict.fromkeys(keep) if c.lower() not in ("n_tokens", "ids_crc32", "parity", "round_trip", *["ids"] * ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(path)
        try:
            for batch in slices(batches, 500):
                done = encoder.encode([t.decode() for t in texts(batch)])
                found = [x for x, _ in done]
                back = [a == b for a, b in zip(encoder.decode(found), texts(batch), strict=True)]
                made = [pa.array([x.size for x in found], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()), pa.array([p for _, p in done]), pa.array(back)]
                names = ["n_tokens", "ids_crc32", "parity", "round_trip"]
                if ids:
                    ends = np.concatenate(([0], np.cumsum([x.size for x in found]))).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])
        finally:  # workers wait for later stages with what they hold
            encoder.forget()
            pa.default_memory_pool().release_unused()

    extra = [StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("parity", BooleanType()), StructField("round_trip", BooleanType())]
    if ids:
        extra.append(StructField("ids", ArrayType(IntegerType())))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *extra]))
