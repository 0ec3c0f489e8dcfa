"""Language identification of mixed texts: script ranges, word scores, and Viterbi with a switching penalty.

Words are maximal runs of letters of one script, lower-cased. A model holds for each learned language the logarithms of
its words' and character n-grams' shares (one to three characters, word ends marked), and which scripts it is written
in. A word's script narrows the languages that it may have; of those it gets a score. Viterbi labels a text's words so
that the sum of scores less ``SWITCH`` for each change of language is largest: neighbours of one label are a span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lumenspan.llm.common import slices, texts

#: Penalty of a change of language, and the most that a word may tell against one, in natural logarithms.
SWITCH, MOST = 14.0, 12.0
#: A language is a candidate for a script that at least this share of its letters is in.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")

# First code points of Unicode ranges by script; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Coptic"),
    (0x2D00, "Georgian"), (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"),
    (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xA960, "Hangul"), (0xA980, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"),
    (0x1B000, "Kana"), (0x1B170, "Other"), (0x20000, "Han"),
]
_FIRST = [a for a, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(letter)) - 1][1]


def words_of(run: str) -> list[tuple[str, str]]:
    """A run of letters as ``(word, script)``, cut where the script changes; numerals that aren't letters are left out."""
    if run.isascii() or (run.isalpha() and max(run) < "\u0370"):
        return [(run, "Latin")]
    letters = "".join(c for c in run if c.isalpha())
    return [("".join(g), s) for s, g in groupby(letters, script_of)]


#: Sizes of n-grams, and the bits that a letter's code point takes in the number that stands for one.
SIZES, BITS = (1, 2, 3), 21


def ngrams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the n-grams of all words as numbers, and which word each is of, in the words' order; of size one
    without a word's end marks, so that no word is without one of each size."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    inner = np.ones(codes.size, bool)
    ends = np.cumsum([len(w) + 2 for w in words])
    inner[ends - 1] = inner[ends[:-1]] = inner[0] = False
    out = [(codes[inner], owner[inner])]
    keys = codes
    for size in SIZES[1:]:
        keys = keys[:-1] << np.uint64(BITS) | codes[size - 1 :]
        within = owner[: keys.size] == owner[size - 1 :]
        out.append((keys[within], owner[: keys.size][within]))
    return out


def spelled(key: int, size: int) -> str:
    """An n-gram's characters from its number."""
    return "".join(chr(key >> BITS * k & (1 << BITS) - 1) for k in range(size - 1, -1, -1))


def numbered(gram: str) -> int:
    """An n-gram's number."""
    key = 0
    for c in gram:
        key = key << BITS | ord(c)
    return key


@dataclass
class Model:
    """``at`` maps n-grams to rows of ``logs``, a column a language; ``scripts`` says by script which languages are
    candidates. N-grams that no language was seen with tell nothing."""

    langs: list[str]
    at: dict[str, int]
    logs: np.ndarray
    scripts: dict[str, np.ndarray]
    prior: np.ndarray

    def __post_init__(self) -> None:
        # rows of the n-grams of each size by number, and a last row for what no language was seen with
        grams = [sorted((numbered(g), r) for g, r in self.at.items() if not g.startswith("=") and len(g) == size) for size in SIZES]
        self.keys = [np.array([k for k, _ in x] + [np.iinfo(np.uint64).max], np.uint64) for x in grams]
        self.rows = [np.array([r for _, r in x] + [len(self.at)], np.int64) for x in grams]
        self.padded = np.concatenate([self.logs, np.zeros((1, len(self.langs)))])

    def score(self, words: list[tuple[str, str]]) -> np.ndarray:
        """A row of scores for each ``(word, script)`` by language, the best 0, none under ``-MOST``; other scripts'
        languages have ``-2 * MOST``."""
        nothing = len(self.at)
        s = self.padded[[self.at.get(f"={w}", nothing) for w, _ in words]]
        for (keys, owner), known, rows in zip(ngrams([w for w, _ in words]), self.keys, self.rows, strict=True):
            place = np.searchsorted(known, keys)
            found = np.where(known[place] == keys, rows[place], nothing)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))  # every word has n-grams of each size
            s = s + np.add.reduceat(self.padded[found], starts, axis=0)
        s = s / 3  # a letter is in three n-grams
        every = np.ones(len(self.langs), bool)
        may = np.array([self.scripts.get(script, every) for _, script in words])
        top = np.where(may, s, -np.inf).max(axis=1, keepdims=True)
        return np.where(may, np.maximum(s - top, -MOST), -2 * MOST)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id's text leaves 1 when divided by 3; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Words whose n-grams are held at a time.
CHUNK = 20_000


def counted(words: list[tuple[str, str, int]]) -> Counter:
    """How often each word (with ``=`` before it), n-gram, and letter of a script (a space before its name) is in
    ``(word, script, times)``."""
    out: Counter = Counter()
    times = np.array([n for *_, n in words], np.int64)
    for word, script, n in words:
        out[f"={word}"] += n
        out[f" {script}"] += n * len(word)
    for size, (keys, owner) in zip(SIZES, ngrams([w for w, *_ in words]), strict=True):
        distinct, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, times[owner], distinct.size)
        for key, n in zip(distinct.tolist(), sums.tolist(), strict=True):
            out[spelled(key, size)] += int(n)
    return out


def fit(docs: DataFrame, max_rows: int = 20_000, max_langs: int = 100, max_grams: int = 200_000, smoothing: float = 0.5) -> Model:
    """Learn from rows that have a ``lang`` and aren't held out: about ``max_rows`` of each language, those with the smallest hashes.

    Counting rows by language gives each language's threshold; n-grams of the sample's whole texts are counted in tasks
    and summed by a shuffle. The ``max_langs`` languages with the most rows and the ``max_grams`` most frequent n-grams
    (of two occurrences or more) come to the driver. Null, empty and blank languages aren't learned; ties go by name.
    """
    known = docs.where("lang is not null and trim(lang) <> '' and text is not null").where(~held_out()).select("doc_id", "text", "lang")
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros(0))
    most = float(1 << 63)
    limit = {r["lang"]: int(min(1.0, max_rows / r["count"]) * 2 * most - most) for r in rows}
    limits = F.create_map(*[F.lit(x) for lang, n in limit.items() for x in (lang, min(n, (1 << 63) - 1))])
    sample = known.where(F.xxhash64("doc_id", "text") <= F.element_at(limits, F.col("lang"))).select("text", "lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            words: dict[str, Counter] = {}
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.decode("utf-8", "replace").lower()))
            for lang, seen in words.items():
                own = [(w, s, n) for run, n in seen.items() for w, s in words_of(run)]
                for at in range(0, len(own), CHUNK):
                    grams = counted(own[at : at + CHUNK])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # a row a gram, so that all languages of a kept one come with it
    by_gram = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    script = F.col("gram").startswith(" ")
    kept = by_gram.where(script | (F.col("n") > 1)).orderBy(F.desc(script), F.desc("n"), "gram").limit(max_grams).collect()
    return model_of(langs, {r["gram"]: r["by"] for r in kept}, {r["lang"]: r["count"] for r in rows}, smoothing)


def model_of(langs: list[str], counts: dict[str, dict[str, int]], rows: dict[str, int], smoothing: float) -> Model:
    """A model from counts of n-grams, and of letters by script (named with a leading space), by language.

    Words and n-grams of one, two and three characters each are a distribution of their own.
    """
    column, grams = {lang: k for k, lang in enumerate(langs)}, [g for g in counts if not g.startswith(" ")]
    n = np.zeros((len(grams), len(langs)))
    for r, g in enumerate(grams):
        for lang, times in counts[g].items():
            if lang in column:
                n[r, column[lang]] = times
    order = np.array([0 if g.startswith("=") and len(g) > 1 else len(g) for g in grams], np.int64)
    whole = np.zeros((4, len(langs)))
    np.add.at(whole, order, n)
    size = np.bincount(order, minlength=4)[:, None] + 1.0
    logs = np.log((n + smoothing) / (whole + smoothing * size)[order]) if grams else n
    letters = {s: np.array([counts[s].get(lang, 0) for lang in langs], float) for s in counts if s.startswith(" ")}
    total = np.maximum(1.0, sum(letters.values()) if letters else np.ones(len(langs)))
    scripts = {s[1:]: x / total >= SCRIPT_SHARE for s, x in letters.items()}
    share = np.array([rows.get(lang, 0) for lang in langs], float)
    return Model(langs, {g: k for k, g in enumerate(grams)}, logs, {s: x for s, x in scripts.items() if x.any()}, share / share.sum())


def viterbi(scores: np.ndarray) -> np.ndarray:
    """Labels of the best path over rows of scores, ``SWITCH`` less for each change; ties stay, then go to the first label.

    The label with the largest sum, ``top``, is best but for excursions from it. At each of its words the path has not
    lost against ``top`` since an excursion began (else it would better begin later), so it lies where the largest sum of
    the others' gains that ends there is over 0; and it must gain its switches: two within the text, one at either end.
    Only stretches where that can be are searched; most texts have none.
    """
    n, many = scores.shape
    top = int(scores.sum(axis=0).argmax())
    out = np.full(n, top)
    if many == 1 or n == 1:
        return out
    total = np.cumsum(np.delete(scores, top, axis=1).max(axis=1) - scores[:, top])
    # a text's first word comes without a switch, which counts as gained
    gain = total - np.minimum(np.minimum.accumulate(total), -SWITCH)
    if gain.max() <= 2 * SWITCH and gain[-1] <= SWITCH:
        return out
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (gain > 0).view(np.int8), [0])))).reshape(-1, 2)
    for a, b in edges.tolist():
        if gain[a:b].max() > 2 * SWITCH or (b == n and gain[-1] > SWITCH):
            out[a:b] = _best_path(scores[a:b].tolist(), top, a == 0, b == n)
    return out


def _best_path(rows: list[list[float]], top: int, begins: bool, ends: bool) -> list[int]:
    """Labels of the best path over some rows, which comes from ``top`` and goes to it but at the ends of the text."""
    labels = range(len(rows[0]))
    price = [0.0 if k == top else SWITCH for k in labels]
    best, came = [x - (0.0 if begins else p) for x, p in zip(rows[0], price, strict=True)], []
    for row in rows[1:]:
        k = max(labels, key=best.__getitem__)
        bar = best[k] - SWITCH
        came.append([k if x < bar else j for j, x in enumerate(best)])
        best = [(bar if x < bar else x) + y for x, y in zip(best, row, strict=True)]
    last = best if ends else [x - p for x, p in zip(best, price, strict=True)]
    path = [max(labels, key=last.__getitem__)]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


SPAN = StructType([StructField("lang", StringType()), *(StructField(c, LongType()) for c in ("first_word", "n_words", "n_letters"))])
SPANS = pa.list_(pa.struct([("lang", pa.string()), *((c, pa.int64()) for c in ("first_word", "n_words", "n_letters"))]))
ADDED = {"lang_pred": StringType(), "lang_score": DoubleType(), "lang_spans": ArrayType(SPAN)}


class Labeller:
    """Labels texts with a model; scores of words are kept, half a million at most."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        # a run's row of scores, or -1 less its place among the runs that are several words or none
        self.known: dict[str, int] = {}
        self.several: list[list[int]] = []
        self.scores = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, np.int64)

    def _learn(self, runs: set[str]) -> None:
        words, at = [], len(self.scores)
        for run in runs:
            own = words_of(run)
            if len(own) == 1:
                self.known[run] = at + len(words)
            else:
                self.known[run] = -1 - len(self.several)
                self.several.append(list(range(at + len(words), at + len(words) + len(own))))
            words += own
        if words:
            made = [self.model.score(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)]
            self.scores = np.concatenate([self.scores, *(x + np.log(self.model.prior) * 1e-6 for x in made)])
            self.letters = np.concatenate([self.letters, [len(w) for w, _ in words]])

    def __call__(self, found: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Of each text the language of most letters, the share of letters that have it, and the spans."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, [])] * len(found)
        if len(self.scores) > 500_000:
            self._forget()
        runs = [LETTERS.findall(text.lower()) for text in found]
        new = set().union(*runs) - self.known.keys()
        if new:
            self._learn(new)
        return [self._label(np.fromiter(map(self.known.__getitem__, r), np.int64, len(r))) for r in runs]

    def _label(self, rows: np.ndarray) -> tuple[str, float, list[dict]]:
        langs = self.model.langs
        if rows.size and rows.min() < 0:
            rows = np.array([k for r in rows.tolist() for k in ([r] if r >= 0 else self.several[-1 - r])], np.int64)
        if not rows.size:
            return UNKNOWN, 0.0, []
        letters, labels = self.letters[rows], viterbi(self.scores[rows])
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(rows)]
        spans = [{"lang": langs[labels[a]], "first_word": a, "n_words": b - a, "n_letters": int(letters[a:b].sum())} for a, b in zip(edges, edges[1:], strict=False)]
        by = np.bincount(labels, letters, len(langs))
        return langs[int(by.argmax())], float(by.max() / by.sum()), spans


def labelled(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) with ``lang_pred``, ``lang_score`` (share of the text's letters
    that have it) and ``lang_spans`` of the whole text; columns of those names are replaced.

    Texts that are null or have no letter are ``und`` with score 0 and no span, and so are all if no language was
    learned. Letters of a script that no language was seen in go to the language that fits best all the same. Repeated
    rows keep a row each; an empty table gives an empty one. Nothing is shuffled; the model is bounded by :func:`fit`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value)

        for batch in slices(batches, 500, 4 << 20):
            found = label([t.decode("utf-8", "replace") for t in texts(batch)])
            pred, score, spans = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPANS)], [*keep, *ADDED])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, kind) for c, kind in ADDED.items())])
    return docs.mapInArrow(run, schema)
