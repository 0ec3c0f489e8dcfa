"""Text functions: normal forms, error rates, artifacts, clean-up, timestamp tags."""

from __future__ import annotations

import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# White space (Unicode's, and U+001C to U+001F), Japanese letters, and marks that may stand with them.
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
JAPANESE = r"぀-ヿ㐀-鿿々〆〤ヶー"
JAPANESE_MARKS = JAPANESE + r"。、，,.！？!?…「」『』（）【】《》〈〉"
RELAXED = "ー〜～"
PREFIXES = ("Transcription:", "Transcript:", "文字起こし:", "書き起こし:")
REPEATED = r"(?s)(.)\1{11}|(..)\2{5}|(.{3})\3{3}|(.{4})\4{2}|(.{5})\5{2}|(.{6})\6{2}|(.{7})\7{2}|(.{8})\8{2}"
DENSE_CHARS, DENSE_PER_SECOND = 8, 15.0


def strict(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, SPACE, "")


class _Kept(dict):
    """Code points for ``str.translate``: white space, punctuation and symbols go; each is looked up once a process."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = None if c.isspace() or unicodedata.category(c)[0] in "PS" else point
        return self[point]


_KEPT = _Kept()


@F.arrow_udf(StringType())
def practical(texts: pa.Array) -> pa.Array:
    """Compatibility form without white space, punctuation and symbols. Spark has no such builtin. Texts are folded one
    by one out of the Arrow batch, and few at a time are Python strings."""
    folded = lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(_KEPT)
    made = [pa.array([folded(t.as_py()) for t in texts.slice(at, 256)], pa.string()) for at in range(0, len(texts), 256)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def relaxed(text: Column | str) -> Column:
    """:func:`practical` without long-vowel and wave marks; both of one text are one call of Python."""
    return F.translate(practical(text), RELAXED, "")


def _shared_start(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _excess(a: str, b: str, most: int) -> int | None:
    """By how much the distance is over ``len(a) - len(b)``, for ``a`` the longer text; None if by more than ``most``.

    Characters of ``a`` that are left out make up the difference of lengths, so a replaced one costs 1 more than that and
    one of ``b`` that isn't met costs 2. For each excess, ``far[j]`` is the shortest prefix of ``a`` that takes the first
    ``j`` characters of ``b``: work is in proportion to ``len(b)`` times the excess.
    """
    n, m = len(a), len(b)
    never, find = n + 1, a.find
    before, last = None, None
    for e in range(most + 1):
        far, at = array("q", bytes(8 * (m + 1))), 0
        for j, c in enumerate(b, 1):
            at = find(c, at) + 1 or never if at < n else never
            if last is not None:
                at = min(at, last[j - 1] + 1)
                if before is not None:
                    at = min(at, before[j - 1])
            far[j] = at = min(at, never)
            if at == never and last is None and not most:
                return None
        if far[m] <= n:
            return e
        before, last = last, far
    return None


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance over code points.

    A text that has the other's characters in order, but for few, takes time in proportion to its length (:func:`_excess`);
    other pairs go bit-parallel, a column of the table being one integer: the product of the lengths by the word's bits.
    """
    if a == b:
        return 0
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) or len(b)
    if len(a) > len(b):
        a, b = b, a
    more = _excess(b, a, len(a) // 4000)
    if more is not None:
        return len(b) - len(a) + more
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    top, up, down, score = 1 << (len(a) - 1), full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise = down | (~(horizontal | up) & full)
        fall = up & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | (~(vertical | rise) & full)
        down = rise & vertical
    return score


@F.arrow_udf(LongType())
def long_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """:func:`edit_distance` for whole documents, a pair at a time; short texts are faster by Spark's ``levenshtein``."""
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))
    return pa.array([0 if x is None or y is None else edit_distance(x, y) for x, y in pairs], pa.int64())


def error_rate(distance: Column, reference_chars: Column, candidate_chars: Column) -> Column:
    """Distance by reference characters, at least 1 of them; 0 if both sides are empty."""
    none = (reference_chars == 0) & (candidate_chars == 0)
    return F.when(none, F.lit(0.0)).otherwise(distance / F.greatest(F.lit(1), reference_chars))


def not_japanese(normal: Column) -> Column:
    return (normal != "") & ~normal.rlike(f"[{JAPANESE}]")


def dense(chars: Column, duration_ms: Column) -> Column:
    """At least 8 characters and more than 15 a second (at least a millisecond long)."""
    return (chars >= DENSE_CHARS) & (chars / F.greatest(F.lit(0.001), F.greatest(F.lit(0), duration_ms) / 1000.0) > DENSE_PER_SECOND)


def repeated(normal: Column) -> Column:
    """A unit of 1 to 8 characters, repeated to 12 characters or more: 4 times at least if it is one character, else 3."""
    return normal.rlike(REPEATED)


def cleaned(text: Column) -> Column:
    """Speech-model output as text: fences, prefixes and outer noise off, no space between Japanese letters; what has
    no Japanese letter is empty."""
    trim = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    out = trim(text)
    out = F.when(out.startswith("```") & out.endswith("```"), trim(F.regexp_replace(out, "^`+|`+$", ""))).otherwise(out)
    for prefix in PREFIXES:
        out = F.when(out.startswith(prefix), trim(F.substr(out, F.lit(len(prefix) + 1)))).otherwise(out)
    out = F.regexp_replace(out, f"^[^{JAPANESE_MARKS}]+", "")
    out = F.regexp_replace(out, f"[^{JAPANESE_MARKS}]+$", "")
    out = F.regexp_replace(out, f"([{JAPANESE}]){SPACE}+([{JAPANESE}])", "$1$2")
    out = F.regexp_replace(out, f"{SPACE}+([{JAPANESE_MARKS}])", "$1")
    out = trim(F.regexp_replace(out, f"([{JAPANESE_MARKS}]){SPACE}+", "$1"))
    return F.when(out.rlike(f"[{JAPANESE}]"), out).otherwise(F.lit(""))


TAG = r"\[T:(\d{1,3})\]"


def tagged_tokens(text: Column, duration_ms: Column) -> Column:
    """``word [T:centiseconds]`` text → array of (text, end_ms); numbers wrap at 1000 and never run backwards."""
    words = F.transform(F.split(text, TAG), lambda x: F.trim(x))
    ends = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: x.cast("long"))
    begin = F.struct(F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, end: Column) -> Column:
        short = F.greatest(F.lit(0), state.last - state.offset - end)
        offset = state.offset + F.ceil(short / 1000) * 1000
        return F.struct(offset.alias("offset"), (end + offset).alias("last"), F.concat(state.out, F.array(end + offset)).alias("out"))

    absolute = F.aggregate(ends, begin, step, lambda s: s.out)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(ends)), absolute, lambda w, e: F.struct(w.alias("text"), F.greatest(F.lit(0), F.least(e * 10, duration_ms)).alias("end_ms")))
    return F.filter(pairs, lambda p: p.text != "")


def safe_name(text: Column) -> Column:
    """A file name's characters: others become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
