"""Conversation structure repair by cost layers.

A repaired conversation's role initials read ``(s?(ua)+)?``. Edits of its rows, in order: Keep costs 0, Rerole to user or
assistant 3, Delete 4, Insert an empty turn of user or assistant 3; a truncated row that isn't deleted adds 3; blank and
duplicate rows must be deleted. From the last row to the first, and for each increasing cost, a bitset holds the grammar
states from which the rest can be repaired at that cost; a row's layers come from those of the row after it by shifts
and masks. The first layer of the whole conversation that holds the start is the cost. The audit is traced through the
bitsets: at each step the least letter whose state lies in the layer of the cost that is left.

A layer 7 over a row's first holds all states (insert at most one turn, delete at most the one row that only the start
could keep), so a row's layers are one word of eight sets and its first cost, however long the conversation is.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import per_batch, typed

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ACCEPTING, ALL, DEPTH = START | ASSISTANT, 15, 8
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
MARK = re.compile(r"[^\x20\x09-\x0D]")
END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired array<struct<role: string, text: string>>"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault of blank, duplicate (role and text seen earlier), truncated; or the empty string."""
    out, seen = [], set()
    for row in rows:
        blank, again = not MARK.search(row[1]), row in seen
        seen.add(row)
        out.append("blank" if blank else "duplicate" if again else "" if END.search(row[1]) else "truncated")
    return out


def keeps(initial: str, states: int) -> int:
    """States from which a row of this initial leads into ``states``."""
    if initial == "s":
        return START if states & SYSTEM else 0
    if initial == "u":
        return START | SYSTEM | ASSISTANT if states & USER else 0
    if initial == "a":
        return USER if states & ASSISTANT else 0
    return 0 if initial else states  # a row without a role's name adds no initial


def made(states: int) -> int:
    """States from which a user's or an assistant's turn, whichever is next, leads into ``states``."""
    return (START | SYSTEM | ASSISTANT if states & USER else 0) | (USER if states & ASSISTANT else 0)


class Layers:
    """For a place between rows: ``at(cost)`` is the set of states from which what follows can be repaired at that cost or less."""

    __slots__ = ("base", "word")

    def __init__(self, base: int, sets: list[int]):
        first = next(k for k, s in enumerate(sets) if s)
        self.base = base + first
        self.word = sum(s << 4 * k for k, s in enumerate(sets[first : first + DEPTH]))

    def at(self, cost: int) -> int:
        k = cost - self.base
        return 0 if k < 0 else ALL if k >= DEPTH else self.word >> 4 * k & ALL


def inserted(sets: list[int]) -> list[int]:
    """The same layers with what insertions reach, by increasing cost; each holds the one before."""
    for k in range(len(sets)):
        sets[k] |= (sets[k - 1] if k else 0) | (made(sets[k - INSERT]) if k >= INSERT else 0)
    return sets


def layers(rows: list[tuple[str, str]], fault: list[str]) -> list[Layers]:
    """Layers before each row and after the last."""
    out = [Layers(0, inserted([ACCEPTING] * DEPTH))]
    for (role, _), why in zip(reversed(rows), reversed(fault), strict=True):
        after, sets, more = out[-1], [], TRUNCATED * (why == "truncated")
        for cost in range(after.base, after.base + DEPTH + DELETE):
            found = after.at(cost - DELETE)
            if why in ("", "truncated"):
                found |= keeps(role[:1], after.at(cost - more)) | made(after.at(cost - REROLE - more))
            sets.append(found)
        out.append(Layers(after.base, inserted(sets)))
    return out[::-1]


def moved(state: int, initial: str) -> int:
    """The state after a kept row, 0 if it can't be kept there."""
    return next((s for s in (START, SYSTEM, USER, ASSISTANT) if keeps(initial, s) & state), 0)


def repaired(rows: list[tuple[str, str]], fault: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """Least cost, the least of the cheapest audits in ASCII order, and the repaired turns."""
    held = layers(rows, fault)
    cost = next(c for c in range(held[0].base, held[0].base + DEPTH) if held[0].at(c) & START)
    state, at, left, audit, turns = START, 0, cost, [], []
    while at < len(rows) or left:
        steps = [("I", at, INSERT, NEXT[state], "")]
        if at < len(rows):
            (role, text), more = rows[at], TRUNCATED * (fault[at] == "truncated")
            steps.insert(0, ("D", at + 1, DELETE, state, None))
            if fault[at] in ("", "truncated"):
                steps += [("K", at + 1, more, moved(state, role[:1]), text), ("R", at + 1, REROLE + more, NEXT[state], text)]
        letter, to, price, after, text = next(s for s in steps if held[s[1]].at(left - s[2]) & s[3])
        if text is not None:
            turns.append((rows[at][0] if letter == "K" else NAMES[after], text))
        audit.append(letter)
        state, at, left = after, to, left - price
    return cost, "".join(audit), turns


def repair(conversation: list[dict]) -> dict:
    """The report of one conversation's rows (``turn``, ``role``, ``text``), in order."""
    rows = [(r["role"], r["text"]) for r in conversation]
    why = faults(rows)
    known = {r["turn"] for r in conversation} - {None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, turns = repaired(rows, why)
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        **{k: why.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": r, "text": t} for r, t in turns],
    }


def repairs(conversations: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` (rows without one are a conversation of their own): counts of gaps, faults and illegal
    neighbours, ``cost``, ``audit`` and the ``repaired`` turns.

    Rows go by turn, those without one first, then by role and text, so tied rows have one order and repeated rows are
    duplicates. Null roles and texts are one space: such a text is blank, such a role is of no party. A turn that isn't a
    whole number counts as null. Other columns aren't read; an empty table gives no rows. A conversation is one value,
    as its repaired turns are; a conversation's rows meet in one shuffle.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    row = F.struct(F.col("turn").try_cast("long").alias("turn"), space("role"), space("text"))
    held = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [repair(rows.as_py()) for rows in batch.column("rows")]
        columns = [pa.array([r[c] for r in found], pa.int64()) for c in COUNTS]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, pa.array([r["audit"] for r in found], pa.string()), pa.array([r["repaired"] for r in found], TURNS)], ["conv_id", *COUNTS, "audit", "repaired"])

    return held.mapInArrow(per_batch(run), f"conv_id {typed(held, 'conv_id')}, {OUT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 drops one, 1 empties its text, 2 takes out its full stops, question
    and exclamation marks, 3 repeats it, 4 makes it the user's. Nulls are one space first (a null turn in the key alone)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    new_text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_kind", kind).where("_kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(text("role")).alias("role"), new_text.alias("text"), copies).drop("_copy")
