"""Chat formatting by schema fingerprints, natively.

Records are JSON in any layout. Which of the known nested field paths a record has is hashed; the hash selects a
declarative mapping, and the mapping gives canonical turns (role, text). A path into a list counts as there if every
item of the list has it, so one odd item can't lose its text. A template then marks turns. Control strings
inside texts are escaped with one backslash after their first character (one more where there are some), which is
undone by taking one off, so that formatting is reversible for every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may follow the first character of a control string, and the strings the template itself uses.
OPENERS = r"[<\[]"
REST = r"\||/?s>|<SYS>>|</SYS>>|/?INST\]"
TURN_END = "</s>\n"

# Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: a list of items with a role and a text, or fixed (role, path) pairs.

    A role of a fixed pair that starts with ``$`` is a path itself. ``order`` is the path of a record's place among
    the records of its conversation. ``optional`` paths may be missing.
    """

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            return [self.items, f"{self.items}[*].{self.role}", f"{self.items}[*].{self.text}"]
        return [p for pair in self.fixed for p in pair if p.startswith("$")] + [self.order] * bool(self.order)


MAPPINGS = (
    Mapping("turn rows", fixed=(("$.role", "$.text"),), order="$.turn"),
    Mapping("messages", items="$.messages", role="role", text="content"),
    Mapping("messages from and value", items="$.messages", role="from", text="value"),
    Mapping("conversations", items="$.conversations", role="from", text="value"),
    Mapping("conversations role and content", items="$.conversations", role="role", text="content"),
    Mapping("dialog", items="$.dialog", role="speaker", text="text"),
    Mapping("prompt and completion", fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")), optional=("$.system",)),
    Mapping("prompt and response", fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")), optional=("$.system",)),
    Mapping("instruction", fixed=(("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), optional=("$.system", "$.input")),
    Mapping("question and answer", fixed=(("user", "$.question"), ("assistant", "$.answer"))),
)


def known_paths(mappings=MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in m.paths()})


def _there(record: Column, path: str) -> Column:
    """Whether a variant has a path; one into a list: whether each of the list's items has it."""
    head, of_items, field = path.partition("[*].")
    if not of_items:
        return F.try_variant_get(record, path, "variant").isNotNull()
    return F.forall(F.try_variant_get(record, head, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())


def fingerprint_of(record: Column, mappings=MAPPINGS) -> Column:
    """Hash of the known nested field paths that a variant has, in code point order; null values count as there."""
    return F.xxhash64(F.concat_ws("\n", *[F.when(_there(record, p), F.lit(p)) for p in known_paths(mappings)]))


def selected(record: Column, mappings=MAPPINGS) -> Column:
    """Number of the mapping that a record's fingerprint selects, or null.

    Each set of optional paths, and an empty list, has a fingerprint of its own. A record with the paths of several
    layouts has none of these; the first mapping that finds all it needs takes it.
    """
    fp = fingerprint_of(record, mappings)
    out = fallback = F.lit(None).cast("int")
    for n, m in reversed(list(enumerate(mappings))):
        need = [p for p in m.paths() if p not in m.optional]
        sets = [need + list(some) for k in range(len(m.optional) + 1) for some in combinations(m.optional, k)]
        if m.items:  # every item of an empty list has every field
            sets.append(sorted({p for o in mappings if o.items == m.items for p in o.paths()}))
        hashes = [F.xxhash64(F.lit("\n".join(sorted(s)))) for s in sets]
        out = F.when(fp.isin(*hashes), F.lit(n)).otherwise(out)
        all_there = _there(record, need[0])
        for p in need[1:]:
            all_there = all_there & _there(record, p)
        fallback = F.when(all_there, F.lit(n)).otherwise(fallback)
    return F.coalesce(out, fallback)


def _text(v: Column, path: str) -> Column:
    """A string; other values as JSON; null and missing: empty."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(got.isNull() | F.is_variant_null(got), F.lit("")).otherwise(F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(got)))


def _turns(v: Column, m: Mapping) -> Column:
    """An array of (at, role, text)."""
    turn = lambda at, role, text: F.struct(at.cast("long").alias("at"), role.alias("role"), text.alias("text"))
    if m.items:
        roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        named = lambda r: F.coalesce(F.element_at(roles, r), r)
        return F.transform(F.try_variant_get(v, m.items, "array<variant>"), lambda x, i: turn(i, named(_text(x, f"$.{m.role}")), _text(x, f"$.{m.text}")))
    at = F.coalesce(F.try_variant_get(v, m.order, "long"), F.lit(0)) if m.order else None
    made = [F.when(F.try_variant_get(v, path, "variant").isNotNull(), turn(F.lit(k) if at is None else at, _text(v, role) if role.startswith("$") else F.lit(role), _text(v, path))) for k, (role, path) in enumerate(m.fixed)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """``conv_id, record`` (JSON) → ``conv_id, layout, at, role, text``, a row a turn.

    A record that isn't JSON, or whose fingerprint selects nothing, gives one row with a null layout and no turn
    (null ``role``), so that nothing is lost silently. Null texts and roles are empty.
    """
    parsed = records.select("conv_id", F.try_parse_json("record").alias("v"))
    chosen = parsed.withColumn("m", selected(F.col("v"), mappings))
    turns, layout = F.lit(None), F.lit(None).cast("string")
    for n, m in enumerate(mappings):
        turns = F.when(F.col("m") == n, _turns(F.col("v"), m)).otherwise(turns)
        layout = F.when(F.col("m") == n, F.lit(m.name)).otherwise(layout)
    out = chosen.select("conv_id", layout.alias("layout"), F.explode_outer(turns).alias("x"))
    return out.select("conv_id", "layout", "x.at", "x.role", "x.text")


def escaped(text: Column) -> Column:
    """Put a backslash after the first character of each control string."""
    return F.regexp_replace(text, rf"({OPENERS})(\\*)(?={REST})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\(\\*)(?={REST})", "$1$2")


# Characters that a role name can't hold in the header, in the order in which they are replaced.
ROLE_CODES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), ("[", "%5B"), ("\n", "%0A"))


def _coded(role: Column, back: bool = False) -> Column:
    for a, b in reversed(ROLE_CODES) if back else ROLE_CODES:
        role = F.replace(role, F.lit(b if back else a), F.lit(a if back else b))
    return role


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, at, role, text`` → ``conv_id, n_turns, formatted, loss`` a row a conversation.

    ``loss`` has the (start, length) in code points of each text of ``loss_role``, as it stands escaped in
    ``formatted``. Turns stand by ``at``, ties by role and text; repeated rows are repeated turns; null texts are empty.
    Rows with a null role are no turn, and a conversation without a turn has 0, an empty text and an empty mask. A null
    conv_id is a conversation of its own. A conversation's text is one value by contract.
    """
    head = F.concat(F.lit("<|"), _coded(F.col("role")), F.lit("|>\n"))
    parts = turns.select("conv_id", "at", "role", "text", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    parts = parts.withColumn("whole", F.concat("head", "body", F.lit(TURN_END)))
    order = Window.partitionBy("conv_id").orderBy("at", "role", "text")
    before = F.coalesce(F.sum(F.char_length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("conv_id", F.row_number().over(order).alias("n"), "whole", F.when(F.col("role") == loss_role, F.struct((before + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"))
    held = placed.groupBy("conv_id").agg(F.count("whole").alias("n_turns"), F.array_sort(F.collect_list(F.when(F.col("whole").isNotNull(), F.struct("n", "whole", "span")))).alias("xs"))
    return held.select("conv_id", "n_turns", F.array_join(F.transform("xs", lambda x: x.whole), "").alias("formatted"), F.filter(F.transform("xs", lambda x: x.span), lambda s: s.isNotNull()).alias("loss"))


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(text, TURN_END)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "|>\n", 1)
        body = F.substr(part, F.char_length(head) + F.lit(4))
        return F.struct(_coded(F.substr(head, F.lit(3)), back=True).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn (``conv_id, turn, role, text``; other columns are ignored) as JSON records, a record a row."""
    fields = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.select("conv_id", F.to_json(fields).alias("record"))
