"""Mixing sources to target weights by hash-threshold histograms, natively.

A document's key is 48 bits of its id's MD5. Words are summed by source and the key's first 12 bits; the bucket in
which a source's budget ends is the boundary, and only its rows are summed again by the next 12 bits, and then by the
last 24. The thresholds nest, so a larger budget takes a superset, and rows are filtered by one comparison: nothing
is sorted but at most 4096 sums a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.common import count_words, unused, written

BITS, LEVELS = 48, (12, 12, 24)


def key(doc_id: str = "doc_id") -> Column:
    """48 bits of the MD5 of an id's text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = 3) -> DataFrame:
    """``source, size`` rows → ``source, source_size, target``.

    Sources in code point order, null last, take the weights in turn. Targets share the sum of all sizes by weight, up
    to ``epochs`` times the source's size, the excess reshared until none is above: a common level times the weight,
    found in one pass over the sources ordered by the level at which each is full. A row a source, however many rows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - full) / rest
    found = ranked.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), ignorenulls=True).over(every))
    return found.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``source, size, key`` and :func:`targets` → those with ``turns`` whole passes, ``bound`` and ``bound_in``.

    After the whole passes, the rows with a key under ``bound`` are taken once more, and those at it if ``bound_in``:
    whichever comes nearer to the target.
    """
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("turns", turns).withColumn("left", F.col("target") - F.col("turns") * F.col("source_size"))
    goal = written(goal.withColumn("bound", F.lit(0).cast("long")), "goal")
    shift = BITS
    for level, bits in enumerate(LEVELS):
        shift -= bits
        here = rows.select(F.col("source").alias("s"), "size", "key")
        near = goal.select("source", "bound", "left")
        inside = F.col("s").eqNullSafe(F.col("source"))
        if level:
            inside &= F.shiftright("key", shift + bits) == F.shiftright("bound", shift + bits)
        sums = here.join(near, inside).groupBy("source", "left", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.where("n > 0").withColumn("under", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        edge = sums.where("under <= left and left < under + n").select(F.col("source").alias("s"), F.shiftleft("part", shift).alias("at"), "under", "n")
        joined = goal.drop("n").join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        goal = written(joined.select("source", "source_size", "target", "turns", (F.col("left") - F.coalesce("under", F.lit(0))).alias("left"), F.coalesce("at", "bound").alias("bound"), F.coalesce("n", F.lit(0)).alias("n")), "goal")
    return goal.select("source", "source_size", "target", "turns", "bound", (F.col("left") > F.col("n") / F.lit(2.0)).alias("bound_in"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = 3) -> DataFrame:
    """All columns of ``docs``, and ``mix_size, mix_source_size, mix_target, mix_copies``: how often a row is taken
    (columns of those names in ``docs`` are replaced).

    Takes ``doc_id, source, text``. Sizes are words of whole texts (null: 0). Rows of one id are taken alike; a null
    id counts as empty text; null sources are one source. Reruns agree. An empty table gives an empty table.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    rows = written(docs.select("source", count_words().alias("size"), key().alias("key")), "sizes")
    names = dict(zip(("source", "source_size", "target", "turns", "bound", "bound_in"), (unused(f"_mix_{c}", docs) for c in ("source", "source_size", "target", "turns", "bound", "bound_in")), strict=True))
    goal = written(thresholds(rows, targets(rows, weights, epochs)), "thresholds").toDF(*names.values())
    bound = F.col(names["bound"])
    once = (key() < bound) | ((key() == bound) & F.col(names["bound_in"]))
    joined = docs.join(goal, docs["source"].eqNullSafe(F.col(names["source"])))
    added = [count_words().alias("mix_size"), F.col(names["source_size"]).alias("mix_source_size"), F.col(names["target"]).alias("mix_target"), (F.col(names["turns"]) + once.cast("long")).alias("mix_copies")]
    return joined.select(*[docs[c] for c in docs.columns], *added)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; columns named as what :func:`mix` adds stay."""
    apart = {c: unused(f"_{c}", docs) for c in docs.columns if c.lower().startswith("mix_")}
    taken = mix(docs.withColumnsRenamed(apart), **settings).where("mix_copies > 0")
    turn = unused("_mix_turn", taken, docs)
    copies = taken.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    return copies.withColumnsRenamed({v: k for k, v in apart.items()}).select(*docs.columns)
