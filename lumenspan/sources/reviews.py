"""Queues of review items as files: JSON documents with an array of items, or JSON lines with an item a line.

A document's items are one value, as in other documents; lines are what Spark writes and reads of a queue of any size.
Items are read tolerantly: any field may be missing or null, unknown ones are kept as JSON in ``other``. What can't be
merged raises: no array of items, reasons that aren't a list of strings, a score that isn't a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.scratch import checkpointed

TEXTS = ["case_id", "reference_id", "candidate_id", "reference_text", "candidate_text", "reference_channel", "candidate_channel"]
TIMES = ["start_ms", "end_ms", "start_delta_ms", "end_delta_ms", "duration_ms"]
#: Fields that a merge makes anew.
MADE = ["reasons", "priority_score", "priority_rank", "source_reports", "merged_input_count", "item_index"]


def _kind(v: Column, field: str) -> Column:
    """The JSON kind of a field, null if it is missing or null."""
    return F.nullif(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")), F.lit("VOID"))


def _rows(values: DataFrame) -> DataFrame:
    """``source, item_index, v`` → items with ``rule``, null where one is valid."""
    v = F.col("v")
    number = _kind(v, "priority_score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    reasons = F.try_variant_get(v, "$.reasons", "array<variant>")
    strings = (F.size(reasons) > 0) & F.forall(reasons, lambda r: F.coalesce(F.schema_of_variant(r) == "STRING", F.lit(False)))
    rule = F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("an item must be an object")).when(~F.coalesce(strings, F.lit(False)), F.lit("reasons must be a list of strings")).when(~F.coalesce(number, F.lit(True)), F.lit("priority_score must be a number"))
    text = lambda c: F.when(_kind(v, c) == "STRING", F.try_variant_get(v, f"$.{c}", "string")).alias(c)
    whole = lambda c: F.when(_kind(v, c) == "BIGINT", F.try_variant_get(v, f"$.{c}", "long")).alias(c)
    known = TEXTS + TIMES + MADE
    other = F.map_filter(F.transform_values(F.coalesce(F.try_variant_get(v, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>")), lambda k, x: F.coalesce(F.to_json(x), F.lit("null"))), lambda k, x: ~k.isin(*known))
    score = F.coalesce(F.try_variant_get(v, "$.priority_score", "double"), F.lit(0.0)).alias("priority_score")
    return values.select("source", "item_index", *map(text, TEXTS), *map(whole, TIMES), F.array_distinct(F.try_variant_get(v, "$.reasons", "array<string>")).alias("reasons"), score, other.alias("other"), rule.alias("rule"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("source"), F.try_parse_json("value").alias("v"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    held = spark.read.text(path).where("trim(value) <> ''").select(F.lit(path).alias("source"), F.try_parse_json("value").alias("v"))
    rank = F.try_variant_get("v", "$.priority_rank", "long")
    return held.select("source", F.coalesce(rank, F.monotonically_increasing_id()).alias("item_index"), "v")


def items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of one file with ``source, item_index, rule``; not yet checked."""
    if lines:
        return _rows(_lines(spark, path))
    held = _documents(spark, path).withColumn("xs", F.try_variant_get("v", "$.items", "array<variant>"))
    good = held.where("xs is not null").select("source", F.posexplode("xs").alias("item_index", "v"))
    bad = held.where("xs is null").select("source", F.lit(None).cast("int").alias("item_index"), F.lit(None).cast("variant").alias("v"))
    return _rows(good.unionByName(bad)).withColumn("rule", F.when(F.col("item_index").isNull(), F.lit("the file has no array of items")).otherwise(F.col("rule")))


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of one file in its order (``item_index``); raises on the first that isn't valid.

    Lines are parsed once, into a checkpoint.
    """
    rows = items(spark, path, lines)
    if lines:
        rows = checkpointed(rows)
    first = rows.where("rule is not null").orderBy("item_index").limit(1).collect()
    if first:
        raise ValueError(f"{path}: item {first[0]['item_index']}: {first[0]['rule']}")
    return rows.drop("rule", "source")


def case_index(spark: SparkSession, paths: list[str]) -> str | None:
    """The case index that the documents name; raises if they name several, or one that isn't a name."""
    named = None
    for path in paths:
        v = _documents(spark, path).select(_kind(F.col("v"), "source_case_index").alias("kind"), F.try_variant_get("v", "$.source_case_index", "string").alias("name")).first()
        if v is None or v["kind"] is None:
            continue
        if v["kind"] != "STRING" or not v["name"]:
            raise ValueError(f"{path}: source_case_index must be a string with characters")
        if named is not None and named != v["name"]:
            raise ValueError("the queues name different case indexes")
        named = v["name"]
    return named


def item_json(queue: DataFrame) -> Column:
    """An item as JSON text, nulls left out, with its other fields."""
    text = F.to_json(F.struct(*[c for c in queue.columns if c not in ("other", "item_index")]))
    if "other" not in queue.columns:
        return text
    name = lambda k: F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\\\])', r"\\$1"), F.lit('":'))
    more = F.array_join(F.transform(F.map_entries("other"), lambda e: F.concat(F.lit(","), name(e.key), e.value)), "")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - 1), F.coalesce(more, F.lit("")), F.lit("}"))


def write_lines(queue: DataFrame, path: str) -> None:
    """An item a line, as many files as the queue has partitions."""
    queue.select(item_json(queue).alias("value")).write.text(path)


def document(queue: DataFrame, tag: str, **shared: str | None) -> DataFrame:
    """``json``: one document of a queue, its items by rank, with the counts of its reasons and a summary a case.

    A document is one value; queues too large for that go by :func:`write_lines`.
    """
    from lumenspan.operators.effort import case_reason_counts, reason_counts

    held = queue.agg(F.array_sort(F.collect_list(F.struct("priority_rank", item_json(queue).alias("x")))).alias("xs"), F.count("*").alias("item_count"))
    counts = reason_counts(queue).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    cases = case_reason_counts(queue)
    one = F.struct(*[c for c in cases.columns if c != "place"])
    summaries = cases.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.to_json(one).alias("x"), "case_id"))), lambda s: F.struct(s.x.alias("x"), s.case_id.alias("case_id"))).alias("cases"))
    tops = [F.lit(v).alias(k) for k, v in shared.items() if v is not None]
    every = held.crossJoin(counts).crossJoin(summaries)  # a row each
    head = F.to_json(F.struct(F.lit(tag).alias("format"), *tops, "item_count", "reason_counts", F.size("cases").alias("case_count"), F.get("cases", F.lit(0)).case_id.alias("next_case_id")))
    listed = lambda c: F.array_join(F.transform(c, lambda e: e.x), ",")
    return every.select(F.concat(F.substr(head, F.lit(1), F.char_length(head) - 1), F.lit(',"case_summaries":['), listed("cases"), F.lit('],"items":['), listed("xs"), F.lit("]}")).alias("json"))
