"""Manifests of cases: evaluation manifests, slice plans, case indexes, attach plans.

Each is a JSON object with a ``format`` tag and an array of cases. Readers give a row a case, with paths resolved
against the file's folder, and raise on what isn't valid; other keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind → its array's key, the key of a case's id, required and optional strings, required and optional integers, paths.
KINDS: dict[str, tuple[str, str, tuple, tuple, tuple, tuple, tuple]] = {
    "eval": ("cases", "id", ("reference", "candidate"), ("candidate_id", "reference_type", "reference_notes"), (), (), ("reference", "candidate")),
    "slices": ("cases", "id", ("audio", "reference"), ("candidate", "candidate_id"), ("start_ms", "end_ms"), (), ("audio", "reference", "candidate")),
    "index": ("items", "id", ("audio", "reference"), ("candidate", "candidate_id", "reference_type", "reference_notes"), (), ("segments", "review_count", "start_ms", "end_ms", "duration_ms"), ("audio", "reference", "candidate")),
    "attach": ("candidates", "case_id", ("candidate",), ("candidate_id",), (), (), ("candidate",)),
}
#: Strings of the whole file that stand in for a case's own.
SHARED = {"eval": ("reference_type", "reference_notes"), "slices": ("reference_type", "reference_notes"), "index": ("reference_type", "reference_notes"), "attach": ("candidate_id",)}


def resolved(folder: Column, path: Column) -> Column:
    """A path that isn't absolute (and has no scheme) is one of the file's folder."""
    absolute = path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/")
    return F.when(absolute, path).otherwise(F.concat(folder, F.lit("/"), path))


def _checked(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows with ``rule``: null where the case is valid. A file that isn't valid as a whole is one row."""
    array, key, strings, more, numbers, maybe, _ = KINDS[kind]
    named = [(key, "string"), *((c, "string") for c in strings + more), *((c, "long") for c in numbers + maybe)]
    item = f"array<struct<{', '.join(f'{c}: variant' for c, _ in named)}>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.try_parse_json("value").alias("v"))
    held = files.withColumn("xs", F.try_variant_get("v", f"$.{array}", item)).withColumn("tag", F.try_variant_get("v", "$.format", "string"))
    whole = F.when(F.col("v").isNull(), F.lit("the file isn't JSON")).when(F.col("tag").isNull() | (F.col("tag") == ""), F.lit("the file has no format tag")).when(F.coalesce(F.size("xs"), F.lit(0)) < 1, F.lit(f"{array} must be an array with entries"))
    rows = held.withColumn("whole", whole).select("folder", "tag", "v", "whole", F.posexplode_outer("xs").alias("place", "x"))
    kind_of = lambda c: F.schema_of_variant(F.col(f"x.{c}"))
    absent = lambda c: F.col(f"x.{c}").isNull() | F.coalesce(kind_of(c) == "VOID", F.lit(False))
    text = lambda c: F.try_variant_get(F.col(f"x.{c}"), "$", "string")
    rule = F.col("whole")
    for c in (key, *strings):
        rule = F.coalesce(rule, F.when(absent(c) | (kind_of(c) != "STRING") | (text(c) == ""), F.lit(f"{c} must be a string with characters")))
    for c in more:
        rule = F.coalesce(rule, F.when(~absent(c) & ((kind_of(c) != "STRING") | (text(c) == "")), F.lit(f"{c} must be a string with characters")))
    for c in numbers:
        rule = F.coalesce(rule, F.when(absent(c) | (kind_of(c) != "BIGINT"), F.lit(f"{c} must be an integer")))
    for c in maybe:
        rule = F.coalesce(rule, F.when(~absent(c) & (kind_of(c) != "BIGINT"), F.lit(f"{c} must be an integer")))
    columns = [F.when(~absent(c), F.try_variant_get(F.col(f"x.{c}"), "$", t)).alias("case_id" if c == key else c) for c, t in named]
    shared = [F.try_variant_get("v", f"$.{c}", "string").alias(f"_{c}") for c in SHARED[kind]]
    out = rows.select("folder", "tag", F.col("place").cast("long").alias("place"), *columns, *shared, rule.alias("rule"))
    if kind == "slices":
        out = out.withColumn("rule", F.coalesce("rule", F.when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), F.lit("the slice is empty")), F.when(F.col("candidate_id").isNotNull() & F.col("candidate").isNull(), F.lit("candidate_id needs a candidate")), F.when(F.col("case_id").rlike("/") | F.col("case_id").isin(".", ".."), F.lit("the case id must be a bare file name"))))
    return out


def problems(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``case_id, rule``: what isn't valid in manifests of a kind (``eval``, ``slices``, ``index``, ``attach``)."""
    rows = _checked(spark, path, kind)
    repeated = rows.where("rule is null").groupBy("case_id").count().where("count > 1").select("case_id", F.lit("the case id is repeated").alias("rule"))
    return rows.where("rule is not null").select("case_id", "rule").unionByName(repeated)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of a manifest in its order (``place``); raises on the first problem. A case's own values win over the file's."""
    first = problems(spark, path, kind).limit(1).collect()
    if first:
        raise ValueError(f"{path}: case {first[0]['case_id']}: {first[0]['rule']}")
    rows = _checked(spark, path, kind)
    _, _, _, _, _, _, paths = KINDS[kind]
    for c in paths:
        rows = rows.withColumn(c, resolved(F.col("folder"), F.col(c)))
    for c in SHARED[kind]:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}")).drop(f"_{c}")
    return rows.drop("folder", "rule")


def document(rows: DataFrame, kind: str, tag: str, **shared: str | None) -> DataFrame:
    """``json``: one manifest of a kind from rows of cases (with ``place`` if their order matters); nulls are left out.

    A manifest is one document: its cases, small rows, become one value.
    """
    array, key, strings, more, numbers, maybe, _ = KINDS[kind]
    fields = [F.col("case_id").cast("string").alias(key), *[F.col(c) for c in strings + more + numbers + maybe if c in rows.columns]]
    place = F.col("place") if "place" in rows.columns else F.col("case_id")
    held = rows.agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*fields).alias("x")))).alias("xs"))
    tops = [F.lit(v).alias(k) for k, v in shared.items() if v is not None]
    return held.select(F.to_json(F.struct(F.lit(tag).alias("format"), *tops, F.transform("xs", lambda e: e.x).alias(array))).alias("json"))
