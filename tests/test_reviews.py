"""Queues of review items as files, merges with their sources, issues by reference, global ranks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import effort, ranking
from lumenspan.sources import reviews


def document(tmp_path, name, items, **tops):
    path = tmp_path / name
    path.write_text(json.dumps({"format": "t", "items": items, **tops}))
    return str(path)


def item(**x):
    return {"case_id": "c", "reference_id": "r1", "candidate_id": None, "start_ms": 0, "end_ms": 10, "reasons": ["text"]} | x


def test_merge_keeps_sources_reasons_and_first_values(spark, tmp_path):
    a = document(tmp_path, "a.json", [item(priority_score=1, reference_text="", note=None, more={"x": [1]}), item(reference_id="r2", reasons=["channel"], priority_score=7.5)])
    b = document(tmp_path, "b.json", [item(priority_score=3, reasons=["timing", "text", "timing"], reference_text="said", note="n", more=2), item(start_ms=None, end_ms=None, case_id=None, reference_id=None)])
    c = document(tmp_path, "c.json", [item(reasons=["channel"], note="later"), item(case_id=None, reference_id=None, start_ms=True, end_ms="4", reasons=["text", "x"])])
    got = {(r.case_id, r.reference_id): r for r in effort.merged(*[reviews.read(spark, p) for p in (a, b, c)], names=["a", "b", "c"]).collect()}
    one = got["c", "r1"]
    assert (one.reasons, one.priority_score, one.merged_input_count, one.source_reports) == (["text", "timing", "channel"], 3.0, 3, ["a", "b", "c"])
    assert (one.reference_text, one.candidate_text, one.other) == ("said", None, {"note": '"n"', "more": '{"x":[1]}'})
    none = got[None, None]  # times that aren't integers count as missing, and null keys are equal
    assert (none.reasons, none.merged_input_count, none.source_reports, none.priority_score) == (["text", "x"], 2, ["b", "c"], 0.0)
    assert {k: r.priority_rank for k, r in got.items()} == {("c", "r2"): 1, ("c", "r1"): 2, (None, None): 3}
    assert got["c", "r2"].source_reports == ["a"]


def test_empty_values_of_other_fields(spark, tmp_path):
    a = document(tmp_path, "a.json", [item(x="", y=None), item(x=None, y="")])
    assert effort.merged(reviews.read(spark, a)).first().other == {"x": "null", "y": '""'}


@pytest.mark.parametrize(("items", "rule"), [("none", "no array"), ([3], "an object"), ([item(reasons=[])], "reasons"), ([item(reasons=["a", 1])], "reasons"), ([item(reasons="text")], "reasons"), ([item(priority_score="9")], "score"), ([item(priority_score=True)], "score"), ([item(), {}], "item 1: reasons")])
def test_items_that_cannot_be_merged(spark, tmp_path, items, rule):
    with pytest.raises(ValueError, match=rule):
        reviews.read(spark, document(tmp_path, "bad.json", items))


def test_case_indexes_agree(spark, tmp_path):
    a, b = document(tmp_path, "a.json", [item()], source_case_index="i.json"), document(tmp_path, "b.json", [item()])
    assert reviews.case_index(spark, [a, b]) == "i.json" and reviews.case_index(spark, [b]) is None
    for paths in ([a, document(tmp_path, "c.json", [item()], source_case_index="j.json")], [document(tmp_path, "d.json", [item()], source_case_index="")], [document(tmp_path, "e.json", [item()], source_case_index=3)]):
        with pytest.raises(ValueError, match="case.index"):
            reviews.case_index(spark, paths)


def test_a_written_queue_reads_back(spark, tmp_path):
    queue = effort.merged(reviews.read(spark, document(tmp_path, "a.json", [item(case_id=c, reference_id=f"r{k}", priority_score=k % 3, note=k, **{'a "b"': [k]}) for k in range(30) for c in ("x", "y")])), names=["a"])
    reviews.write_lines(queue, str(tmp_path / "lines"))
    again = reviews.read(spark, str(tmp_path / "lines"), lines=True)
    key = ["case_id", "reference_id", "priority_score", "reasons"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, queue.select(*key).collect()))
    made = json.loads(reviews.document(queue, "t", source_case_index="i").first()["json"])
    assert (made["item_count"], made["reason_counts"], made["case_count"], made["next_case_id"], made["source_case_index"]) == (60, {"text": 60}, 2, "x", "i")
    assert all(x['a "b"'] == [x["note"]] for x in made["items"]) and next(iter(again.first().other)) in ("note", 'a "b"')
    assert [x["priority_rank"] for x in made["items"]] == list(range(1, 61)) and made["case_summaries"][1]["reason_counts"] == {"text": 30}


def test_issues_and_totals(spark):
    schema = "case_id string, reference_id string, start_ms long, end_ms long, reasons array<string>, reference_channel string"
    a = spark.createDataFrame([("c", "r1", 0, 5, ["text", "timing"], "L"), ("c", "r2", 9, 8, ["text"], "R"), ("c", None, 1, 2, ["extra_candidate"], None)], schema)
    b = spark.createDataFrame([("c", "r1", 1, 6, ["text"], "R"), (None, "r1", None, None, ["channel"], None)], schema)
    rows = effort.issues({"a": a, "b": b, "none": a.limit(0)}).orderBy("rank").collect()
    assert [(r.case_id, r.reference_id, r.failed_count, r.passed_count, r.failed_labels, r.reason_counts, r.start_ms, r.duration_ms, r.reference_channel) for r in rows] == [
        ("c", "r1", 2, 1, ["a", "b"], {"text": 2, "timing": 1}, 0, 5, "L"),
        (None, "r1", 1, 2, ["b"], {"channel": 1}, None, None, None),
        ("c", "r2", 1, 2, ["a"], {"text": 1}, 9, 0, "R"),
    ]
    totals = {r.label: (r.reference_failures, r.text, r.timing, r.channel, r.missing_reference, r.extra_candidate) for r in effort.label_totals({"a": a, "b": b, "none": a.limit(0)}).collect()}
    assert totals == {"a": (2, 2, 1, 0, 0, 1), "b": (2, 1, 0, 1, 0, 0), "none": (0, 0, 0, 0, 0, 0)}
    assert effort.repeated_references({"a": a.union(a.where("reference_id = 'r2'"))}).collect()[0].label == "a"


def test_numbers_over_many_ranges_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7).withColumn("n", F.lit(0))
    got = ranking.numbered(df, [F.col("a").desc_nulls_last(), F.col("b")], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(r.n for r in got) == list(range(1, 501)) and [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want
    assert ranking.numbered(df.limit(0), [F.col("a")], "n").count() == 0


def test_lines_are_parsed_once(spark, tmp_path):
    """What was checked is what is merged, also if the file goes."""
    path = str(tmp_path / "queue")
    spark.createDataFrame([('{"case_id": "a", "reasons": ["text"], "priority_score": 1.5}',)], "value string").write.text(path)
    rows = reviews.read(spark, path, lines=True)
    spark.createDataFrame([('{"case_id": "b", "reasons": ["text"]}',)], "value string").write.mode("overwrite").text(path)
    assert [(r.case_id, r.priority_score) for r in rows.collect()] == [("a", 1.5)]
