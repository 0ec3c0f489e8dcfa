"""Registered queries of the transcript operators, over the carrier views, and the DuckDB SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions import hooks, model_output
from lumenspan.functions import text as T
from lumenspan.operators import audit, cases, channels, comparison, coverage, effort, evaluate, gates, intervals, matching, packs, readiness
from lumenspan.plans import report
from lumenspan.scratch import folder
from lumenspan.sources import detections, documents, reviews, srt
from lumenspan.sources.carrier import DUCK, LETTERS, STAND_INS, carrier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PAIRS = DUCK + """, pairs as (select r.case_id, r.ord as ref_ord, r.id as ref_id, r.start_ms as rs, r.end_ms as re, r.channel as rc, r.text as rt, r.needs_review as rn,
  c.id as cand_id, c.ord as cand_ord, c.start_ms as cs, c.end_ms as ce, c.channel as cc, c.text as ct,
  regexp_replace(r.text, '[\\s\\p{Z}\\p{P}\\p{S}]', '', 'g') as rp, regexp_replace(c.text, '[\\s\\p{Z}\\p{P}\\p{S}]', '', 'g') as cp,
  least(r.end_ms, c.end_ms) - greatest(r.start_ms, c.start_ms) as ov from ref r join cand c on r.case_id = c.case_id and r.start_ms < c.end_ms and c.start_ms < r.end_ms
  qualify row_number() over (partition by r.case_id, r.ord order by least(r.end_ms, c.end_ms) - greatest(r.start_ms, c.start_ms) desc, c.ord) = 1)"""
GONE = ", gone as (select r.* from ref r where not exists (select 1 from cand c where r.case_id = c.case_id and r.start_ms < c.end_ms and c.start_ms < r.end_ms))"
MORE = ", more as (select c.* from cand c where not exists (select 1 from ref r where r.case_id = c.case_id and r.start_ms < c.end_ms and c.start_ms < r.end_ms))"
TIMING = """count(*) as paired_segments, sum(abs(rs - cs)) / count(*) as mean_start_error_ms, sum(abs(re - ce)) / count(*) as mean_end_error_ms,
  (sum(abs(rs - cs)) + sum(abs(re - ce))) / (2 * count(*)) as mean_boundary_error_ms, max(greatest(abs(rs - cs), abs(re - ce))) as max_boundary_error_ms,
  cast(sum((abs(rs - cs) <= 250)::int + (abs(re - ce) <= 250)::int) as bigint) as within_250ms_count, sum((abs(rs - cs) <= 250)::int + (abs(re - ce) <= 250)::int) / (2 * count(*)) as within_250ms_ratio,
  cast(sum((abs(rs - cs) <= 500)::int + (abs(re - ce) <= 500)::int) as bigint) as within_500ms_count, sum((abs(rs - cs) <= 500)::int + (abs(re - ce) <= 500)::int) / (2 * count(*)) as within_500ms_ratio"""
CHANNEL = """count(*) filter (rc in ('L','R') and cc in ('L','R')) as comparable_segments,
  case when count(*) filter (rc in ('L','R') and cc in ('L','R')) > 0 then count(*) filter (rc in ('L','R') and cc = rc) / count(*) filter (rc in ('L','R') and cc in ('L','R')) end as accuracy,
  count(*) filter (cc = 'MIX') as candidate_mix_segments, count(*) filter (cc = 'MIX') / count(*) as candidate_mix_ratio"""


@query(PAIRS + f" select case_id, {TIMING}, {CHANNEL} from pairs group by case_id")
def eval_time_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.best_overlap(*carrier(spark, sf_dir))
    return evaluate.timing(pairs, "case_id").join(evaluate.channel_accuracy(pairs, "case_id").drop("paired_segments"), "case_id")


@query(PAIRS + f" select {TIMING}, {CHANNEL} from pairs")
def eval_time_aligned_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.best_overlap(*carrier(spark, sf_dir))
    return evaluate.timing(pairs).join(evaluate.channel_accuracy(pairs), "paired_segments")


@query(DUCK + f""", x as (select *, row_number() over (partition by case_id order by ord) as pos from ref), y as (select *, row_number() over (partition by case_id order by ord) as pos from cand),
  pairs as (select x.case_id, x.start_ms as rs, x.end_ms as re, y.start_ms as cs, y.end_ms as ce from x join y using (case_id, pos)) select case_id, {TIMING} from pairs group by case_id""")
def eval_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.timing(matching.positional(*carrier(spark, sf_dir)), "case_id")


@query(DUCK + GONE + MORE + " select case_id, id, 'missing_reference' as kind from gone union all select case_id, id, 'extra_candidate' from more")
def eval_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    row = lambda df, kind: df.select("case_id", "id", F.lit(kind).alias("kind"))
    return row(matching.missing(ref, cand), "missing_reference").unionByName(row(matching.extra(ref, cand), "extra_candidate"))


@query(PAIRS + ", d as (select unnest(['L','R','MIX']) as c) select a.c as ref_channel, b.c as cand_channel, count(p.case_id) as n from d a cross join d b left join pairs p on p.rc = a.c and p.cc = b.c group by 1, 2")
def eval_channel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(matching.best_overlap(*carrier(spark, sf_dir)))


DISTANCE = f"levenshtein(translate({{0}}, '{LETTERS}', '{STAND_INS}'), translate({{1}}, '{LETTERS}', '{STAND_INS}'))"
CER = """, r as (select case_id, string_agg(regexp_replace(text, '\\s', '', 'g'), '' order by ord) as t from ref where text <> '' group by case_id),
  c as (select case_id, string_agg(regexp_replace(text, '\\s', '', 'g'), '' order by ord) as t from cand where text <> '' group by case_id),
  b as (select case_id, coalesce(r.t, '') as rt, coalesce(c.t, '') as ct from r full join c using (case_id)),
  e as (select case_id, cast(""" + DISTANCE.format("rt", "ct") + """ as bigint) as edit_distance, length(rt) as reference_characters, length(ct) as candidate_characters from b)"""


@query(DUCK + CER + " select *, case when reference_characters = 0 and candidate_characters = 0 then 0.0::double else edit_distance / greatest(1, reference_characters) end as cer from e")
def eval_cer_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_rates(*carrier(spark, sf_dir), normal=T.strict)


@query(DUCK + CER + """, s as (select cast(sum(edit_distance) as bigint) as edit_distance, cast(sum(reference_characters) as bigint) as reference_characters, cast(sum(candidate_characters) as bigint) as candidate_characters from e)
  select *, edit_distance / greatest(1, reference_characters) as cer from s""")
def eval_cer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rolled_error_rate(evaluate.error_rates(*carrier(spark, sf_dir), normal=T.strict))


PRACTICAL = r"[\s\p{Z}\p{P}\p{S}]"  # what the practical form drops; of compatibility forms the carrier has none, the tests hold those against Python


@query(DUCK + CER.replace("\\s", PRACTICAL) + " select *, case when reference_characters = 0 and candidate_characters = 0 then 0.0::double else edit_distance / greatest(1, reference_characters) end as cer from e")
def eval_cer_practical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_rates(*carrier(spark, sf_dir))


ITEMS = PAIRS + GONE + MORE + """, items as (
  select case_id, ref_id as reference_id, cand_id as candidate_id, least(rs, cs) as start_ms, greatest(re, ce) as end_ms,
    list_filter([case when rp <> cp then 'text' end, case when rc <> cc then 'channel' end, case when abs(rs - cs) > 500 or abs(re - ce) > 500 then 'timing' end], lambda x: x is not null) as reasons,
    case when rp <> cp then """ + DISTANCE.format("rp", "cp") + """ else 0 end as dist, greatest(abs(rs - cs), abs(re - ce)) as delta from pairs where rp <> cp or rc <> cc or abs(rs - cs) > 500 or abs(re - ce) > 500
  union all select case_id, id, null, start_ms, end_ms, ['missing_reference'], 0, 0 from gone
  union all select case_id, null, id, start_ms, end_ms, ['extra_candidate'], 0, 0 from more),
  scored as (select *, list_sum(list_transform(reasons, lambda x: case x when 'missing_reference' then 5000.0::double when 'extra_candidate' then 4000.0::double when 'text' then 3000.0::double when 'timing' then 2000.0::double else 1000.0::double end))
    + least(999.0::double, dist::double) + least(999.0::double, delta / 10.0::double) + least(99.0::double, greatest(0, end_ms - start_ms) / 1000.0::double) as priority_score from items),
  queue as (select *, row_number() over (order by priority_score desc, case_id, start_ms, end_ms, coalesce(reference_id, ''), coalesce(candidate_id, '')) as priority_rank from scored)"""


@query(ITEMS + " select case_id, reference_id, candidate_id, start_ms, end_ms, array_to_string(reasons, ',') as reasons, priority_score, priority_rank from queue")
def effort_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = effort.ranked(effort.items(*carrier(spark, sf_dir)))
    return queue.select("case_id", "reference_id", "candidate_id", "start_ms", "end_ms", F.array_join("reasons", ",").alias("reasons"), "priority_score", "priority_rank")


RATES = ", ".join(f"{a}_segments / greatest(1, reference_segments + extra_candidate_segments) as {a}_segment_ratio" for a in ("text_edit", "channel_edit", "timing_edit", "missing_reference", "extra_candidate"))
COUNTS = ", ".join(f"coalesce(n_{k}, 0) as {v}_segments" for k, v in (("text", "text_edit"), ("channel", "channel_edit"), ("timing", "timing_edit"), ("missing_reference", "missing_reference"), ("extra_candidate", "extra_candidate")))
HAS = ", ".join(f"count(*) filter (list_contains(reasons, '{k}')) as n_{k}" for k in ("text", "channel", "timing", "missing_reference", "extra_candidate"))


@query(ITEMS + f""", q as (select case_id, count(*) as n, {HAS} from items group by case_id), rr as (select case_id, count(*) as reference_segments from ref group by 1), cd as (select case_id, count(*) as candidate_segments from cand group by 1),
  z as (select case_id, coalesce(reference_segments, 0) as reference_segments, coalesce(candidate_segments, 0) as candidate_segments, {COUNTS}, coalesce(n, 0) as segments_needing_edit from rr full join cd using (case_id) left join q using (case_id))
  select *, segments_needing_edit / greatest(1, reference_segments + extra_candidate_segments) as segments_needing_edit_ratio, {RATES} from z""")
def effort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return effort.rollup(effort.edits(ref, cand))


SECOND = ITEMS.replace(DUCK, "").replace("pairs", "pairs2").replace("gone", "gone2").replace("more", "more2").replace(" items", " items2").replace(" scored", " scored2").replace(" queue", " queue2").replace("join cand c", "join cand2 c").replace("from cand c", "from cand2 c")


@query(ITEMS + SECOND + """, f as (select 'first' as label, case_id, reference_id, reasons from items where reference_id is not null union all select 'second', case_id, reference_id, reasons from items2 where reference_id is not null),
  g as (select label, case_id, reference_id, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') as reasons from f group by all)
  select r.case_id, r.id as reference_id, l.label, g.reasons is null as passed, coalesce(g.reasons, '') as reasons from ref r cross join (select unnest(['first', 'second']) as label) l left join g on g.label = l.label and g.case_id = r.case_id and g.reference_id = r.id""")
def effort_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    return effort.compared(ref, {"first": effort.items(ref, cand), "second": effort.items(ref, other)})


MERGED = ITEMS + SECOND + """, bo as (select 0 as q, case_id, reference_id, candidate_id, start_ms, end_ms, reasons, priority_score from queue union all select 1, case_id, reference_id, candidate_id, start_ms, end_ms, reasons, priority_score from queue2),
  u as (select case_id, reference_id, candidate_id, start_ms, end_ms, max(priority_score) as priority_score, count(*) as merged_input_count, list_concat(list(reasons order by q)[1], list_filter(coalesce(list(reasons order by q)[2], []), lambda x: not list_contains(list(reasons order by q)[1], x))) as reasons from bo group by case_id, reference_id, candidate_id, start_ms, end_ms),
  m as (select *, row_number() over (order by priority_score desc, case_id, start_ms, end_ms, coalesce(reference_id, ''), coalesce(candidate_id, '')) as priority_rank from u)"""


@query(MERGED + " select case_id, reference_id, candidate_id, start_ms, end_ms, array_to_string(reasons, ',') as reasons, priority_score, merged_input_count, priority_rank from m")
def effort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    merged = effort.merged(effort.items(ref, cand), effort.items(ref, other))
    return merged.select(*effort.MERGE_KEY, F.array_join("reasons", ",").alias("reasons"), "priority_score", "merged_input_count", "priority_rank")


@query(MERGED.replace("list_concat(list(reasons order by q)[1]", "list(q order by q) as qs, list_concat(list(reasons order by q)[1]") + """ select case_id, reference_id, candidate_id, start_ms, end_ms, array_to_string(reasons, ',') as reasons, priority_score, merged_input_count,
  array_to_string(list_transform(qs, lambda q: ['first', 'second'][q + 1]), ',') as source_reports, priority_rank from m""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queues written as files, read back item by item and merged with where their items came from."""
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    read = []
    for candidate in (cand, other):
        queue, path = effort.ranked(effort.items(ref, candidate)), folder(spark, "queue")
        reviews.write_lines(queue.withColumn("case_id", F.col("case_id").cast("string")), path)
        read.append(reviews.read(spark, path, lines=True).withColumn("case_id", F.col("case_id").cast("long")))
    merged = effort.merged(*read, names=["first", "second"])
    return merged.select(*effort.MERGE_KEY, F.array_join("reasons", ",").alias("reasons"), "priority_score", "merged_input_count", F.array_join("source_reports", ",").alias("source_reports"), "priority_rank")


@query(ITEMS + SECOND + """, f as (select 0 as place, case_id, reference_id, start_ms, end_ms, reasons from items where reference_id is not null union all select 1, case_id, reference_id, start_ms, end_ms, reasons from items2 where reference_id is not null),
  rs as (select case_id, reference_id, unnest(reasons) as reason from f), rc as (select case_id, reference_id, reason, count(*) as n from rs group by all),
  rm as (select case_id, reference_id, string_agg(reason || '=' || n, ',' order by reason) as reason_counts, cast(sum(n) as bigint) as total from rc group by all),
  g as (select case_id, reference_id, arg_min(start_ms, place) as start_ms, arg_min(end_ms, place) as end_ms, count(*) as failed_count, 2 - count(*) as passed_count from f group by all)
  select case_id, reference_id, start_ms, end_ms, failed_count, passed_count, reason_counts, row_number() over (order by failed_count desc, total desc, case_id, start_ms, reference_id) as rank from g join rm using (case_id, reference_id)""")
def effort_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return effort.issues(_two_queues(spark, sf_dir)).select("case_id", "reference_id", "start_ms", "end_ms", "failed_count", "passed_count", counts.alias("reason_counts"), "rank")


def _two_queues(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    return {"first": effort.items(ref, cand), "second": effort.items(ref, other)}


@query(ITEMS + SECOND + """, f as (select 'first' as label, * from items union all select 'second', * from items2)
  select label, count(*) filter (reference_id is not null) as reference_failures, count(*) filter (list_contains(reasons, 'missing_reference')) as missing_reference, count(*) filter (list_contains(reasons, 'text')) as text,
    count(*) filter (list_contains(reasons, 'timing')) as timing, count(*) filter (list_contains(reasons, 'channel')) as channel, count(*) filter (reference_id is null) as extra_candidate from f group by label""")
def effort_label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.label_totals(_two_queues(spark, sf_dir))


@query(ITEMS + """, rs as (select case_id, unnest(reasons) as reason from queue), rc as (select case_id, reason, count(*) as n from rs group by all), rm as (select case_id, string_agg(reason || '=' || n, ',' order by reason) as reason_counts from rc group by case_id),
  s as (select case_id, count(*) as item_count, min(priority_rank) as top_priority_rank from queue group by case_id)
  select case_id, item_count, top_priority_rank, reason_counts, row_number() over (order by top_priority_rank, case_id) as place from s join rm using (case_id)""")
def effort_case_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = effort.case_reason_counts(effort.ranked(effort.items(*carrier(spark, sf_dir))))
    counts = F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return held.select("case_id", "item_count", "top_priority_rank", counts.alias("reason_counts"), "place")


@query(ITEMS + """ select case_id, count(*) as item_count, cast(sum(greatest(0, end_ms - start_ms)) as bigint) as review_duration_ms, min(start_ms) as first_start_ms, max(end_ms) as last_end_ms,
  max(priority_score) as top_priority_score, min(priority_rank) as top_priority_rank from queue group by case_id""")
def effort_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.case_summaries(effort.ranked(effort.items(*carrier(spark, sf_dir))))


@query(ITEMS + " select reason, count(*) as n from (select unnest(reasons) as reason from items) group by reason")
def effort_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.reason_counts(effort.items(*carrier(spark, sf_dir)))


@query(ITEMS + """, d as (select case_id, max(end_ms) as dur from ref group by case_id)
  select q.case_id, q.reference_id, q.candidate_id, greatest(0, q.start_ms - 500) as clip_start_ms, least(d.dur, q.end_ms + 500) as clip_end_ms from queue q join d using (case_id)""")
def review_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    durations = ref.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms"))
    return effort.review_clips(effort.items(ref, cand), durations).select("case_id", "reference_id", "candidate_id", "clip_start_ms", "clip_end_ms")


UNION = """, {0}_m as (select *, case when start_ms > max(end_ms) over (partition by case_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 1 else 0 end as b from {0}),
  {0}_i as (select *, sum(b) over (partition by case_id order by start_ms, end_ms rows unbounded preceding) as isl from {0}_m), {0}_u as (select case_id, min(start_ms) as start_ms, max(end_ms) as end_ms from {0}_i group by case_id, isl)"""
SWEEP = """, ed as (select case_id, start_ms as t, 1 as da, 0 as db from ref union all select case_id, end_ms, -1, 0 from ref union all select case_id, start_ms, 0, 1 from cand union all select case_id, end_ms, 0, -1 from cand),
  st as (select case_id, t, sum(da) as da, sum(db) as db from ed group by case_id, t),
  sw as (select case_id, t as start_ms, lead(t) over (partition by case_id order by t) as end_ms, sum(da) over (partition by case_id order by t rows unbounded preceding) > 0 as in_a, sum(db) over (partition by case_id order by t rows unbounded preceding) > 0 as in_b from st)"""


@query(DUCK + UNION.format("ref") + " select case_id, start_ms, end_ms from ref_u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(carrier(spark, sf_dir)[0])


@query(DUCK + SWEEP + ", dif as (select case_id, start_ms, end_ms from sw where end_ms is not null and in_a and not in_b)" + UNION.format("dif") + " select case_id, start_ms, end_ms from dif_u")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.difference(*carrier(spark, sf_dir))


@query(DUCK + SWEEP + ", dif as (select case_id, start_ms, end_ms from sw where end_ms is not null and in_a and in_b)" + UNION.format("dif") + " select case_id, start_ms, end_ms from dif_u")
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersection(*carrier(spark, sf_dir))


@query(DUCK + SWEEP + ", dif as (select case_id, start_ms, end_ms from sw where end_ms is not null and in_a and not in_b)" + UNION.format("dif") + """, al as (select case_id, start_ms, end_ms from cand union all select case_id, start_ms, end_ms from dif_u where end_ms - start_ms >= 200)
  select *, row_number() over (partition by case_id order by start_ms, end_ms) - 1 as index from al""")
def interval_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return intervals.rescued(cand, ref, 200)


COVER = SWEEP + """, cv as (select case_id, cast(coalesce(sum(end_ms - start_ms) filter (in_a), 0) as bigint) as r, cast(coalesce(sum(end_ms - start_ms) filter (in_b), 0) as bigint) as d, cast(coalesce(sum(end_ms - start_ms) filter (in_a and in_b), 0) as bigint) as o from sw where end_ms is not null group by case_id),
  ck as (select case_id, count(*) as n, max(end_ms - start_ms) as mx, avg(end_ms - start_ms) as mean from cand group by case_id),
  rep as (select case_id, r as reference_speech_duration_ms, d as detected_speech_duration_ms, o as overlap_duration_ms, r - o as missed_reference_duration_ms, d - o as extra_detected_duration_ms, case when r > 0 then o / r end as reference_recall,
    case when d > 0 then o / d end as detected_precision, coalesce(n, 0) as detected_interval_count, mx as detected_max_interval_ms, mean as detected_mean_interval_ms from cv left join ck using (case_id))"""


@query(DUCK + COVER + " select * from rep")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(*carrier(spark, sf_dir))


@query(DUCK + COVER + """, s as (select count(*) as case_count, cast(sum(reference_speech_duration_ms) as bigint) as reference_speech_duration_ms, cast(sum(detected_speech_duration_ms) as bigint) as detected_speech_duration_ms, cast(sum(overlap_duration_ms) as bigint) as overlap_duration_ms,
  cast(sum(missed_reference_duration_ms) as bigint) as missed_reference_duration_ms, cast(sum(extra_detected_duration_ms) as bigint) as extra_detected_duration_ms, cast(sum(detected_interval_count) as bigint) as detected_interval_count, max(detected_max_interval_ms) as detected_max_interval_ms from rep)
  select *, detected_speech_duration_ms / detected_interval_count as detected_mean_interval_ms, overlap_duration_ms / reference_speech_duration_ms as reference_recall, overlap_duration_ms / detected_speech_duration_ms as detected_precision from s""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.suite(coverage.coverage(*carrier(spark, sf_dir)))


@query(DUCK + SWEEP + """, m as (select case_id || ' missed' as case_id, start_ms, end_ms from sw where end_ms is not null and in_a and not in_b union all select case_id || ' extra', start_ms, end_ms from sw where end_ms is not null and in_b and not in_a)""" + UNION.format("m") + """
  select cast(split_part(case_id, ' ', 1) as bigint) as case_id, split_part(case_id, ' ', 2) as kind, start_ms, end_ms from m_u""")
def coverage_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.fragments(*carrier(spark, sf_dir))


SEG = "case_id, ord, id, start_ms, end_ms, channel, kind, text, needs_review"


@query(DUCK + """, s as (select case_id, greatest(start_ms, 3000) - 3000 as start_ms, least(end_ms, 9000) - 3000 as end_ms, channel, kind, text, needs_review or start_ms < 3000 or end_ms > 9000 as needs_review from ref where end_ms > 3000 and start_ms < 9000),
  n as (select *, row_number() over (partition by case_id order by start_ms, end_ms, channel, text) as ord from s) select case_id, ord, concat('seg_', lpad(ord::varchar, 6, '0')) as id, start_ms, end_ms, channel, kind, text, needs_review from n""")
def slice_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.time_slice(carrier(spark, sf_dir)[0], 3000, 9000).select(*SEG.split(", "))


@query(DUCK + " select case_id, ord, x as start_ms, least(x + 1500, end_ms) as end_ms from (select *, unnest(range(start_ms, end_ms, 1500)) as x from ref)")
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_long(carrier(spark, sf_dir)[0].select("case_id", "ord", "start_ms", "end_ms"), 1500)


@query(DUCK + ", d as (select case_id, max(end_ms) as dur from ref group by case_id) select case_id, x as start_ms, least(x + 5000, dur) as end_ms, row_number() over (partition by case_id order by x) - 1 as index from (select *, unnest(range(0, dur, 5000)) as x from d)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fixed_chunks(carrier(spark, sf_dir)[0].groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")), 5000)


@query(DUCK + ", n as (select *, row_number() over (partition by case_id order by start_ms, end_ms, id) as o from cand) select case_id, o as ord, concat('seg_', lpad(o::varchar, 6, '0')) as id, start_ms, end_ms, channel, kind, text, false as needs_review from n")
def freeze_reid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.freeze(carrier(spark, sf_dir)[1]).select(*SEG.split(", "))


@query(DUCK + " select case_id, id, needs_review or trim(text) = '' or end_ms - start_ms > 3000 as needs_review from cand")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.review_flags(carrier(spark, sf_dir)[1], 3000).select("case_id", "id", "needs_review")


OVER = DUCK + """, op as (select a.case_id, a.id as left_id, b.id as right_id, greatest(a.start_ms, b.start_ms) as start_ms, least(a.end_ms, b.end_ms) as end_ms, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms,
  a.channel as left_channel, b.channel as right_channel, a.channel = b.channel as same_channel, a.start_ms = b.start_ms and a.end_ms = b.end_ms as exact_boundary
  from cand a join cand b on a.case_id = b.case_id and (a.start_ms, a.end_ms, a.id) < (b.start_ms, b.end_ms, b.id) and a.text <> '' and b.text <> '' and least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 100)"""


@query(OVER + " select * from op")
def audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap_pairs(carrier(spark, sf_dir)[1])


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cand = carrier(spark, sf_dir)
    return audit.audit(cand, cand.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")), long_ms=3000)


AUD = OVER + ", ct as (select case_id, start_ms, end_ms from cand where text <> '')" + UNION.format("ct") + """, b as (select case_id, count(*) as speech_segment_count, count(*) filter (needs_review) as review_count, count(*) filter (end_ms - start_ms >= 3000) as long_segment_count, max(end_ms - start_ms) as max_segment_duration_ms from cand where text <> '' group by case_id),
  pr as (select case_id, count(*) as overlap_pair_count, count(*) filter (same_channel) as same_channel_overlap_pair_count, count(*) filter (not same_channel) as cross_channel_overlap_pair_count, count(*) filter (exact_boundary) as exact_boundary_overlap_pair_count, count(*) filter (exact_boundary and same_channel) as exact_boundary_same_channel_overlap_pair_count, cast(sum(overlap_ms) as bigint) as pair_overlap_duration_ms from op group by case_id),
  un as (select case_id, cast(sum(end_ms - start_ms) as bigint) as speech_union_duration_ms from ct_u group by case_id), du as (select case_id, max(end_ms) as duration_ms from cand group by case_id),
  au as (select case_id, speech_segment_count, review_count, long_segment_count, max_segment_duration_ms, speech_union_duration_ms, coalesce(overlap_pair_count, 0) as overlap_pair_count, coalesce(same_channel_overlap_pair_count, 0) as same_channel_overlap_pair_count, coalesce(cross_channel_overlap_pair_count, 0) as cross_channel_overlap_pair_count,
    coalesce(exact_boundary_overlap_pair_count, 0) as exact_boundary_overlap_pair_count, coalesce(exact_boundary_same_channel_overlap_pair_count, 0) as exact_boundary_same_channel_overlap_pair_count, coalesce(pair_overlap_duration_ms, 0) as pair_overlap_duration_ms, duration_ms, speech_union_duration_ms / duration_ms as speech_coverage_ratio from b left join pr using (case_id) left join un using (case_id) left join du using (case_id))"""


@query(AUD + " select * from au")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


@query(AUD + """ select case_id, 'review_flag_segments' as flag, review_count as count from au where review_count > 0 union all select case_id, 'same_channel_overlap', same_channel_overlap_pair_count from au where same_channel_overlap_pair_count > 0
  union all select case_id, 'exact_boundary_overlap', exact_boundary_same_channel_overlap_pair_count from au where exact_boundary_same_channel_overlap_pair_count > 0 union all select case_id, 'long_segment', long_segment_count from au where long_segment_count > 0
  union all select case_id, 'near_full_speech_coverage', null from au where speech_coverage_ratio >= 0.95""")
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flags(_audited(spark, sf_dir))


@query(AUD + " select count(*) as case_count, " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("speech_segment_count", "review_count", "long_segment_count", "overlap_pair_count", "same_channel_overlap_pair_count", "cross_channel_overlap_pair_count", "exact_boundary_overlap_pair_count", "exact_boundary_same_channel_overlap_pair_count", "pair_overlap_duration_ms", "speech_union_duration_ms")) + ", case when count(*) = count(duration_ms) then cast(sum(duration_ms) as bigint) end as duration_ms from au")
def audit_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.suite(_audited(spark, sf_dir))


@query(OVER + """, q as (select case_id, id as reference_id, null as candidate_id, start_ms, end_ms, 'reference-needs-review' as reasons, 5000.0::double as w from cand where needs_review and text <> ''
  union all select case_id, id, null, start_ms, end_ms, 'reference-long-segment', 2000.0::double from cand where end_ms - start_ms >= 3000 and text <> ''
  union all select case_id, left_id, right_id, start_ms, end_ms, case when exact_boundary then 'reference-exact-boundary-overlap,' else '' end || 'reference-same-channel-overlap', case when exact_boundary then 4000.0::double else 0.0::double end + 3000.0::double from op where same_channel)
  select case_id, reference_id, candidate_id, start_ms, end_ms, reasons, w + least(99.0::double, greatest(0, end_ms - start_ms) / 1000.0::double) as priority_score from q""")
def audit_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.queue(carrier(spark, sf_dir)[1], long_ms=3000).withColumn("reasons", F.array_join("reasons", ","))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(DUCK + """, t as (select case_id, id, end_ms - start_ms as duration_ms, regexp_replace(text, '\\s', '', 'g') as n from cand where text <> ''),
  rp as (select distinct case_id, id from (select case_id, id, n, unnest(range(1, length(n) - 10)) as s from t where length(n) >= 12) cross join (values (1, 12), (2, 6), (3, 4), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3)) u(u, r) where s + u * r - 1 <= length(n) and substr(n, s, u * r) = repeat(substr(n, s, u), r))
  select t.case_id, t.id, duration_ms, length(n) as chars, n <> '' and not regexp_matches(n, '[{JA}]') as non_japanese_text, length(n) >= 8 and length(n) / greatest(0.001::double, greatest(0, duration_ms) / 1000.0::double) > 15.0 as high_text_density, rp.id is not null as repeated_text,
  (n <> '' and not regexp_matches(n, '[{JA}]')) or (length(n) >= 8 and length(n) / greatest(0.001::double, greatest(0, duration_ms) / 1000.0::double) > 15.0) or rp.id is not null as artifact from t left join rp on t.case_id = rp.case_id and t.id = rp.id""".replace("{JA}", T.JAPANESE))
def artifact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.artifacts(carrier(spark, sf_dir)[1], normal=T.strict)


@query("select doc_id, length(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]', '', 'g')) as chars, md5(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]', '', 'g')) as digest from documents")
def normalize_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = T.strict(F.coalesce("text", F.lit("")))
    return _documents(spark, sf_dir).select("doc_id", F.char_length(normal).cast("long").alias("chars"), F.md5(normal).alias("digest"))


@query()
def normalize_practical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility folding is beyond DuckDB; the tests hold it against Python."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.practical("text")).alias("practical"), F.md5(T.relaxed("text")).alias("relaxed"))


STAMP = "lpad(({0} // 3600000)::varchar, 2, '0') || ':' || lpad((({0} // 60000) % 60)::varchar, 2, '0') || ':' || lpad((({0} // 1000) % 60)::varchar, 2, '0') || ',' || lpad(({0} % 1000)::varchar, 3, '0')"


@query(DUCK + f""", n as (select *, row_number() over (partition by case_id order by start_ms, end_ms, id, text) as i from ref where text <> '')
  select case_id, string_agg(i::varchar || chr(10) || {STAMP.format('start_ms')} || ' --> ' || {STAMP.format('end_ms')} || chr(10) || text, chr(10) || chr(10) order by i) || chr(10) as content from n group by case_id""")
def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.formatted(carrier(spark, sf_dir)[0])


@query(DUCK + ", n as (select *, row_number() over (partition by case_id order by start_ms, end_ms, id) as i from ref where trim(text) <> '') select case_id, i as ord, start_ms, end_ms, 'MIX' as channel, trim(text) as text, null::varchar as problem from n")
def srt_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = carrier(spark, sf_dir)[0].where("trim(text) <> ''")
    return srt.parse(srt.formatted(spoken)).select("case_id", "ord", "start_ms", "end_ms", "channel", "text", "problem")


@query(DUCK + """, n as (select *, ord % 5 as k, row_number() over (partition by case_id order by ord) as i from ref where trim(text) <> '')
  select case_id, i as ord, case when k < 3 then start_ms end as start_ms, case when k < 3 then end_ms end as end_ms, case k when 1 then 'L' when 2 then 'R' else 'MIX' end as channel, trim(text) as text,
    case k when 3 then 'the timing line isn''t valid' when 4 then 'a cue must end after it starts' end as problem from n""")
def srt_parse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues without numbers, with labels, other line ends and points, without times, and that run backwards."""
    k, start, end = F.col("ord") % 5, srt.timestamp(F.col("start_ms")), srt.timestamp(F.col("end_ms"))
    arrow = lambda a, b: F.concat(a, F.lit(" --> "), b)
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    timing = F.when(k == 2, arrow(point(start), point(end))).when(k == 3, F.lit("soon")).when(k == 4, arrow(end, start)).otherwise(arrow(start, end))
    number = F.when(k == 0, F.lit("")).otherwise(F.concat((F.col("ord") + 1).cast("string"), F.lit("\n")))
    label = F.when(k == 1, F.lit("[L] ")).when(k == 2, F.lit("[SPEAKER_1][r]")).otherwise(F.lit(""))
    cue = F.concat(number, timing, F.when(k == 1, F.lit("\r\n")).otherwise(F.lit("\n")), label, F.col("text"))
    held = carrier(spark, sf_dir)[0].where("trim(text) <> ''").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", cue.alias("cue")))).alias("xs"))
    content = F.array_join(F.transform("xs", lambda x: x.cue), "\n\n")
    return srt.parse(held.select("case_id", content.alias("content"))).select("case_id", "ord", "start_ms", "end_ms", "channel", "text", "problem")


@query(DUCK + """ select case_id, id, 'missing' as rule from (select case_id, id from ref except select case_id, id from cand) union all select case_id, id, 'unknown' from (select case_id, id from cand except select case_id, id from ref)
  union all select case_id, id, 'repeated' from cand group by case_id, id having count(*) > 1""")
def translation_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return matching.bijection_errors(ref.select("case_id", "id"), cand.select("case_id", "id"))


@query(DUCK + " select r.case_id, r.id, coalesce(c.text, r.text) as text from ref r left join cand c using (case_id, id)")
def translation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    new = cand.select("case_id", "id", F.col("text").alias("new"))
    return ref.join(new, ["case_id", "id"], "left").select("case_id", "id", F.coalesce("new", "text").alias("text"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate metrics by case."""
    ref, cand = carrier(spark, sf_dir)
    pairs = matching.best_overlap(ref, cand)
    timing = evaluate.timing(pairs, "case_id").select("case_id", F.col("within_500ms_ratio").alias("time_aligned_500ms_ratio"))
    sides = evaluate.channel_accuracy(pairs, "case_id").select("case_id", F.col("accuracy").alias("channel_accuracy"), F.col("candidate_mix_ratio").alias("mix_ratio"))
    edits = effort.rollup(effort.edits(ref, cand)).select("case_id", F.col("segments_needing_edit_ratio").alias("edit_ratio"))
    rates = evaluate.error_rates(ref, cand).select("case_id", F.col("cer").alias("practical_cer"))
    review = cand.groupBy("case_id").agg((F.sum(F.col("needs_review").cast("long")) / F.count("*")).alias("review_ratio"))
    return rates.join(timing, "case_id", "left").join(sides, "case_id", "left").join(edits, "case_id", "left").join(review, "case_id", "left")


GATE = ITEMS + CER.replace("\\s", PRACTICAL).replace(", r as", ", rx as").replace(", c as", "").replace("\n  c as", "\n  cx as").replace("from r full join c", "from rx r full join cx c") + """, t as (select case_id, sum((abs(rs - cs) <= 500)::int + (abs(re - ce) <= 500)::int) / (2 * count(*)) as t5,
    case when count(*) filter (rc in ('L','R') and cc in ('L','R')) > 0 then count(*) filter (rc in ('L','R') and cc = rc) / count(*) filter (rc in ('L','R') and cc in ('L','R')) end as acc, count(*) filter (cc = 'MIX') / count(*) as mix from pairs group by case_id),
  ec as (select e.case_id, (select count(*) from items i where i.case_id = e.case_id) / greatest(1, (select count(*) from ref r where r.case_id = e.case_id) + (select count(*) from more m where m.case_id = e.case_id)) as edit from e),
  rv as (select case_id, count(*) filter (needs_review) / count(*) as rev from cand group by case_id),
  g as (select e.case_id, edit_distance / greatest(1, reference_characters) as cer, t5, acc, mix, edit, rev from e left join t using (case_id) left join ec using (case_id) left join rv using (case_id))"""


@query(GATE + """ select case_id, array_to_string(list_filter([
  case when cer > 0.1 then 'practical_cer fails max_practical_cer' end, case when t5 is null then 'time_aligned_500ms_ratio is unavailable' when t5 < 0.9 then 'time_aligned_500ms_ratio fails min_500ms_ratio' end,
  case when acc is null then 'channel_accuracy is unavailable' when acc < 0.85 then 'channel_accuracy fails min_channel_accuracy' end, case when mix is null then 'mix_ratio is unavailable' when mix > 0.5 then 'mix_ratio fails max_mix_ratio' end,
  case when edit > 0.15 then 'edit_ratio fails max_edit_ratio' end, case when rev is null then 'review_ratio is unavailable' when rev > 0 then 'review_ratio fails max_review_ratio' end], lambda x: x is not null), '; ') as failures from g""")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("case_id", F.array_join(evaluate.gate_failures(), "; ").alias("failures"))


@query(AUD + COVER + """, m as (select (select sum(review_count) from au) as rc, (select sum(same_channel_overlap_pair_count) from au) as sc, (select sum(exact_boundary_same_channel_overlap_pair_count) from au) as eb, (select sum(long_segment_count) from au) as lg, (select cast(sum(missed_reference_duration_ms) as bigint) from rep) as miss)
  select 'reference' as stage, 0 as place, case when rc + sc + eb + lg > 0 then 'fail' else 'pass' end as status, array_to_string(list_filter([case when rc > 0 then 'review flags remain: ' || rc end, case when sc > 0 then 'same-channel overlaps remain: ' || sc end,
    case when eb > 0 then 'exact-boundary overlaps remain: ' || eb end, case when lg > 0 then 'long segments remain: ' || lg end], lambda x: x is not null), '; ') as reasons from m
  union all select 'vad_chunking', 1, case when miss > 0 then 'fail' else 'pass' end, case when miss > 0 then 'reference speech is missed (ms): ' || miss else '' end from m
  union all select 'alignment', 2, 'unknown', '' union all select 'channel_attribution', 3, 'unknown', '' union all select 'text_asr', 4, 'unknown', ''""")
def readiness_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an audit and a coverage comparison given, and no evaluation."""
    found = coverage.ranked(coverage.suite(coverage.coverage(*carrier(spark, sf_dir))).withColumn("label", F.lit("suite")))
    rows = readiness.assembled(spark, audit=audit.suite(_audited(spark, sf_dir)), coverage=found)
    return rows.select("stage", "place", "status", F.array_join("reasons", "; ").alias("reasons"))


@query(DUCK + """, rc as (select case_id, count(*) as n, count(*) filter (needs_review) as k, cast(coalesce(sum(end_ms - start_ms) filter (needs_review), 0) as bigint) as ms, arg_min(id, ord) filter (needs_review) as first_review_id from ref group by case_id),
  cc as (select case_id, count(*) as n, count(*) filter (needs_review) as k from cand group by case_id)
  select rc.case_id, rc.n as reference_segments, rc.k as reference_review_count, rc.ms as reference_review_duration_ms, first_review_id, cc.n as candidate_segments, rc.case_id % 2 as missing_file_count,
    array_to_string(list_filter([case when rc.case_id % 2 = 1 then 'audio file is missing: ' || rc.case_id || '.wav' end, case when rc.n <> cc.n then 'reference has ' || rc.n || ' segments, the index ' || cc.n end,
      case when rc.k <> cc.k then 'reference has ' || rc.k || ' review_count, the index ' || cc.k end], lambda x: x is not null), '; ') as issues from rc left join cc using (case_id)""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that has the candidates' counts, and the audio of every second case alone, against the references."""
    ref, cand = carrier(spark, sf_dir)
    named = ref.select("case_id").distinct().join(cases.counts(cand).select("case_id", "segments", "review_count"), "case_id", "left")
    path = lambda ending: F.concat(F.col("case_id").cast("string"), F.lit(ending))
    index = named.select("*", path(".wav").alias("audio"), path(".srt").alias("reference"), F.lit(None).cast("string").alias("candidate"))
    files = index.select(F.col("reference").alias("path")).unionByName(index.where("case_id % 2 = 0").select(F.col("audio").alias("path")))
    found = cases.status(index, files, ref, cand)
    return found.select("case_id", "reference_segments", "reference_review_count", "reference_review_duration_ms", "first_review_id", "candidate_segments", "missing_file_count", F.array_join("issues", "; ").alias("issues"))


LEVELS = DUCK + """, lv as (select *, -20.0::double - (case_id * 7 + ord * 11) % 40 as l, -20.0::double - (case_id * 5 + ord * 13) % 40 as r from cand)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate segments with synthetic levels, as the test tables have no audio."""
    base = lambda a, b: F.lit(-20.0) - (F.col("case_id") * a + F.col("ord") * b) % 40
    return carrier(spark, sf_dir)[1].withColumn("left_dbfs", base(7, 11)).withColumn("right_dbfs", base(5, 13))


SIDE = "case when l - r >= {t} and ({q} is null or r <= {q}) then 'L' when r - l >= {t} and ({q} is null or l <= {q}) then 'R' else 'MIX' end"


@query(LEVELS + f", st as (select t, q, s from (values (2.0::double, null::double, 'th2_quietnone'), (2.0, -40.0, 'th2_quietm40'), (8.0, null, 'th8_quietnone'), (8.0, -40.0, 'th8_quietm40')) v(t, q, s)) select s as setting, {SIDE.format(t='t', q='q')} as channel, count(*) as n from lv cross join st group by 1, 2")
def sweep_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.swept(_levels(spark, sf_dir), [2.0, 8.0], [None, -40.0]).groupBy("setting", "channel").agg(F.count("*").alias("n"))


@query(LEVELS + f""", d as (select *, {SIDE.format(t='8.0', q='-40.0')} as side from lv) select case_id, id, channel as original_channel, case when channel = 'MIX' then side else channel end as channel,
  case when channel <> 'MIX' then 'skipped_existing_channel' when side = 'L' then 'left_dominant' when side = 'R' then 'right_dominant' when abs(l - r) < 8.0 then 'below_threshold' else 'quieter_side_active' end as reason from d""")
def channel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.attributed(_levels(spark, sf_dir)).select("case_id", "id", "original_channel", "channel", "reason")


@query(LEVELS + f""", d as (select case_id, id, channel, start_ms, end_ms, {SIDE.format(t='8.0', q='-40.0')} as side from lv where text <> '' and channel in ('L', 'R')),
  s as (select *, case when side = 'MIX' then 'uncertain' when side = channel then 'match' else 'mismatch' end as status from d)
  select case_id, id, status, case status when 'mismatch' then 3500.0::double else 2500.0::double end + greatest(0, end_ms - start_ms) / 1000.0::double as priority_score from s where status <> 'match'""")
def channel_reference_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.reference_queue(channels.reference_audit(_levels(spark, sf_dir))).select("case_id", "id", "status", "priority_score")


@query(LEVELS + f""", d as (select case_id, channel, {SIDE.format(t='8.0', q='-40.0')} as side from lv where text <> ''),
  s as (select case_id, case when side = 'MIX' and channel = 'MIX' then 'mix_match' when side = 'MIX' then 'over_attribution' when side = channel then 'match' when channel = 'MIX' then 'missed_attribution' else 'wrong_side' end as status from d),
  n as (select case_id, count(*) as segments, count(*) filter (status = 'match') as m, count(*) filter (status = 'missed_attribution') as mi, count(*) filter (status = 'wrong_side') as w, count(*) filter (status = 'mix_match') as mm, count(*) filter (status = 'over_attribution') as oa from s group by case_id)
  select case_id, segments, m + mi + w as energy_labeled_count, case when m + mi + w > 0 then m / (m + mi + w) end as match_ratio, case when m + mi + w > 0 then mi / (m + mi + w) end as mix_ratio, case when m + mi + w > 0 then w / (m + mi + w) end as wrong_side_ratio, case when mm + oa > 0 then oa / (mm + oa) end as over_attribution_ratio from n""")
def channel_candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = channels.summary(channels.candidate_audit(_levels(spark, sf_dir)), "case_id")
    return out.select("case_id", "segments", "energy_labeled_count", "match_ratio", "mix_ratio", "wrong_side_ratio", "over_attribution_ratio")


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in time order as windows of 100 ms."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("case_id"), at.cast("long").alias("at"), F.col("value").alias("level"))


SIGNAL = "with e as (select user_id as case_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value as level from events)"


@query(SIGNAL + """, d as (select case_id, count(*) * 100 as dur from e group by case_id), on_ as (select case_id, pos * 100 as start_ms, pos * 100 + 100 as end_ms from e where level >= 100),
  b as (select *, case when start_ms - lag(end_ms) over (partition by case_id order by start_ms) > 200 then 1 else 0 end as b from on_), i as (select *, sum(b) over (partition by case_id order by start_ms rows unbounded preceding) as isl from b),
  m as (select case_id, min(start_ms) as s, max(end_ms) as e from i group by case_id, isl having max(end_ms) - min(start_ms) >= 200),
  p as (select case_id, greatest(0, s - 50) as start_ms, least(dur, e + 50) as end_ms from m join d using (case_id) union all select case_id, 0, dur from d where case_id not in (select case_id from m))
  select *, row_number() over (partition by case_id order by start_ms, end_ms) - 1 as index from p""")
def energy_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _signal(spark, sf_dir)
    windows = frames.select("case_id", (F.col("at") * 100).alias("start_ms"), (F.col("at") * 100 + 100).alias("end_ms"), "level")
    durations = frames.groupBy("case_id").agg((F.count("*") * 100).alias("duration_ms"))
    return channels.energy_intervals(windows, durations, 100.0, 200, 200, 50)


@query()
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine; the tests hold it against a plain loop."""
    frames = _signal(spark, sf_dir).select("case_id", "at", F.least(F.lit(1.0), F.col("level") / 200.0).alias("p"))
    return channels.hysteresis(frames, min_speech_ms=40, min_silence_ms=40)


# ---- case sets, packs, reports ----

REASONED = f""", q as (select case_id, count(*) as n, {HAS} from items group by case_id), rr as (select case_id, count(*) as reference_segments from ref group by 1), cd as (select case_id, count(*) as candidate_segments from cand group by 1),
  z as (select case_id, coalesce(reference_segments, 0) as reference_segments, coalesce(candidate_segments, 0) as candidate_segments, {COUNTS}, coalesce(n, 0) as segments_needing_edit from rr full join cd using (case_id) left join q using (case_id))"""
TOP = "case when greatest({0}) > 0 then case greatest({0}) " + " ".join(f"when {a}_segments then '{k}'" for k, a in (("text", "text_edit"), ("channel", "channel_edit"), ("timing", "timing_edit"), ("missing_reference", "missing_reference"), ("extra_candidate", "extra_candidate"))) + " end end"
FIVE = "text_edit_segments, channel_edit_segments, timing_edit_segments, missing_reference_segments, extra_candidate_segments"


@query(ITEMS + REASONED + f" select case_id, {TOP.format(FIVE)} as dominant_reason, case when greatest({FIVE}) > 0 then greatest({FIVE}) / greatest(1, reference_segments + extra_candidate_segments) end as dominant_ratio from z")
def comparison_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return comparison.with_reasons(effort.rollup(effort.edits(ref, cand))).select("case_id", "dominant_reason", "dominant_ratio")


SUITE = ["case_count", "practical_edit_distance", "practical_reference_characters", "practical_cer", "aligned_paired_segments", "aligned_mean_boundary_error_ms", "aligned_within_500ms_ratio", "aligned_channel_accuracy", "aligned_channel_candidate_mix_ratio", "reference_segments", "candidate_segments", "segments_needing_edit", "segments_needing_edit_ratio", "text_edit_segments", "extra_candidate_segments", "dominant_reason", "candidate_review_count", "candidate_review_ratio"]
RX = CER.replace(", r as", ", rx as").replace("\n  c as", "\n  cx as").replace("from r full join c", "from rx r full join cx c").replace("\\s", PRACTICAL)


@query(ITEMS + RX + REASONED + f""", s1 as (select count(*) as case_count, cast(sum(edit_distance) as bigint) as practical_edit_distance, cast(sum(reference_characters) as bigint) as practical_reference_characters, sum(edit_distance) / greatest(1, sum(reference_characters)) as practical_cer from e),
  s2 as (select {TIMING}, {CHANNEL} from pairs), s3 as (select cast(sum(reference_segments) as bigint) as reference_segments, cast(sum(candidate_segments) as bigint) as candidate_segments, cast(sum(segments_needing_edit) as bigint) as segments_needing_edit, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in FIVE.split(", "))} from z),
  s4 as (select count(*) filter (needs_review) as candidate_review_count, count(*) filter (needs_review) / greatest(1, count(*) filter (text <> '')) as candidate_review_ratio from cand)
  select case_count, practical_edit_distance, practical_reference_characters, practical_cer, paired_segments as aligned_paired_segments, mean_boundary_error_ms as aligned_mean_boundary_error_ms, within_500ms_ratio as aligned_within_500ms_ratio, accuracy as aligned_channel_accuracy, candidate_mix_ratio as aligned_channel_candidate_mix_ratio,
    reference_segments, candidate_segments, segments_needing_edit, segments_needing_edit / greatest(1, reference_segments + extra_candidate_segments) as segments_needing_edit_ratio, text_edit_segments, extra_candidate_segments, {TOP.format(FIVE)} as dominant_reason, candidate_review_count, candidate_review_ratio from s1, s2, s3, s4""")
def eval_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.suite(*carrier(spark, sf_dir)).select(*SUITE)


def _mode(name: str, dropped: str) -> str:
    """Error rates of one text form by case, in SQL."""
    text = "string_agg(regexp_replace(text, '" + dropped + "', '', 'g'), '' order by ord)"
    return f""", {name}_r as (select case_id, {text} as t from ref where text <> '' group by case_id), {name}_c as (select case_id, {text} as t from cand where text <> '' group by case_id),
  {name}_b as (select case_id, coalesce(r.t, '') as rt, coalesce(c.t, '') as ct from {name}_r r full join {name}_c c using (case_id)),
  {name} as (select case_id, cast({DISTANCE.format("rt", "ct")} as bigint) as {name}_edit_distance, length(rt) as {name}_reference_characters, length(ct) as {name}_candidate_characters,
    case when rt = '' and ct = '' then 0.0::double else {DISTANCE.format("rt", "ct")} / greatest(1, length(rt)) end as {name}_cer from {name}_b)"""


FORMS = {"strict": "\\s", "practical": PRACTICAL, "relaxed": PRACTICAL[:-1] + T.RELAXED + "]"}
PAIRED = ["paired_segments", "mean_start_error_ms", "mean_end_error_ms", "mean_boundary_error_ms", "max_boundary_error_ms", "within_250ms_count", "within_250ms_ratio", "within_500ms_count", "within_500ms_ratio"]
SIDED = ["comparable_segments", "accuracy", "candidate_mix_segments", "candidate_mix_ratio"]


def _paired(prefix: str, table: str) -> str:
    """Columns of a table of pairs' metrics; counts and shares of no pairs are 0."""
    known = lambda c: f"coalesce({table}.{c}, 0)" if c.endswith(("_count", "_segments")) or c == "candidate_mix_ratio" else f"{table}.{c}"
    return ", ".join([*[f"{known(c)} as {prefix}_{c}" for c in PAIRED], *[f"{known(c)} as {prefix}_channel_{c}" for c in SIDED]])


REPORT = ITEMS + "".join(_mode(m, p) for m, p in FORMS.items()) + REASONED + f""", al as (select case_id, {TIMING}, {CHANNEL} from pairs group by case_id),
  px as (select *, row_number() over (partition by case_id order by ord) as pos from ref where text <> ''), py as (select *, row_number() over (partition by case_id order by ord) as pos from cand where text <> ''),
  pp as (select px.case_id, px.start_ms as rs, px.end_ms as re, px.channel as rc, py.start_ms as cs, py.end_ms as ce, py.channel as cc from px join py using (case_id, pos)),
  po as (select case_id, {TIMING}, {CHANNEL} from pp group by case_id),
  art as (select case_id, end_ms - start_ms as ms, regexp_replace(text, '{PRACTICAL}', '', 'g') as n from cand where text <> ''),
  af as (select case_id, n <> '' and not regexp_matches(n, '[{T.JAPANESE}]') as nj, length(n) >= 8 and length(n) / greatest(0.001::double, greatest(0, ms) / 1000.0::double) > 15.0 as dn,
    len(list_filter([(1, 12), (2, 6), (3, 4), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3)], lambda u: len(list_filter(range(1, length(n) - u[1] * u[2] + 2), lambda i: substr(n, i, u[1] * u[2]) = repeat(substr(n, i, u[1]), u[2]))) > 0)) > 0 as rp from art),
  aa as (select case_id, count(*) filter (nj or dn or rp) as a0, count(*) filter (nj) as a1, count(*) filter (dn) as a2, count(*) filter (rp) as a3 from af group by case_id),
  rv as (select case_id, count(*) filter (needs_review) as k, count(*) as n from cand group by case_id)
  select case_id, {", ".join(f"{m}_{c}" for m in FORMS for c in ("edit_distance", "reference_characters", "candidate_characters", "cer"))}, {_paired("aligned", "al")}, {_paired("positional", "po")},
    reference_segments, candidate_segments, {FIVE}, segments_needing_edit, segments_needing_edit / greatest(1, reference_segments + extra_candidate_segments) as segments_needing_edit_ratio, {RATES},
    {", ".join(f"coalesce(a{k}, 0) as asr_{n}_segments, coalesce(a{k}, 0) / greatest(1, candidate_segments) as asr_{n}_segment_ratio" for k, n in enumerate(report.ARTIFACTS))},
    coalesce(rv.k, 0) as candidate_review_count, coalesce(rv.k, 0) / greatest(1, coalesce(rv.n, 0)) as candidate_review_ratio, case when reference_segments > 0 then coalesce(al.paired_segments, 0) / reference_segments end as reference_match_ratio,
    {TOP.format(FIVE)} as dominant_reason, case when greatest({FIVE}) > 0 then greatest({FIVE}) / greatest(1, reference_segments + extra_candidate_segments) end as dominant_ratio
  from z {" ".join(f"left join {t} using (case_id)" for t in (*FORMS, "al", "po", "aa", "rv"))}"""


@query(REPORT)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families by case."""
    return report.evaluated(*carrier(spark, sf_dir)).drop("reason_ranking")


ATTRIBUTED = f"case when cc = 'MIX' then {SIDE.format(t='t', q='q')} else cc end as nc"
SWEPT = PAIRS + GONE + MORE + LEVELS.removeprefix(DUCK) + RX + f""", st as (select * from (values (2.0::double, null::double, 'th2_quietnone'), (2.0, -40.0, 'th2_quietm40'), (8.0, null, 'th8_quietnone'), (8.0, -40.0, 'th8_quietm40')) v(t, q, s)),
  f as (select s, p.*, {ATTRIBUTED} from pairs p join lv on lv.case_id = p.case_id and lv.ord = p.cand_ord cross join st),
  a as (select s, count(*) as n, count(*) filter (rc in ('L','R') and nc in ('L','R')) as both_sided, count(*) filter (rc in ('L','R') and nc = rc) as correct, count(*) filter (nc = 'MIX') as mixed, count(*) filter (rc <> nc) as channel_edits,
    sum((abs(rs - cs) <= 500)::int + (abs(re - ce) <= 500)::int) / (2 * count(*)) as t5, count(*) filter (rp <> cp or rc <> nc or abs(rs - cs) > 500 or abs(re - ce) > 500) as edits from f group by s),
  o as (select (select count(*) from ref) as refs, (select count(*) from gone) as gone, (select count(*) from more) as more, (select sum(edit_distance) / greatest(1, sum(reference_characters)) from e) as cer, (select count(*) filter (needs_review) / greatest(1, count(*)) from cand) as rev),
  m as (select s, count(*) as total_segments, count(*) filter (nc <> cc) as changed_segments from (select s, cc, {ATTRIBUTED} from (select channel as cc, l, r from lv) cross join st) group by s),
  z as (select s as setting, total_segments, changed_segments, channel_edits as channel_edit_segments, edits + gone + more as segments_needing_edit, (edits + gone + more) / greatest(1, refs + more) as edit_ratio, cer as practical_cer, t5 as time_aligned_500ms_ratio,
    case when both_sided > 0 then correct / both_sided end as channel_accuracy, mixed / n as mix_ratio, rev from a join m using (s) cross join o)
  select setting, total_segments, changed_segments, channel_edit_segments, segments_needing_edit, edit_ratio, practical_cer, channel_accuracy, mix_ratio,
    row_number() over (order by edit_ratio, practical_cer, time_aligned_500ms_ratio desc, coalesce(channel_accuracy, -1) desc, setting) as rank,
    array_to_string(list_filter([case when practical_cer > 0.1 then 'practical_cer fails max_practical_cer' end, case when time_aligned_500ms_ratio < 0.9 then 'time_aligned_500ms_ratio fails min_500ms_ratio' end,
      case when channel_accuracy is null then 'channel_accuracy is unavailable' when channel_accuracy < 0.85 then 'channel_accuracy fails min_channel_accuracy' end, case when mix_ratio > 0.5 then 'mix_ratio fails max_mix_ratio' end,
      case when edit_ratio > 0.15 then 'edit_ratio fails max_edit_ratio' end, case when rev > 0 then 'review_ratio fails max_review_ratio' end], lambda x: x is not null), '; ') as failures from z"""


@query(SWEPT)
def sweep_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates under four settings of attribution, evaluated, ranked and held against the product's limits."""
    rows = report.channel_sweep(carrier(spark, sf_dir)[0], _levels(spark, sf_dir), [2.0, 8.0], [None, -40.0])
    held = report.gated(rows, evaluate.PRODUCT_GATE)
    return held.select("setting", "total_segments", "changed_segments", "channel_edit_segments", "segments_needing_edit", "edit_ratio", "practical_cer", "channel_accuracy", "mix_ratio", "rank", F.array_join("gate_failures", "; ").alias("failures"))


@query(DUCK + """, p as (select distinct case_id, k, k * 2500 as lo, k * 2500 + 4000 as hi from ref cross join (select unnest([0, 1]) as k)),
  s as (select p.case_id::varchar || '-' || k::varchar as case_id, greatest(start_ms, lo) - lo as start_ms, least(end_ms, hi) - lo as end_ms, channel, text, needs_review or start_ms < lo or end_ms > hi as needs_review from cand c join p using (case_id) where end_ms > lo and start_ms < hi),
  n as (select *, row_number() over (partition by case_id order by start_ms, end_ms, channel, text) as ord from s) select case_id, concat('seg_', lpad(ord::varchar, 6, '0')) as id, start_ms, end_ms, channel, text, needs_review from n""")
def case_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of each source, of 4 s, 2.5 s apart."""
    ref, cand = carrier(spark, sf_dir)
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    plan = ref.select("case_id").distinct().select("case_id", k).select(F.concat_ws("-", "case_id", "k").alias("case_id"), F.col("case_id").alias("source_id"), (F.col("k") * 2500).cast("long").alias("start_ms"), (F.col("k") * 2500 + 4000).cast("long").alias("end_ms"))
    return cases.sliced(cand, plan).select("case_id", "id", "start_ms", "end_ms", "channel", "text", "needs_review")


PACK = """, d as (select case_id, max(end_ms) as dur from ref group by case_id), pk as (select q.*, greatest(0, q.start_ms - 500) as clip_start_ms, least(d.dur, q.end_ms + 500) as clip_end_ms,
  lpad(priority_rank::varchar, 6, '0') || '__' || q.case_id::varchar || '__' || reasons[1] || '__' || coalesce(reference_id, 'no-ref') || '__' || coalesce(candidate_id, 'no-cand') || '.wav' as clip_file from queue q join d using (case_id))"""


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return packs.review_pack(effort.ranked(effort.items(ref, cand)), ref.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")))


@query(ITEMS + PACK + " select case_id, priority_rank, clip_start_ms, clip_end_ms, clip_file from pk")
def review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).select("case_id", "priority_rank", "clip_start_ms", "clip_end_ms", "clip_file")


@query(ITEMS + PACK + """ select count(*) as clip_count, cast(sum(end_ms - start_ms) as bigint) as source_item_duration_ms_sum, cast(sum(end_ms - start_ms) as bigint) as effective_item_duration_ms_sum,
  cast(sum(clip_end_ms - clip_start_ms) as bigint) as clip_duration_ms_sum, max(clip_end_ms - clip_start_ms) as clip_duration_ms_max, 0::bigint as focus_item_count from pk""")
def review_pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.duration_summary(_pack(spark, sf_dir))


@query(DUCK + " select case_id, id as reference_id, (end_ms - start_ms)::double as priority_score, row_number() over (order by case_id, ord) as priority_rank from cand where needs_review")
def review_flagged_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.flagged_queue(carrier(spark, sf_dir)[1]).select("case_id", "reference_id", "priority_score", "priority_rank")


@query(DUCK + """ select case_id, ord, id, coalesce((select arg_max(x.id, x.ord) from cand x where x.case_id = c.case_id and x.needs_review and x.ord < c.ord), (select arg_max(x.id, x.ord) from cand x where x.case_id = c.case_id and x.needs_review and x.ord > c.ord)) as previous_review_id,
  coalesce((select arg_min(x.id, x.ord) from cand x where x.case_id = c.case_id and x.needs_review and x.ord > c.ord), (select arg_min(x.id, x.ord) from cand x where x.case_id = c.case_id and x.needs_review and x.ord < c.ord)) as next_review_id from cand c""")
def review_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.neighbours(carrier(spark, sf_dir)[1])


@query(DUCK + COVER + """ select case_id, array_to_string(list_filter([case when detected_max_interval_ms > 4000 then 'detected_max_interval_ms is over 4000' end, case when missed_reference_duration_ms > 500 then 'missed_reference_duration_ms is over 500' end,
  case when reference_recall is null then 'reference_recall is unavailable' when reference_recall < 0.9 then 'reference_recall is under 0.9' end, case when detected_precision is null then 'detected_precision is unavailable' when detected_precision < 0.9 then 'detected_precision is under 0.9' end], lambda x: x is not null), '; ') as failures from rep""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = gates.coverage_gate(coverage.coverage(*carrier(spark, sf_dir)), 4000, 500, 0.9, 0.9)
    return held.select("case_id", F.array_join("gate_failures", "; ").alias("failures"))


@query(DUCK + """ select case_id, 'the plan lacks the case' as rule from (select distinct case_id from ref except select distinct case_id from cand)
  union all select case_id, 'the index lacks the case' from (select distinct case_id from cand except select distinct case_id from ref)""")
def case_attach_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cand = carrier(spark, sf_dir)
    return cases.attach_errors(ref.select("case_id").distinct(), cand.select("case_id").distinct())


MOVED = DUCK + """, m as (select r.case_id, abs(c.start_ms - r.start_ms) as s, abs(c.end_ms - r.end_ms) as e, r.needs_review <> c.needs_review as f from ref r join cand c using (case_id, id)),
  al as (select case_id, count(*) as segments, count(*) * 2 as boundary_count, sum(s + e) as total, max(greatest(s, e)) as max_delta_ms, sum((s <= 250)::int + (e <= 250)::int) as w, count(*) filter (s > 0 or e > 0) as changed, count(*) filter (f) as review_flag_changes from m group by case_id)"""


@query(MOVED + " select case_id, segments, boundary_count, total / boundary_count as mean_delta_ms, max_delta_ms, cast(w as bigint) as within_250ms, changed, review_flag_changes from al")
def alignment_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameterless look at how candidates' bounds differ from those of references with the same ids."""
    return hooks.alignment_diagnostics(*carrier(spark, sf_dir)).select("case_id", "segments", "boundary_count", "mean_delta_ms", "max_delta_ms", "within_250ms", "changed", "review_flag_changes")


@query(MOVED + " select cast(sum(segments) as bigint) as segments, cast(sum(boundary_count) as bigint) as boundary_count, sum(total) / sum(boundary_count) as mean_delta_ms, max(max_delta_ms) as max_delta_ms, sum(w) / sum(boundary_count) as within_250ms_ratio from al")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.alignment_summary(hooks.alignment_diagnostics(*carrier(spark, sf_dir))).select("segments", "boundary_count", "mean_delta_ms", "max_delta_ms", "within_250ms_ratio")


@query(LEVELS + f""", d as (select channel as o, {SIDE.format(t='8.0', q='-40.0')} as side, l, r from lv), x as (select o, case when o = 'MIX' then side else o end as c, case when o <> 'MIX' then 'skipped_existing_channel' when side = 'L' then 'left_dominant' when side = 'R' then 'right_dominant' when abs(l - r) < 8.0 then 'below_threshold' else 'quieter_side_active' end as reason from d)
  select 'reason' as field, reason as value, count(*) as n from x group by 2 union all select 'original_channel', o, count(*) from x group by 2 union all select 'attributed_channel', c, count(*) from x group by 2""")
def channel_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.histograms(channels.attributed(_levels(spark, sf_dir)))


@query(DUCK + " select case_id, row_number() over (partition by case_id order by ord) as ord, start_ms, end_ms, channel, kind, text, needs_review, null::varchar as problem from ref")
def model_output_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a model's fenced JSON, read back."""
    item = F.struct("start_ms", "end_ms", "channel", "kind", "text", "needs_review")
    held = carrier(spark, sf_dir)[0].groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("s")))), lambda x: x.s).alias("segments"))
    content = F.concat(F.lit("```json\n"), F.to_json(F.struct("segments")), F.lit("\n```"))
    return model_output.model_segments(held.select("case_id", content.alias("content"))).drop("id")


@query(LEVELS + f""", d as (select case_id, channel, {SIDE.format(t='8.0', q='-40.0')} as side from lv where text <> '' and channel in ('L', 'R')),
  n as (select case_id, count(*) as segments, count(*) filter (side = channel) as match, count(*) filter (side <> channel and side <> 'MIX') as mismatch, count(*) filter (side = 'MIX') as uncertain from d group by case_id)
  select *, match + mismatch as energy_labeled_count, case when match + mismatch > 0 then match / (match + mismatch) end as match_ratio from n""")
def channel_reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.summary(channels.reference_audit(_levels(spark, sf_dir)), "case_id")
    return found.select("case_id", "segments", "match", "mismatch", "uncertain", "energy_labeled_count", "match_ratio")


@query(DUCK + """, l as (select unnest(['first', 'second']) as label), dt as (select 'first' as label, case_id, start_ms, end_ms from cand union all select 'second', case_id, start_ms, end_ms from cand2),
  ev as (select label, case_id, start_ms as t, 1 as da, 0 as db from ref cross join l union all select label, case_id, end_ms, -1, 0 from ref cross join l union all select label, case_id, start_ms, 0, 1 from dt union all select label, case_id, end_ms, 0, -1 from dt),
  es as (select label, case_id, t, sum(da) as da, sum(db) as db from ev group by all),
  sw as (select label, case_id, t as a, lead(t) over (partition by label, case_id order by t) as b, sum(da) over (partition by label, case_id order by t rows unbounded preceding) > 0 as ia, sum(db) over (partition by label, case_id order by t rows unbounded preceding) > 0 as ib from es),
  k as (select *, case when ia and not ib then 'missed' when ib and not ia then 'extra' end as kind from sw where b is not null),
  g as (select *, lag(kind) over (partition by label, case_id order by a) as kind_before, coalesce(lag(ia) over (partition by label, case_id order by a), false) as ia_before from k),
  s as (select label, count(distinct case_id) as case_count, cast(coalesce(sum(b - a) filter (ia), 0) as bigint) as r, cast(coalesce(sum(b - a) filter (ib), 0) as bigint) as d, cast(coalesce(sum(b - a) filter (ia and ib), 0) as bigint) as o,
    count(*) filter (kind = 'missed' and kind_before is distinct from kind) as missed_reference_interval_count, count(*) filter (kind = 'extra' and kind_before is distinct from kind) as extra_detected_interval_count, count(*) filter (ia and not ia_before) as reference_interval_count from g group by label),
  c as (select label, count(*) as detected_interval_count, max(end_ms - start_ms) as detected_max_interval_ms from dt group by label),
  z as (select label, case_count, r as reference_speech_duration_ms, d as detected_speech_duration_ms, o as overlap_duration_ms, r - o as missed_reference_duration_ms, d - o as extra_detected_duration_ms, detected_interval_count, detected_max_interval_ms, d / detected_interval_count as detected_mean_interval_ms,
    o / r as reference_recall, o / d as detected_precision, missed_reference_interval_count, extra_detected_interval_count, reference_interval_count, (select count(*) from ref) as reference_segment_count, (select cast(sum(ms) as bigint) from (select max(end_ms) as ms from ref group by case_id)) as audio_duration_ms from s join c using (label))
  select *, row_number() over (order by missed_reference_duration_ms, extra_detected_duration_ms, reference_recall desc, detected_precision desc, label) as rank from z""")
def coverage_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates' segments as detected intervals, side by side and ranked."""
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    return coverage.compared(ref, ref.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")), {"first": cand, "second": other})


RX2 = RX.replace("rx", "rx2").replace("cx", "cx2").replace("from cand where", "from cand2 where").replace("\n  b as", "\n  b2 as").replace("from b)", "from b2)").replace("\n  e as", "\n  e2 as")


def _suite_row(label: str, n: str) -> str:
    """Gated metrics of one candidate's suite, in SQL."""
    return f"""select '{label}' as label, (select sum(edit_distance) / greatest(1, sum(reference_characters)) from e{n}) as practical_cer, (select count(*) from items{n}) / greatest(1, (select count(*) from ref) + (select count(*) from more{n})) as edit_ratio,
      sum((abs(rs - cs) <= 500)::int + (abs(re - ce) <= 500)::int) / (2 * count(*)) as time_aligned_500ms_ratio, count(*) filter (rc in ('L','R') and cc = rc) / count(*) filter (rc in ('L','R') and cc in ('L','R')) as channel_accuracy, count(*) filter (cc = 'MIX') / count(*) as mix_ratio,
      (select count(*) filter (needs_review) / greatest(1, count(*)) from cand{n}) as review_ratio from pairs{n}"""


@query(ITEMS + SECOND + RX + RX2 + f""", u as ({_suite_row("first", "")} union all {_suite_row("second", "2")})
  select *, row_number() over (order by edit_ratio, practical_cer, time_aligned_500ms_ratio desc, channel_accuracy desc, label) as rank from u""")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates' suites, ranked."""
    (ref, cand), (_, other) = carrier(spark, sf_dir), carrier(spark, sf_dir, second=True)
    return report.compared({"first": report.suite(ref, cand), "second": report.suite(ref, other)}).select("label", *report.GATED, "rank")


@query(DUCK + " select case_id::varchar as case_id, row_number() over (partition by case_id order by ord) - 1 as ord, id, start_ms, end_ms, channel, kind, text, needs_review from ref")
def master_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as master documents, read back."""
    ref = carrier(spark, sf_dir)[0].withColumn("case_id", F.col("case_id").cast("string"))
    heads = ref.groupBy("case_id").agg(F.max("end_ms").alias("duration_ms")).withColumn("source_language", F.lit("ja"))
    return documents.parse_masters(documents.master_json(ref, heads, "lumenspan-master-v1").select("case_id", F.col("json").alias("value")))


@query(DUCK + """, r as (select case_id, ord, start_ms, end_ms, max(end_ms) over (partition by case_id order by ord rows between unbounded preceding and 1 preceding) as before, (select max(end_ms) - 500 from ref x where x.case_id = c.case_id) as dur from cand c)
  select case_id::varchar as case_id, 'interval is empty, unsorted or overlaps' as rule, count(*) as n from r where end_ms <= start_ms or start_ms < before group by case_id union all select case_id::varchar, 'an interval ends after the audio', count(*) from r where end_ms > dur group by case_id""")
def detection_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as a detector's intervals, of audio half a second shorter than the references."""
    ref, cand = carrier(spark, sf_dir)
    text = F.col("case_id").cast("string").alias("case_id")
    heads = ref.groupBy(text).agg((F.max("end_ms") - 500).alias("duration_ms"))
    return detections.problems(cand.select(text, F.col("ord").alias("index"), "start_ms", "end_ms"), heads).groupBy("case_id", "rule").agg(F.count("*").alias("n"))
