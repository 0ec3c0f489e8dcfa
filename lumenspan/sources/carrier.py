"""Reference and candidate transcripts made from the ``conversations`` table: a conversation is a case, a turn a segment.

Texts are ASCII, four of seven with a Japanese phrase before them. The SQL runs unchanged in Spark and DuckDB.
"""

from __future__ import annotations

# What is said before some turns, in turn; in few letters, so that each has an ASCII stand-in in SQL.
PHRASES = ("これはテストです。", "そうですか、はい！", "音声テスト〜", "ーれー、です")
#: DuckDB's edit distance is of bytes: letters of the phrases, and control characters for them.
LETTERS = "".join(sorted(set("".join(PHRASES))))
STAND_INS = "".join(map(chr, [*range(1, 9), *range(14, 28)]))[: len(LETTERS)]

from pyspark.sql import DataFrame, SparkSession


def carrier_sql(conversations: str = "conversations", drop: int = 7, mix: int = 5, cut: int = 4, names: tuple[str, str] = ("ref", "cand")) -> str:
    """Common table expressions for a reference and a candidate: one turn in ``drop`` is left out, one in ``mix`` loses
    its channel, one in ``cut`` its first two characters; every third case has a trailing extra segment."""
    ref, cand = names
    return f"""
{cand}_seg0 as (select conv_id as case_id, turn, role, text, 400 + (length(text) % 97) * 40 as dur from {conversations}),
{cand}_seg1 as (select case_id, turn, role, text, dur, coalesce(sum(dur - 150) over (partition by case_id order by turn
  rows between unbounded preceding and 1 preceding), 0) as off from {cand}_seg0),
{ref} as (select case_id, turn as ord, concat('seg_', lpad(cast(turn + 1 as varchar(10)), 6, '0')) as id,
  cast(off as bigint) as start_ms, cast(off + dur as bigint) as end_ms,
  case role when 'user' then 'L' when 'assistant' then 'R' else 'MIX' end as channel, 'speech' as kind,
  concat(case (case_id * 5 + turn) % 7 {"".join(f"when {n} then '{p}' " for n, p in enumerate(PHRASES))}else '' end, regexp_replace(text, '[^ -~]', '', 'g')) as text, ((case_id + turn) % 9 = 0) as needs_review from {cand}_seg1),
{cand}_moved as (select case_id, ord, id, greatest(0, start_ms + (case_id * 13 + ord * {drop}) % 1400 - 700) as s,
  end_ms - start_ms as dur, channel, text, needs_review from {ref} where (case_id + ord) % {drop} <> 0),
{cand}_tail as (select case_id, max(ord) as ord, max(end_ms) as last_ms from {ref} group by case_id),
{cand} as (select case_id, ord, id, s as start_ms, s + dur as end_ms,
  case when (case_id + ord) % {mix} = 0 then 'MIX' else channel end as channel, 'speech' as kind,
  case when (case_id * 3 + ord) % {cut} = 0 then substr(text, 3) else text end as text, needs_review from {cand}_moved
  union all
  select case_id, ord + 1, concat('seg_', lpad(cast(ord + 2 as varchar(10)), 6, '0')), last_ms + 1000, last_ms + 1600,
  'MIX', 'speech', 'noise', true from {cand}_tail where case_id % 3 = 0)"""


#: DuckDB: reference, candidate, and a second candidate with other moduli.
DUCK = f"with {carrier_sql()}, {carrier_sql(drop=5, mix=3, cut=3, names=('ref2', 'cand2'))}"


def carrier(spark: SparkSession, sf_dir: str, second: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reference and candidate segments of a data folder (``second``: the other candidate)."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    moduli = {"drop": 5, "mix": 3, "cut": 3} if second else {}
    sql = carrier_sql("{conversations}", **moduli).replace(", 'g')", ")")
    return tuple(spark.sql(f"with {sql} select * from {name}", conversations=conversations) for name in ("ref", "cand"))
