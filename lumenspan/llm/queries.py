"""The registered queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import chat, fingerprints, languages, licenses, line_quality, mixing, near_simhash, periodic, pieces, repair, token_files, toxicity, warc


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in the folder ``LUMENSPAN_TOKENIZERS``, or where the installed package has it."""
    folder = os.environ.get("LUMENSPAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    records = chat.records_of(table(spark, sf_dir, "conversations"))
    one = spark.range(1).select(F.lit(-1).cast(records.schema["conv_id"].dataType).alias("conv_id"), F.lit(extra).alias("record"))
    out = chat.formatted(chat.canonical_turns(records.unionByName(one)))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.searched(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, machine, keep_text=False)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.transform("base", lambda x: x.label)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    at = F.transform("base", lambda x: x["at"])
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, F.transform("found", lambda x: x.label))).alias("labels"), score.alias("score"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    every = rows.groupBy("conv_id").agg(F.lit(0).cast("long").alias("_none"))
    found = repair.repairs(repair.damaged(rows)).withColumnRenamed("conv_id", "_id")
    held = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return held.select("conv_id", *[F.coalesce(c, "_none").alias(c) for c in repair.COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(said, F.lit("")), 256).alias("repaired_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic(periodic.looped(table(spark, sf_dir, "documents")), keep=("doc_id",))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = periodic.strongest(F.col("runs"))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.labelled(docs.select("doc_id", "text"), languages.fit(docs), keep=("doc_id",))
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").cast("long").alias("n_spans"))


# ---- stages of the corpus pipeline ----


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted to the labelled rows among these documents, doesn't call toxic.

    Null and empty texts score the bias alone, repeated rows keep a row each, null ids have no label; without labels or
    documents nothing is called toxic. The result has the columns of ``docs``, whatever their names.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, machine).where("tox_score < 0.5").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines over the limits.

    Null, empty and short texts fail the base rules and go; null sources are a host of their own; equal texts count once
    for a line. Repeated rows keep a row each; an empty table gives an empty one, with the columns of ``docs``.
    """
    return line_quality.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Links are those of SimHashes that differ in 4 or fewer bits, by the byte-position index, and of the texts that these
    leave apart all with a five-word shingle similarity of 0.8, as shortened and extended copies lie beyond the radius.
    Null and empty texts are one class; of rows that tie in id and text one stays, unlike texts under one id are
    documents of their own, and a null id is the smallest of none but itself. An empty table gives an empty one, with
    the columns of ``docs``.
    """
    return near_simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once, or a row for each time up to three.

    Null and empty texts have size 0 and null sources are a source of their own; documents whose hashes tie are taken
    together or not at all. An empty table gives an empty one, with the columns of ``docs``.
    """
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its ``doc_id``, ``lang`` and ``source``.

    Null and empty texts have no ids; repeated rows keep a row each; an empty table gives an empty one. Other columns
    are left out, so none can clash.
    """
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_simhash_near_dedup, op3_document_fingerprints, op4_quality_rules, op5_source_mixing, op6_sentencepiece, op7_toxicity, op8_license_scans, op9_warc, op10_token_files, op11_structure_repair, op12_periodic_runs, op13_language_id)}

WORDS = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op1_chat_formatting": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(5 + length(replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), '[', '%5B'), chr(10), '%0A'))
           + 5 + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\2\\\3', 'g'))) as bigint) as formatted_chars
from t group by conv_id""",
    "op4_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
c as (select r, cast(len(regexp_extract_all(t, '{WORDS}')) as bigint) as n_words,
             cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols from d),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
m as (select r, line, count(*) as times from l where regexp_matches(line, '{WORDS}') group by r, line),
dup as (select r, cast(sum(times - 1) as bigint) as n_dup_lines from m group by r),
w as (select r, unnest(range(len(ws))) as k, unnest(ws) as w from (select r, regexp_extract_all(t, '{WORDS}') as ws from d)),
x as (select r, k, [w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o] as five from w window o as (partition by r order by k)),
y as (select r, k, count(*) over (partition by r, five) as times from x where five[5] is not null),
rep as (select r, count(distinct k + i) as n_repeat_words from y, range(5) s(i) where times > 1 group by r),
host as (select source, greatest(50, 0.005 * count(*)) as most from d group by source),
norm as (select r, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line,
                sum(times * len(regexp_extract_all(line, '{WORDS}'))) as words from m group by 1, 2),
often as (select d.source, line from norm join d using (r) join host on d.source is not distinct from host.source
          group by d.source, line, most having count(distinct t) > most),
gone as (select r, sum(words) as words from norm join d using (r) join often on d.source is not distinct from often.source and norm.line = often.line group by r),
z as (select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed, n_words - coalesce(gone.words, 0) as rest
      from d join c using (r) left join dup using (r) left join rep using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 10 * rest >= 3 * n_words as kept from z""",
    "op5_source_mixing": rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as bigint) as size,
                  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as w, cast(3 * source_size as double) as cap from s),
l as (select *, (sum(cast(source_size as double)) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
                / sum(w) over (o rows between current row and unbounded following) as lv,
             row_number() over o as n from r window o as (order by cap / w, source nulls last)),
lam as (select lv from l where lv <= cap / w order by n limit 1),
g as (select source, source_size, least(cap, (select lv from lam) * w) as target from l),
h as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as turns from g),
b as (select source, k, sum(size) as n from d group by source, k),
c as (select b.*, coalesce(sum(n) over (partition by source order by k rows between unbounded preceding and 1 preceding), 0) as under from b),
e as (select c.source, c.k, case when under + n <= target - turns * source_size then true
             when under <= target - turns * source_size then target - turns * source_size - under > n / 2.0 else false end as once
      from c join h on c.source is not distinct from h.source)
select d.doc_id, d.size, h.source_size, h.target, d.size * (h.turns + case when e.once then 1 else 0 end) as taken
from d join h on d.source is not distinct from h.source join e on d.source is not distinct from e.source and d.k = e.k""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
m as (select payload_digest as d, max(page_id) as top from q where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
       case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from top then top end as refers_to
from q left join m on payload_digest = d""",
    "op11_structure_repair": r"""
with recursive keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hashed as (select *, xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda b: (ascii(substr(k, i, 1)) >> b) & 1))),
             lambda c, b: case when (c & 1) <> b then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint), 4294967295) % 20 as h from keyed),
hurt as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case when h = 3 then [0, 1] else [0] end) as copy from hashed where h <> 0),
ids as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
r as (select c, turn, role, text, left(role, 1) as x, row_number() over (partition by c order by turn nulls first, role, text) as i from hurt join ids on hurt.conv_id is not distinct from ids.conv_id),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
             when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault, lag(x) over (partition by c order by i) || x as pair from r),
g as (select *, fault in ('', 'truncated') as may, case when fault = 'truncated' then 3 else 0 end as more from f),
dp as (select c, 0::bigint as i, '000000000' as st, cast(null as varchar) as s, '000000003I' as u, '000000006II' as a from ids
  union all
  select c, i, st, s, least(u, printf('%09d', cast(left(least(st, s, a), 9) as int) + 3) || substr(least(st, s, a), 10) || 'I'),
    least(a, case when least(u, printf('%09d', cast(left(least(st, s, a), 9) as int) + 3) || substr(least(st, s, a), 10) || 'I') is not null then
      printf('%09d', cast(left(least(u, printf('%09d', cast(left(least(st, s, a), 9) as int) + 3) || substr(least(st, s, a), 10) || 'I'), 9) as int) + 3) || substr(least(u, printf('%09d', cast(left(least(st, s, a), 9) as int) + 3) || substr(least(st, s, a), 10) || 'I'), 10) || 'I' end)
  from (select dp.c, g.i,
      least(printf('%09d', cast(left(dp.st, 9) as int) + 4) || substr(dp.st, 10) || 'D', case when may and x = '' then printf('%09d', cast(left(dp.st, 9) as int) + more) || substr(dp.st, 10) || 'K' end) as st,
      least(printf('%09d', cast(left(dp.s, 9) as int) + 4) || substr(dp.s, 10) || 'D', case when may and x = '' then printf('%09d', cast(left(dp.s, 9) as int) + more) || substr(dp.s, 10) || 'K' end,
        case when may and x = 's' then printf('%09d', cast(left(dp.st, 9) as int) + more) || substr(dp.st, 10) || 'K' end) as s,
      least(printf('%09d', cast(left(dp.u, 9) as int) + 4) || substr(dp.u, 10) || 'D', case when may and x = '' then printf('%09d', cast(left(dp.u, 9) as int) + more) || substr(dp.u, 10) || 'K' end,
        case when may then printf('%09d', cast(left(least(dp.st, dp.s, dp.a), 9) as int) + more + case when x = 'u' then 0 else 3 end) || substr(least(dp.st, dp.s, dp.a), 10) || case when x = 'u' then 'K' else 'R' end end) as u,
      least(printf('%09d', cast(left(dp.a, 9) as int) + 4) || substr(dp.a, 10) || 'D', case when may and x = '' then printf('%09d', cast(left(dp.a, 9) as int) + more) || substr(dp.a, 10) || 'K' end,
        case when may then printf('%09d', cast(left(dp.u, 9) as int) + more + case when x = 'a' then 0 else 3 end) || substr(dp.u, 10) || case when x = 'a' then 'K' else 'R' end end) as a
    from dp join g on g.c = dp.c and g.i = dp.i + 1)),
best as (select c, least(st, a) as k from dp qualify i = max(i) over (partition by c)),
cut as (select c, cast(left(k, 9) as bigint) as cost, substr(k, 10) as audit from best),
letters as (select c, j, substr(audit, j, 1) as e, j - length(replace(left(audit, j), 'I', '')) as ins from (select *, unnest(range(1, length(audit) + 1)) as j from cut)),
made as (select l.c, j, e, role, text, x, row_number() over (partition by l.c order by j) - max(case when e = 'K' and x = 's' then 1 else 0 end) over (partition by l.c) as m
  from letters l left join g on g.c = l.c and g.i = l.j - l.ins and e <> 'I' where e <> 'D' and (e <> 'K' or x <> '')),
kept as (select c, j, case when e = 'K' then role when m % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, '') as line from made
  union all select l.c, j, role || ':' || text from letters l join g on g.c = l.c and g.i = l.j - l.ins where e = 'K' and x = ''),
told as (select c, string_agg(line, chr(10) order by j) as t from kept group by c),
n as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from f group by c)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  case when n.c is null then 0 else cost end as cost, case when n.c is null then '' else audit end as audit, sha256(coalesce(t, '')) as repaired_sha256
from ids left join cut on cut.c = ids.c left join told on told.c = ids.c left join n on n.c = ids.c""",
    "op12_periodic_runs": rf"""
with keyed as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws, cast(doc_id as varchar) as k from documents),
hashed as (select r, doc_id, ws, len(ws) as n, xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda b: (ascii(substr(k, i, 1)) >> b) & 1))),
             lambda c, b: case when (c & 1) <> b then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295::bigint), 4294967295) as h from keyed),
d as (select *, case when n > 0 and h % 10 = 0 then (h // 10) % n end as a, h // 10 % 8 as e from hashed),
one as (select r, n, unnest(ws) as w, unnest(range(len(ws))) as i, a, 1 + (n - a) // (3 + e) as p from d),
w as (select x.r, x.i, coalesce(y.w, x.w) as w from one x left join one y on y.r = x.r and x.i >= x.a and y.i = x.a + (x.i - x.a) % x.p),
g as (select r, i, case when i + 16 <= count(*) over (partition by r) then md5(array_to_string(list(w) over (partition by r order by i rows between current row and 15 following), ' ')) end as h from w),
often as (select r, h from g where h is not null group by r, h having count(*) > 1),
m as (select g.r, g.i, g.h from g join often using (r, h)),
pair as (select x.r, y.i - x.i as q, x.i from m x join m y on y.r = x.r and y.h = x.h and y.i > x.i),
island as (select r, q, i, i - row_number() over (partition by r, q order by i) as isl from pair),
stretch as (select r, q, min(i) as s, count(*) + 15 + q as len from island group by r, q, isl),
run as (select r, s, len, min(q) as q from stretch where len >= greatest(24, 3 * q) group by r, s, len),
top as (select * from run qualify row_number() over (partition by r order by len::hugeint * 1000000000000 // q desc, s, q) = 1),
said as (select r, count(*) as n_runs, string_agg(s::varchar || ',' || len::varchar || ',' || q::varchar || chr(10), '' order by s, q) as t from run group by r),
gone as (select distinct r, unnest(range(s + q, s + len)) as i from run),
kept as (select r, string_agg(w, ' ' order by i) as t from w where not exists (select 1 from gone where gone.r = w.r and gone.i = w.i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, s as start, len as length, q as period, 1000 * len // q as exponent_milli, sha256(coalesce(said.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from d left join top on top.r = d.r left join said on said.r = d.r left join kept on kept.r = d.r""",
}
