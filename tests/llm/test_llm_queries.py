"""Registered queries against SQL or brute force on the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import compare
from test_llm_cases import brute_licenses

from lumenspan.llm import queries as q


def docs_of(spark, data):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_its_sql(name, spark, data, duck):
    compare(q.QUERIES[name](spark, data), duck, q.ORACLE[name])


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op2(spark, data):
    docs = docs_of(spark, data)
    fps = {d: brute_simhash(t) for d, t in docs}
    component = {d: d for d, _ in docs}
    changed = True
    while changed:
        changed = False
        for a in fps:
            least = min(component[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4)
            if least < component[a]:
                component[a], changed = least, True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op2_simhash_near_dedup(spark, data).collect()}
    assert got == {d: (f"{fps[d]:016x}", component[d]) for d in fps}


def brute_votes(text):
    """Words and neighbouring pairs vote on each bit with 16 + 16 log2(frequency), rounded."""
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    terms = Counter(words + [a + b" " + b for a, b in itertools.pairwise(words)])
    votes = [0] * 64
    for t, n in terms.items():
        h, w = xxhash.xxh64_intdigest(t), round(16 + 16 * math.log2(n))
        for b in range(64):
            votes[b] += w if h >> b & 1 else -w
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_op3(spark, data):
    docs = docs_of(spark, data)
    got = {r.doc_id: r for r in q.op3_document_fingerprints(spark, data).collect()}
    assert len(got) == len(docs)
    fp = {d: int(got[d].fingerprint, 16) for d, _ in docs}
    for k, (d, t) in enumerate(docs):
        following, after = docs[(k + 1) % len(docs)][::-1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        if len(t) < 3000:
            assert fp[d] == brute_votes(t) and int(r.edited_fingerprint, 16) == brute_votes(new)
        assert r.near_next == 1 - (fp[d] ^ fp[after]).bit_count() / 64
        assert r.near_edited == 1 - (fp[d] ^ int(r.edited_fingerprint, 16)).bit_count() / 64
        if d % 50 == 0:
            assert r.n_near == sum((fp[d] ^ x).bit_count() <= 3 for x in fp.values())
        else:
            assert r.n_near is None
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    again = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(again)


def test_op4(spark, data):
    got = {r.doc_id: r for r in q.op4_quality_rules(spark, data).collect()}
    for d, t in docs_of(spark, data):
        if len(t) < 6000:
            r, want = got[d], brute_quality(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_op6(spark, data):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in q.op6_sentencepiece(spark, data).collect()}
    for d, t in docs_of(spark, data):
        ids = model.encode(t)
        assert (got[d].n_tokens, got[d].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[d].parity and got[d].round_trip


def test_op7(spark, data):
    rows = q.op7_toxicity(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    toxic = [r for r in rows if labels.get(r.doc_id)]
    assert np.mean([r.predicted for r in toxic]) > 0.6 and all(not r.predicted for r in rows if labels.get(r.doc_id) == 0)


def test_op7_scores_equal_the_formula_and_held_out_rows(spark):
    """Scores recomputed pair by pair; accuracy on held-out rows alone, of a larger table."""
    from lumenspan.llm import toxicity

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    machine = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = dict(docs.collect())
    held = []
    for r in toxicity.scores(docs, machine, keep_text=False).collect():
        at = sorted({machine.at[p] for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()) for p in toxicity.places(w) if p in machine.at})
        if len(at) < 60:
            z = machine.bias + sum(float(machine.w[i]) for i in at) + sum(float(machine.v[i] @ machine.v[j]) for i, j in itertools.combinations(at, 2))
            assert r.tox_score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-4)
        if toxicity.crc_held_out(r.doc_id) and r.doc_id in labels:
            held.append((r.tox_score >= 0.5, labels[r.doc_id] > 0))
    assert len(held) > 50 and sum(a and b for a, b in held) >= 0.5 * sum(b for _, b in held) and sum(a and not b for a, b in held) <= 0.03 * len(held)


def test_op8(spark, data):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in q.op8_license_scans(spark, data).collect()}
    for d, t in docs_of(spark, data):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        if len(words) < 1500:
            whole = brute_licenses([w.encode() for w in words])
            assert set(r.labels.split(",")) - {""} == {x for _, x in at} | whole.keys()
            assert r.score == (1.0 if at else max(whole.values(), default=0.0))


def test_op10(spark, data):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    got = {r.doc_id: r for r in q.op10_token_files(spark, data).collect()}
    start = 0
    for d, t in docs_of(spark, data):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline(spark, data):
    """Each stage against what it may do with its input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    from lumenspan.llm.common import written

    kept = []
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, data), "t")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= (kept[-2] if len(kept) > 1 else set(seen)), name
    toxic, quality, near, mixed, encoded = kept
    assert len(clean - toxic) <= 0.05 * len(clean)
    verdicts = {r.doc_id: r.kept for r in q.op4_quality_rules(spark, data).collect()}
    for d in toxic - quality:  # the stage's own table is smaller by the toxic documents, so its lines are no more frequent
        n_words, *_, again = brute_quality(seen[d])
        assert n_words < 10 or 100 * again > 20 * n_words or not verdicts[d]
    texts = {}
    for d in sorted(quality):
        texts.setdefault(seen[d], d)
    assert near <= set(texts.values())  # of equal texts only the first
    assert encoded == mixed and docs.where("not parity").count() == 0
    assert docs.count() == p.run(spark, data).count()
