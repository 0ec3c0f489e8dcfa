"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns; round trips and properties."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from lumenspan.llm import chat, components, fingerprints, licenses, line_quality, mixing, near_simhash, pieces, queries, token_files, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, tox_score double, mix_size long, fp long, key string, ids string, n_tokens long, removed string, size long"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows: nulls, empties, spaces only, one very long text, repeated rows and ids, clashing columns."""
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, same), (5, same), (6, same), (7, same + " thirteen"), (8, "é ß 你好 \U0001f600 ▁mark"), (None, "no id at all but some words in a text that is long enough"), (9, "released under the MIT License."), (9, "another text with the same id")]
    return spark.createDataFrame([(i, t, None, None if i == 6 else "s", None, 0.5, 1, 2, "k", "i", 3, "r", 4) for i, t in rows], DOC)


def count(df):
    return df.count()


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    path = queries.tokenizer_file
    assert count(near_simhash.near_duplicates(odd)) == n
    assert count(near_simhash.similar_documents(odd)) == n
    assert count(fingerprints.searched(odd)) == n
    assert count(line_quality.line_quality(odd)) == n
    assert count(mixing.mix(odd)) == n
    assert count(pieces.encoded(odd, path("piece_bpe_32k.model"))) == n
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 1), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(odd, labels)
    assert count(toxicity.scores(odd, machine)) == n
    assert count(licenses.scan(odd)) == n
    assert count(token_files.token_files(odd, path("word_bpe_49k.json"))) == n


def test_every_operator_takes_empty_tables(spark, odd):
    none = odd.limit(0)
    path = queries.tokenizer_file
    for df in (near_simhash.near_duplicates(none), near_simhash.representatives(none), fingerprints.searched(none), line_quality.line_quality(none), line_quality.kept_documents(none), mixing.mix(none), mixing.mixed_documents(none), pieces.encoded(none, path("piece_bpe_32k.model")), licenses.scan(none), token_files.token_files(none, path("word_bpe_49k.json"))):
        assert df.count() == 0
    machine = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.scores(odd, machine).where("tox_score >= 0.5").count() == 0
    assert warc.archived(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    got = {(r.doc_id, r.component_id) for r in near_simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= got
    kept = near_simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and ids.count(None) == 1 and 1 in ids and 2 not in ids
    assert ids.count(9) == 2  # unlike texts under one id


def test_columns_of_internal_names_stay(spark):
    """Columns named like the operators' own keep their values, in any case."""
    words = " ".join(f"w{k}" for k in range(30))
    names = ["_id", "_at", "_HASH", "_removed", "_source", "_mix_turn", "_mix_bound", "mix_copies", "class", "root", "component_id", "text_hash"]
    df = spark.createDataFrame([(1, words, "s", *range(9, 9 + len(names))), (2, words, "s", *range(50, 50 + len(names)))], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    for out, ids in ((near_simhash.representatives(df), [1]), (line_quality.kept_documents(df), [1, 2]), (mixing.mixed_documents(df, epochs=1), [1, 2])):
        assert out.columns == df.columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.collect() if r.doc_id in ids)


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([(c, f"some words of text {c} " * 9, "s") for c in "bca"], "doc_id string, text string, source string")
    assert {r.component_id for r in near_simhash.near_duplicates(docs).collect()} <= {"a", "b", "c"}
    assert sorted(r.doc_id for r in near_simhash.representatives(docs).collect()) == ["a", "b", "c"]
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(docs).collect()}
    assert got["a"].near_next == fingerprints.likeness(*(fingerprints.fingerprint(f"some words of text {c} " * 9) for c in "ab"))
    assert [r.start for r in token_files.token_files(docs, queries.tokenizer_file("word_bpe_49k.json")).orderBy("doc_id").collect()][0] == 0
    machine = toxicity.fit(docs, spark.createDataFrame([("a", 1, 1), ("b", 0, 0), ("c", 0, 0)], "doc_id string, quality int, toxic int"))
    assert toxicity.scores(docs, machine).count() == 3


def test_search_and_archives_take_text_ids(spark):
    docs = spark.createDataFrame([(c, "the very same words here") for c in ("50", "x", "7", "100", "5 0", "-50", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_near for r in fingerprints.searched(docs).collect()} == {"50": 7, "100": 7, "-50": 7, "x": None, "7": None, "5 0": None, None: None}
    big = "y" * 1500
    pages = spark.createDataFrame([("a:b>", None, big), ("é %", "u", big), ("None", "u", "s"), ("!", "u", "s"), ("", "u", "s"), (None, "u", "s")], "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert got == {("a:b>", "revisit", "é %"), ("é %", "response", None), *((x, "response", None) for x in ("None", "!", "", None))}


def test_conversations_without_a_layout_keep_a_row(spark):
    records = spark.createDataFrame([(1, '{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}'), (2, "no json"), (3, '{"messages": []}'), (4, '{"prompt": "p", "completion": "c"}'), (4, "[]")], "conv_id long, record string")
    got = {r.conv_id: (r.n_turns, r.formatted == "", len(r.loss)) for r in chat.formatted(chat.canonical_turns(records)).collect()}
    assert got == {1: (0, True, 0), 2: (0, True, 0), 3: (0, True, 0), 4: (2, False, 1)}


def test_decoding_is_the_library_s(spark):
    """The given model's decoding by parts against the library's own of whole ids; names that clash are left out."""
    path = queries.tokenizer_file("piece_bpe_32k.model")
    encoder = pieces.Encoder(path)
    said = ["plain words, and more.", "", " two  spaces ", "tab\tand\nfeed", "日本語 \U0001f600 \x01", "▁ marker", "a" * 500]
    ids = [x for x, _ in encoder.encode(said)]
    assert [x.decode() for x in encoder.decode(ids)] == encoder.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    encoder.table = encoder.table.take([*range(1, len(encoder.table)), 0])  # a wrong table has no parity
    assert not encoder.encode(["words never met before"])[0][1]
    clash = spark.createDataFrame([(1, "some words", True, 3)], "doc_id long, text string, parity boolean, n_tokens int")
    assert pieces.encoded(clash, path, keep=("doc_id", "parity", "n_tokens", "doc_id")).columns == ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip", "ids"]
    assert pieces.encoded(clash, path, keep=("doc_id", "parity")).first().n_tokens > 0


def test_components_leave_nothing_behind(spark):
    from pathlib import Path

    from lumenspan.llm import common

    common.shared_folder(spark, "any")
    root = Path(common._FOLDERS[spark.sparkContext.applicationId].removeprefix("file:"))
    links = lambda: {x.name for x in root.glob("links-*")}
    before = links()
    near_simhash.near_duplicates(spark.createDataFrame([(k, "same words of a text " * 9) for k in range(5)], "doc_id long, text string")).count()
    near_simhash.similar_documents(spark.createDataFrame([(k, "same words of a text " * 9 + "z" * k) for k in range(5)], "doc_id long, text string")).count()
    assert links() == before


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lumenspan.llm import common

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(SimpleNamespace(conf={}, sparkContext=context))


def test_settings_of_the_session_stay(spark, odd):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    near_simhash.near_duplicates(odd).count()
    licenses.scan(odd).count()
    assert before == {k: spark.conf.get(k) for k in before}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 10, 200, 1001])
def test_ranges_equal_a_plain_search(spark, count):
    from lumenspan.llm import common

    bounds = [3 * k for k in range(count)]
    docs = spark.createDataFrame([(k,) for k in (None, -5, 0, 1, 2, 3, 4, 5, 6, 599, 600, 601, 2999, 3000, 3001, 9999)], "doc_id long")
    for r in docs.select("doc_id", common.range_of(docs, bounds).alias("at")).collect():
        assert r["at"] == (count if r.doc_id is None else sum(b < r.doc_id for b in bounds))


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_first_pairs_of_a_stream(batch):
    """Postings of up to six texts give all pairs; of larger ones all members, whatever the batches."""
    sizes = [1, 2, 6, 7, 9, 40, 3]
    rows = [(key, 100 * key + k, 10) for key, m in enumerate(sizes) for k in range(m) for _ in range(1 + k % 2)]
    table = pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("key", "name", "n"))})
    out = [r for b in near_simhash._first_pairs(0.8)(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    pairs = {(r["u"], r["v"]) for r in out if r["v"] is not None}
    members = sorted((r["key"], r["u"]) for r in out if r["v"] is None)
    assert members == sorted((key, 100 * key + k) for key, m in enumerate(sizes) if m > 6 for k in range(m))
    for key, m in enumerate(sizes):
        own = {(a, b) for a, b in pairs if a // 100 == key}
        every = {(100 * key + a, 100 * key + b) for a, b in itertools.combinations(range(m), 2)}
        assert own == (every if m <= 6 else {(a, b) for a, b in every if b - a <= 4 or a == 100 * key})


def test_kept_documents_of_odd_rows(odd):
    kept = line_quality.kept_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "6", "7", "None"]


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, footer = [], "All Rights reserved by the shared footer line of this host"
    for k in range(120):
        rows.append((k, "\n".join([" ".join(word() for _ in range(12)), " " + (footer.upper() if k % 2 else footer)]), "h"))
    clean = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3))
    rows += [(1000 + k, clean, "h") for k in range(200)]  # copies aren't their own boilerplate
    rows.append((5000, footer + "\n" + "some three words", "h"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality.line_quality(docs, min_docs=50, share=0.01).collect()}
    assert all(r.kept for d, r in got.items() if d < 5000) and not got[5000].kept
    assert all(len(got[k].removed) == 1 for k in range(120)) and not got[1000].removed
    kept = {r.doc_id: r.text for r in line_quality.kept_documents(docs, min_docs=50, share=0.01).collect()}
    assert "shared footer" not in kept[0].lower() and kept[1000] == clean


def test_pages_of_nothing_but_shared_lines_are_rejected(spark):
    """Distinct texts count each: footers in many orders, near copies, and pages of one own line under many shared."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    footers = [" ".join(word() for _ in range(12)) for _ in range(3)]
    rows = [(k, "\n".join(rng.sample(footers, 3)) + "\n" + word(), "only footers") for k in range(300)]
    shared = [" ".join(word() for _ in range(6)) for _ in range(20)]
    rows += [(1000 + k, "\n".join([*shared, " ".join(word() for _ in range(12))]), "own line") for k in range(300)]
    near = [" ".join(word() for _ in range(12)) for _ in range(20)]
    rows += [(2000 + k, "\n".join([x if j != k % 20 else x + " edit" + str(k) for j, x in enumerate(near)]), "near copies") for k in range(200)]
    rows += [(3000 + k, "\n".join(near), "exact copies") for k in range(200)]
    got = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.kept == (d >= 3000) for d, r in got.items())
    assert all(len(got[1000 + k].removed) == 20 and got[1000 + k].left_words == 12 for k in range(300))


def test_documents_that_share_many_lines_are_counted_each(spark):
    """Different articles under one set of menu lines: the menu goes, and those with little else are rejected."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    menu = [" ".join(word() for _ in range(3)) for _ in range(20)]
    rows = [(k, "\n".join([*menu, " ".join(word() for _ in range(100 if k < 150 else 20))]), "h") for k in range(300)]
    got = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.01).collect()}
    assert all(len(r.removed) == 20 for r in got.values())
    assert all(r.kept == (d < 150) for d, r in got.items())


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    nodes = list(range(400))
    rng.shuffle(nodes)
    links = list(itertools.pairwise(nodes[:150])) + [(nodes[200], x) for x in nodes[201:300]] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got.get(x, x) for x in nodes[:150]} == {min(nodes[:150])} and {got.get(x, x) for x in nodes[200:300]} == {min(nodes[200:300])}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_position_sets_cover_every_guarantee():
    for minimum in (2, 3, 4, 8):
        sets = near_simhash.position_sets(minimum)
        assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), minimum))


@pytest.mark.parametrize("seed", range(3))
def test_links_of_clusters_keep_all_components(spark, seed):
    """Clusters of fingerprints a few bits apart, in chains longer than the radius."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.node: r.root for r in components.components(near_simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(fps, signed, strict=True), 2):
        if (a ^ b).bit_count() <= 4:
            p, r = find(x), find(y)
            root[max(p, r)] = min(p, r)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_similar_documents_find_edited_copies(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(800)]
    rows, first = [], {}
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(120, 400))
        rows.append((10 * k, " ".join(words)))
        words[len(words) // 2] = "changed"
        rows.append((10 * k + 1, " ".join(words)))
        first[10 * k + 1] = 10 * k
    got = {r.doc_id: r.component_id for r in near_simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] == f for d, f in first.items()) >= 57
    assert len(set(got.values())) >= 60


@pytest.mark.parametrize("block", [4096, 16])
def test_similar_documents_equal_brute_force(spark, monkeypatch, block):
    """Truncated and extended copies of short texts, and many texts around one passage, at and beside the limit."""
    monkeypatch.setattr(near_simhash, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    out = []
    for size in (12, 30, 60, 150, 400):
        for _ in range(12):
            words = [word() for _ in range(size)]
            out += [words, words[: round(size * rng.uniform(0.78, 0.95))], words + [word() for _ in range(round(size * rng.uniform(0.05, 0.25)))]]
    passage = [word() for _ in range(80)]
    out += [[word() for _ in range(rng.randrange(0, 12))] + passage + [word() for _ in range(rng.randrange(0, 12))] for _ in range(120)]
    rng.shuffle(out)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in out]
    root = list(range(len(out)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(out)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, r = find(a), find(b)
            root[max(p, r)] = min(p, r)
    got = {r.doc_id: r.component_id for r in near_simhash.similar_documents(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(out)], "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(out))}


def test_near_dedup_stage_links_by_simhash_and_by_shingles(spark, data):
    """Texts whose repeated part decides the fingerprint, copies with a word changed, and shortened ones: the classes of
    all pairs within 4 bits or of similarity 0.8."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    out = []
    for _ in range(6):
        words, often = [word() for _ in range(200)], [word() for _ in range(12)] * 90
        out += [words, [*words[:90], "changed", *words[91:]], words[:170], words[:100]]
        out += [often + [word() for _ in range(12)] for _ in range(3)]
    rng.shuffle(out)
    made = [" ".join(w) for w in out]
    fps = [near_simhash.simhash(t.encode()) for t in made]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in out]
    root = list(range(len(out)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_bits = 0
    for a, b in itertools.combinations(range(len(out)), 2):
        near, alike = (fps[a] ^ fps[b]).bit_count() <= 4, len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        by_bits += near and not alike
        if near or alike:
            p, r = find(a), find(b)
            root[max(p, r)] = min(p, r)
    assert by_bits > 3
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.doc_id for r in queries.near_dedup_stage(spark, docs, data).collect()} == {find(k) for k in range(len(out))}


def test_within_radius_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(50)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base] + base[:10]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.n_near for r in fingerprints.within_radius(df.limit(60), df, 3).collect()}
    assert got == {s: sum((x ^ y).bit_count() <= 3 for y in fps) for s, x in list(zip(signed, fps, strict=True))[:60]}


def test_mixing_caps_and_repeats(spark):
    rows = [(k, "w " * 10, "big") for k in range(300)] + [(1000 + k, "w " * 10, "small") for k in range(5)] + [(2000, "w " * 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert {r.source: r.mix_target for r in got if r.source != "big"} == {"small": 150.0, None: 21.0}
    assert all(r.mix_copies == 3 for r in got if r.source != "big")
    assert abs(sum(r.mix_size * r.mix_copies for r in got if r.source == "big") - (3057 - 171)) <= 10
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.mix_copies) for r in got) == sorted((r.doc_id, r.mix_copies) for r in again)
    assert mixing.mixed_documents(docs).where("source = 'small'").count() == 15


def test_machine_learns_a_pair_that_weights_miss():
    """Either word alone is harmless; both together are not."""
    rng = np.random.default_rng(0)
    a, b = toxicity.places("red")[0], toxicity.places("blue")[0]
    rows, y = [], []
    for _ in range(4000):
        has = rng.random(2) < 0.5
        rows.append(np.array([p for p, h in zip((a, b), has, strict=True) if h] + [int(x) for x in rng.integers(0, 50, 3)], np.int64))
        y.append(float(has.all()))
    m = toxicity.train([np.unique(r) for r in rows], np.array(y))
    score = lambda *ps: m.score([m.at[p] for p in ps if p in m.at])
    assert score(a, b) > 0.8 and score(a) < 0.3 and score(b) < 0.3


def test_places_that_matter_in_pairs_only_are_kept():
    """Of the rows with a bad word those without the second are harmless; the second tells nothing alone."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for k in range(6000):
        bad, second = k % 10 == 0, rng.random() < 0.5
        rows.append(np.unique([1] * bad + [2] * second + [int(x) for x in rng.integers(10, 5000, 20)]).astype(np.int64))
        y.append(float(bad and not second))
    assert {1, 2} <= set(toxicity.select_places(rows, np.array(y), 8).tolist())


def test_machine_of_few_rows_reads_few(spark):
    """The sample's bound is of rows: an id with many rows doesn't exceed it."""
    docs = spark.createDataFrame([(1, f"row {k} of one id") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels, max_rows=2).n_rows == 2
    assert toxicity.fit(docs, labels).n_rows == 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_repair_round_trip_and_ranges(ids, a, b):
    x = np.array(ids * 3, np.uint32)
    shard = token_files.Shard(token_files.write_shard(x, 31))
    assert (shard.all() == x).all() and shard.size == x.size
    a, b = sorted((min(a, x.size), min(b, x.size)))
    assert shard.range(a, b).tolist() == x[a:b].tolist()


def test_word_cache_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["", None, "It's Don't x.'s a_b I'LL 12.5% ¿Qué? É. ÉCOLE, straße. İstanbul. ΣΟΦΟΣ. á. é!", "\x1c\x1d a b c", "a<|endoftext|>b.", "你好。x,y;z", "(a)b[c] ... ''' 'tis"]
    for t in texts:
        ids, sizes = token_files.WordCache(path, "<u2").encode(pa.array([t, "q."], pa.string()))
        want = [library.encode(x or "", add_special_tokens=False).ids for x in (t, "q.")]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_word_cache_of_another_tokenizer_encodes_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["It's a test.  Of two, spaces", None, "ÉCOLE\n\tx"]
    ids, sizes = token_files.WordCache(path, "<u2").encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_repair_goes_on_while_pairs_are_frequent():
    """A shard of copies shrinks to little; on what has no frequent pair nothing is done."""
    rng = np.random.default_rng(1)
    copies = np.tile(rng.integers(0, 40_000, 300), 3000)[: 1 << 19]
    assert len(token_files.write_shard(copies, 49_408)) < 15_000
    rules, symbols = token_files.repair(np.arange(40_000), 49_408)
    assert len(rules) == 0 and symbols.size == 40_000


def test_selected_documents_of_a_shard_are_read(spark):
    from lumenspan.llm.common import shared_folder

    path = queries.tokenizer_file("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, f"text number {k} with words " * (k % 7)) for k in range(400)], "doc_id long, text string")
    folder = shared_folder(spark, "t")
    index = token_files.write_files(token_files.encoded(docs, path, 1, "<u2"), [100, 200], folder, 49_408, "<u2")
    every = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_files(index, folder).collect()}
    some = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_files(index.where("doc_id % 50 = 7"), folder).collect()}
    assert some == {d: every[d] for d in range(7, 400, 50)}


TEXTS = ["", " ", "Hello  world ñ 你好\n x ", "a\n\nb\tc", "▁x", "don't (stop) 3.14!", "\U0001f600 \x00", "x" * 500]


def test_pieces_equal_sentencepiece_and_decode():
    encoder = pieces.Encoder(queries.tokenizer_file("piece_bpe_32k.model"))
    got = encoder.encode(TEXTS)
    for t, (ids, same), back in zip(TEXTS, got, encoder.decode([x for x, _ in got]), strict=True):
        assert ids.tolist() == encoder.check.encode(t) == encoder.whole.encode(t, add_special_tokens=False).ids
        assert same and (back.decode() == t) == ("▁" not in t)
        assert back.decode() == encoder.check.decode(ids.tolist())


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model(rule, fallback=True):
    """A small unigram model's file, its scores from counts of these words; the normaliser is the library's."""
    import struct

    import sentencepiece

    words = ["▁the", "▁cat", "▁in", "in", "ing", "▁s", "at", "the", "▁é", "re", "er", "▁ca", "ts", "!", "▁", *"abcdefghilnorst"]
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    listed += [(w, -2.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(kind)) for p, s, kind in listed)
    spec = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    numbers = ((3, 1), (35, int(fallback)), (40, 0), (41, 1), (42, 2))
    return out + field(2, b"".join(varint(k << 3) + varint(v) for k, v in numbers) + varint(43 << 3) + b"\xff" * 9 + b"\x01") + field(3, spec)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models_equal_sentencepiece(rule, fallback):
    encoder = pieces.Encoder.of(unigram_model(rule, fallback))
    assert encoder.model.kind == pieces.UNIGRAM and not encoder.by_runs
    rng = random.Random(1)
    bits = ["the", "cats", "in", "singing", " ", "  ", "é", "你", "!", "\n", "ﬁ", "restart", "Ａ", "\t"]
    data = [*TEXTS, "the cat's in", *("".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(300))]
    got = encoder.encode(data)
    for t, (ids, same) in zip(data, got, strict=True):
        want = encoder.check.encode(t)
        assert same == (ids.tolist() == want)
    assert sum(same for _, same in got) >= 0.98 * len(data)


def test_a_difference_between_the_libraries_shows():
    """With pieces scored otherwise in what verifies, ids stay the tokenizers library's and parity is false."""
    encoder = pieces.Encoder(queries.tokenizer_file("piece_bpe_32k.model"))

    class Other:
        def encode(self, data):
            return [[*x[:-1], 0] for x in real.encode(data)] if isinstance(data, list) else real.encode(data)

    real, encoder.check = encoder.check, Other()
    ids, same = encoder.encode(["some words"])[0]
    assert ids.tolist() == encoder.whole.encode("some words").ids and not same


def test_an_encoder_forgets_the_older_half_and_no_difference():
    """What is held stays bounded, ids and parity don't depend on it, and a task leaves nothing in its worker."""
    path = queries.tokenizer_file("piece_bpe_32k.model")
    few, all_ = pieces.Encoder(path, most=20), pieces.Encoder(path)

    class Other:
        def encode(self, data):
            return [[0 if y == 500 + k else y for y in x] for x in real.encode(data)] if isinstance(data, list) else real.encode(data)

    real, k = few.check, all_.whole.encode("odd").ids[-1] - 500
    few.check = all_.check = Other()
    data = [f"odd w{n}x, again{n}. odd\n" if n % 2 else f"w{n} (plain{n % 7})" for n in range(60)]
    for at in range(0, 60, 5):
        for (a, x), (b, y) in zip(few.encode(data[at : at + 5]), all_.encode(data[at : at + 5]), strict=True):
            assert a.tolist() == b.tolist() and x == y
        assert len(few.known) <= 20 and len(few.parts) <= 20 and few.bad <= {*few.known, *few.parts}
    assert not all(x for _, x in all_.encode(data)) and any(x for _, x in all_.encode(data))


def test_a_task_leaves_no_runs_in_its_worker(monkeypatch):
    made = {}

    class Docs:
        schema = {"doc_id": StructField("doc_id", LongType())}
        select = lambda self, *_: self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
            made["rows"] = [x.num_rows for x in run([batch])]

    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces.encoded(Docs(), path)
    encoder = pieces.kept_encoder(path)
    assert made["rows"] == [2] and not encoder.known and not encoder.parts and not encoder.bad


def control(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")


@settings(max_examples=1, deadline=None)
@given(st.none())
def test_chat_escapes_are_reversible(_):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(0)
    bits = ["<", "[", "\\", "|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "</s>\n", "<|user|>\n", "é", "%0A", "|>", "\n", "a"]
    rows = [(k, j, rng.choice(["user", "assistant", "we|ird\n<%"]), "".join(rng.choices(bits, k=rng.randrange(0, 12)))) for k in range(150) for j in range(3)]
    out = chat.formatted(chat.canonical_turns(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.under) for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    for k in range(150):
        mine = [(r, t) for c, _, r, t in rows if c == k]
        assert back[k] == (mine, "".join(t for r, t in mine if r == "assistant"))


def test_chat_layouts(spark):
    records = {
        1: '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}], "id": 7, "meta": {"x": 1}}',
        2: '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        3: '{"prompt": "a", "completion": "b"}',
        4: '{"instruction": "a", "input": "c", "output": "b", "system": "s"}',
        5: '{"question": "a", "answer": {"k": 1}}',
        6: "not json",
        7: '{"something": "else"}',
        8: '{"messages": []}',
        9: '{"turn": 3, "role": "user", "text": "a"}',
        10: None,
        11: '{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}',
        12: '{"messages": [{"from": "human", "value": "a"}]}',
        13: '{"messages": [{"role": "user", "content": "a"}], "prompt": "p", "completion": "c"}',
        14: '{"conversations": []}',
    }
    df = spark.createDataFrame(list(records.items()), "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "at").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[1] == [("messages", "user", "a"), ("messages", "assistant", "")]
    assert got[2] == [("conversations", "user", "a"), ("conversations", "assistant", "b")]
    assert [x[1:] for x in got[3]] == [("user", "a"), ("assistant", "b")]
    assert [x[1:] for x in got[4]] == [("system", "s"), ("user", "a"), ("user", "c"), ("assistant", "b")]
    assert got[5][1][1:] == ("assistant", '{"k":1}')
    assert got[6] == got[7] == got[10] == [(None, None, None)]
    assert got[11] == [(None, None, None)] and got[12] == [("messages from and value", "user", "a")]
    assert got[13] == [("messages", "user", "a")] and got[14] == [("conversations", None, None)]
    assert got[8] == [("messages", None, None)] and got[9] == [("turn rows", "user", "a")]
    assert chat.formatted(chat.canonical_turns(df.limit(0))).count() == 0


def test_chat_rows_with_nulls(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "x"), (None, 0, "user", "y"), (1, 0, None, None)]
    out = chat.formatted(chat.canonical_turns(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert {r.conv_id: r.n_turns for r in out.collect()} == {1: 3, None: 1}
    named = spark.createDataFrame([("a", 0, "user", "x")], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.formatted(chat.canonical_turns(chat.records_of(named))).collect()] == [("a", 1)]


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "http://a/é b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (5, "http://f\r\nInjected: 1", big), (None, "http://n", big), (5, "http://f2", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect()), key=str)
    assert got == sorted([(1, 2000, "revisit", 5), (2, 2000, "revisit", 5), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (5, 2000, "response", None), (5, 2000, "response", None), (None, 2000, "revisit", 5)], key=str)


def test_warc_selected_records_and_ranges(spark):
    from lumenspan.llm.common import shared_folder

    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * k) for k in range(200)], "page_id long, url string, html string")
    folder = shared_folder(spark, "t")
    index = warc.write_archives(warc.with_revisits(pages), folder, file_bytes=3000)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(index.where("page_id % 3 = 0"), folder, payload=True).collect()}
    assert got == {k: f"page {k} " * k for k in range(0, 200, 3)}
    assert list(warc.ranges([("a", 0, 10), ("a", 12, 5), ("a", 100, 5), ("b", 0, 9)], 5, 100)) == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 100, 105, [(100, 5)]), ("b", 0, 9, [(0, 9)])]


def plain(text):
    return " ".join(w.decode() for w in licenses.words_of(text.encode()))


def test_license_templates(spark):
    rows = [(n, "junk the of " + text + " tail") for n, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, "plain words of no license at all number " + str(k)) for k in range(200)]
    got = {r.doc_id: {f.label for f in r.found} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[n] for n, (label, *_) in enumerate(licenses.TEMPLATES))
    assert not any(got[100 + k] for k in range(200))
    lacking = licenses.TEMPLATES[1][1].replace("without restriction", "with restriction")
    assert not licenses.matches(licenses.words_of(lacking.encode()), licenses.Index())


def brute_licenses(words, least=0.8):
    """For each label the largest share over all windows, by a plain table of common subsequences."""
    out = {}
    for label, text, keys in licenses.TEMPLATES:
        template = licenses.words_of(text.encode())
        size = len(template)
        same = math.ceil(least * size - 1e-9)
        for s in range(len(words)):
            window = words[s : s + 2 * size - same]
            joined = b" " + b" ".join(window) + b" "
            if sum((Counter(template) & Counter(window)).values()) < same or not all(f" {k} ".encode() in joined for k in keys):
                continue
            row = [0] * (size + 1)
            for w in window:
                above = 0
                for k in range(size):
                    row[k + 1], above = max(row[k + 1], row[k]) if w != template[k] else above + 1, row[k + 1]
            if row[size] >= same:
                out[label] = max(out.get(label, 0), row[size] / size)
    return out


def test_licenses_of_edited_notices_equal_brute_force():
    """Words missing, changed and inserted, several notices in a file, frequencies of any kind."""
    rng = random.Random(5)
    planted = found = 0
    for trial in range(40):
        words, labels = [], set()
        for label, text, keys in rng.choices(licenses.TEMPLATES, k=rng.randrange(1, 4)):
            words += rng.choices([b"the", b"of", b"software", b"x", b"license"], k=rng.randrange(20))
            fixed = {w for k in keys for w in k.encode().split()}
            for w in licenses.words_of(text.encode()):
                r = rng.random()
                if r < 0.04 and w not in fixed:
                    continue
                if r > 0.96 and w not in fixed:
                    words.append(b"inserted")
                words.append(w)
            labels.add(label)
        idf = {w: rng.choice([0.0, 1.0, 5.0]) for w in licenses.VOCABULARY} if trial % 2 else None
        got = {}
        for label, share, _, _ in licenses.matches(words, licenses.Index(idf)):
            got[label] = max(got.get(label, 0), share)
        assert got == brute_licenses(words)
        planted += len(labels)
        found += len(labels & got.keys())
    assert found >= 0.95 * planted


def test_licenses_of_common_words(spark):
    """A notice in a third of the rows hides none."""
    texts = {label: text for label, text, _ in reversed(licenses.TEMPLATES)}
    for label in ("bsd", "gpl-3", "mpl-2", "unlicense", "cc0"):
        rows = [(k, f"row {k} " + (texts[label] if k % 3 == 0 else "of plain words")) for k in range(90)]
        got = {r.doc_id: {f.label for f in r.found} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all((label in got[k]) == (k % 3 == 0) for k in range(90))


def test_licenses_of_many_notices(spark):
    """A file with every notice has every label, once a template."""
    rows = [(k, f"row {k} of plain words") for k in range(90)] + [(1000, " tail of file ".join(text for _, text, _ in licenses.TEMPLATES))]
    got = {r.doc_id: [f.label for f in r.found] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[1000]) == {label for label, *_ in licenses.TEMPLATES} and not any(got[k] for k in range(90))
