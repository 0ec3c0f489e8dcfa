"""Structure repair, periodic runs and language identification against brute force; odd rows of each."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import languages, periodic, queries, repair

GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows, fault):
    """Least (cost, audit) over all edits, by a search that checks the grammar on whole strings of initials only."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, turns = heapq.heappop(queue)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(turns)
        if (at, initials, audit) in seen or len(initials) > len(rows) + 6:
            continue
        seen.add((at, initials, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", at, initials + role[0], (*turns, (role, ""))))
        if at < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, initials, turns))
            if fault[at] in ("", "truncated"):
                more, (mine, text) = 3 * (fault[at] == "truncated"), rows[at]
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + mine[:1], (*turns, (mine, text))))
                for role in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, initials + role[0], (*turns, (role, text))))
    raise AssertionError


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["", " ", "a.", "b.", "c", "d?"])), max_size=4))
def test_repair_is_the_cheapest_and_least(rows):
    fault = repair.faults(rows)
    assert repair.repaired(rows, fault) == cheapest(rows, fault)


def test_repair_of_long_conversations_is_linear_and_right():
    """Against a plain table of least (cost, audit) by state."""
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "system", "x"]), f"{k}{rng.choice(['.', '', '!'])}") for k in range(3000)]
    fault = repair.faults(rows)
    cost, audit, turns = repair.repaired(rows, fault)
    states, step = "sua", {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": 0}
    for k in range(len(rows) + 1):
        for _ in range(3):
            for (p, c), n in step.items():
                if c != "s" and p in best:
                    best[n] = min(best.get(n, 10**9), best[p] + 3)
        if k == len(rows):
            break
        more, new = 3 * (fault[k] == "truncated"), {}
        for p, c in best.items():
            new[p] = min(new.get(p, 10**9), c + 4)
            for letter in states:
                n = step.get((p, letter))
                if n and (letter == rows[k][0][0] or letter != "s"):
                    new[n] = min(new.get(n, 10**9), c + more + 3 * (letter != rows[k][0][0]))
        best = new
    assert cost == min(best[""], best["a"])
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in turns)) and len(audit) - audit.count("I") == len(rows)
    spent = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + 3 * sum(f == "truncated" and e != "D" for f, e in zip(fault, audit.replace("I", ""), strict=True))
    assert spent == cost


def test_repairs_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "hi."), (1, 9, "assistant", "yo."), (2, 1, "user", ""), (None, 0, "user", "q?"), (None, 0, "user", "q?"), (None, 1, "assistant", "a" * 300_000 + ".")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    got = {r.conv_id: r for r in repair.repairs(df).collect()}
    assert (got[1].gaps, got[1].blank, got[1].illegal, got[1].cost, got[1].audit) == (6, 1, 1, 4, "DKK")
    assert (got[2].gaps, got[2].blank, got[2].cost, got[2].audit, got[2].repaired) == (0, 1, 4, "D", [])
    assert (got[None].duplicate, got[None].audit, [t.role for t in got[None].repaired]) == (1, "KDK", ["user", "assistant"])
    assert repair.repairs(df.limit(0)).count() == 0
    turns = spark.createDataFrame([("a", "one", "user", "x."), ("a", "2", "assistant", "y.")], "conv_id string, turn string, role string, text string")
    found = repair.repairs(turns).first()  # a turn that isn't a number goes first
    assert (found.gaps, found.audit) == (0, "KK")


def test_op11_keeps_conversations_that_damage_empties(spark, tmp_path):
    gone = next(k for k in range(500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_structure_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got.keys() == {gone, None}
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", empty) and got[None].repaired_sha256 == empty


def brute_runs(x):
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out[i, j + q] = min(q, out.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=11), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_runs_equal_brute_force(parts):
    ids = [w for unit, times in parts for w in unit * times]
    words = [b"w%d" % k for k in ids]
    assert periodic.runs_of(words) == brute_runs(ids)
    assert sorted((s, e - s, q) for (s, e), q in periodic.divided(ids).items()) == sorted(brute_runs(ids))


def test_runs_of_every_period_and_alignment():
    for q, times, lead in itertools.product(range(1, 14), (3, 4, 7), (0, 1, 5, 17)):
        ids = [100 + k for k in range(lead)] + (list(range(q)) * 40)[: max(24, times * q)] + [200 + k for k in range(9)]
        assert periodic.runs_of([b"%d" % k for k in ids]) == brute_runs(ids) == [(lead, max(24, times * q), q)]


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 60))
def test_z_function(x, count):
    count = min(count, len(x))
    got = periodic.z_function(x, count)
    assert got[1:] == [sum(1 for _ in itertools.takewhile(lambda k, i=i: x[k] == x[i + k], range(len(x) - i))) for i in range(1, count)]


def test_periodic_takes_odd_rows(spark):
    loop = "a b c d e f " * 5
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, loop), (4, loop), (None, "x " * 50_000), (5, "é ß 你 " * 10)]
    df = spark.createDataFrame([(i, t, 9, "r") for i, t in rows], "doc_id long, text string, runs int, N_words string")
    out = periodic.periodic(df)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), *[(4, 30, [(0, 30, 6)], "a b c d e f")] * 2, (None, 50_000, [(0, 50_000, 1)], "x"), (5, 30, [(0, 30, 3)], "é ß 你")], key=str)
    assert periodic.periodic(df.limit(0)).count() == 0 and periodic.looped(df).count() == len(rows)


def test_strongest_run(spark):
    df = spark.sql("select array(named_struct('start', 5L, 'length', 30L, 'period', 10L), named_struct('start', 7L, 'length', 60L, 'period', 20L), named_struct('start', 90L, 'length', 31L, 'period', 10L)) runs union all select array()")
    assert [r.b and tuple(r.b) for r in df.select(periodic.strongest(df.runs).alias("b")).collect()] == [(90, 31, 10), None]


@given(st.lists(st.text("abñß你\U00020000", min_size=1, max_size=5), min_size=1, max_size=5))
def test_ngrams_are_those_of_each_word(words):
    for size, (keys, owner) in zip(languages.SIZES, languages.ngrams(words), strict=True):
        ended = [w if size == 1 else f"<{w}>" for w in words]
        want = [(w[k : k + size], n) for n, w in enumerate(ended) for k in range(len(w) - size + 1)]
        assert [(languages.spelled(k, size), n) for k, n in zip(keys.tolist(), owner.tolist(), strict=True)] == want
        assert [languages.numbered(g) for g, _ in want] == keys.tolist()


def test_op13_held_out(spark):
    """Accuracy on the rows that were not learned from."""
    data = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op13_language_id(spark, data).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98


EN, FR, RU = "the cat and the dog were in the house with that man ", "le chat et le chien sont dans la maison avec cet homme ", "кошка и собака живут в доме с этим человеком "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t * 3, lang) for k in range(20) for t, lang in ((EN, "en"), (FR, "fr"), (RU, "ru"))] + [(99, "x", None), (98, None, "zz"), (97, "y", " ")]
    return languages.fit(spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, lang_score double"))


def test_spans_of_mixed_text(model):
    labeller = languages.Labeller(model)
    label = lambda text: labeller([text])[0]
    pred, score, spans = label(EN + FR * 2 + RU + "12 ½ !")
    assert pred == "fr" and 0.4 < score < 0.7
    assert [(s["lang"], s["n_words"]) for s in spans] == [("en", 12), ("fr", 24), ("ru", 9)]
    assert [s["first_word"] for s in spans] == [0, 12, 36]
    assert label("Дом")[0] == "ru" and label("12 ½ ٣ !") == ("und", 0.0, []) and label("ελληνικά")[0] in model.langs
    assert label("кошкаcat")[2][0]["n_letters"] + sum(s["n_letters"] for s in label("кошкаcat")[2][1:]) == 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-12, 0), min_size=3, max_size=3), min_size=1, max_size=7))
def test_viterbi_is_the_best_path(rows):
    scores = np.array(rows, float) * 2

    def worth(path):
        return sum(scores[t, k] for t, k in enumerate(path)) - languages.SWITCH * sum(a != b for a, b in itertools.pairwise(path))

    assert worth(languages.viterbi(scores)) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(rows)))))


def test_languages_takes_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, EN), (4, EN), (None, (FR + RU) * 3000)]
    df = spark.createDataFrame([(i, t, "zz", 3) for i, t in rows], "doc_id long, text string, lang string, LANG_pred int")
    out = languages.labelled(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_spans"]
    got = sorted((r.doc_id or 0, r.lang_pred, len(r.lang_spans)) for r in out.collect())
    assert got == [(0, "fr", 6000), (1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 1), (4, "en", 1)]
    none = languages.fit(df.limit(0))
    assert languages.labelled(df.limit(0), model).count() == 0 and {r.lang_pred for r in languages.labelled(df, none).collect()} == {"und"}


def test_model_bounds(spark):
    """``max_langs`` and ``max_grams`` bound what comes to the driver; ``max_rows`` the rows that are counted."""
    rows = [(k, EN if k % 3 else FR, "en" if k % 3 else "fr") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = languages.fit(docs, max_langs=1, max_grams=40)
    assert few.langs == ["en"] and len(few.at) <= 40
    whole, some = languages.fit(docs), languages.fit(docs, max_rows=30)
    count = lambda m: np.exp(m.logs[m.at["=the"]])
    assert whole.langs == some.langs == ["en", "fr"] and count(whole)[0] == pytest.approx(count(some)[0], rel=0.1)


def folder_of(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


LABELS = "doc_id long, quality int, toxic int"


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, docs, spark.createDataFrame([], LABELS))).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats, one long text, ids that repeat, and columns named like the stages' own."""
    import corpus_pipeline

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ro", "su") for b in ("ta", "ve", "xo", "yu", "zi", "ba", "de")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    same, long = text(60), text(30_000)
    texts = [None, "", " \n", same, same, same + " tail", long, *(text(40) for _ in range(20))]
    rows = [(k, t, "s" if k % 3 else None) for k, t in enumerate(texts)] + [(None, text(50), "s"), (7, texts[7], "s"), (8, text(45), None)]
    names = ["ids", "mix_size", "_id", "tox_score", "removed", "class", "parity"]
    docs = spark.createDataFrame([(i, t, None, s, None, *range(len(names))) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in names))
    path = folder_of(spark, tmp_path, docs, spark.createDataFrame([(3, 1, 0), (9, None, None), (None, 1, 1)], LABELS))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, path)
        assert held.columns == docs.columns, name
        held = held.cache()
        if name == "SimHash near-dedup":  # empty texts and copies are gone, clean ones stay
            assert {r.doc_id for r in held.collect()} == {3, 6, None, *range(7, len(texts))}
    assert corpus_pipeline.run(spark, path).count() == held.count()
