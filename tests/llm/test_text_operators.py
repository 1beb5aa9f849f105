import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, decontamination, ngram_join, packing, pii, quality, substring_dedup


@pytest.mark.parametrize("hot", [2, 5000])
def test_repeats_equal_brute_force(documents, corpus, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda d, w, f=substring_dedup.repeated_windows: f(d, w, hot))
    out = substring_dedup.remove_repeats(documents)
    assert out.columns == [*documents.columns, "repeats"]
    rows = out.select("doc_id", "repeats.*").collect()
    assert {r[0]: (r[1], r[2], brute.sha(r[3])) for r in rows} == brute.repeats(corpus)


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"a{k}" for k in range(20))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, "short"), (5, text.replace("a3 ", "b3 "))]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r[0] or 0, r[1]["n_removed"]) for r in out.select("doc_id", "repeats").collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20), (3, 0), (4, 0), (5, 16)]
    empty = substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_automaton_knows_every_substring():
    machine = decontamination.SuffixAutomaton()
    texts = [[1, 2, 1, 2, 3], [2, 1, 2, 2], [3, 3, 1]]
    for t in texts:
        machine.add(t)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stream = [1, 2, 1, 2, 2, 3, 3, 1, 2, 3, 4, 3, 1]
    for at, (_, length) in enumerate(machine.matches(stream), 1):
        longest = max((n for n in range(at + 1) if n == 0 or tuple(stream[at - n : at]) in known))
        assert length == longest


ITEMS = [(1, " ".join(f"q{k}" for k in range(30))), (2, "Three short words"), (12, "three SHORT words"), (3, None), (4, "..."), (5, " ".join(f"q{k}" for k in range(10, 26)))]


@pytest.mark.parametrize("shard", [20, 200_000])
def test_contamination_equals_brute_force(spark, corpus, shard, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    q = [f"Q{k}" for k in range(30)]
    rows = [*corpus, (900, "x y " + " ".join(q[4:22]) + " z"), (901, "a, three-short:words b"), (902, "word " * 600 + ", ".join(q[:13])), (903, "three short")]
    found = decontamination.find_windows(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Hits", F.lit(1)), spark.createDataFrame(ITEMS, "item_id long, text string"))
    hits = found.columns[-1]
    assert hits == "_hits"
    got = {r[0]: (r[1], r[2], len(r[3]), brute.sha(",".join(r[3])), r[4]) for r in found.select("doc_id", f"{hits}.n_words", f"{hits}.n_hit", f"{hits}.items", decontamination.contaminated(hits)).collect()}
    assert got == brute.contamination(rows, ITEMS)
    cut = {r[0]: r[1] for r in decontamination.cut_hits(found, hits).select("doc_id", "text").collect()}
    assert cut[900] == "x y z" and cut[903] == "three short" and cut[400] is None and cut[902] == "word " * 600


def test_components_equal_brute_force(documents, corpus):
    out = ngram_join.similar_components(documents)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute.near(corpus)


@pytest.mark.parametrize("block", [2, 1024])
def test_links_across_components_are_found(spark, block, monkeypatch):
    """A chain of texts, each near its neighbours only, some of which share their rarest shingles with unlike ones."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    words = [f"c{k}" for k in range(120)]
    rows = [(k, " ".join(words[:100][: 100 - 4 * k] + [f"n{j}" for j in range(4 * k)])) for k in range(12)]
    rows += [(50 + k, " ".join(words[:30] + [f"z{k}_{j}" for j in range(8)])) for k in range(6)]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_components_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e f"), (None, "a b c d e f"), (7, None), (8, None), (9, "a b")]
    got = sorted(((r[0] or 0), r[1], r[2]) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 9)]
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 150), (150, 120), (7, 7), (200, None)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {120: 100, 150: 100}


HARD = [
    "a@b.c_d@e.f x@y@z.w .a..b@c.d. a@b a@b.c.d-e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.1.1 999999999999.1.1.1", "4111 1111-1111 1111 and 4111-1111-1111-1112, 41111111  11111111",
    "+1 (988) 555-2485 +1 2 +49.30.123456 ++12345678901+ (+4420 7946 0958)", "é☃ u@v.de 🙂 9.9.9.9 🙂", None, "", "@", "+", "1", "1 " * 3000, "a." * 3000 + "@b.c", "x@" + "y." * 3000 + "z", "+" * 2000, "9" * 5000,
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)] + [(0, HARD[0])], "doc_id long, text string").withColumn("personal", F.lit(1))
    found = pii.find_spans(df, pii.Detector())
    assert found.columns[-1] == "_personal"
    rows = found.select("doc_id", pii.listed(F.col("_personal.base")), pii.listed(F.col("_personal.spans"))).collect()
    assert len(rows) == len(HARD) + 1
    for k, base, every in rows:
        assert base == every == brute.personal(HARD[k])[1], k


def test_many_matches_keep_their_places(spark):
    text = "é " + " ".join(f"u{k}@h{k}.org" for k in range(1000))
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Detector()).select(pii.listed(F.col("personal.base"))).first()
    assert row[0] == brute.personal(text)[1]


def test_detector_adds_to_the_base_and_redacts(spark):
    rows = [(k, f"call +1 ({200 + k}) 555-{1000 + k} or 1 ({200 + k}) 555-{2000 + k} key AKIA{k:016d} id {k:012d}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    detector = pii.fit_on(df)
    found = pii.find_spans(df, detector)
    got = found.select("text", "personal.base", "personal.spans", pii.redacted(F.col("text"), F.col("personal.spans")).alias("out")).collect()
    assert detector.trees and all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got)
    assert all("+1 (" not in r["out"] and r["out"].startswith("call [PHONE]") for r in got)
    assert pii.fit_on(df.limit(0)).trees == []


def _graded(n):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(n):
        words = list(rng.choice(["rain", "river", "stone", "light", "north", "sea", "wind"], 30))
        kind = k % 3
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 0:
            words[k % 30] = "scum"
        texts.append((k, " ".join(words), "x"))
        labels.append((k, int(kind != 1), int(kind == 0)))
    return texts, labels


def test_classifier_tells_grades_apart_on_held_out_rows(spark):
    texts, labels = _graded(600)
    docs = spark.createDataFrame([*texts, (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, quality string")
    rated = spark.createDataFrame([*labels[:400], (None, 1, 0), (5, None, None), (777777, 1, 0)], "doc_id long, quality int, toxic int")
    graded = quality.grade_documents(docs, quality.fit_on(docs, rated))
    assert graded.columns[-1] == "_quality" and graded.count() == 602
    rows = graded.filter("doc_id >= 400 and doc_id < 600").select("doc_id", "_quality.tails", "_quality.expected").collect()
    right = sum(sum(t >= 0.5 for t in r["tails"]) == (0, 1, 2)[r["doc_id"] % 3] for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(abs(sum(r["tails"]) - r["expected"]) < 1e-9 and r["tails"][0] >= r["tails"][1] for r in rows)


def test_classifier_without_ratings(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = quality.fit_on(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not model.weights.any() and quality.grade_documents(docs, model).count() == 1


def test_packing_has_no_faults(spark, corpus, documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 25)
    rows = packing.best_fit(documents, capacity=128).collect()
    known = {d: (len((t or "").encode().split()), f"s{d % 3}", " ".join((t or "").lower().split())) for d, t in corpus}
    assert brute.packing_faults([tuple(r) for r in rows], known, 128) == []


def test_best_fit_takes_the_tightest_compatible_bin():
    pieces = [(70, "a", 1), (60, "b", 2), (35, "b", 3), (30, "a", 4), (5, None, None), (5, "b", 3)]
    places = packing.pack(pieces, 100)
    # 35 does not fit beside 70, and 60 has its source; 30 shares its source with 70 and goes to the 60, the tightest left.
    assert places[:4] == [(0, 0), (1, 0), (2, 0), (1, 60)]
    assert places[4] == (1, 90) and places[5] == (0, 70)
    assert packing.pack([], 10) == []
