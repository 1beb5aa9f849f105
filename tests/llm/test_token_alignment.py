import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import token_alignment as ta

ODD = [
    "", None, " ", "  two  spaces ", "\ttab\n\nlines\r\n", "<|endoftext|></s><s><unk>", "é" * 50, "😀 👩‍👩‍👧 \u200d", "a▁b", "x\x00y", "\u00a0nbsp\u3000", "日本語のテキスト", "don't we'll I'M",
    "1234567890" * 30, "word " * 500, "ﬁ ligature", "\ufeffbom", "q" * 5000, "0x1f\x7f\x80",
]


def _scored(df, **options):
    return {(r["id"], r["groups"]): tuple(r)[1:] for r in ta.index_links(df, **options).scores().collect()}


def test_alignment_equals_brute_force(spark, corpus):
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_links int, Block string").repartition(7)
    want = brute.alignments(rows)
    got = {r["id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in ta.index_links(df).scores().collect()}
    assert got == want
    hashed = {r["id"]: r["groups"] for r in ta.index_links(df, digest=True).scores().collect()}
    assert hashed == {d: brute.sha(w[6]) if w[6] else "" for d, w in want.items()}


def test_small_blocks_and_dense_bitmaps_give_the_same_scores(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    whole = _scored(df)
    index = ta.index_links(df)
    kinds = {(r["dense"], r["plane"] > 0) for r in index.rows.filter("pair is not null").select("dense", "plane").distinct().collect()}
    assert kinds == {(True, False), (True, True), (False, False), (False, True)}
    monkeypatch.setattr(ta, "BLOCK_POSTINGS", 300)
    assert _scored(df) == whole


def test_counts_come_from_bitmaps_and_planes(spark):
    text = "the cat the cat the cat and the dog"
    df = spark.createDataFrame([(1, text), (2, text), (3, "the cat")], "doc_id long, text string")
    counts = ta.index_links(df).counts().collect()
    assert sum(r["n_links"] for r in counts) == sum(r["n_links"] for r in ta.index_links(df).documents().collect())
    assert max(r["n_docs"] for r in counts) == 3 and max(r["n_links"] for r in counts) == 9
    pairs, slots, times = np.array([5, 5, 5, 9]), np.array([0, 3, 7, 2]), np.array([1, 6, 3, 1])
    back = {}
    for plane, found, sizes, dense, maps in ta.planes(pairs, slots, times, 8):
        for pair, size, bitmap in zip(found, sizes, maps, strict=True):
            at = ta.slots_of(bitmap.as_py(), dense)
            assert len(at) == size
            for slot in at:
                back[pair, int(slot)] = back.get((pair, int(slot)), 0) + (1 if plane == 0 else 2 ** (plane - 1))
    assert back == {(5, 0): 1, (5, 3): 6, (5, 7): 3, (9, 2): 1}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "some text"), ("a", "some text"), (None, "some text"), ("b", None)], "doc_id string, text string")
    rows = ta.index_links(df).scores().collect()
    assert sorted((r["id"] or "", r["n_a"]) for r in rows) == [("", 2), ("a", 2), ("a", 2), ("b", 0)]
    assert {r["count_sum"] for r in rows if r["n_a"]} == {3 * rows_links for rows_links in {r["n_links"] for r in rows if r["n_a"]}}
    assert ta.index_links(df.limit(0)).scores().count() == 0


def test_text_that_is_no_utf8_has_no_tokens(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("CAST(X'61ff62' AS STRING)").alias("text"))
    assert [(r["n_a"], r["groups"]) for r in ta.index_links(df).scores().collect()] == [(0, "")]


def test_a_file_whose_ids_are_not_in_the_order_of_merges_is_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8") as f, open("/opt/tokenizers/piece_bpe_32k.model", "rb") as g:
        with pytest.raises((ValueError, KeyError)):
            ta.Aligner(f.read(), g.read())
